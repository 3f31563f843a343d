"""Queries that write tables and read them back: incremental saves, retention, layouts for pruning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.functions import calendar as C
from tidewatch.functions import text as T
from tidewatch.operators import upkeep
from tidewatch.plans.tables import NEWS, news, query, shared_folder
from tidewatch.sources import layout


def _store(spark, parts: int) -> upkeep.Store:
    return upkeep.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", parts)


def _part_sql(parts: int) -> str:
    return f"CAST('0x' || left(md5(id), 8) AS BIGINT) % {parts}"


def _hash():
    return T.content_hash(F.col("title"), F.col("content"), F.col("link"))


def _to_jobs(rows):
    return rows.select("id", F.col("h").alias("content_hash"), F.lit("pending").alias("status"))


@query(f"""WITH {NEWS}, changed AS (SELECT *, {_part_sql(64)} AS part FROM news WHERE ordinal % 100 = 7 OR ordinal % 250 = 3), n AS (SELECT count(*) AS every, count(*) FILTER (ordinal % 250 <> 3) AS stored FROM news),
c AS (SELECT count(*) FILTER (ordinal % 250 <> 3) AS updated, count(*) FILTER (ordinal % 250 = 3) AS added, count(DISTINCT part) AS parts FROM changed)
SELECT run, added, updated, skipped, articles, jobs, entries, parts FROM (
  SELECT 1 AS run, stored AS added, 0 AS updated, 0 AS skipped, stored AS articles, stored AS jobs, stored AS entries, (SELECT count(DISTINCT {_part_sql(64)}) FROM news WHERE ordinal % 250 <> 3) AS parts FROM n
  UNION ALL SELECT 2, 0, 0, stored, stored, stored, stored, 0 FROM n
  UNION ALL SELECT 3, added, updated, every - added - updated, every, every, every, parts FROM n, c)""")
def save_articles(spark, sf_dir):
    """Three saves: all but a few articles, the same again, and one in which about one in a hundred is new or changed: counts, what the tables hold, and the parts of 64 that were written."""
    store, n = _store(spark, 64), news(spark, sf_dir)
    first = n.where("ordinal % 250 <> 3")
    later = n.withColumn("title", F.when(F.col("ordinal") % 100 == 7, F.concat("title", F.lit(" (changed)"))).otherwise(F.col("title")))
    out = []
    for run, (rows, day) in enumerate(((first, "20240101"), (first, "20240102"), (later, "20240103")), 1):
        before = store.table("articles").version()
        counts = {r.action: r.n_rows for r in upkeep.save(store, rows, _hash(), day, _to_jobs).collect()}
        after = store.table("articles").version()
        written = sum(after.folders[p] != (before.folders.get(p) if before else None) for p in after.folders)
        held = [store.table(t).read().count() for t in ("articles", "jobs", "index")]
        out.append((run, *(counts.get(a, 0) for a in ("added", "updated", "skipped")), *held, written))
    return spark.createDataFrame(out, "run int, added long, updated long, skipped long, articles long, jobs long, entries long, parts long")


_EXPIRED = "pub < TIMESTAMP '2023-11-30 16:00:00'"


@query(f"""WITH {NEWS}, gone AS (SELECT id, ordinal, {_part_sql(128)} AS part FROM news WHERE {_EXPIRED} ORDER BY pub, id LIMIT 20)
SELECT 'articles' AS name, (SELECT count(*) FROM news) - count(*) AS n_left, count(*) AS deleted, count(DISTINCT part) AS parts, (SELECT count(*) > 20 FROM news WHERE {_EXPIRED}) AS remaining FROM gone
UNION ALL SELECT 'jobs', (SELECT count(*) FROM news WHERE ordinal % 2 = 0) - count(*) FILTER (ordinal % 2 = 0), count(*) FILTER (ordinal % 2 = 0), count(DISTINCT part) FILTER (ordinal % 2 = 0), (SELECT count(*) > 20 FROM news WHERE {_EXPIRED}) FROM gone
UNION ALL SELECT 'insights', (SELECT count(*) FROM news WHERE ordinal % 3 = 0) - count(*) FILTER (ordinal % 3 = 0), count(*) FILTER (ordinal % 3 = 0), count(DISTINCT part) FILTER (ordinal % 3 = 0), (SELECT count(*) > 20 FROM news WHERE {_EXPIRED}) FROM gone""")
def retention_delete(spark, sf_dir):
    """A run that deletes the 20 oldest expired articles with their jobs and insights: the cap is the feature. What is left in each table, and how many of its 128 parts were written."""
    store, n = _store(spark, 128), news(spark, sf_dir)
    kinds = {"articles": n.select("id", "title", "content", "pub"), "jobs": n.where("ordinal % 2 = 0").select("id", F.lit("pending").alias("status")), "insights": n.where("ordinal % 3 = 0").select("id", F.left("content", F.lit(300)).alias("summary"))}
    before = {}
    for name, rows in kinds.items():
        store.table(name).create(rows, 128)
        before[name] = store.table(name).read().count()
    _, parts, remaining = upkeep.retain(store, C.instant("2023-11-30 16:00:00"), 20)
    left = {name: store.table(name).read().count() for name in kinds}
    return spark.createDataFrame([(name, left[name], before[name] - left[name], len(parts[name]), remaining) for name in kinds], "name string, n_left long, deleted long, parts long, remaining boolean")


_SINCE = "2024-01-10 16:00:00"
_MONTH = "strftime(pub + INTERVAL 8 HOUR, '%Y-%m')"


@query(f"""WITH {NEWS}, n AS (SELECT *, {_MONTH} >= '2024-01' AS recent, pub >= TIMESTAMP '{_SINCE}' AS wanted FROM news), t AS (SELECT count(*) AS n FROM news)
SELECT 'all' AS asked, t.n AS n_rows, t.n AS scanned, t.n AS returned, false AS fewer_bytes FROM t UNION ALL SELECT 'category', t.n, count(*), count(*), true FROM n, t WHERE cat = 'en' GROUP BY t.n
UNION ALL SELECT 'month', t.n, count(*), count(*) FILTER (wanted), true FROM n, t WHERE recent GROUP BY t.n UNION ALL SELECT 'category and month', t.n, count(*), count(*) FILTER (wanted), true FROM n, t WHERE recent AND cat = 'en' GROUP BY t.n
UNION ALL SELECT 'two categories and month', t.n, count(*), count(*) FILTER (wanted), true FROM n, t WHERE recent AND cat IN ('en', 'fr') GROUP BY t.n""")
def pruned_reads(spark, sf_dir):
    """Articles laid out by local month and category: for each predicate, the rows of all files, those of the files that were read, and those that were returned."""
    path = f"{shared_folder(spark)}/layout-{uuid.uuid4().hex}"
    layout.write_by_month(news(spark, sf_dir), path)
    asked = {"all": (None, None), "category": (None, ["en"]), "month": (_SINCE, None), "category and month": (_SINCE, ["en"]), "two categories and month": (_SINCE, ["en", "fr"])}
    found = {name: layout.scanned(spark, path, "pub", since, cats) for name, (since, cats) in asked.items()}
    every = found["all"]
    return spark.createDataFrame([(name, every["rows"], f["rows"], f["returned"], f["bytes"] < every["bytes"]) for name, f in found.items()], "asked string, n_rows long, scanned long, returned long, fewer_bytes boolean")
