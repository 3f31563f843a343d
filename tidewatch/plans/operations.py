"""Queries over events and snapshots: periods, facets, retention, jobs, verification, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import calendar as C
from tidewatch.functions import numbers as N
from tidewatch.operators import jobs, merge, verify
from tidewatch.plans.tables import AS_OF, query, shared_folder, table

_AT = f"TIMESTAMP '{AS_OF}'"


def _start(unit: str) -> str:
    return f"(date_trunc('{unit}', {_AT} + INTERVAL 8 HOUR) - INTERVAL 8 HOUR)"


@query(f"""SELECT event_type, count(*) FILTER (WHERE ts >= {_start('day')}) AS today, count(*) FILTER (WHERE ts >= {_start('week')}) AS week, count(*) AS month
FROM events WHERE ts >= {_start('month')} GROUP BY event_type""")
def period_counts(spark, sf_dir):
    """The filter on the month reaches the scan; the counts within it are nested."""
    at, ts = C.instant(AS_OF), F.col("ts")
    return table(spark, sf_dir, "events").where(ts >= C.local_start(at, "MONTH")).groupBy("event_type").agg(F.count_if(ts >= C.local_start(at, "DAY")).alias("today"), F.count_if(ts >= C.local_start(at, "WEEK")).alias("week"), F.count("*").alias("month"))


@query("""WITH b AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), t AS (SELECT count(*) AS total, count(*) FILTER (WHERE value > 50) AS high, CAST(count(DISTINCT event_type) AS BIGINT) AS kinds FROM events)
SELECT total, high, CAST(floor(100.0 * high / greatest(total, 1) + 0.5) AS BIGINT) AS high_pct, kinds, (SELECT event_type FROM b ORDER BY n DESC, event_type LIMIT 1) AS top FROM t""")
def facet_stat_cards(spark, sf_dir):
    """One pass: counts per kind are combined into the cards."""
    by = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"))
    cards = by.agg(F.sum("n").alias("total"), F.sum("high").alias("high"), F.count("event_type").alias("kinds"), F.min(F.struct(F.negative("n"), "event_type")).alias("best"))
    return cards.select("total", "high", N.share(F.col("high"), F.col("total")).alias("high_pct"), "kinds", F.col("best.event_type").alias("top"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS n_chosen FROM events WHERE value >= 10 GROUP BY 1")
def facet_before_filter(spark, sf_dir):
    """Facet counts come from before the facet's own filter."""
    return table(spark, sf_dir, "events").where("value >= 10").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("n_chosen"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-03-20 12:00:00' - INTERVAL 61 DAY")
def age_window(spark, sf_dir):
    return table(spark, sf_dir, "events").where(C.within_age(F.col("ts"), C.instant("2024-03-20 12:00:00"))).select("event_id")


@query("""WITH u AS (SELECT event_id AS id, value, 1 AS version FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, value + 1, 2 FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0)
SELECT id, arg_max(value, version) AS value, max(version) AS version FROM u GROUP BY id""")
def feed_union_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    part = lambda which, add, v: e.where(which).select(F.col("event_id").alias("id"), (F.col("value") + add).alias("value"), F.lit(v).alias("version"))
    return merge.latest(part("event_id % 3 <> 0", 0, 1).unionByName(part("event_id % 2 = 0 OR event_id % 3 = 0", 1, 2)), "id", F.col("version"))


_CUT = "(CAST(date_trunc('month', TIMESTAMP '2024-02-20 00:00:00' + INTERVAL 8 HOUR) - INTERVAL 1 MONTH AS TIMESTAMP) + INTERVAL 14 DAY - INTERVAL 8 HOUR)"


def _cut():
    return C.shifted(C.retention_cutoff(C.instant("2024-02-20 00:00:00")), 14 * 24)


@query(f"SELECT count(*) AS matched, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest, (SELECT count(*) FROM events WHERE ts IS NULL) AS skipped FROM events WHERE ts < {_CUT}")
def retention_scan(spark, sf_dir):
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    old = F.col("ts") < _cut()
    return table(spark, sf_dir, "events").agg(F.count_if(old).alias("matched"), day(F.min(F.when(old, F.col("ts")))).alias("oldest"), day(F.max(F.when(old, F.col("ts")))).alias("newest"), F.count_if(F.col("ts").isNull()).alias("skipped"))


@query(f"""WITH gone AS (SELECT event_id FROM events WHERE ts < {_CUT} ORDER BY ts, event_id LIMIT 2000)
SELECT (SELECT count(*) FROM events WHERE event_id NOT IN (SELECT event_id FROM gone)) AS articles_left, (SELECT count(*) FROM events WHERE event_id % 3 = 0 AND event_id NOT IN (SELECT event_id FROM gone)) AS jobs_left, (SELECT count(*) FROM gone) AS deleted, (SELECT count(*) > 2000 FROM events WHERE ts < {_CUT}) AS remaining""")
def retention_apply(spark, sf_dir):
    """One run deletes the 2,000 oldest expired articles and what belongs to them: the cap is the feature."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts")
    gone = jobs.expired(e, _cut(), 2000)
    left = jobs.without(e, gone).agg(F.count("*").alias("articles_left"), F.count_if(F.col("id") % 3 == 0).alias("jobs_left"))
    counts = e.agg((F.count_if(F.col("ts") < _cut()) > 2000).alias("remaining"))
    return left.join(gone.agg(F.count("*").alias("deleted"))).join(counts)


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE ts > TIMESTAMP '2024-01-10' OR (ts = TIMESTAMP '2024-01-10' AND event_id > 5) ORDER BY ts, event_id LIMIT 300")
def keyset_page(spark, sf_dir):
    """A page of 300: the limit is the feature."""
    rows = jobs.page(table(spark, sf_dir, "events"), F.col("ts"), F.col("event_id"), (C.instant("2024-01-10 00:00:00"), F.lit(5)), 300)
    return rows.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


_JOBS = f"""jobs AS (SELECT event_id AS job_id, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'pending' END AS status, event_id * 37 % 101 AS priority, event_id % 4 AS attempts, 'w' || (event_id % 3) AS owner,
 CASE WHEN event_id % 5 <> 0 THEN ts + INTERVAL 20 DAY END AS lease_until, CASE WHEN event_id % 7 <> 0 THEN ts + INTERVAL 15 DAY END AS next_at, CAST(event_id AS VARCHAR) AS id, md5(CAST(event_id % 10 AS VARCHAR)) AS h, CASE WHEN event_id % 8 < 3 THEN 'error ' || event_id END AS last_error FROM events)"""


def _jobs(spark, sf_dir):
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        n.alias("job_id"), F.when(n % 4 == 1, "processing").when(n % 4 == 2, "completed").otherwise("pending").alias("status"), (n * 37 % 101).alias("priority"), (n % 4).alias("attempts"), F.concat(F.lit("w"), n % 3).alias("owner"),
        F.when(n % 5 != 0, C.shifted(F.col("ts"), 480)).alias("lease_until"), F.when(n % 7 != 0, C.shifted(F.col("ts"), 360)).alias("next_at"), n.cast("string").alias("id"), F.md5((n % 10).cast("string")).alias("h"), F.when(n % 8 < 3, F.concat(F.lit("error "), n)).alias("last_error"),
    )


@query(f"WITH {_JOBS} SELECT job_id, priority, attempts + 1 AS attempts, 'me' AS owner, 'processing' AS status, '2024-01-31 00:10:00' AS lease FROM jobs WHERE status = 'pending' AND (next_at IS NULL OR next_at <= {_AT}) ORDER BY priority DESC, job_id LIMIT 100")
def job_claim(spark, sf_dir):
    """A worker takes 100 jobs: the limit is the feature."""
    done = jobs.claim(_jobs(spark, sf_dir), C.instant(AS_OF), "me", 100)
    return done.select("job_id", "priority", "attempts", "owner", "status", F.date_format("lease_until", "yyyy-MM-dd HH:mm:ss").alias("lease"))


@query(f"WITH {_JOBS}, r AS (SELECT *, status = 'processing' AND (lease_until IS NULL OR lease_until <= {_AT}) AS recovered FROM jobs) SELECT job_id, CASE WHEN recovered THEN 'pending' ELSE status END AS status, CASE WHEN NOT recovered THEN owner END AS owner, CASE WHEN recovered THEN 'broke off' ELSE last_error END AS last_error, recovered FROM r")
def job_recover(spark, sf_dir):
    return jobs.recover(_jobs(spark, sf_dir), C.instant(AS_OF), "broke off").select("job_id", "status", "owner", "last_error", "recovered")


@query(f"WITH {_JOBS}, r AS (SELECT *, status = 'processing' AND owner = 'w1' AS own FROM jobs) SELECT job_id, CASE WHEN own AND attempts >= 3 THEN 'failed' WHEN own THEN 'pending' ELSE status END AS status, strftime(CASE WHEN own AND attempts >= 3 THEN NULL WHEN own THEN {_AT} + to_minutes(greatest(attempts, 1)) ELSE next_at END, '%Y-%m-%d %H:%M:%S') AS next_at, CASE WHEN NOT own THEN owner END AS owner, own OR lease_until IS NULL AS unleased, CASE WHEN own THEN left(trim('Timeout: job ' || job_id || ' ' || repeat('x', CAST(job_id % 300 AS BIGINT))), 240) ELSE last_error END AS last_error FROM r")
def job_fail(spark, sf_dir):
    error = F.concat(F.lit("Timeout:\n  job "), "job_id", F.lit("\t"), F.repeat(F.lit("x"), (F.col("job_id") % 300).cast("int")))
    done = jobs.fail(_jobs(spark, sf_dir), C.instant(AS_OF), "w1", error)
    return done.select("job_id", "status", F.date_format("next_at", "yyyy-MM-dd HH:mm:ss").alias("next_at"), "owner", F.col("lease_until").isNull().alias("unleased"), "last_error")


@query(f"WITH {_JOBS} SELECT job_id, CASE WHEN job_id % 6 = 0 THEN 'failed' WHEN job_id % 5 = 0 AND job_id % 10 < 6 THEN 'complete' ELSE 'analyse' END AS outcome FROM jobs")
def job_join_existing(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    articles = j.where("job_id % 6 <> 0").select("id")
    insights = j.where("job_id % 5 = 0").select("id", F.when(F.col("job_id") % 10 < 6, F.col("h")).otherwise("old").alias("h"))
    return jobs.outcome(j, articles, insights).select("job_id", "outcome")


@query("SELECT o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS eligible, count(*) AS n_rows FROM (SELECT l_orderkey AS o_orderkey FROM lineitem) GROUP BY 1")
def related_semi_anti(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return verify.related(items, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_orderkey").groupBy("eligible").agg(F.count("*").alias("n_rows"))


@query("SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'differs' ELSE 'match' END AS verdict, count(*) AS n_rows FROM orders GROUP BY 1 UNION ALL SELECT 'extra', count(*) FROM orders WHERE o_orderkey % 11 = 0 HAVING count(*) > 0")
def snapshot_verify(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    copy = o.where("o_orderkey % 13 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    extra = o.where("o_orderkey % 11 = 0").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return verify.compared(o, copy.unionByName(extra), "o_orderkey").groupBy("verdict").agg(F.count("*").alias("n_rows"))


@query("""SELECT 'orders' AS collection, CASE WHEN o_orderstatus = 'F' THEN 'eligible' ELSE 'excluded' END AS class, count(*) AS n_rows FROM orders GROUP BY 2 UNION ALL SELECT 'customer', 'eligible', count(*) FROM customer
UNION ALL SELECT 'names', CASE WHEN starts_with(n_name, 'A') THEN 'exclude' WHEN n_name IN ('BRAZIL', 'CHINA') THEN 'preserve' ELSE 'unclassified' END, count(*) FROM nation GROUP BY 2""")
def copy_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.lit("orders").alias("collection"), F.when(F.col("o_orderstatus") == "F", "eligible").otherwise("excluded").alias("class"))
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("collection"), F.lit("eligible").alias("class"))
    n = table(spark, sf_dir, "nation").select(F.lit("names").alias("collection"), verify.meta_class(F.col("n_name"), ("A",), ("BRAZIL", "CHINA")).alias("class"))
    return o.unionByName(c).unionByName(n).groupBy("collection", "class").agg(F.count("*").alias("n_rows"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, greatest(0, least(100, CAST(json_extract(props, '$.k') AS BIGINT) * 3 - 20)) AS score, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS kind FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_validate(spark, sf_dir):
    """Model output as JSON text: required field, clamped score, enumerated kind."""
    e = table(spark, sf_dir, "events").withColumn("j", F.from_json("props", "k long"))
    return e.where("j.k IS NOT NULL").select("event_id", F.col("j.k").alias("k"), F.greatest(F.lit(0), F.least(F.lit(100), F.col("j.k") * 3 - 20)).alias("score"), F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("other").alias("kind"))


@query("""WITH r AS (SELECT o_orderkey AS ordinal, CAST(o_custkey % 40 AS VARCHAR) AS code, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus AS summary, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'api' END AS source, o_orderkey % 2 AS late FROM orders),
old AS (SELECT * FROM r WHERE ordinal % 2 = 0 AND source IS NOT NULL), new AS (SELECT *, row_number() OVER (PARTITION BY code, day, summary ORDER BY ordinal) AS n FROM r WHERE ordinal % 2 = 1 AND (code, day, summary) NOT IN (SELECT code, day, summary FROM old))
SELECT ordinal, code, day, summary FROM (SELECT ordinal, code, day, summary, late FROM old UNION ALL SELECT ordinal, code, day, summary, late FROM new WHERE n = 1) ORDER BY day DESC, late, ordinal LIMIT 500""")
def notice_merge(spark, sf_dir):
    """Known notices stay, unseen ones follow, the newest 500 remain: the cap is the feature."""
    r = _records(spark, sf_dir)
    done = merge.append_records(*_notices(r), 500)
    return done.select("ordinal", "code", "day", "summary")


def _records(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), (F.col("o_custkey") % 40).cast("string").alias("code"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderstatus").alias("summary"), F.when(F.col("o_orderkey") % 9 != 0, "api").alias("source"))


def _notices(r):
    keys = [F.col("code"), F.col("day"), F.left("summary", F.lit(30))]
    return r.where("ordinal % 2 = 0"), r.where("ordinal % 2 = 1"), keys, F.col("source").isNotNull()


@query("""WITH o AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 9 = 0) AS purged FROM orders WHERE o_orderkey % 2 = 0),
r AS (SELECT o_orderkey AS ordinal, CAST(o_custkey % 40 AS VARCHAR) AS code, strftime(o_orderdate, '%Y-%m-%d') AS day, left(o_orderstatus, 30) AS summary FROM orders), old AS (SELECT * FROM r WHERE ordinal % 2 = 0 AND ordinal % 9 <> 0),
new AS (SELECT count(DISTINCT (code, day, summary)) AS added FROM r WHERE ordinal % 2 = 1 AND (code, day, summary) NOT IN (SELECT code, day, summary FROM old))
SELECT n AS n_before, n - purged + added AS n_after, added, purged, added > 0 OR purged > 0 OR n - purged + added <> n AS changed FROM o, new""")
def notice_changes(spark, sf_dir):
    """Whether a merge of notices has anything to write."""
    old, new, keys, source = _notices(_records(spark, sf_dir))
    return merge.records_changed(old, merge.append_records(old, new, keys, source, 1 << 30), source)


@query("""SELECT 's' AS kind, s_suppkey AS id, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_3')
UNION ALL SELECT 'c', c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_3')""")
def source_union(spark, sf_dir):
    """Two market-wide sources narrowed to tracked codes; the optimizer chooses how to join."""
    tracked = table(spark, sf_dir, "nation").where(F.col("n_name").isin("NATION_1", "NATION_2", "NATION_3")).select("n_nationkey")
    s = table(spark, sf_dir, "supplier").join(tracked, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").join(tracked, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return s.unionByName(c)


_LITERALS = ("1120309", "112/03/09", "20230309", "2023-03-09", "", "no day", "2023-3-9", "112/3/9", "112.03.09", "2023.03.09", " 112-3-9 ", "2023/03", "1/2/3/4", "2023-xx-01", "112030", "no 1120309")
_WANTED = ("2023-03-09", "2023-03-09", "2023-03-09", "2023-03-09", "", "", "2023-03-09", "2023-03-09", "2023-03-09", "2023-03-09", "2023-03-09", "", "", "", "", "2023-03-09")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in zip(_LITERALS, _WANTED, strict=True)) + f") v(text, day) UNION ALL SELECT DISTINCT strftime(ts, '%Y%m%d'), strftime(ts, '%Y-%m-%d') FROM events WHERE ts > {_AT} - INTERVAL 96 HOUR")
def calendar_pack(spark, sf_dir):
    inline = spark.createDataFrame([(x,) for x in _LITERALS], "text string")
    days = table(spark, sf_dir, "events").where(F.col("ts") > jobs.hours_back(C.instant(AS_OF))).select(F.date_format("ts", "yyyyMMdd").alias("text")).distinct()
    return inline.unionByName(days).select("text", C.iso_day(F.col("text")).alias("day"))


@query("SELECT event_id % 1000 AS id, max(event_id) AS version, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def stream_upsert(spark, sf_dir):
    """Events as a change feed, upserted by micro-batches; the table of latest versions when the feed has been read."""
    import uuid

    from tidewatch.sources import sinks
    from tidewatch.streaming import upsert

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 1000).alias("id"), F.col("event_id").alias("version"), "value")
    rows.repartition(3).write.parquet(f"{base}/in")
    upsert.keep_latest(upsert.feed(spark, f"{base}/in", "id long, version long, value double", 2), f"{base}/table", "id", "version", f"{base}/checkpoint").awaitTermination()
    return sinks.current(spark, f"{base}/table").select("id", "version", "value")


@query("SELECT DISTINCT user_id % 97 AS story FROM events")
def stream_first_seen(spark, sf_dir):
    """Stories of a feed that is read in one batch: each once."""
    import uuid

    from tidewatch.streaming import upsert

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").select((F.col("user_id") % 97).alias("story"), F.col("ts").cast("timestamp").alias("ts")).repartition(3).write.parquet(f"{base}/in")
    seen = upsert.first_seen(upsert.feed(spark, f"{base}/in", "story long, ts timestamp", 1000), "story", "ts", "10000 hours").select("story")
    seen.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("story long").parquet(f"{base}/out")
