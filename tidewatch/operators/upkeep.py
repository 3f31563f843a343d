"""Writes of the article store: incremental saves, and retention with its cascade. Tables are kept by parts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import jobs, merge
from tidewatch.sources.parted import PartedTable
from tidewatch.sources.sinks import merged


@dataclass(frozen=True)
class Store:
    """Articles, jobs, insights and the index of hashes (id, h, t), all by id."""

    spark: SparkSession
    root: str
    parts: int = 16

    def table(self, name: str) -> PartedTable:
        return PartedTable(self.spark, f"{self.root}/{name}", "id")


def save(store: Store, incoming: DataFrame, own_hash: Column, today: str, to_jobs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Write the articles that are new or changed, then their jobs, then the index; one row of counts per action.

    An article whose hash the index knows is not touched. A failed read of the index ends the save before
    anything is written. The order makes a save that broke off harmless: what isn't in the index yet is
    written again, to the same rows. Rows of one id count one by one and the last of them by `ordinal`, then hash, is kept. Parts
    without a changed row are neither read nor written.
    """
    index = store.table("index")
    known = index.read() if index.version() is not None else None
    keys = ["id", "ordinal", "h"]
    entry = incoming.withColumn("h", own_hash).select(keys)
    # Decided on ids and hashes alone; whole articles are read once more, and only those that are written move.
    acted = merge.changes(entry, known.select("id", "h") if known is not None else entry.select("id", "h").limit(0)).persist()
    fresh = None
    try:
        counts = acted.groupBy("action").agg(F.count("*").alias("n_rows")).persist()
        n = {r.action: r.n_rows for r in counts.collect()}  # decided before the index changes
        if known is not None and not n.keys() - {"skipped"}:
            return counts
        fresh = merge.latest(acted.where("action <> 'skipped'").drop("action"), "id", F.col("ordinal"), F.col("h")).persist()
        n_fresh = fresh.count()
        rows = incoming.withColumn("h", own_hash)
        if n_fresh < sum(n.values()):
            same = [F.col(f"i.{c}").eqNullSafe(F.col(f"f.{c}")) for c in keys]
            rows = rows.alias("i").join(fresh.alias("f"), same[0] & same[1] & same[2], "left_semi")
            if not acted.where("action <> 'skipped'").groupBy(keys).count().where("count > 1").isEmpty():
                rows = merge.latest(rows, "id", F.col("ordinal"))  # rows alike in id, ordinal and hash: any one of them
        over = lambda now, rows: merged(now, rows, "id")
        store.table("articles").merge(rows.drop("h"), over, store.parts, keys=fresh)
        store.table("jobs").merge(to_jobs(rows), over, store.parts, keys=fresh)
        index.merge(fresh.select("id", "h", F.lit(today).alias("t")), over, store.parts)
        return counts
    finally:
        acted.unpersist()
        if fresh is not None:
            fresh.unpersist()


def retain(store: Store, cutoff: Column, cap: int, related: Sequence[str] = ("jobs", "insights")) -> tuple[DataFrame, dict[str, list[int]], bool]:
    """Delete the oldest articles before the cutoff, at most cap, and what belongs to them.

    Returns the articles' ids and dates, for each table the parts that were rewritten, and whether expired
    articles remain. Articles without a date stay. Related rows go first and articles last, so a run that broke off
    is finished by the next. What is written are the parts that hold a deleted row.
    """
    articles = store.table("articles")
    at = articles.version()
    rows = articles.read(at=at)
    if rows is None:
        return store.spark.createDataFrame([], "id string, ts timestamp_ntz"), {}, False
    dated = rows.select("id", F.col("pub").alias("ts"))
    gone = jobs.expired(dated, cutoff, cap).persist()
    try:
        n = gone.count()
        parts = {name: store.table(name).delete(gone) for name in related}
        parts["articles"] = articles.delete(gone, at)
        # More than the cap can be left only if the cap was reached; then one row decides.
        remaining = n == cap and not articles.read().where(F.col("pub") < cutoff).limit(1).isEmpty()
        return store.spark.createDataFrame(gone.collect(), gone.schema), parts, remaining
    finally:
        gone.unpersist()
