"""Articles laid out for pruning: by local month and category, in order of time, with statistics and Bloom filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import calendar as C


def local_month(ts: Column, offset: int = C.OFFSET_HOURS) -> Column:
    return F.date_format(C.shifted(ts, offset), "yyyy-MM")


def write_by_month(rows: DataFrame, path: str, ts: str = "pub", cat: str = "cat", key: str = "id", files: int | None = None, block_bytes: int = 32 << 20) -> None:
    """Write rows below path by local month and category, in order of time.

    Tasks take ranges of month, category and time of about the same size, so a month and category of any size is
    shared between tasks, and small ones share a task; with `files`, each month and category goes to that many tasks, by
    days. Within a file rows go by time, so row groups have narrow ranges; a Bloom filter on the key skips row groups in
    point lookups. Rows without a time come under the default partition, which no window reads.
    """
    placed = rows.withColumn("month", local_month(F.col(ts))).withColumn("category", F.col(cat))
    if files is None:
        spread = placed.repartitionByRange("month", "category", ts, key)
    else:
        slot = F.pmod(F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / 86_400), F.lit(files)) if files > 1 else F.lit(0)
        spread = placed.repartition("month", "category", slot)
    spread = spread.sortWithinPartitions("month", "category", ts)
    spread.write.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.block.size", block_bytes).partitionBy("month", "category").parquet(path)


def _pruned(spark: SparkSession, path: str, since: str | None, cats: Sequence[str] | None, offset: int) -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(path)
    if since is not None:
        month = C.instant(since)
        rows = rows.where(F.col("month").cast("string") >= local_month(month, offset))
    if cats is not None:
        rows = rows.where(F.col("category").isin(*cats))
    return rows


def window(spark: SparkSession, path: str, ts: str = "pub", since: str | None = None, cats: Sequence[str] | None = None, offset: int = C.OFFSET_HOURS) -> DataFrame:
    """Rows from an instant on, of some categories; only folders that can hold any are read, and of their files only row groups that can."""
    rows = _pruned(spark, path, since, cats, offset)
    return (rows if since is None else rows.where(F.col(ts) >= C.instant(since))).drop("month", "category")


def scanned(spark: SparkSession, path: str, ts: str = "pub", since: str | None = None, cats: Sequence[str] | None = None, offset: int = C.OFFSET_HOURS) -> dict[str, int]:
    """What `window` reads at most, measured by running it: rows and bytes of the files that it opens, and rows that it returns.

    The observer stands behind the choice of folders and before the filter on time, so it counts whole files; the
    filter, which here can't pass it, skips row groups besides.
    """
    seen = Observation("scanned")
    rows = _pruned(spark, path, since, cats, offset).observe(seen, F.count(F.lit(1)).alias("n"))
    kept = rows if since is None else rows.where(F.col(ts) >= C.instant(since))
    returned = kept.agg(F.count(ts)).first()[0]
    files = _pruned(spark, path, since, cats, offset).select("_metadata.file_path", "_metadata.file_size").distinct()
    size = files.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]
    return {"rows": seen.get["n"], "bytes": size, "returned": returned}
