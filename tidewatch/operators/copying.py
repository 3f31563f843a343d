"""Copies of tables: a gate that fails closed, verdicts on reports, and a resumable copy."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.sources import sinks

REPORT = "collection string, status string, n_rows long"
PAGES = "collection string, page int, status string, n_rows long"


def blocking(found: DataFrame, name: str, known: tuple[str, ...]) -> DataFrame:
    """Collections that nobody knows; an unreadable (null) name blocks as well."""
    return found.where(F.col(name).isNull() | ~F.col(name).isin(*known))


def gate(found: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Findings (collection, class, children) in counts, and whether they block: unknown collections, unclassified names, and children that exist or couldn't be checked (null)."""
    unknown = F.col("collection").isNull() | ~F.col("collection").isin(*known)
    counts = found.agg(
        F.count_if(unknown).alias("unknown"), F.count_if(F.coalesce(F.col("class"), F.lit("unclassified")) == "unclassified").alias("unclassified"), F.count_if(F.col("children") > 0).alias("with_children"), F.count_if(F.col("children").isNull()).alias("unverifiable")
    )
    return counts.withColumn("blocked", (F.col("unknown") > 0) | (F.col("unclassified") > 0) | (F.col("with_children") > 0) | (F.col("unverifiable") > 0))


def copy_failed(report: DataFrame) -> DataFrame:
    """One row: whether any collection of a copy failed or was halted."""
    return report.agg(F.coalesce(F.bool_or(F.col("status").isin("failed", "halted")), F.lit(False)).alias("failed"))


def verify_failed(report: DataFrame) -> DataFrame:
    """One row: whether a comparison (verdict) found anything but matches."""
    return report.agg(F.coalesce(F.bool_or(F.col("verdict") != "match"), F.lit(False)).alias("failed"))


def fingerprint(**parameters: object) -> str:
    """What a copy depends on, as a key; another one starts afresh."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]


def copy(spark: SparkSession, tables: Iterable[tuple[str, DataFrame]], root: str, key: str) -> DataFrame:
    """Copy tables below root/key, each in one commit, and report on each.

    A table that was copied whole under the same key is skipped, so a copy can be resumed; under another key
    nothing counts as done. A failure halts its own table and leaves no part of it; the others go on.
    """
    done = []
    for name, df in tables:
        path = f"{root}/{key}/{name}"
        try:
            status = "skipped" if sinks.exists(spark, f"{path}/_SUCCESS") else "copied"
            if status == "copied":
                df.write.mode("overwrite").parquet(path)
            done.append((name, status, spark.read.parquet(path).count()))
        except Exception as e:  # noqa: BLE001  whatever went wrong, the report says so and the gate acts on it
            done.append((name, "failed", None))
            print(f"copy of {name} failed: {e}")
    return spark.createDataFrame(done, REPORT)


#: Pages that one job copies: so many times those of the job before it.
PAGE_GROWTH = 4


def page_starts(rows: DataFrame, key: str, n: int, folder: str) -> DataFrame:
    """The keys that open each page of n rows in the order of unique keys: page, start. Ranges of keys, written to folder so that they stay as they are, are sorted apart, and their sizes, one number each, place them."""
    rows.select(key).repartitionByRange(key).withColumn("__range", F.spark_partition_id()).write.mode("overwrite").parquet(folder)
    ranged = rows.sparkSession.read.parquet(folder)
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1).join(F.broadcast(sizes.withColumn("__before", before).drop("__n")), "__range")
    at = F.col("__at") + F.col("__before")
    return placed.where(at % n == 0).select((at / n).cast("int").alias("page"), F.col(key).alias("start"))


def page_counts(keys: DataFrame, key: str, starts: DataFrame, folder: str) -> DataFrame:
    """How many keys each page of starts (page, start) holds: page, n_rows. Keys and starts are sorted by ranges together; a key belongs to the last start before it, in its own range or an earlier one. Counts by range are written to folder, so that all that follows sees the same ranges."""
    both = keys.select(F.col(key).alias("__key"), F.lit(None).cast("int").alias("__page")).unionByName(starts.select(F.col("start").alias("__key"), F.col("page").alias("__page")))
    ranged = both.repartitionByRange("__key").withColumn("__range", F.spark_partition_id())
    upto = Window.partitionBy("__range").orderBy("__key", F.desc_nulls_last("__page")).rowsBetween(Window.unboundedPreceding, 0)
    counted = ranged.withColumn("page", F.max("__page").over(upto)).groupBy("__range", "page").agg(F.count_if(F.col("__page").isNull()).alias("n"), F.max("__page").alias("last"))
    counted.write.parquet(folder)
    runs = keys.sparkSession.read.schema(counted.schema).parquet(folder)
    # What stands before a range's first start belongs to the last one of the ranges before: one row for each of them.
    opened = runs.where("page IS NULL").select("__range", "n")
    lasts = runs.groupBy("__range").agg(F.max("last").alias("last"))
    carried = lasts.withColumn("page", F.max("last").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))).join(opened, "__range").select("page", "n")
    return runs.where("page IS NOT NULL").select("page", "n").unionByName(carried).groupBy("page").agg(F.sum("n").alias("n_rows"))


def _done(spark: SparkSession, base: str) -> list[tuple[int, int]]:
    """The runs of pages that were copied whole, in order: first page, and the page after the last."""
    if not sinks.exists(spark, f"{base}/done"):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/done")
    names = (f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))
    return sorted(tuple(map(int, n.split("-"))) for n in names if n[0].isdigit())


def copy_pages(spark: SparkSession, name: str, rows: DataFrame, root: str, run: str, key: str, n: int) -> DataFrame:
    """Copy a collection below root/run/name by pages of n rows in the order of its unique, non-null key; reports on each page.

    Where pages begin is decided once per run and stored; the pages that were written whole are the cursor's place and are
    skipped when the copy is run again. The first page that fails halts the collection: of pages after it nothing is kept,
    and they are copied by a later call. Another run starts afresh.

    One job copies many pages, PAGE_GROWTH times as many as the job before it, into the folder page=<the first of them>,
    which counts once done/<first>-<after the last> stands. Pages of a job that fails are taken up again by halves, until
    the one that fails is alone: so jobs grow with the logarithm of the number of pages.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    base = f"{root}/{run}/{name}"
    if not sinks.exists(spark, f"{base}/starts/_SUCCESS"):
        page_starts(rows, key, n, f"{base}/keys").write.mode("overwrite").parquet(f"{base}/starts")
    starts = spark.read.schema(f"page int, start {rows.schema[key].dataType.simpleString()}").parquet(f"{base}/starts")
    total, done = starts.count(), _done(spark, base)
    before = at = done[-1][1] if done else 0
    size, bad, failed = 1, None, False
    while at < total and not failed:
        upto = min(at + size, bad or total)
        bounds = {r.page: r.start for r in starts.where(F.col("page").isin(at, upto)).collect()}
        own = rows.where(F.col(key) >= F.lit(bounds[at]))
        own = own if upto == total else own.where(F.col(key) < F.lit(bounds[upto]))
        try:
            own.write.mode("overwrite").parquet(f"{base}/page={at}")
        except Exception as e:  # noqa: BLE001  whatever went wrong, the report says so and what follows waits
            print(f"pages {at} to {upto - 1} of {name} failed: {str(e)[:200]}")
            failed, bad, size = upto - at == 1, upto, (upto - at) // 2
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/done/{at}-{upto}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True).close()
        done.append((at, upto))
        at = upto
        if bad is None:
            size *= PAGE_GROWTH
        elif at < bad:
            size = max(1, (bad - at) // 2)
        else:  # what had failed went well now
            bad, size = None, 1
    status = F.when(F.col("page") < before, "skipped").when(F.col("page") < at, "copied").when((F.col("page") == at) & F.lit(failed), "failed").otherwise("halted")
    report = starts.select(F.lit(name).alias("collection"), "page", status.alias("status"))
    if done:
        held = spark.read.schema(rows.schema).parquet(*(f"{base}/page={first}" for first, _ in done))
        report = report.join(page_counts(held, key, starts.where(F.col("page") < at), f"{base}/counts/{uuid.uuid4().hex}"), "page", "left").select("collection", "page", "status", F.when(F.col("page") < at, F.coalesce("n_rows", F.lit(0))).alias("n_rows"))
    else:
        report = report.withColumn("n_rows", F.lit(None).cast("long"))
    place = f"{base}/reports/{uuid.uuid4().hex}"
    report.write.parquet(place)
    return spark.read.schema(PAGES).parquet(place)
