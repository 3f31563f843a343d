"""Sinks: upserts into tables by parts, snapshots, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.parted import PartedTable


def merged(current: DataFrame | None, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming fields over current ones; a null field doesn't overwrite. Keys of the input must be unique."""
    if current is None:
        return incoming
    columns = list(dict.fromkeys([*current.columns, *incoming.columns]))
    a, b = current.alias("a"), incoming.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    pick = lambda c: F.coalesce(*(F.col(f"{s}.{c}") for s, df in (("b", incoming), ("a", current)) if c in df.columns)).alias(c)
    return joined.select(*map(pick, columns))


def exists(spark: SparkSession, place: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def current(spark: SparkSession, root: str, key: str = "") -> DataFrame | None:
    """The last version that was written to its end."""
    return PartedTable(spark, root, key).read()


def upsert(incoming: DataFrame, root: str, key: str, parts: int = 16) -> list[int]:
    """Merge fields into the table under root, rewriting the parts that the keys fall into; says which. A failed write leaves the last version."""
    return PartedTable(incoming.sparkSession, root, key).merge(incoming, lambda now, rows: merged(now, rows, key), parts)


def upsert_parts(incoming: DataFrame, root: str, key: str, merge, parts: int = 16) -> list[int]:
    """As upsert, with merge(current rows or None, new rows) for what stays. The writer is the only one: old versions but the last, which a reader may hold, are deleted."""
    rows = incoming.persist()
    try:
        held = PartedTable(incoming.sparkSession, root, key)
        touched = held.merge(rows, merge, parts)
        held.drop_old(2)
        return touched
    finally:
        rows.unpersist()


def snapshot(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_if_changed(df: DataFrame, changed: DataFrame, path: str) -> bool:
    """Write only if there are changes; says whether it wrote."""
    if changed.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def export_csv(df: DataFrame, path: str, names: dict[str, str]) -> None:
    df.select(*(F.col(c).alias(n) for c, n in names.items())).write.mode("overwrite").option("header", True).csv(path)


def once(spark: SparkSession, marker: str, apply) -> bool:
    """Run apply() unless the marker stands; the marker is written after it succeeded."""
    path = spark._jvm.org.apache.hadoop.fs.Path(marker)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        return False
    apply()
    fs.create(path, True).close()
    return True
