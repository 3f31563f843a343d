"""A change feed kept as a table of the latest version per key, and stories seen once within a bound on lateness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.merge import latest
from tidewatch.sources import sinks


def feed(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def keep_latest(changes: DataFrame, root: str, key: str, version: str, checkpoint: str):
    """Upsert each micro-batch into the table under root, by parts, so that a batch rewrites what it touches alone. A batch that is run again merges to the same table; what leaves the feed stays."""

    def write(batch: DataFrame, _: int) -> None:
        def newest(now: DataFrame | None, rows: DataFrame) -> DataFrame:
            both = rows if now is None else now.unionByName(rows)
            return latest(both, key, F.col(version), *(F.col(c) for c in both.columns if c not in (key, version)))

        sinks.upsert_parts(batch, root, key, newest)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stories: DataFrame, key: str, ts: str, lateness: str = "96 hours") -> DataFrame:
    """Each story once; state is dropped when its time falls behind the watermark."""
    return stories.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])
