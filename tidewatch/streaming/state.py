"""Streams with bounded state: the newest entries of an index, rows behind a moving watermark, counts by the clock."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.functions import calendar as C

ENTRIES = "ids array<string>, hashes array<string>, days array<string>, cutoff string"


def keep_newest(entries: DataFrame, days: int = 90, cap: int = 6000) -> DataFrame:
    """An index stream (shard, id, h, t as yyyymmdd, version) into bounded state; emits what each batch changed by shard.

    State holds, per shard, the last entry (h, t) of each id: those of the last `days` days before the shard's newest
    day, at most `cap` of them, the newest, of one day the least ids. A shard that gets no rows for as many days of
    processing time is dropped as a whole. One task holds one shard, which `cap` bounds.
    With the trigger availableNow the session must have empty batches switched off, which time-outs would ask for forever.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ids, hashes, ts, cutoff = state.get if state.exists else ([], [], [], "")
        held = {i: (h, t) for i, h, t in zip(ids, hashes, ts, strict=True)}
        newest: dict[str, tuple] = {}
        for part in parts:
            for i, h, t, version in zip(part["id"], part["h"], part["t"], part["version"], strict=True):
                if i not in newest or version > newest[i][2]:
                    newest[i] = (h, t, version)
        last = max(t for _, t, _ in newest.values())
        day = datetime.date(int(last[:4]), int(last[4:6]), int(last[6:])) - datetime.timedelta(days)
        cutoff = max(cutoff, day.strftime("%Y%m%d"))
        held |= {i: (h, t) for i, (h, t, _) in newest.items()}
        order = sorted(sorted(held), key=lambda i: held[i][1], reverse=True)
        left = [i for i in order if held[i][1] >= cutoff][:cap]
        state.update((left, [held[i][0] for i in left], [held[i][1] for i in left], cutoff))
        state.setTimeoutDuration(days * 86_400_000)
        yield pd.DataFrame({"shard": [key[0]], "updated": [len(newest)], "evicted": [len(held) - len(left)], "n_entries": [len(left)]})

    return entries.groupBy("shard").applyInPandasWithState(run, "shard string, updated long, evicted long, n_entries long", ENTRIES, "append", GroupStateTimeout.ProcessingTimeTimeout)


def newest_entries(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of keep_newest as of its last batch, read from its checkpoint: shard, id, h, t."""
    held = spark.read.format("statestore").load(checkpoint).select(F.col("key.shard").alias("shard"), F.col("value.groupState.*"))
    return held.select("shard", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("hashes").alias("h"), F.col("days").alias("t"))))


def unsent(stories: DataFrame, sent: DataFrame, key: str, ts: str, lateness: str) -> DataFrame:
    """Stories that weren't sent, each (key, ts) once. What lies `lateness` or more behind the newest of them, as of the batches up to the last but one, is late: it is dropped, and counted by `late_rows`. (The last batch's watermark clears state; rows are judged by the one before it.)"""
    return stories.join(sent.select(key), key, "left_anti").withWatermark(ts, lateness).dropDuplicates([key, ts])


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query's batches dropped for being late."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


def keep_counts(changes: DataFrame, root: str, checkpoint: str, clock: Callable[[int], str], offset: int = C.OFFSET_HOURS) -> StreamingQuery:
    """Counts by kind of a stream (kind, ts) for today, this week and this month, as the clock stands at each batch.

    clock(batch id) is the instant, in UTC; the month's start is computed anew for each batch. Kept are counts by
    local day of the month, which are updated, and dropped when the month has passed: at most 31 rows a kind, however
    long the stream. root/days/<batch> and root/reports/<batch> are written whole for each batch, so a batch that runs
    again gives the same. As for the batch query, the week counts only its days in this month, and nothing
    bounds the counts above.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = C.instant(clock(number))
        day = F.date_trunc("DAY", C.shifted(F.col("ts"), offset)).cast("timestamp_ntz")
        new = batch.where(F.col("ts") >= C.local_start(at, "MONTH", offset)).groupBy("kind", day.alias("day")).agg(F.count("*").alias("n"))
        if number:
            new = new.unionByName(spark.read.schema(new.schema).parquet(f"{root}/days/{number - 1}"))
        start = lambda unit: C.shifted(C.local_start(at, unit, offset), offset)
        new.where(F.col("day") >= start("MONTH")).groupBy("kind", "day").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{root}/days/{number}")
        kept = spark.read.schema("kind string, day timestamp_ntz, n long").parquet(f"{root}/days/{number}")
        since = lambda unit: F.sum(F.when(F.col("day") >= start(unit), F.col("n")).otherwise(0))
        kept.groupBy("kind").agg(since("DAY").alias("today"), since("WEEK").alias("week"), F.sum("n").alias("month")).write.mode("overwrite").parquet(f"{root}/reports/{number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reports(spark: SparkSession, root: str, batches: int) -> DataFrame:
    """The reports of the batches so far, with their numbers."""
    out = None
    for i in range(batches):
        one = spark.read.schema("kind string, today long, week long, month long").parquet(f"{root}/reports/{i}").select(F.lit(i).alias("batch"), "*")
        out = one if out is None else out.unionByName(one)
    return out
