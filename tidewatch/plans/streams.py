"""Queries that run events as a stream in several micro-batches, against SQL over all batches at once."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.functions import calendar as C
from tidewatch.plans.tables import query, shared_folder, table
from tidewatch.streaming import state, upsert

BATCHES = 6


def _base(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _landed(rows, path: str, batches: range) -> None:
    """One file for each batch, in order."""
    for i in batches:
        rows.where(F.col("batch") == i).drop("batch").coalesce(1).write.mode("append").parquet(path)


def _run(stream, base: str, spark, empty_batches: bool = True) -> object:
    """Run a stream over what has landed, to its end; a state with time-outs by the clock would ask for empty batches forever."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, str(empty_batches).lower())
    try:
        done = stream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        done.awaitTermination()
        return done
    finally:
        spark.conf.set(name, before)


#: Batches hold five days each, in order.
_BATCH = "least(5, CAST(floor((day(ts) - 1) / 5) AS INT))"


@query("""WITH e AS (SELECT id, arg_max(md5(event_type), (ts, event_id)) AS h, strftime(max(ts), '%Y%m%d') AS t, left(md5(id), 1) AS shard FROM (SELECT *, CAST(event_id % 3001 AS VARCHAR) AS id FROM events) GROUP BY id),
c AS (SELECT shard, strftime(CAST(strptime(max(t), '%Y%m%d') AS DATE) - 9, '%Y%m%d') AS cutoff FROM e GROUP BY shard), r AS (SELECT e.*, row_number() OVER (PARTITION BY shard ORDER BY t DESC, id) AS n FROM e JOIN c USING (shard) WHERE t >= cutoff)
SELECT shard, id, h, t FROM r WHERE n <= 40""")
def stream_index(spark, sf_dir):
    """The index of hashes as state of a stream, in six batches with a restart after three: entries of the last nine days of their shard, at most 40 of a shard: the cap is the feature."""
    base = _base(spark)
    key = (F.col("event_id") % 3001).cast("string")
    rows = table(spark, sf_dir, "events").select(F.left(F.md5(key), F.lit(1)).alias("shard"), key.alias("id"), F.md5("event_type").alias("h"), F.date_format("ts", "yyyyMMdd").alias("t"), F.format_string("%s %019d", F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.col("event_id")).alias("version"), F.expr(_BATCH).alias("batch"))
    for part in (range(3), range(3, BATCHES)):
        _landed(rows, f"{base}/in", part)
        changes = upsert.feed(spark, f"{base}/in", "shard string, id string, h string, t string, version string")
        _run(state.keep_newest(changes, 9, 40).writeStream.format("parquet").option("path", f"{base}/changes"), base, spark, False)
    return state.newest_entries(spark, f"{base}/checkpoint")


#: Every tenth row comes up to three batches late.
_LATE_BATCH = f"least(5, {_BATCH} + CASE WHEN event_id % 10 = 0 THEN CAST((event_id / 10) % 4 AS INT) ELSE 0 END)"


@query(f"""WITH e AS (SELECT user_id % 97 AS story, ts, {_LATE_BATCH.replace("(event_id / 10)", "(event_id // 10)")} AS batch FROM events), m AS (SELECT batch, max(ts) AS newest FROM e WHERE story % 11 <> 0 GROUP BY batch),
w AS (SELECT a.batch, (SELECT max(newest) FROM m b WHERE b.batch < a.batch - 1) - INTERVAL 96 HOUR AS mark FROM m a), f AS (SELECT e.*, coalesce(ts <= mark, false) AS late FROM e JOIN w USING (batch) WHERE story % 11 <> 0)
SELECT story, count(DISTINCT ts) AS n_rows FROM f WHERE NOT late GROUP BY story UNION ALL SELECT -1, count(*) FROM f WHERE late""")
def stream_late_rows(spark, sf_dir):
    """Stories that were not sent before, in six batches out of order; rows that come 96 hours or more behind what the batches up to the last but one held are dropped, and counted under story -1."""
    base = _base(spark)
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 97).alias("story"), F.col("ts").cast("timestamp").alias("ts"), F.expr(_LATE_BATCH.replace("(event_id / 10)", "(event_id div 10)")).alias("batch"))
    _landed(rows, f"{base}/in", range(BATCHES))
    sent = table(spark, sf_dir, "events").select((F.col("user_id") % 97).alias("story")).where("story % 11 = 0").distinct()
    kept = state.unsent(upsert.feed(spark, f"{base}/in", "story long, ts timestamp"), sent, "story", "ts", "96 hours")
    done = _run(kept.writeStream.format("parquet").option("path", f"{base}/out"), base, spark)
    late = spark.createDataFrame([(-1, state.late_rows(done))], "story long, n_rows long")
    return spark.read.schema("story long, ts timestamp").parquet(f"{base}/out").groupBy("story").agg(F.count("*").alias("n_rows")).unionByName(late)


#: The clock at each batch, in UTC: the local month changes between the third and the fourth.
_CLOCK = ("2024-01-26 01:00:00", "2024-01-30 20:00:00", "2024-01-31 15:59:59", "2024-01-31 16:00:00", "2024-02-14 09:30:00", "2024-02-20 03:00:00")
_CLOCK_SQL = ", ".join(f"({i}, TIMESTAMP '{t}')" for i, t in enumerate(_CLOCK))
_SINCE = lambda unit: f"(date_trunc('{unit}', as_of + INTERVAL 8 HOUR) - INTERVAL 8 HOUR)"


@query(f"""WITH e AS (SELECT event_type AS kind, ts + INTERVAL 20 DAY AS ts, {_BATCH} AS batch FROM events), c(batch, as_of) AS (VALUES {_CLOCK_SQL})
SELECT CAST(c.batch AS INT) AS batch, kind, count(*) FILTER (ts >= {_SINCE('day')}) AS today, count(*) FILTER (ts >= {_SINCE('week')}) AS week, count(*) AS month FROM c JOIN e ON e.batch <= c.batch AND ts >= {_SINCE('month')} GROUP BY ALL""")
def stream_clock_counts(spark, sf_dir):
    """Counts for today, this week and this month after each of six batches, at the instant of each, over a change of month and one restart."""
    base = _base(spark)
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), C.shifted(F.col("ts"), 20 * 24).alias("ts"), F.expr(_BATCH).alias("batch"))
    for part in (range(2), range(2, BATCHES)):
        _landed(rows, f"{base}/in", part)
        state.keep_counts(upsert.feed(spark, f"{base}/in", "kind string, ts timestamp_ntz"), base, f"{base}/checkpoint", _CLOCK.__getitem__).awaitTermination()
    return state.reports(spark, base, BATCHES)
