"""What a worker does with a job: output checked, results written, leases on names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions.columns import held

OUTPUT = "summary string, eventType string, impact string, importanceScore string, confidence string, recommendedAction string, entities array<string>, bullets array<string>"


def unfenced(text: Column) -> Column:
    """Text without the fence of three backticks around it."""
    clean = T.stripped(T.or_empty(text))
    body = F.regexp_replace(F.regexp_replace(clean, "^```[^\n]*\n?", ""), r"\n?[ \t]*```[ \t]*$", "")
    return F.when(F.startswith(clean, F.lit("```")), T.stripped(body)).otherwise(clean)


def checked_output(rows: DataFrame, output: str, kinds: Sequence[str], impacts: Sequence[str]) -> DataFrame:
    """Model output as JSON text to columns; `valid` says whether it is an object with a summary.

    Unknown kinds and impacts become other and neutral, scores are cut to 0..100 and 0..1 (0 if they are no
    numbers), texts and lists to their lengths.
    """
    rows = held(rows, __j=F.from_json(unfenced(F.col(output)), OUTPUT))
    j = lambda c: F.col("__j")[c]
    kept = lambda c, allowed, default: F.when(j(c).isin(*allowed), j(c)).otherwise(default)
    number = lambda c, most: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.coalesce(j(c).try_cast("double"), F.lit(0.0))))
    cut = lambda c, n, size: F.transform(F.slice(F.coalesce(j(c), F.array().cast("array<string>")), 1, n), lambda x: F.left(x, F.lit(size)))
    summary = F.left(T.stripped(T.or_empty(j("summary"))), F.lit(500))
    columns = [c for c in rows.columns if c != "__j"]
    return rows.select(
        *columns, (summary != "").alias("valid"), summary.alias("summary"), kept("eventType", kinds, "other").alias("event"), kept("impact", impacts, "neutral").alias("impact"), number("importanceScore", 100).cast("long").alias("importance"),
        number("confidence", 1).alias("confidence"), F.left(T.or_empty(j("recommendedAction")), F.lit(300)).alias("action"), cut("entities", 10, 80).alias("entities"), cut("bullets", 5, 200).alias("bullets"),
    )


def rules_output(scored: DataFrame, names: dict[str, str], advice: str) -> DataFrame:
    """The same from rule scores alone, with a fixed confidence."""
    shown = F.transform("entities", lambda c: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), c), c))
    return scored.select(
        "id", T.labelled(F.col("title"), F.col("source_name"), F.col("event")).alias("summary"), "event", shown.alias("entities"), "impact", "importance", F.lit(0.55).alias("confidence"), F.when(F.col("review"), advice).otherwise("").alias("action"), F.col("reasons").alias("bullets")
    )


def complete(jobs: DataFrame, as_of: Column, owner: str, done: DataFrame) -> DataFrame:
    """Jobs of the owner that have a result (job_id) are completed; what another worker has taken over stays."""
    mine = jobs.join(done.select("job_id").distinct().withColumn("__done", F.lit(True)), "job_id", "left")
    own = F.coalesce("__done", F.lit(False)) & (F.col("status") == "processing") & (F.col("owner") == owner)
    none = lambda c: F.when(F.col("__own"), F.lit(None)).otherwise(F.col(c))
    return mine.withColumn("__own", F.coalesce(own, F.lit(False))).withColumns(
        {"completed_at": F.when(F.col("__own"), as_of), "status": F.when(F.col("__own"), "completed").otherwise(F.col("status")), "owner": none("owner"), "lease_until": none("lease_until"), "next_at": none("next_at"), **({"last_error": none("last_error")} if "last_error" in jobs.columns else {})}
    ).drop("__done", "__own")


def insights(jobs: DataFrame, results: DataFrame, owner: str, review_at: int = 70) -> DataFrame:
    """Results (job_id, importance, ...) of jobs that are still the owner's, with what is to be reviewed."""
    own = jobs.where((F.col("status") == "processing") & (F.col("owner") == owner)).select("job_id", "h")
    return results.join(own, "job_id").withColumn("review_status", F.when(F.col("importance") >= review_at, "pending").otherwise("not_required"))


def lease_free(as_of: Column) -> Column:
    """Whether a lock row may be taken: none yet, or run out."""
    return F.col("expires_at").isNull() | (F.col("expires_at") <= as_of)


def acquired(locks: DataFrame, wanted: DataFrame, as_of: Column, minutes: int = 15) -> DataFrame:
    """Locks (name, owner, expires_at) after requests (name, token), one per name: the request gets what is free; `granted` says so. Mutual exclusion is the scheduler's."""
    if minutes <= 0:
        raise ValueError("minutes must be positive")
    both = locks.join(wanted, "name", "full").withColumn("granted", F.col("token").isNotNull() & lease_free(as_of))
    until = (as_of + F.expr(f"INTERVAL '{minutes}' MINUTE")).cast("timestamp_ntz")
    return both.withColumns({"owner": F.when(F.col("granted"), F.col("token")).otherwise(F.col("owner")), "expires_at": F.when(F.col("granted"), until).otherwise(F.col("expires_at"))}).drop("token")


def released(locks: DataFrame, tokens: DataFrame) -> DataFrame:
    """Locks without those whose owner hands in its token (name, token); a lock that another has taken over stays."""
    given = tokens.select(F.col("name").alias("__name"), F.col("token").alias("__token"))
    return locks.join(given, (F.col("name") == F.col("__name")) & (F.col("owner") == F.col("__token")), "left_anti")
