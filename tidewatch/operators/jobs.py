"""Job queue decisions as pure transforms: who claims, what comes back, what failed, what is retained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions.calendar import shifted


def claim(jobs: DataFrame, as_of: Column, owner: str, n: int, lease_minutes: int = 10) -> DataFrame:
    """The n pending jobs of highest priority that are due, leased to owner."""
    if n <= 0 or lease_minutes <= 0:
        raise ValueError("n and lease_minutes must be positive")
    due = jobs.where((F.col("status") == "pending") & (F.col("next_at").isNull() | (F.col("next_at") <= as_of)))
    lease = (as_of + F.expr(f"INTERVAL '{lease_minutes}' MINUTE")).cast("timestamp_ntz")
    return due.orderBy(F.desc("priority"), "job_id").limit(n).withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "owner": F.lit(owner), "lease_until": lease})


def _changed(jobs: DataFrame, where: Column, **columns: Column | str | None) -> DataFrame:
    """Jobs with new values in the rows that `where` (decided on the old ones) names; columns that are missing arise."""
    old = lambda c: F.col(c) if c in jobs.columns else F.lit(None)
    rows = jobs.withColumn("__hit", F.coalesce(where, F.lit(False)))
    return rows.withColumns({c: F.when(F.col("__hit"), v if isinstance(v, Column) else F.lit(v)).otherwise(old(c)) for c, v in columns.items()}).drop("__hit")


def recover(jobs: DataFrame, as_of: Column, note: str = "the worker before broke off") -> DataFrame:
    """Jobs whose lease has run out, or that have none, are pending again, with no owner and a note; `recovered` says which."""
    stale = (F.col("status") == "processing") & (F.col("lease_until").isNull() | (F.col("lease_until") <= as_of))
    return _changed(jobs.withColumn("recovered", F.coalesce(stale, F.lit(False))), F.col("recovered"), status="pending", owner=F.lit(None).cast("string"), last_error=note)


def fail(jobs: DataFrame, as_of: Column, owner: str, error: Column | str, most: int = 3) -> DataFrame:
    """A failure of the owner's jobs: the last attempt makes it final, with no next one, else the next is due after a minute per attempt.

    Either way nobody owns or leases the job any more, and the error is kept, in one line of 240 characters at
    most. Others' jobs stay. A job without a number of attempts counts as tried once.
    """
    attempts = F.coalesce(F.nullif(F.col("attempts"), F.lit(0)), F.lit(1))
    final = attempts >= most
    wait = F.timestamp_add("MINUTE", attempts.cast("int"), as_of).cast("timestamp_ntz")
    message = F.left(F.trim(T.collapsed(error if isinstance(error, Column) else F.lit(error))), F.lit(240))
    own = (F.col("status") == "processing") & (F.col("owner") == owner)
    return _changed(jobs, own, status=F.when(final, "failed").otherwise("pending"), next_at=F.when(~final, wait), owner=F.lit(None).cast("string"), lease_until=F.lit(None).cast("timestamp_ntz"), last_error=message)


def outcome(jobs: DataFrame, articles: DataFrame, insights: DataFrame) -> DataFrame:
    """Per job: no article is a failure, an insight of the same content completes it, else it is to be analysed."""
    known = articles.select("id", F.lit(True).alias("__article"))
    done = insights.select(F.col("id").alias("__i"), F.col("h").alias("__h")).distinct()
    joined = jobs.join(known, "id", "left").join(done, (F.col("id") == F.col("__i")) & (F.col("h") == F.col("__h")), "left")
    return joined.withColumn("outcome", F.when(F.col("__article").isNull(), "failed").when(F.col("__i").isNotNull(), "complete").otherwise("analyse")).drop("__article", "__i", "__h")


def expired(rows: DataFrame, cutoff: Column, cap: int) -> DataFrame:
    """The oldest rows before the cutoff, at most cap in a run; undated rows are never deleted."""
    if cap <= 0:
        raise ValueError("cap must be positive")
    return rows.where(F.col("ts") < cutoff).orderBy("ts", "id").limit(cap)


def without(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def page(rows: DataFrame, ts: Column, key: Column, after: tuple[Column, Column] | None, n: int) -> DataFrame:
    """The n rows after a cursor of values, which still stands when its row is deleted."""
    if n <= 0:
        raise ValueError("n must be positive")
    if after:
        rows = rows.where((ts > after[0]) | ((ts == after[0]) & (key > after[1])))
    return rows.orderBy(ts, key).limit(n)


def hours_back(as_of: Column, hours: int = 96) -> Column:
    return shifted(as_of, -hours)


def of_code(rows: DataFrame, column: str, code: str | None) -> DataFrame:
    """Rows of one code, or all where none is asked for."""
    return rows if code is None else rows.where(F.col(column) == code)
