"""Copies: what may be copied, what was, and whether it arrived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compared(source: DataFrame, copy: DataFrame, key: str) -> DataFrame:
    """Per key: match, differs, missing (in the copy) or extra. All other columns count, nulls included."""
    rest = [c for c in source.columns if c != key]
    a = source.select(key, F.struct(*rest).alias("a"))
    b = copy.select(key, F.struct(*rest).alias("b"))
    verdict = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a").eqNullSafe(F.col("b")), "match").otherwise("differs")
    return a.join(b, key, "full").select(key, verdict.alias("verdict"))


def related(rows: DataFrame, eligible: DataFrame, key: str) -> DataFrame:
    """Adds whether a row belongs to an eligible parent."""
    return rows.join(eligible.select(key).distinct().withColumn("__in", F.lit(True)), key, "left").withColumn("eligible", F.coalesce("__in", F.lit(False))).drop("__in")


def meta_class(name: Column, locks: tuple[str, ...], kept: tuple[str, ...]) -> Column:
    """Locks are recognised by prefix first; names that nobody classified block a copy."""
    lock = F.lit(False)
    for prefix in locks:
        lock = lock | F.startswith(name, F.lit(prefix))
    return F.when(lock, "exclude").when(name.isin(*kept), "preserve").otherwise("unclassified")
