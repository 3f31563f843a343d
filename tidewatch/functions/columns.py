"""Columns that are computed once, however often later steps name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(df: DataFrame, name: str) -> Column:
    """A column, or null where df has none of that name."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns. A generator of one row stands between them and their uses, so that the optimizer doesn't copy their definitions into each; filters on other columns still pass below it."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))
