"""Fold and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5. A null id counts as held out, so nothing is learned from it."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True)) if isinstance(doc_id, str) else F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def bounded(rows: DataFrame, group: str, counts: dict, n: int) -> DataFrame:
    """About the n rows of least hash of doc_id in each group of known size, by one filter: at most some n per group reach what follows."""
    share = F.lit(0.0)
    for value, size in counts.items():
        share = F.when(F.col(group) == F.lit(value), F.lit(min(1.0, n / max(1, size)))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < share * F.lit(float(1 << 30)))
