"""Matching texts against tables of terms: one automaton over all terms finds them in one pass over a text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of terms that one automaton may hold, since it goes to all tasks.
MOST_BYTES = 8 << 20


def _clean(terms: DataFrame) -> DataFrame:
    return terms.select("term").where("term IS NOT NULL AND term <> ''").distinct()


def _size(terms: DataFrame) -> int:
    return terms.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]


def _bounded(before: str, after: str) -> bool:
    outside = lambda c: not (c.isascii() and c.isalnum())
    return outside(before) and outside(after)


def _found(spark, terms: list[str], whole: bool) -> Callable[[Column], Column]:
    shared = spark.sparkContext.broadcast(terms)

    @F.pandas_udf("array<string>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t in shared.value:
            automaton.add_word(t, t)
        if shared.value:
            automaton.make_automaton()

        def one(text: str | None) -> list[str]:
            if not text or not shared.value:
                return []
            if not whole:
                return sorted({t for _, t in automaton.iter(text)})
            padded = f" {text} "
            # An ASCII term counts only between characters other than a-z and 0-9; any other term anywhere.
            return sorted({t for end, t in automaton.iter(text) if not t.isascii() or _bounded(padded[end + 1 - len(t)], padded[end + 2])})

        for part in texts:
            yield part.map(one)

    return found


def matcher(terms: DataFrame, whole_words: bool = False) -> Callable[[Column], Column]:
    """A function of a text column to the array of terms (column `term`) that it contains, each once, in order.

    Texts and terms are compared as they are. With whole_words, ASCII terms must stand between characters other than
    letters and digits of ASCII. Terms of more than MOST_BYTES together are an error; `term_hits` has no such bound.
    """
    clean = _clean(terms)
    if (size := _size(clean)) > MOST_BYTES:
        raise ValueError(f"terms of {size} bytes are too many for one automaton of {MOST_BYTES}")
    return _found(terms.sparkSession, [r.term for r in clean.collect()], whole_words)


def term_hits(texts: DataFrame, text: str, terms: DataFrame, whole_words: bool = False, most_bytes: int | None = None) -> DataFrame:
    """Each row of texts with each term that its column `text` contains, as the column `term`; rows without one are left out.

    Terms are dealt by a hash to as many automata as keep each within the bound; the rows are read once for each.
    No row meets a term that it doesn't hold.
    """
    clean, most = _clean(terms), most_bytes or MOST_BYTES
    groups = max(1, -(-_size(clean) // most))
    out = None
    for g in range(groups):
        own = [r.term for r in clean.where(F.pmod(F.xxhash64("term"), F.lit(groups)) == g).collect()]
        one = texts.select("*", F.explode(_found(texts.sparkSession, own, whole_words)(F.col(text))).alias("term"))
        out = one if out is None else out.unionByName(one)
    return out
