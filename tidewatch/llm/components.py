"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import discard, join_counted, stored


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Link each vertex's neighbours (larger ones, or smaller ones and itself) to its least neighbour. Minima are pre-aggregated, and a hub's edges meet its minimum where they are, so they never gather."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("rows")), "least")
        out = join_counted(both, least, "a", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = stored(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows")), "least")
        out = join_counted(edges, least, "a", total).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    done = stored(out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    discard(least)
    return done


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """A stored table (vertex, root) of each vertex that has a link to another; root is the least vertex of its component."""
    edges = stored(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "links")
    last = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
        if state == last or not state.n:
            break
        last = state
        wide = _star(edges, True, state.n)
        before, edges = edges, _star(wide, False, state.n)
        discard(before, wide)
    done = stored(edges.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("vertex"), F.col("b").alias("root"))).distinct(), "roots")
    discard(edges)
    return done
