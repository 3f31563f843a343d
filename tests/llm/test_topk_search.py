import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import topk_search as tk

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=5, every=50):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=1)
    pad = [(i, v + [0] * (width - len(v))) for i, v in good]
    out = []
    for q in sorted({i for i, _ in pad if i % every == 0}):
        found = {(sum(a * b for a, b in zip(u, v, strict=True)), i) for j, u in pad if j == q for i, v in pad if i != q}
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:k])]
    return out


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) * 0.2 * (1 + i % 7) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(20)] + [(50, rows[51][1]), (500, None), (550, [1.0, None]), (600, [float("nan")] * 6), (650, [float("inf")] * 6), (700, [0.1, 0.2]), (750, []), (None, rows[0][1]), (800, [1e9] * 6), (-50, rows[7][1])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)).withColumn("block", F.lit(2)).repartition(3)
    want = brute(rows)
    assert got(tk.top_k(df)) == want
    monkeypatch.setattr(tk, "BLOCK", 16)
    monkeypatch.setattr(tk, "QUERY_BLOCK", 4)
    assert got(tk.top_k(df)) == want


def test_small_tables(spark):
    assert got(tk.top_k(spark.createDataFrame([], SCHEMA))) == []
    assert got(tk.top_k(spark.createDataFrame([(0, [1.0])], SCHEMA))) == []
    assert got(tk.top_k(spark.createDataFrame([(0, [1.0]), (3, [-0.5])], SCHEMA))) == [(0, 1, 3, -128 * 256)]


def test_supplied_vectors(spark):
    from tidewatch.llm import registry

    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    m = np.floor(256 * np.array([r.embedding for r in rows], np.float64)).astype(np.int64)
    ids = np.array([r.vec_id for r in rows])
    want = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = m @ m[i]
        keep = ids != ids[i]
        order = np.lexsort((ids[keep], -s[keep]))[:5]
        want += [(int(ids[i]), r + 1, int(ids[keep][o]), int(s[keep][o])) for r, o in enumerate(order)]
    assert got(registry.op2_topk_search(spark, d)) == sorted(want)
