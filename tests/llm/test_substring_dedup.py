import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tidewatch.llm import substring_dedup as sd


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[s : s + window]) for _, w in words for s in range(len(w) - window + 1))
    out = []
    for i, w in words:
        keep = [True] * len(w)
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] > 1:
                keep[s : s + window] = [False] * window
        text = b" ".join(x for x, k in zip(w, keep, strict=True) if k)
        out.append((i, len(w), keep.count(False), hashlib.sha256(text).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_covers_hold_every_difference():
    for v, cover in sd.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(300)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = [words(60), words(36), words(35), words(34)]
    rows = []
    for i in range(60):
        text = words(rng.randint(0, 90))
        for s in rng.sample(shared, rng.randint(0, 2)):
            at = rng.randint(0, len(text))
            text[at:at] = s
        rows.append((i, " ".join(text)))
    rows += [(100, None), (101, ""), (102, "a " * 200), (103, rows[0][1]), (103, rows[0][1]), (None, rows[1][1]), (104, " \t\n"), (105, "x y " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("body", F.lit(1)).repartition(3)
    assert got(sd.substring_dedup(df)) == brute(rows, 35)
    assert got(sd.substring_dedup(df, window=8)) == brute(rows, 8)


def test_empty_table(spark):
    assert got(sd.substring_dedup(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_supplied_documents(spark):
    from tidewatch.llm import registry

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert got(registry.op1_substring_dedup(spark, d)) == brute(rows, 35)
