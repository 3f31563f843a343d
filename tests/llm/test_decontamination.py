import hashlib
import random
import re

from pyspark.sql import functions as F

from tidewatch.llm import decontamination as dc


def fold(t):
    t = re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, window=13):
    out = []
    for d, t in docs:
        w = fold(t)
        hit, owners = set(), set()
        for i, p in items:
            q = fold(p)
            for k in [q[s : s + window] for s in range(max(1, len(q) - window + 1))] if q and i is not None else []:
                for s in range(len(w) - len(k) + 1):
                    if w[s : s + len(k)] == k:
                        hit |= set(range(s, s + len(k)))
                        owners.add(str(i))
        names = ",".join(sorted(owners))
        out.append((d, len(w), len(hit), len(owners), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.drop("items").collect()), key=str)


def cases():
    rng = random.Random(3)
    vocab = [f"W{i}é" if i % 3 else f"w{i}" for i in range(80)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(words(rng.choice((3, 12, 13, 14, 40))))) for i in range(30)]
    items += [(5, items[7][1]), (40, items[8][1].upper()), (50, None), (51, ""), (52, "..."), (None, "w0 w3")]
    docs = []
    for i in range(80):
        t = words(rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            q = rng.choice(items)[1]
            at = rng.randint(0, len(t))
            t[at:at] = (q or "").split()[rng.randint(0, 5) :]
        docs.append((i, rng.choice((" ", ", ", "\n")).join(t)))
    return [*docs, (90, None), (91, ""), (0, docs[1][1]), (None, docs[2][1])], items


def test_against_brute_force(spark, monkeypatch):
    docs, items = cases()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("term", F.lit(2)).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert got(dc.decontaminate(df, bench)) == brute(docs, items)
    monkeypatch.setattr(dc, "BLOCK_WORDS", 150)
    assert got(dc.decontaminate(df, bench)) == brute(docs, items)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert got(dc.decontaminate(docs, bench)) == [(1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    assert got(dc.decontaminate(docs.where("false"), bench)) == []


def test_phrase_and_proximity(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox"), (2, "quick and brown fox, quick brown"), (3, "fox")], "doc_id long, text string")
    index = dc.build_index(docs)
    find = lambda phrases, slop=0: sorted(map(tuple, dc.matches(index, phrases, slop).collect()))
    assert find([(7, "Quick Brown"), (8, "fox quick"), (9, "")]) == [(1, 7, 1), (2, 7, 4), (2, 8, 3)]
    assert (2, 7, 0) in find([(7, "quick brown")], 1)


def test_supplied_documents(spark):
    from tidewatch.llm import registry

    d = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{d}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got(registry.op3_decontamination(spark, d)) == brute(docs, items)
