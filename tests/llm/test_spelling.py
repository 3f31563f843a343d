import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import registry
from tidewatch.llm import spelling as sp

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lowered(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def brute_counts(rows, damage):
    counts = Counter()
    for d, t in rows:
        for w in map(lowered, RUN.findall(t or "")):
            h = zlib.crc32(f"{d}:{w}".encode())
            if damage and d is not None and h % damage == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, damage=0):
    counts = brute_counts(rows, damage)
    by_size = {}
    for w in counts:
        by_size.setdefault(len(w), []).append(w)
    form, n_near = {}, {}
    for w, n in counts.items():
        found = [x for k in (-1, 0, 1) for x in by_size.get(len(w) + k, []) if near(w, x)]
        n_near[w] = len(found)
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, n_near[w], counts.get(form[w])) for w, n in counts.items())


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def texts(seed, n=40, alphabet="aabé", words=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(3, 8)))
    return [(i, " ".join(word() for _ in range(words))) for i in range(n)]


@pytest.mark.parametrize("alphabet", ["ab", "aabé", "abcdefÿÀ÷z"])
@pytest.mark.parametrize("size", [1, 7, 400])
def test_trie_against_brute_force(alphabet, size, monkeypatch):
    monkeypatch.setattr(sp, "STATES", 64)
    rng = random.Random(size)
    words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(size)})
    queries = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))) for _ in range(200)} | set(words))
    trie = sp.Trie.load(sp.Trie.of(words, np.ones(len(words), np.int64)).dump())
    assert [trie.word(i) for i in range(len(words))] == words
    found = [(queries[i], words[j]) for q, w in trie.neighbours(*sp.symbols(queries)) for i, j in zip(q.tolist(), w.tolist())]
    assert len(found) == len(set(found))
    assert set(found) == {(q, w) for q in queries for w in words if near(q, w)}


ROWS = [*texts(1), (None, "Naïve naïve NAÏVE naÏve nAïve " * 2), (40, None), (41, ""), (42, "hello-hello_hello1hello Ωhello helloæ ß÷×é " * 2), (43, "x" * 3000 + " " + "x" * 3001), (43, "hello world " * 3), (43, "hello world " * 3)]


@pytest.mark.parametrize("shard_words,group_bytes", [(100_000, 1 << 30), (37, 20_000)])
def test_against_brute_force(spark, shard_words, group_bytes, monkeypatch):
    monkeypatch.setattr(sp, "SPLIT_BYTES", 500)
    monkeypatch.setattr(sp, "HELD_WORDS", 50)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x")).repartition(3)
    done = got(sp.spelling_variants(docs, damage=7, shard_words=shard_words, group_bytes=group_bytes))
    want = brute(ROWS, 7)
    assert len(want) > 200 and any(r[1] != r[2] and r[1] for r in want)
    assert done == want


def test_chain_of_forms_ends_at_the_last(spark):
    chain = ["alpha", "alphas", "alphass", "alphasss", "alphassss"]
    rows = [(i, " ".join([w] * (3 * 2**k))) for i, (k, w) in enumerate(enumerate(chain))]
    done = {r[0]: r[1:3] for r in got(sp.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert done == {w: (chain[k + 1] if k < 4 else None, "alphassss") for k, w in enumerate(chain)}


def test_ties_go_to_the_lesser_word(spark):
    rows = [(0, "cable " * 3 + "table " * 6 + "fable " * 6)]
    assert got(sp.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))[0] == ("cable", "fable", "fable", 3, 2, 6)


def test_empty_table_and_bad_factor(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert got(sp.spelling_variants(empty)) == []
    with pytest.raises(ValueError):
        sp.spelling_variants(empty, factor=1)


def test_registered_query_against_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    sql = con.execute(registry.oracle_sql()["op11_spelling_variants"])
    names = [x[0] for x in sql.description]
    df = registry.op11_spelling_variants(spark, d)
    want = sorted(sql.fetchall(), key=str)
    assert df.columns == names and sorted(map(tuple, df.collect()), key=str) == want
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(want) == brute(rows, 97)
