import random

from pyspark.sql import functions as F

from tidewatch.llm import jaccard_join as jj
from tidewatch.llm.components import components


def brute(rows, k=5):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(s), least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def cases(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(2000)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = []
    passage = words(50)
    for n in (3, 5, 6, 8, 9, 10, 12, 15, 20, 30, 45, 60, 90, 140, 300, 700):
        base = words(n)
        for _ in range(9):
            text = list(base)
            for _ in range(rng.randint(0, max(1, n // 18))):
                op, at = rng.randint(0, 2), rng.randrange(len(text))
                if op == 0:
                    text[at] = rng.choice(vocab)
                elif op == 1 and len(text) > 1:
                    del text[at]
                else:
                    text.insert(at, rng.choice(vocab))
            rows.append(" ".join(text))
    for _ in range(60):
        text = words(rng.randint(20, 200))
        text[5:5] = passage
        rows.append(" ".join(text))
    rows += ["", " \n ", "Same Words here", "same words HERE", rows[0], rows[30], "a a a a a a a a a"]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [*zip(ids, rows, strict=True), (900, None), (901, None), (ids[3], rows[5]), (None, rows[40]), (None, "quite alone with this text")]


def test_bands_and_allocation():
    for x in range(1, 400):
        b = jj.band_of(x)
        assert jj.band_floor(b) <= x < jj.band_floor(b + 1)
        assert jj.band_of(x * 5 // 4) - b in (0, 1)
        d, e = jj.allocation(b)
        assert 2 * d + e >= jj.difference(x, min(x * 5 // 4, jj.band_floor(b + 1) - 1)) + 1 + jj.spare(x, b)


def test_against_brute_force(spark):
    rows = cases(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("ref", F.lit("x")).repartition(3)
    assert got(jj.jaccard_join(df)) == brute(rows)


def test_empty_table(spark):
    assert got(jj.jaccard_join(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 200).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    assert {tuple(r) for r in components(links, "a", "b").collect()} == {(i, 0) for i in range(200)}


def test_supplied_documents(spark):
    from tidewatch.llm import registry

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert got(registry.op8_jaccard_join(spark, d)) == brute(rows)


def test_large_groups_are_dealt_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK_FEW", 2)
    monkeypatch.setattr(jj, "BLOCK_MANY", 3)
    monkeypatch.setattr(jj, "HUB_ROUNDS", 1)
    monkeypatch.setattr(jj, "BUCKET_MEMBERS", 5)
    monkeypatch.setattr(jj, "PARTNERS", 1)
    monkeypatch.setattr(jj, "PARTNERS_GROW", 2)
    monkeypatch.setattr(jj, "BLOCK_PAIRS", 2)
    monkeypatch.setattr(jj, "FETCH_BROADCAST", 3)
    rows = cases(5)
    assert got(jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_dense_group_below_the_threshold(spark, monkeypatch):
    """Copies that each lie just below, at or above 0.8 from the others: hubs and nearest partners alone don't tell."""
    monkeypatch.setattr(jj, "PARTNERS", 1)
    monkeypatch.setattr(jj, "PARTNERS_GROW", 2)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(90):
        text = list(base)
        for at in range(rng.randint(0, 9), 300, rng.choice((38, 41, 45, 48, 52, 60))):
            text[at] = f"x{i}_{at}"
        rows.append((i, " ".join(text)))
    want = brute(rows)
    assert len({c for _, _, c in want}) > 5 and sum(d != c for d, _, c in want) > 20
    assert got(jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))) == want
