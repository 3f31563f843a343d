import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidewatch.llm.quality_classifier import classify

SCHEMA = "doc_id long, text string, lang string, n_chars long"


def words(rng, n):
    return [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 999)) for _ in range(n)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def made(spark, rows):
    return spark.createDataFrame([(d, t, "x", None if t is None else len(t)) for d, t in rows], SCHEMA).repartition(3)


def got(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def near_rows():
    rng = random.Random(2)
    rows = []
    for i in range(12):
        base = words(rng, 60)
        near = [*base[:30], "other", *base[31:]]
        ids = [i, 100 + i, None] if i % 3 else [None, None, None]
        rows += [(ids[0], " ".join(near)), (ids[1], " ".join(base)), (ids[2], " ".join(base)), (ids[1], " ".join(base))]
    namesake = " ".join(words(rng, 40))
    rows += [(1, namesake), (101, namesake), (1, " ".join(words(rng, 40)))]
    return rows + [(200, None), (200, None), (201, ""), (201, "  "), (None, ""), (None, ""), (None, None)]


def near_by_hand(rows):
    """Kept rows, but for which of two texts of one id or without id stays; groups of linked rows by plain Python."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root = [root[j] if r == root[i] else r for r in root]
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(i)
    return [(min((rows[i][0] is None, rows[i][0] or 0) for i in g), {rows[i][1] for i in g}) for g in groups.values() if sets[g[0]]]


def test_near_duplicates_by_row(spark):
    rows = near_rows()
    kept = got(cp.near_duplicates(spark, made(spark, rows), ""))
    full = [(d, t) for d, t in kept if (t or "").strip()]
    want = near_by_hand(rows)
    assert len(full) == len(want)
    for (none, doc_id), texts in want:
        assert sum(t in texts and d == (None if none else doc_id) for d, t in full) == 1
    assert sorted(((d, t) for d, t in kept if not (t or "").strip()), key=str) == sorted([(200, None), (201, ""), (201, "  "), (None, ""), (None, ""), (None, None)], key=str)
    assert got(cp.near_duplicates(spark, made(spark, []), "")) == []


def test_decontaminated_by_row(spark, tmp_path):
    rng = random.Random(3)
    item = words(rng, 20)
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    dirty, clean = [" ".join(words(rng, 5) + item + words(rng, 5)) for _ in range(3)], [" ".join(words(rng, 30)) for _ in range(3)]
    rows = [(1, dirty[0]), (1, clean[0]), (None, dirty[1]), (None, clean[1]), (2, dirty[2]), (3, clean[2]), (4, None), (None, "")]
    assert got(cp.decontaminated(spark, made(spark, rows), str(tmp_path))) == sorted([(1, clean[0]), (None, clean[1]), (3, clean[2]), (4, None), (None, "")], key=str)


def test_lines_keep_every_row_and_count_characters(spark):
    passage = "one two\nthree four\nfive six"
    rows = [(1, passage + "\nown"), (2, "new\n" + passage), (None, None), (3, "")]
    out = cp.lines(spark, made(spark, rows), "")
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, passage + "\nown", len(passage) + 4), (2, "new", 3), (None, None, None), (3, "", 0)}
    assert out.columns == ["doc_id", "text", "lang", "n_chars"]


def test_quality_keeps_what_the_classifier_passes(spark, tmp_path):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["river", "stone", "bridge", "harbour", "tide"]) for _ in range(30))
    bad = lambda: " ".join(rng.choice(["buy", "cheap", "click", "win", "prize"]) for _ in range(30))
    rows = [(i, good() if i % 2 else bad()) for i in range(200)]
    spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = made(spark, [*rows, (None, rows[1][1]), (7, None)]), spark.read.parquet(f"{tmp_path}/labels.parquet")
    passed = sorted(r.doc_id for r in classify(docs.where("text IS NOT NULL AND doc_id IS NOT NULL"), labels, least=0.3).where("predicted = 1").collect())
    out = cp.quality(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and {(d, t) for d, t in rows if d in passed} | {(None, rows[1][1])} == {x for x in got(out) if x[1] is not None}
    assert passed == [i for i, _ in rows if i % 2]


def test_encoded_spells_every_text(spark):
    rows = [(1, "one two\nthree"), (2, ""), (3, "zw\u00f6lf"), (None, "one two\nthree")]
    out = cp.encoded(spark, made(spark, rows), "").collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(rows, key=str)
    assert all(r.lossless and r.n_pieces == len(r.pieces) for r in out)


def odd(spark, rows):
    """Rows with columns named like those that stages add."""
    return made(spark, rows).selectExpr("*", "1 AS key", "2 AS own", "3 AS of", "4 AS gone", "5 AS __id", "6 AS __key", "7 AS __named", "8 AS __row", "9 AS hash", "10 AS `rows`", "11 AS `__text`")


def test_stages_with_clashing_names_odd_bytes_and_very_long_texts(spark, tmp_path):
    rng = random.Random(5)
    item = words(rng, 20)
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long_text = " ".join(words(rng, 40_000))
    rows = [(i, " ".join(words(rng, 20))) for i in range(60)] + [(100, long_text), (101, long_text), (102, "w" * 300_000), (None, None), (None, ""), (None, long_text), (103, long_text + " " + " ".join(item))]
    docs = odd(spark, rows).unionByName(odd(spark, rows).where("doc_id = 1").withColumn("text", F.expr("CAST(X'FF6162FE' AS STRING)")))
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        kept = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
        assert sum(kept.values()) > 30
        assert {tuple(r) for r in out.select("key", "own", "of", "gone", "__id", "__key", "__named", "__row", "hash", "rows").distinct().collect()} == {(1, 2, 3, 4, 5, 6, 7, 8, 9, 10)}
        if stage is cp.near_duplicates:
            assert 100 in kept and not {101, 103} & set(kept) and kept[None] == 2
        if stage is cp.lines:
            assert out.count() == docs.count()
        if stage is cp.decontaminated:
            assert len(kept) == len({d for d, _ in rows})  # 20 of 40,020 words are too few
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_run_is_the_stages_in_order(spark, tmp_path):
    """The whole pipeline against its stages applied one by one, on planted documents."""
    rng = random.Random(6)
    item = words(rng, 30)
    good = lambda n: [" ".join(rng.choice(["river", "stone", "bridge", "harbour", "tide", "quay", "mast", "sail"]) + str(rng.randint(0, 50)) for _ in range(8)) for _ in range(n)]
    shared = good(3)
    rows = [(i, "\n".join(good(4))) for i in range(40)]
    rows += [(100 + i, "\n".join(good(3) + shared)) for i in range(5)]
    rows += [(200, rows[3][1]), (201, rows[3][1].replace("river", "River", 1)), (300, " ".join(item)), (301, None)]
    made(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r.text for r in cp.run(spark, str(tmp_path)).collect()}
    assert 300 not in out and set(range(40)) <= set(out)
    assert not out.get(200) and (out.get(201) or "").count("\n") == 0  # their repeated lines go before
    assert sum(shared[1] in (out.get(100 + i) or "") for i in range(5)) == 1
    assert all(out[i] == t for i, t in rows[:40])
