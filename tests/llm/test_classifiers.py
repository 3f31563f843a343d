import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm import quality_classifier as qc
from tidewatch.llm.language_id import Identifier, SuffixAutomaton, identify, references
from tidewatch.llm.quality_classifier import classify

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, x, "old", "old") for d, t, x in rows], SCHEMA).repartition(3)


def said(rng, letters, n=25):
    return " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))


def test_language_of_rows(spark):
    rng = random.Random(6)
    rows = [(i, said(rng, "abcde" if i % 2 else "vwxyz"), "aa" if i % 2 else "vv") for i in range(100)]
    odd = [(200, None, "aa"), (201, "", "vv"), (202, "123 456", None), (None, rows[1][1], None), (1, rows[1][1], "aa")]
    out = identify(docs(spark, [*rows, *odd]))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = out.collect()
    assert len(found) == len(rows) + len(odd)
    want = {i: x for i, _, x in rows} | {200: "und", 201: "und", 202: "und", None: "aa"}
    assert all(r.lang_pred == want[r.doc_id] and (r.score == 0.0) == (r.lang_pred == "und") for r in found)
    assert [r.held_out for r in found if r.doc_id is None] == [True]


def test_language_ties_and_nothing_learned(spark):
    text = said(random.Random(7), "abcde")
    tied = identify(docs(spark, [(i, text, "bb" if i % 2 else "aa") for i in range(40)])).collect()
    assert {(r.lang_pred, r.score) for r in tied} == {("aa", 0.5)}
    assert {r.lang_pred for r in identify(docs(spark, [(i, text, None) for i in range(9)])).collect()} == {"und"}
    assert identify(docs(spark, [])).collect() == []


def test_quality_of_rows(spark):
    rng = random.Random(8)
    rows = [(i, said(rng, "abcde" if i % 2 else "vwxyz"), None) for i in range(200)]
    odd = [(300, None, None), (301, "", None), (None, rows[1][1], None), (1, rows[1][1], None)]
    marks = [(i, i % 2, "x") for i, _, _ in rows] + [(1, 1, "x"), (300, None, "x"), (301, 7, "x"), (None, 0, "x"), (999, 1, "x")]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, score string")
    out = classify(docs(spark, [*rows, *odd]), labels, least=0.3)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    found = out.collect()
    assert len(found) == len(rows) + len(odd) and all(r.predicted == (r.score >= 0.3) for r in found)
    assert all(r.predicted == r.doc_id % 2 for r in found if r.doc_id is not None and r.doc_id < 200)
    score = {r.doc_id: r.score for r in found}
    assert score[300] == score[301] and score[None] == score[1]
    twice = classify(docs(spark, rows), labels.unionByName(labels), least=0.3).collect()
    assert {r.doc_id: r.predicted for r in twice} == {i: i % 2 for i, _, _ in rows}


def test_quality_without_labels_or_with_one_kind(spark):
    rows = docs(spark, [(i, f"text {i}", None) for i in range(40)])
    labels = lambda marks: spark.createDataFrame(marks, "doc_id long, quality int")
    scores = lambda marks: {r.score for r in classify(rows, labels(marks)).collect()}
    assert scores([]) == {0.5} and scores([(i, q) for i in range(40) for q in (0, 1)]) == {0.5}
    assert min(scores([(i, 1) for i in range(40)])) > 0.9 and max(scores([(i, 0) for i in range(40)])) < 0.1
    assert classify(docs(spark, []), labels([])).collect() == []


def test_automaton_against_brute_force():
    rng = random.Random(1)
    for _ in range(30):
        text = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 60)))
        auto, known = SuffixAutomaton(text), {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}
        for _ in range(20):
            asked, n, at = "".join(rng.choice("abc x") for _ in range(rng.randint(1, 12))), 0, 0
            while at < len(asked):
                end = at + 1
                while end < len(asked) and asked[at : end + 1] in known:
                    end += 1
                n, at = n + 1, end
            assert auto.phrases(asked) == n


def test_totals_of_a_very_long_text_are_those_of_its_words():
    model = Identifier({"aa": " abc abd abe ", "bb": " xyz xyw "})
    tokens = ["abcabd", "xyz", "w" * 5000, "abeé", "123"] * 300
    total = model.totals(" ".join(tokens).encode())
    assert total.tolist() == (sum(map(model.totals, [t.encode() for t in tokens[:5]])) * 300).tolist()


def plain_features(text):
    """Words and character n-grams of a text by a loop, as a sorted list of table rows."""
    out = []
    padded = " " + re.sub(r"[ \t\n\v\f\r]", " ", text) + "  "
    for n in qc.GRAMS:
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if " " not in g[1:-1]:
                h = n * 0x9E3779B1
                for c in g:
                    h = (h * 0x100000001B3 + ord(c)) % (1 << 64)
                out.append(h)
    for w in padded.split():
        out.append(sum((ord(c) + 1) * pow(common.MULTIPLIERS[0], i, 1 << 64) for i, c in enumerate(w)) % (1 << 64))
    return sorted(int(x) % (qc.ROWS - 1) + 1 for x in common.mixed(np.array(out, np.uint64)).tolist())


def test_features_against_a_plain_loop_whole_and_in_pieces(monkeypatch):
    texts = ["", "a", "one two\nthrée", "  中文字 x ", "w" * 70 + " y", "ab " * 40 + "c" * 90 + "\td e"]
    row, owner = qc.features(texts)
    for i, t in enumerate(texts):
        assert sorted(row[owner == i].tolist()) == plain_features(t)
    odds = np.arange(qc.ROWS, dtype=np.int64) * 7919 % 10007
    whole = qc.Model(odds).log_odds([t.encode() for t in texts])
    monkeypatch.setattr(qc, "CHUNK", 13)
    for t in texts:
        assert sorted(x for part in qc.long_features(t) for x in part.tolist()) == (plain_features(t) if t else [])
    assert whole.tolist() == qc.Model(odds).log_odds([t.encode() for t in texts]).tolist()


def test_gradient_steps_against_a_plain_loop(monkeypatch):
    monkeypatch.setattr(qc, "ROWS", 512)
    texts, labels = ["good fine good", "bad worse", "fine words", "worse bad bad"], [1, 0, 1, 0]
    got = qc.fit([t.encode() for t in texts], labels, 0.5).odds
    rng = np.random.default_rng(qc.SEED)
    table, layer = rng.uniform(-1 / qc.WIDTH, 1 / qc.WIDTH, (512, qc.WIDTH)), np.zeros((qc.WIDTH, 2))
    bags = [[0, *plain_features(t)] for t in texts]
    done, steps = 0, qc.EPOCHS * len(texts)
    for _ in range(qc.EPOCHS):
        for i in rng.permutation(len(texts)).tolist():
            rate, bag = qc.RATE * (1 - done / steps), bags[i]
            done += 1
            mean = sum(table[r] for r in bag) / len(bag)
            p = np.exp(mean @ layer) / np.exp(mean @ layer).sum()
            wrong = p - np.eye(2)[labels[i]]
            back = layer @ wrong
            layer = layer - rate * np.outer(mean, wrong)
            for r in set(bag):
                table[r] = table[r] - rate * np.sqrt(bag.count(r) / len(bag)) * back
    assert np.abs(got - np.rint(table @ (layer[:, 1] - layer[:, 0]) * 2**20)).max() <= 2


def test_held_out_accuracy_and_no_leak(spark):
    """On the supplied documents; what is held out may change its labels, lang and source without changing any result."""
    d = "/root/testdata/sf0.01"
    table = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    rows, labels = table("documents"), table("labels")
    found = {r.doc_id: r for r in identify(rows).collect()}
    truth = {r.doc_id: r.lang for r in rows.where("lang IS NOT NULL AND text RLIKE '[a-z]{3}'").collect()}
    held = [i for i, r in found.items() if r.held_out and i in truth]
    assert len(held) > 100 and sum(found[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    scored = {r.doc_id: r for r in classify(rows, labels).collect()}
    marks = {r.doc_id: r.quality for r in labels.where("quality IS NOT NULL").collect()}
    held = [i for i, r in scored.items() if r.held_out and i in marks]
    assert len(held) > 50 and sum(scored[i].predicted == marks[i] for i in held) >= 0.9 * len(held)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    swapped = rows.withColumns({"lang": F.when(fold, F.lit("zz")).otherwise(F.col("lang")), "source": F.lit("s")})
    assert {r.doc_id: r for r in identify(swapped).collect()} == found
    turned = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r for r in classify(swapped, turned).collect()} == scored


def test_language_of_long_documents_only(spark):
    """No document is left out of the sample for its length, with blanks or without any."""
    rng = random.Random(12)
    rows = [(i, said(rng, "abcde", 16_000), "aa") for i in range(8)] + [(i, said(rng, "vwxyz"), "vv") for i in range(100, 140)] + [(i, "".join(rng.choice("klmno") for _ in range(92_000)), "kk") for i in range(200, 208)]
    rows += [(300, said(rng, "abcde"), None), (301, said(rng, "klmno"), None)]
    found = {r.doc_id: r.lang_pred for r in identify(docs(spark, rows)).collect()}
    assert found == {i: x for i, _, x in rows if x} | {300: "aa", 301: "kk"}
    sample = references(docs(spark, rows), sample_chars=5_000)
    assert all(4_000 <= len(t) <= 7_500 for x, t in sample.items() if x != "vv")


def test_labels_between_the_kinds_are_left_out(spark):
    rng = random.Random(13)
    rows = [(i, said(rng, "abcde" if i % 2 else "vwxyz"), None) for i in range(100)]
    marks = [(i, float(i % 2)) for i in range(60)] + [(i, 0.7) for i in range(60, 100)]
    some = qc.train(docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality double"))
    only = qc.train(docs(spark, rows), spark.createDataFrame(marks[:60], "doc_id long, quality double"))
    assert (some.odds == only.odds).all()


def test_sample_bounds_are_arguments(spark):
    rng = random.Random(3)
    rows = docs(spark, [(i, said(rng, "abcde" if i % 2 else "vwxyz", 5), "aa" if i % 2 else "vv") for i in range(100)])
    few = references(rows, sample_docs=3)
    assert {x: len(t.split()) for x, t in few.items()} == {"aa": 15, "vv": 15}
    assert all(30 <= len(t) < 70 for t in references(rows, sample_chars=35).values())
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    whole, part = qc.train(rows, labels), qc.train(rows, labels, sample_bytes=100)
    assert (whole.odds != part.odds).any()
