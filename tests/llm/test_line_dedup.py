import random

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import line_dedup as ld


def brute(spark, rows, extended=True):
    """Chunks by the operator's boundaries; repeats, their extension over neighbouring chunks and removal by plain Python."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.col("text").alias("__text"))
    parts = {(r.doc_id, r.key): (r["tt"], r["__chunks"]) for r in ld.chunked(df.withColumn("tt", F.col("__text"))).collect()}
    bare = lambda x: not x.strip("\n\t\r ")
    docs, chunks, by_text = {}, {}, {}
    for (d, k), (text, found) in parts.items():
        at = (d is not None, d or 0, k)
        assert text is None or "\n".join(x for c in found for x in c) == text
        docs[at], chunks[at] = [x for c in found for x in c], []
        start = 0
        for c in found:
            chunks[at].append((start, len(c)))
            if len(c) > 1 and not bare("\n".join(c)):
                by_text.setdefault(tuple(c), []).append((*at, start))
            start += len(c)
    first = {c: min(places) for c, places in by_text.items()}
    lost = {p for c, places in by_text.items() for p in places if p != first[c]}

    def beside(p, step):
        """Lines of the two chunks before (nearest first) or after a place, up to one that is lost."""
        own, out = chunks[p[:3]], []
        i = next(i for i, (s, _) in enumerate(own) if s == p[3]) + step
        while 0 <= i < len(own) and (*p[:3], own[i][0]) not in lost and abs(i - next(i for i, (s, _) in enumerate(own) if s == p[3])) <= 2:
            lines = docs[p[:3]][own[i][0] : own[i][0] + own[i][1]]
            out += lines[::-1] if step < 0 else lines
            i += step
        return out

    gone, rest = set(), set()
    for c, places in by_text.items():
        for p in set(places) & lost:
            n = []
            for step in (-1, 1) if extended else ():
                same = []
                for x, y in zip(beside(p, step), beside(first[c], step)):
                    if x != y:
                        break
                    same.append(x)
                while same and bare(same[-1]):
                    same.pop()
                n.append(len(same))
            n = n or [0, 0]
            span = range(-n[0], len(c) + n[1])
            gone |= {(p[:3], p[3] + i) for i in span}
            rest |= {(first[c][:3], first[c][3] + i) for i in span}
    gone -= rest
    out = {}
    for at, lines in docs.items():
        (text, _), d = parts[at[1] if at[0] else None, at[2]], at[1] if at[0] else None
        keep = [x for i, x in enumerate(lines) if (at, i) not in gone]
        out[d, text] = ("\n".join(keep) if text is not None else None, len(lines), len(lines) - len(keep))
    return sorted(((d, *out[d, t]) for d, t, _ in rows), key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "text", "n_lines", "n_removed").collect()), key=str)


def cases():
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice("abcdefghijkl") for _ in range(4))
    passage = [line() for _ in range(12)]
    rows = []
    for i in range(50):
        own = [line() for _ in range(rng.randint(1, 9))]
        if i % 2:
            at = rng.randint(0, len(own))
            own[at:at] = passage if i % 3 else passage + passage
        rows.append((i, "\n".join(own), "en"))
    return [*rows, (60, None, None), (61, "", "x"), (62, "\n\n\n\n\n", "x"), (62, "\n\n\n\n\n", "x"), (None, rows[1][1], "x"), (63, rows[3][1], "y"), (63, rows[3][1], "y"), (63, rows[5][1], None), (64, "a\r\nb\r\n" * 30, None)]


def test_against_brute_force(spark):
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n_lines", F.lit("old")).withColumn("chunk", F.lit(1)).withColumn("hash", F.lit(2)).repartition(3)
    done = ld.line_dedup(df)
    assert done.columns == ["doc_id", "text", "lang", "chunk", "hash", "n_lines", "n_removed"]
    assert got(done) == brute(spark, rows)
    assert sum(r.n_removed for r in done.collect()) > 100


def test_clashing_hashes_are_told_apart(spark, monkeypatch):
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want, real = brute(spark, rows, extended=False), F.xxhash64
    # A weak hash for chunk bodies only: a single argument named body. Chunks that clash go without their neighbours' lines.
    monkeypatch.setattr(ld.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(5)) if isinstance(c[0], str) and c[0] == "body" else real(*c))
    assert got(ld.line_dedup(df)) == want


def test_empty_table(spark):
    assert got(ld.line_dedup(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_supplied_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    assert got(ld.line_dedup(docs)) == brute(spark, rows)


def planted():
    rng = random.Random(7)
    line = lambda: " ".join(str(rng.randint(0, 10**6)) for _ in range(3))
    passages = {n: [[line() for _ in range(n)] for _ in range(6)] for n in range(2, 13)}
    rows, lengths = [], {}
    for copy in range(2):
        for n, found in passages.items():
            for p in found:
                lengths[len(rows)] = n if copy else 0
                rows.append((len(rows), "\n".join([line() for _ in range(rng.randint(1, 4))] + p + [line() for _ in range(rng.randint(1, 4))]), "x"))
    return rows, lengths


def test_planted_passages(spark):
    """A passage that holds a whole chunk goes to its ends: those of ten lines or more always, and most others."""
    rows, lengths = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    done = ld.line_dedup(df).collect()
    assert got(ld.line_dedup(df)) == brute(spark, rows)
    assert all(r.n_removed in (0, lengths[r.doc_id]) for r in done)
    assert all(r.n_removed == n for r, n in ((r, lengths[r.doc_id]) for r in done) if n >= 10 or not n)
    assert sum(r.n_removed for r in done) > 0.7 * sum(lengths.values())


def test_first_place_keeps_the_passage(spark):
    rows = [(1, "W\nX", "x"), (2, "A\nQ", "x"), (3, "W\nX\nA\nQ", "x"), (4, "X\nA", "x"), (5, "X\nA", "x")]
    out = {r.doc_id: r.text for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (out[1], out[2], out[4], out[5]) == ("W\nX", "A\nQ", "X\nA", "")
    assert out[3] in ("", "W\nX\nA\nQ")


def test_boundaries_decide(spark, monkeypatch):
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = got(ld.line_dedup(df))
    monkeypatch.setattr(ld, "_may_end", lambda rolled, i, last: F.lit(False))
    assert sum(r[3] for r in got(ld.line_dedup(df))) < sum(r[3] for r in want)


@pytest.mark.parametrize("seed", range(4))
def test_every_lost_run_stands_elsewhere(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", "d"] if seed else ["a", "b"]) for _ in range(rng.randint(1, 14))), "x") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    out = {r.doc_id: r for r in ld.line_dedup(df).collect()}
    assert got(ld.line_dedup(df)) == brute(spark, rows)
    assert sum(r.n_removed for r in out.values()) > 30


def test_whole_repeats_over_blank_lines(spark):
    long = "\n".join(f"line {i}" + "\n" * (i % 3) for i in range(12))
    rows = [(1, long, "x"), (2, "own\n\n" + long + "\n\nend", "x"), (6, None, "x"), (None, "p\nq", "x"), (7, "p\nq", "x")]
    out = {r.doc_id: r.text for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert out == {1: long, 2: "own\n\n\n\n\nend", 6: None, None: "p\nq", 7: ""}


def test_chunks_have_two_lines_at_least(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("__text", F.col("text"))
    assert ld.chunked(docs).where("size(split(text, '\n')) > 1 and exists(__chunks, c -> size(c) < 2)").count() == 0
