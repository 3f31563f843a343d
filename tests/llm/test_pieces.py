import math
from collections import Counter

import numpy as np

from tidewatch.llm import pieces as P

SCHEMA = "doc_id long, text string"


def small(extra=()):
    names = [b" ", b"a", b"b", b"ab", b" a", b"ba", b"bab", "é".encode(), "éa".encode(), *extra]
    surface = tuple([*names, *(bytes([i]) for i in range(256))])
    weights = -np.log(2.0 + np.arange(len(surface)))
    return P.Vocabulary.of({p: i for i, p in enumerate(names)}, weights, np.arange(256) + len(names), surface)


def ways(text: bytes, v: P.Vocabulary):
    """All segmentations with their weights, by recursion over characters."""
    own = {s: i for i, s in enumerate(v.surface[: len(v.surface) - 256])}

    def rest(at):
        if at == len(text):
            yield (), 0.0
            return
        for s, i in own.items():
            if text.startswith(s, at):
                for tail, w in rest(at + len(s)):
                    yield (i, *tail), w + v.weights[i]
        size = next(n for n in range(1, 5) if at + n == len(text) or text[at + n] & 0xC0 != 0x80)
        if text[at : at + size] not in own:
            ids = [int(v.bytes_[b]) for b in text[at : at + size]]
            for tail, w in rest(at + size):
                yield (*ids, *tail), w + sum(v.weights[i] for i in ids)

    return {ids: math.exp(w) for ids, w in rest(0)}


def test_samples_follow_the_lattice():
    for v in (small(), small([b"b a"])):
        for text in (b"abab", "xéab".encode(), b"b a\nab"):
            want = ways(b" " + text, v)
            n = 6000
            got = Counter(tuple(r.tolist()) for r in P.Sampler(v).encode([text] * n, list(range(n))))
            assert set(got) <= set(want)
            total = sum(want.values())
            for ids, w in want.items():
                p = w / total
                assert abs(got[ids] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 3


def test_long_parts_follow_the_same_lattice(monkeypatch):
    v, n = small(), 4000
    text = "abé".encode()
    want = ways(b" " + text, v)
    monkeypatch.setattr(P, "LONG_PART", 0)
    monkeypatch.setattr(P, "BLOCK", 2)
    got = Counter(tuple(r.tolist()) for r in P.Sampler(v).encode([text] * n, list(range(n))))
    for ids, w in want.items():
        p = w / sum(want.values())
        assert abs(got[ids] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 3


TEXTS = ["Hello world", "a", "  x  y\n\n z ▁▁ é😀\t", "", " ", "x" * 3000, "é" * 900 + "😀" * 90, "\0a\0 b\0", "\n", "le la les " * 5000]


def test_lossless_and_independent_of_grouping():
    v = P.Vocabulary.load(P.MODEL)
    raw = [t.encode() for t in TEXTS] + [b"\x80\xff abc\xc3 \xe2\x96 " + bytes(range(256)) * 3]
    keys = [P.row_key(i, t, 5) for i, t in enumerate(raw)]
    one = P.Sampler(v).encode(raw, keys)
    for ids, t, k in zip(one, raw, keys, strict=True):
        assert P.decode(ids, v.surface) == t
        assert np.array_equal(ids, P.Sampler(v).encode([t], [k])[0])


def test_rows(spark):
    rows = [*enumerate(TEXTS), (90, None), (None, "no id"), (None, "no id"), (1, "a")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "0 AS pieces", "0 AS n_pieces").repartition(3)
    done = P.encode_documents(df).collect()
    assert len(done) == len(rows) and all(r.lossless for r in done)
    assert Counter((r.doc_id, r.text) for r in done) == Counter(rows)
    by = {r.doc_id: r for r in done}
    assert by[90].pieces is None and by[3].pieces == [] and by[90].n_pieces == 0
    encoded = P.encode_pieces(df)
    assert {(r.doc_id, tuple(r.pieces or [])) for r in encoded.collect()} == {(r.doc_id, tuple(r.pieces or [])) for r in done}
    assert Counter((r.doc_id, r.text) for r in P.decode_pieces(encoded).collect()) == Counter(rows)
    other = P.encode_documents(df, seed=1).collect()
    assert {tuple(r.pieces or []) for r in other} != {tuple(r.pieces or []) for r in done}
    assert P.encode_documents(spark.createDataFrame([], SCHEMA)).collect() == []
