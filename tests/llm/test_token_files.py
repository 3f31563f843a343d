import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import registry
from tidewatch.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


def folder(spark, tmp_path):
    return f"file://{tmp_path}/tokens"


def expected(rows):
    """(doc_id, start, ids) by the library itself, in ascending doc_id order."""
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, ids))
        start += len(ids)
    return out


def got(df):
    return [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in df.orderBy("start").collect()]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_numbers_round_trip(n):
    rng = np.random.default_rng(n)
    values = (rng.integers(0, 2**32, n, np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
    control, data = tf.encode_numbers(values)
    assert len(control) == -(-n // 4) and len(data) == sum(max(1, (int(v).bit_length() + 7) // 8) for v in values)
    assert np.array_equal(tf.decode_numbers(control, data, n), values)


def test_files_round_trip_and_damage():
    content = tf.pack_file([None, -5, 2**60], np.array([1, 0, 70_000]), np.arange(70_001))
    ids, sizes, values = tf.unpack_file(content)
    assert ids == [None, -5, 2**60] and sizes.tolist() == [1, 0, 70_000] and np.array_equal(values, np.arange(70_001))
    for bad in (content[:-1], content[:100], b"", content[:90] + bytes([content[90] ^ 1]) + content[91:]):
        with pytest.raises(ValueError):
            tf.unpack_file(bad)


ODD = [
    (-3, "<|endoftext|>x<|startoftext|> <|endoftext|>"), (0, None), (1, ""), (2, " \t\n\r\x0b\x0c"), (3, "It's I'll they'd 1234 é ́e  a b　c\x1c\x1d\x85d"),
    (4, "ΣΑΣ İstanbul ǅ ﬁ 漢字かな交じり文 👩‍👩‍👧"), (5, "a\x0bb\x0cc\rd"), (6, "word " * 5000), (7, "ab" * 60_000), (8, " ".join(f"w{i}" for i in range(30_000))), (9, "\x00\x01 ~"),
]


def test_every_id_against_the_library(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "SPLIT_BYTES", 1000)
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("key", F.lit("x")).repartition(3)
    manifest = tf.write_tokens(docs, folder(spark, tmp_path), PATH, 2, file_ids=20_000)
    assert manifest.count() > 2 and manifest.agg(F.sum("n_docs")).first()[0] == len(ODD)
    assert got(tf.read_tokens(spark, folder(spark, tmp_path))) == expected(ODD)


def test_repeated_rows_and_ids(spark, tmp_path):
    rows = [(None, "b"), (None, "b"), (None, None), (1, "same"), (1, "same"), (1, "other"), (2, "z")]
    tf.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), folder(spark, tmp_path), PATH, 2)
    out = got(tf.read_tokens(spark, folder(spark, tmp_path)))
    assert [d for d, _, _ in out] == [None, None, None, 1, 1, 1, 2]
    assert sorted((str(d), i) for d, _, i in out) == sorted((str(d), i) for d, _, i in expected(rows))
    assert [s for _, s, _ in out] == np.cumsum([0, *(len(i) for _, _, i in out[:-1])]).tolist()


def test_frequent_ids_are_short(spark, tmp_path):
    tf.write_tokens(spark.createDataFrame([(1, "rare " + "often " * 300)], "doc_id long, text string"), folder(spark, tmp_path), PATH, 2)
    ranks = tf.unpack_file((tmp_path / "tokens" / "ranks.tok").read_bytes())[2].tolist()
    often, rare = (Tokenizer.from_file(PATH).encode(w, add_special_tokens=False).ids[0] for w in ("often", "rare"))
    assert ranks == [often, *sorted([2, rare])]


def test_empty_table(spark, tmp_path):
    tf.write_tokens(spark.createDataFrame([], "doc_id long, text string"), folder(spark, tmp_path), PATH, 2)
    assert tf.read_tokens(spark, folder(spark, tmp_path)).collect() == []


def test_missing_file_is_an_error(spark, tmp_path):
    tf.write_tokens(spark.createDataFrame([(1, "a")], "doc_id long, text string"), folder(spark, tmp_path), PATH, 2)
    for f in (tmp_path / "tokens").glob("part-*"):
        f.unlink()
    with pytest.raises(Exception, match="part-"):
        tf.read_tokens(spark, folder(spark, tmp_path)).collect()


def test_registered_query(spark):
    d = "/root/testdata/sf0.001"
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    want = [(i, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, ids in expected(rows)]
    assert sorted(map(tuple, registry.op12_token_files(spark, d).collect())) == want


def test_marks_after_letters_are_encoded_apart(monkeypatch):
    """The tokenizer sees the letters of many words in one call, and each run of marks once, not each word with its marks."""
    encoder, seen = tf.Encoder(PATH), []
    plain = encoder._encoded
    monkeypatch.setattr(encoder, "_encoded", lambda texts: seen.extend(texts) or plain(texts))
    text = " ".join(f"{w}{m}" for w in ("stone", "bridge", "größe") for m in ("***", "$$$", "&&&", "'", ".,"))
    assert next(encoder.ids([text.encode()])).tolist() == expected([(0, text)])[0][2][:-1]
    assert not [t for t in seen if any(c.isalpha() for c in t) and any(c in "*$&'.," for c in t)]


def test_random_words_with_little_memory(monkeypatch):
    monkeypatch.setattr(tf, "MEMORY_BYTES", 300)
    monkeypatch.setattr(tf, "CALL_WORDS", 3)
    monkeypatch.setattr(tf, "SPLIT_BYTES", 200)
    rng = np.random.default_rng(5)
    parts = ["a", "stone", "Größe", "É", "×", "é", "'", "'s", "'ll", "$$", ".", "_", "7", "½", "ſ", "K", "<|endoftext|>", "<|", "|>", " ", "\x1c", " ", "  ", "\n", "\t"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 120))) for _ in range(300)]
    out = list(tf.Encoder(PATH).ids([t.encode() for t in texts]))
    assert [x.tolist() for x in out] == [ids[:-1] for _, _, ids in expected(enumerate(texts))]


@pytest.mark.parametrize(("end_id", "width"), [(2, 2), (70_000, 4)])
def test_blocks_count_their_ids(spark, end_id, width):
    docs = spark.createDataFrame([(i, "to be or not to be " * (i % 3)) for i in range(50)], "doc_id long, text string")
    blocks = tf.encoded(docs, PATH, end_id, file_ids=30)
    rows = blocks.collect()
    assert len(rows) > 4 and {r.width for r in rows} == {width}
    ids, n = np.unique(np.concatenate([np.frombuffer(r.ids, f"<u{width}") for r in rows]), return_counts=True)
    assert sorted(map(tuple, tf.id_counts(blocks).collect())) == list(zip(ids.tolist(), n.tolist(), strict=True)) and end_id in ids
