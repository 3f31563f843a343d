"""One text beyond a shard, a batch and a chunk, through every operator on documents, beside short rows."""

import hashlib

import pytest

from tidewatch.llm import common
from tidewatch.llm.decontamination import decontaminate
from tidewatch.llm.jaccard_join import jaccard_join
from tidewatch.llm.language_id import identify
from tidewatch.llm.line_dedup import line_dedup
from tidewatch.llm.pieces import encode_documents
from tidewatch.llm.pii import pseudonymise
from tidewatch.llm.quality_classifier import classify
from tidewatch.llm.substring_dedup import substring_dedup

N = 900_000


@pytest.fixture(scope="module")
def long_text():
    text = " ".join(f"w{i}" for i in range(N))
    assert len(text) > common.SHARD_BYTES
    return text


@pytest.fixture(scope="module")
def docs(spark, long_text):
    return spark.createDataFrame([(1, long_text, "en"), (2, long_text + " end", "en"), (3, "short text", "en"), (4, None, None)], "doc_id long, text string, lang string").repartition(2).cache()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_substring_dedup(docs):
    out = by_id(substring_dedup(docs, window=35).drop("kept"))
    assert [(out[i].n_words, out[i].n_removed) for i in (1, 2, 3, 4)] == [(N, N), (N + 1, N), (2, 0), (0, 0)]
    assert out[2].kept_sha256 == hashlib.sha256(b"end").hexdigest()


def test_decontamination(spark, docs):
    item = " ".join(f"w{i}" for i in range(N - 20, N))
    out = by_id(decontaminate(docs, spark.createDataFrame([("a", item), ("b", "short")], "item_id string, text string")).drop("items"))
    assert [(out[i].n_words, out[i].n_hit, out[i].contaminated) for i in (1, 2, 3, 4)] == [(N, 20, False), (N + 1, 20, False), (2, 1, True), (0, 0, False)]


def test_jaccard_join(docs):
    out = by_id(jaccard_join(docs))
    assert [(out[i].n_shingles, out[i].component_id) for i in (1, 2, 3, 4)] == [(N - 4, 1), (N - 3, 1), (1, 3), (0, 4)]


def test_lines_languages_quality_and_values(spark, docs, long_text):
    assert {r.doc_id: r.n_removed for r in line_dedup(docs, whole=True).select("doc_id", "n_removed").collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert {r.doc_id: r.lang_pred for r in identify(docs).collect()}[4] == "und"
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in classify(docs, labels).collect())
    assert {r.doc_id: r.n_values for r in pseudonymise(docs, b"key").select("doc_id", "n_values").collect()} == {1: 0, 2: 0, 3: 0, 4: 0}


def test_encoding(docs):
    out = by_id(encode_documents(docs).select("doc_id", "lossless", "n_pieces"))
    assert all(r.lossless for r in out.values()) and out[1].n_pieces > N and out[4].n_pieces == 0
