"""Corpus pipeline: quality, repeated lines, near duplicates, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import discard, stored
from tidewatch.llm.decontamination import decontaminate
from tidewatch.llm.jaccard_join import jaccard_join
from tidewatch.llm.line_dedup import line_dedup
from tidewatch.llm.pieces import encode_documents
from tidewatch.llm.quality_classifier import filter_quality


def _unlike(docs: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores in front as keep them apart from the columns of docs."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; a null text is judged as an empty one.

    Every row is judged by its own whole text, of any length, and stays or goes with all its columns, whatever
    their names; rows that are equal share their verdict; an empty table gives an empty result.
    """
    return filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), least=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages of lines; n_chars follows the text, and a null text stays null.

    No row goes; an empty text stays empty, a text of which nothing is left becomes empty; a text of any
    length is one row's work; input columns called n_lines and n_removed come back as the counts of this
    stage; an empty table gives an empty result.
    """
    done = line_dedup(docs)
    kinds = dict(docs.dtypes)
    kept = [F.coalesce(F.length("text").cast(kinds[c]), F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return done.select(*kept)


def _key() -> Column:
    """Both operators below judge a row by its text alone, so rows go by a 64-bit hash of their text, whatever their ids."""
    return F.xxhash64(F.col("text").cast("string"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: the one of least doc_id (null last), of equal ids the one of least text hash.

    Texts without words, null and empty ones included, link with nothing: of those, rows equal in doc_id and
    text count once, and rows without doc_id all stay. Texts of any length are compared whole; other columns
    may have any names; an empty table gives an empty result.
    """
    key, own, of = _unlike(docs, "key", "own", "of")
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    full, bare = docs.where(worded), docs.where(~worded)
    groups = jaccard_join(full.select(_key().alias("doc_id"), "text"), words=5).groupBy(F.col("doc_id").alias("of")).agg(F.min("component_id").alias("grouped"))
    least = full.groupBy(_key().alias("key")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("least"))
    chosen = least.join(groups, F.col("key") == F.col("of")).groupBy("grouped").agg(F.min(F.struct("least.none", "least.id", "key")).alias("r"))
    chosen = stored(chosen.select(F.col("r.id").alias(own), F.col("r.key").alias(of)), "representatives")
    keyed = full.withColumn(key, _key())
    named = keyed.where("doc_id IS NOT NULL").join(chosen, (F.col("doc_id") == F.col(own)) & (F.col(key) == F.col(of)), "left_semi").dropDuplicates(["doc_id", key])
    nameless = keyed.where("doc_id IS NULL").join(chosen.where(F.col(own).isNull()), F.col(key) == F.col(of), "left_semi").dropDuplicates([key])
    once = bare.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(bare.where("doc_id IS NULL"))
    return named.unionByName(nameless).drop(key).unionByName(once)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is not contaminated by the benchmark.

    Null and empty texts are clean; rows with the same text share their verdict, whatever their ids; whole
    texts of any length are searched; other columns may have any names; an empty table gives an empty
    result, and an empty benchmark leaves all rows.
    """
    (gone,) = _unlike(docs, "gone")
    judged = decontaminate(docs.select(_key().alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, share=20)
    found = stored(judged.where("contaminated").select(F.col("doc_id").alias(gone)).distinct(), "contaminated")
    return docs.join(found, _key() == F.col(gone), "left_anti")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces, n_pieces, the text that the pieces spell, and whether it is the one encoded."""
    return encode_documents(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminated), ("SentencePiece encoding", encoded)]

#: Trained scores and sampled pieces have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
        if before is not None:
            discard(before)
        before = docs
    return docs
