"""The numbered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import chat_format, conversation_repair, oracles
from tidewatch.llm.common import checkpoint_dir
from tidewatch.llm.decontamination import decontaminate
from tidewatch.llm.jaccard_join import jaccard_join
from tidewatch.llm.language_id import identify
from tidewatch.llm.line_dedup import line_dedup
from tidewatch.llm.pieces import encode_documents
from tidewatch.llm.pii import pseudonymise
from tidewatch.llm.quality_classifier import classify
from tidewatch.llm.spelling import spelling_variants
from tidewatch.llm.substring_dedup import substring_dedup
from tidewatch.llm.token_files import read_tokens, write_tokens
from tidewatch.llm.topk_search import top_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=5, scale=256, every=50)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, share=20).drop("items")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under a key for examples; whoever uses the operator passes a secret one."""
    return pseudonymise(table(spark, sf_dir, "documents"), b"tidewatch example key")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat_format.digest(chat_format.chat_format(turns.unionByName(extra)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), words=5)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the pieces and of the text decoded from them."""
    done = encode_documents(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_pieces", F.sha2(F.array_join("pieces", ","), 256).alias("pieces_sha256"), F.sha2("text", 256).alias("text_sha256"), "lossless")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), least=0.3)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), least_length=5, least_count=3, damage=97)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are written to a folder of this run below the shared one, and read back."""
    from public_tokenizers import path

    folder = f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), folder, path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.digest(*conversation_repair.repair(turns))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_topk_search, op3_decontamination, op4_pii, op5_line_dedup, op6_chat_format, op7_language_id, op8_jaccard_join, op9_sentencepiece, op10_quality_classifier, op11_spelling_variants, op12_token_files, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op2_topk_search": oracles.TOPK_SEARCH,
        "op3_decontamination": oracles.DECONTAMINATION,
        "op6_chat_format": chat_format.oracle(),
        "op8_jaccard_join": oracles.JACCARD_JOIN,
        "op11_spelling_variants": oracles.SPELLING_VARIANTS,
        "op13_conversation_repair": oracles.CONVERSATION_REPAIR,
    }
