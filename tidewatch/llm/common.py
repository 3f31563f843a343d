"""Shared by the operators: stored intermediate tables, word hashes and packed shards."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw text bytes per shard. A single longer text makes a shard of its own.
SHARD_BYTES = 6_000_000
#: A document's place within its shard takes so many bits, so that shard and place make one long.
ORD_BITS = 20
SHARD_BITS = 20

PACK_SCHEMA = "shard long, doc_ids array<long>, sizes binary, body binary"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Where it names none, one machine with all executors in it gets a temporary folder; a cluster gets an error."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.conf.set("spark.checkpoint.dir", os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex))
    return spark.conf.get("spark.checkpoint.dir")


#: Removes a finished query's shuffle files, which else stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of one key up to which no key counts as heavy.
HEAVY_ROWS = 256


def join_counted(rows: DataFrame, facts: DataFrame, key: str, total: int, keep: bool = False) -> DataFrame:
    """rows joined with facts, which has one row per key and counts rows in its column `rows`, out of `total`.

    A key that holds more than an eighth of a task's fair share is heavy; there are at most eight per task,
    so their facts go to all tasks and their rows stay where they are. Both tables should be stored. `keep` keeps
    the count.
    """
    least = max(HEAVY_ROWS, total // (8 * part_count(rows.sparkSession)))
    heavy, light = facts.where(F.col("rows") > least), facts.where(F.col("rows") <= least)
    met = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    both = met.unionByName(rest.join(light, key))
    return both if keep else both.drop("rows")


def bounded_batches(spark: SparkSession, n_bytes: int = 16 << 20) -> None:
    """Arrow batches by bytes, so that very long texts don't meet in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(n_bytes))


def part_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The id and the text's UTF-8 bytes; other columns stay out, whatever their names."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def pack_batches(batches: Iterator[pa.RecordBatch], extra=None, shard_bytes: int = SHARD_BYTES) -> Iterator[pa.RecordBatch]:
    """One row per shard of whole documents, text compressed; extra(texts) adds columns (name -> Arrow array of one row)."""
    from pyspark import TaskContext

    base, seq = TaskContext.get().partitionId() << SHARD_BITS, 0
    ids: list = []
    texts: list[bytes] = []
    held = 0

    def flush() -> pa.RecordBatch:
        columns = {
            "shard": pa.array([base + seq], pa.int64()),
            "doc_ids": pa.array([ids], pa.list_(pa.int64())),
            "sizes": pa.array([np.fromiter(map(len, texts), np.int64, len(texts)).tobytes()], pa.binary()),
            "body": pa.array([pa.Codec("zstd", 1).compress(b"".join(texts), asbytes=True)], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns | (extra(texts) if extra else {}))

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or b""
            if texts and (held + len(text) > shard_bytes or len(texts) == 1 << ORD_BITS):
                yield flush()
                ids, texts, held, seq = [], [], 0, seq + 1
            ids.append(doc_id)
            texts.append(text)
            held += len(text)
    if texts:
        yield flush()


def packed(df: DataFrame, tag: str) -> DataFrame:
    """df's documents as stored shards. A shard is fixed once written, so that later passes agree on it."""
    bounded_batches(df.sparkSession)
    return stored(texts_of(df).mapInArrow(pack_batches, PACK_SCHEMA), tag)


def unpack(sizes: bytes, body: bytes) -> list[bytes]:
    lengths = np.frombuffer(sizes, np.int64)
    total = int(lengths.sum())
    raw = pa.Codec("zstd").decompress(body, decompressed_size=total, asbytes=True) if total else b""
    ends = np.cumsum(lengths).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def hash_words(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all documents' words in a row, and each document's number of words."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(counts.sum())), counts


#: Odd multipliers of two independent rolling hashes, and the inverses modulo 2^64.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    out[1:] = base & _MASK
    np.multiply.accumulate(out, out=out)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that any part of the bits can serve as a bucket."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, starts: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Rolling hash of the `length` hashes from each start: a polynomial modulo 2^64, made independent of the start."""
    base = MULTIPLIERS[which]
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers(base, len(hashes))[: len(hashes)], out=sums[1:])
    back = _powers(pow(base, -1, 1 << 64), len(hashes))
    return mixed((sums[starts + length] - sums[starts]) * back[starts])


def spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: its document's number, its place in the document, and where the document ends."""
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(int(counts.sum())) - (ends - counts)[doc]
    return doc, place, ends[doc]
