"""Exact top-k inner products over integer vectors.

Vectors are packed into blocks by descending length. A rotation from the singular value decomposition
of the data (by its Gram matrix, summed over all rows) moves most of each product into the first
coordinates. A block is skipped for a query when the lengths alone rule it out (Cauchy-Schwarz); within
a block, the partial product over the leading coordinates plus the product of the residual lengths
bounds each score, and only rows whose bound reaches the query's threshold are scored exactly. The
threshold is the k-th score among the longest vectors, found first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm import common

#: Vectors in a block of candidates, and queries in a block.
BLOCK, QUERY_BLOCK = 8192, 1024
#: Share of the squared length that the leading coordinates should hold.
LEADING = 0.8
#: Integer scores below this are exact in double precision.
_EXACT = float(1 << 53)


def _vectors(df: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v array<long>, norm2 double) of the rows that take part."""
    x = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where(
        "vec_id IS NOT NULL AND x IS NOT NULL AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))"
    )
    v = x.select("vec_id", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c)).alias("v"))
    return v.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


def _pack(kind: str, rows: DataFrame, size: int, width: int, seq: DataFrame | None = None) -> DataFrame:
    """Blocks of up to `size` rows: block, ids, matrix."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held_ids: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def flush(ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            longest = float(np.sqrt((m.astype(np.float64) ** 2).sum(1)).max(initial=0.0))
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | n], pa.int64()), pa.array([longest]), pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["block", "longest", "ids", "matrix"])

        for batch in batches:
            ids = batch["vec_id"].to_numpy()
            lists = batch["v"]
            lengths = np.diff(lists.offsets.to_numpy())
            m = np.zeros((len(ids), width), np.int64)
            flat = lists.flatten().to_numpy()
            at = np.repeat(np.arange(len(ids)), lengths)
            m[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
            held_ids.append(ids)
            held.append(m)
            while sum(map(len, held_ids)) >= size:
                ids, m = np.concatenate(held_ids), np.concatenate(held)
                yield flush(ids[:size], m[:size])
                held_ids, held, n = [ids[size:]], [m[size:]], n + 1
        if sum(map(len, held_ids)):
            yield flush(np.concatenate(held_ids), np.concatenate(held))

    return common.stored(rows.select("vec_id", "v").mapInArrow(pack, "block long, longest double, ids binary, matrix binary"), kind)


def _unpacked(row: dict, prefix: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row[f"{prefix}ids"], np.int64), np.frombuffer(row[f"{prefix}matrix"], np.int64).reshape(-1, width)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; in double precision where that is exact."""
    if np.abs(q).sum(1, dtype=np.float64).max(initial=0) * np.abs(c).max(initial=0) < _EXACT:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q @ c.T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _search(k: int, width: int, rotation: np.ndarray, lead: int, seeded: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qids, q = _unpacked(row, "q_", width)
                cids, c = _unpacked(row, "", width)
                # A query with fewer than k scores so far has no threshold.
                floor = np.frombuffer(row["floors"], np.float64) if seeded else np.full(len(qids), -np.inf)
                rq, rc = q.astype(np.float64) @ rotation, c.astype(np.float64) @ rotation
                nq, nc = np.sqrt((rq**2).sum(1)), np.sqrt((rc**2).sum(1))
                slack = 1e-6 * (1 + nq.max(initial=0) * nc.max(initial=0))
                live = np.flatnonzero(nq * nc.max(initial=0) + slack >= floor)
                tail_q, tail_c = np.sqrt((rq[:, lead:] ** 2).sum(1)), np.sqrt((rc[:, lead:] ** 2).sum(1))
                out_q, out_c, out_s = [], [], []
                for part in np.array_split(live, max(1, len(live) // 128)):
                    bound = rq[part, :lead] @ rc[:, :lead].T + tail_q[part, None] * tail_c + slack
                    columns = np.flatnonzero((bound >= floor[part, None]).any(0))
                    scores = _scores(q[part], c[columns])
                    for i, s in zip(part.tolist(), scores, strict=True):
                        keep = np.flatnonzero((s >= floor[i]) & (cids[columns] != qids[i]))
                        keep = keep[_best(cids[columns[keep]], s[keep], k)]
                        out_q.append(np.full(len(keep), qids[i]))
                        out_c.append(cids[columns[keep]])
                        out_s.append(s[keep])
                arrays = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_c, out_s)]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in arrays], ["query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, k: int = 5, scale: int = 256, every: int = 50) -> DataFrame:
    """The k best inner products of each query among all other rows.

    A component x counts as floor(scale * x), x as double. Queries are rows whose vec_id is divisible by
    `every`. Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, and fewer than k
    other rows give fewer results. Rows with a null id or vector, or with a null or non-finite component,
    take no part; missing components of shorter vectors count as 0; an id that repeats is searched for
    once per distinct vector it has, its own rows are never its results and rows equal in id and score
    are reported once; scores are 64-bit; an empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    common.bounded_batches(spark)
    rows = common.stored(_vectors(vectors, scale).distinct(), "vectors")
    width = rows.agg(F.max(F.size("v")).alias("n")).first().n or 0
    if not width:
        width = 1

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for row in batch.to_pylist():
                m = _unpacked(row, "", width)[1].astype(np.float64)
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["cell", "x"])

    ordered = rows.orderBy(F.desc("norm2"), "vec_id")
    blocks = _pack("candidate-blocks", ordered, BLOCK, width)
    queries = _pack("query-blocks", rows.where(F.pmod("vec_id", F.lit(every)) == 0), QUERY_BLOCK, width)
    queries = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns))
    # width * width sums, whatever the number of rows.
    cells = blocks.select("ids", "matrix").mapInArrow(gram, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(width * width)
    for cell in cells:
        total[cell.cell] = cell.x
    values, rotation = np.linalg.eigh(total.reshape(width, width))
    rotation, values = rotation[:, ::-1], np.maximum(values[::-1], 0)
    lead = int(np.searchsorted(np.cumsum(values), LEADING * values.sum())) + 1 if values.sum() else 1

    # The block with the longest vectors gives every query a threshold.
    first = blocks.orderBy(F.desc("longest"), "block").limit(1)
    schema = "query_id long, vec_id long, score long"
    seed = queries.join(F.broadcast(first)).mapInArrow(_search(k, width, rotation, lead, False), schema)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    seed = common.stored(seed.distinct(), "seed-scores")
    floors = seed.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))

    def with_floors(block: pa.Table, known: pa.Table) -> pa.Table:
        if not len(block):
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.float64())], ["q_block", "q_longest", "q_ids", "q_matrix", "floors", "least"])
        row = block.to_pylist()[0]
        found = dict(zip(known["query_id"].to_pylist(), known["floor"].to_pylist(), strict=True))
        floor = np.array([found.get(i, -np.inf) for i in np.frombuffer(row["q_ids"], np.int64).tolist()], np.float64)
        return block.append_column("floors", pa.array([floor.tobytes()], pa.binary())).append_column("least", pa.array([floor.min()]))

    ids = queries.mapInArrow(_ids, "q_block long, query_id long")
    known = ids.join(floors, "query_id").select("q_block", "query_id", "floor")
    staged = queries.groupBy("q_block").cogroup(known.groupBy("q_block")).applyInArrow(with_floors, "q_block long, q_longest double, q_ids binary, q_matrix binary, floors binary, least double")
    staged = common.stored(staged, "queries-with-floors")
    others = blocks.join(first.select(F.col("block").alias("seen")).distinct(), F.col("block") == F.col("seen"), "left_anti")
    # Stated queries against all rows, block by block: descriptors pair up where the lengths leave a chance, and matrices follow to one task per pair.
    chance = F.col("q_longest") * F.col("longest") * (1 + 1e-6) + 1e-6 >= F.col("least")
    pairs = staged.select("q_block", "q_longest", "least").join(others.select("block", "longest"), chance).select("q_block", "block")
    parts = max(1, common.part_count(spark))
    work = pairs.repartition(parts, "q_block", "block").join(staged.drop("least"), "q_block").join(others, "block")
    rest = work.mapInArrow(_search(k, width, rotation, lead, True), schema)
    merged = seed.unionByName(rest).distinct().withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["q_ids"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["q_block"])), pa.array(ids)], ["q_block", "query_id"])
