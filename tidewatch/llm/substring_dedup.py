"""Substring dedup with difference-cover anchors.

A difference cover D of the residues modulo v holds, for every difference d, two members that differ
by d. So two equal windows, wherever they start, share a shift k < v that brings both onto the cover,
and the sub-window of `window - v + 1` words at that shift is equal in both. Only sub-windows at
cover positions are hashed and exchanged. Windows around an anchor that occurs again are then
extended to full length and compared by 96 bits of hashes over 64-bit word hashes, again across the whole
corpus; words themselves are not compared.

Shards (groups of whole documents) hold each hash once, so that a passage repeated a million times
costs one entry per shard, and reducers answer with one bit per entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common

#: Perfect difference sets: every non-zero residue is a difference of two members in exactly one way.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Hashes that a reducer holds at once, on average.
BUCKET_KEYS = 4_000_000

_KEYS = "bucket int, shard long, lo binary, hi binary"
_MASKS = "shard long, stage int, bucket int, mask binary"
OUTPUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def period_for(window: int) -> int:
    """The longest period that leaves anchors of at least two fifths of the window."""
    return max(v for v in COVERS if window - v + 1 >= max(1, 2 * window // 5))


class _Shard:
    """What every pass computes again from a shard's text."""

    def __init__(self, sizes: bytes, body: bytes, window: int):
        self.words = [t.split() for t in common.unpack(sizes, body)]
        self.hashes, self.counts = common.hash_words(self.words)
        self.window, self.period = window, period_for(window)
        _, self.place, self.ends = common.spans(self.counts)
        self.at = np.arange(len(self.hashes))
        self.full = self.at + window <= self.ends

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        length = self.window - self.period + 1
        on_cover = np.isin(self.place % self.period, COVERS[self.period])
        starts = self.at[on_cover & (self.at + length <= self.ends) & ((self.ends - self.at + self.place) >= self.window)]
        return starts, common.window_hashes(self.hashes, starts, length)

    def candidates(self, starts: np.ndarray) -> np.ndarray:
        """Full windows that hold one of these anchors at a shift below the period."""
        mark = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(mark, np.maximum(starts - self.period + 1, starts - self.place[starts]), 1)
        np.add.at(mark, starts + 1, -1)
        return self.at[(np.cumsum(mark[:-1]) > 0) & self.full]


def _keyed(lo: np.ndarray, hi: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Distinct keys by bucket: (bucket, indices of one occurrence of each key, in key order)."""
    if not len(lo):
        return []
    bucket = (lo % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((hi, lo, bucket))
    b, x, y = bucket[order], lo[order], hi[order]
    order = order[np.r_[True, (b[1:] != b[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]]
    b = bucket[order]
    edges = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    return list(zip(b[edges].tolist(), np.split(order, edges[1:]), strict=True))


def _repeats(lo: np.ndarray, hi: np.ndarray, buckets: int, masks: dict[int, bytes]) -> np.ndarray:
    """Which entries occur again in the shard or, by the reducers' answers, in another one."""
    again = np.zeros(len(lo), bool)
    if not len(lo):
        return again
    order = np.lexsort((hi, lo))
    new = np.r_[True, (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])]
    group = np.empty(len(lo), np.int64)
    group[order] = np.cumsum(new) - 1
    found = np.bincount(group) > 1
    for bucket, first in _keyed(lo, hi, buckets):
        if bucket in masks:
            found[group[first[np.unpackbits(np.frombuffer(masks[bucket], np.uint8), count=len(first)).astype(bool)]]] = True
    return found[group]


def _sent(shard: int, lo: np.ndarray, hi: np.ndarray, buckets: int, tag_only: bool) -> pa.RecordBatch:
    """Anchors travel as 32-bit tags within their bucket (a chance match only adds a candidate), windows as 96 bits on top of it."""
    rows = _keyed(lo, hi, buckets)
    low = [(lo[i] >> np.uint64(32)).astype(np.uint32) if tag_only else lo[i] for _, i in rows]
    high = [b"" if tag_only else (hi[i] >> np.uint64(32)).astype(np.uint32).tobytes() for _, i in rows]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([shard] * len(rows), pa.int64()), pa.array([x.tobytes() for x in low], pa.binary()), pa.array(high, pa.binary())], ["bucket", "shard", "lo", "hi"])


def _answer(stage: int):
    def repeated(table: pa.Table) -> pa.Table:
        shards, bucket = table["shard"].to_pylist(), table["bucket"][0].as_py()
        lows = [np.frombuffer(x, np.uint64 if stage else np.uint32) for x in table["lo"].to_pylist()]
        lo = np.concatenate(lows)
        hi = np.concatenate([np.frombuffer(x, np.uint32) for x in table["hi"].to_pylist()]) if stage else None
        order = np.lexsort((hi, lo)) if stage else np.argsort(lo, kind="stable")
        x = lo[order]
        same = x[1:] == x[:-1]
        if stage:
            same &= hi[order][1:] == hi[order][:-1]
        twice = np.zeros(len(lo), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        out, at = [], 0
        for shard, part in zip(shards, lows, strict=True):
            mask = twice[at : at + len(part)]
            at += len(part)
            if mask.any():
                out.append((shard, stage, bucket, np.packbits(mask).tobytes()))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["shard", "stage", "bucket", "mask"])

    return repeated


def _by_stage(masks: pa.Table) -> tuple[dict[int, bytes], dict[int, bytes]]:
    found: tuple[dict, dict] = ({}, {})
    for row in masks.to_pylist():
        found[row["stage"]][row["bucket"]] = row["mask"]
    return found


def substring_dedup(docs: DataFrame, window: int = 35) -> DataFrame:
    """Remove every word covered by a window of words that also starts elsewhere in the corpus.

    Words are runs of bytes other than ASCII white space. All windows are judged on the input. Returns
    one row per input row: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by a
    space). A null or empty text has no words and keeps the digest of the empty string; a text shorter
    than the window keeps everything; repeated rows (even of one doc_id) count as places of their own, so
    equal rows lose the same words; a text beyond the size of a shard makes one of its own and is judged
    whole; an empty table gives an empty result; other columns are ignored.
    """
    packs = common.packed(docs, "substring-packs")
    total = packs.agg(F.sum(F.octet_length("body")).alias("n")).first().n or 0
    # Compressed text holds about one word in three bytes.
    n_words = total // 3 + 1
    parts = common.part_count(docs.sparkSession)
    cover = len(COVERS[period_for(window)]) / period_for(window)
    buckets = (max(parts, int(n_words * cover) // BUCKET_KEYS + 1), max(parts, n_words // BUCKET_KEYS + 1))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, lo = _Shard(row["sizes"], row["body"], window).anchors()
                yield _sent(row["shard"], lo, np.zeros_like(lo), buckets[0], True)

    def found(pack: pa.Table, masks: pa.Table):
        row = pack.to_pylist()[0]
        shard = _Shard(row["sizes"], row["body"], window)
        stages = _by_stage(masks)
        starts, lo = shard.anchors()
        starts = shard.candidates(starts[_repeats(lo, np.zeros_like(lo), buckets[0], stages[0])])
        return row, shard, starts, *(common.window_hashes(shard.hashes, starts, window, k) for k in (0, 1)), stages[1]

    def windows(pack: pa.Table, masks: pa.Table) -> pa.Table:
        if not len(pack):
            return pa.Table.from_batches([_sent(0, np.zeros(0, np.uint64), np.zeros(0, np.uint64), 1, False)])
        row, _, _, lo, hi, _ = found(pack, masks)
        return pa.Table.from_batches([_sent(row["shard"], lo, hi >> np.uint64(32) << np.uint64(32), buckets[1], False)])

    def kept(pack: pa.Table, masks: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(pack):
            row, shard, starts, lo, hi, answers = found(pack, masks)
            starts = starts[_repeats(lo, hi >> np.uint64(32) << np.uint64(32), buckets[1], answers)]
            cover = np.zeros(len(shard.hashes) + 1, np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + window, -1)
            keep = np.cumsum(cover[:-1]) == 0
            at = 0
            for doc_id, words in zip(row["doc_ids"], shard.words, strict=True):
                mask = keep[at : at + len(words)]
                at += len(words)
                text = b" ".join(words if mask.all() else compress(words, mask.tolist()))
                out.append((doc_id, len(words), int(len(words) - mask.sum()), hashlib.sha256(text).hexdigest(), text))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
        return pa.Table.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    keys = packs.select("shard", "sizes", "body").mapInArrow(anchors, _KEYS)
    first = common.stored(keys.groupBy("bucket").applyInArrow(_answer(0), _MASKS), "substring-anchors")
    grouped = packs.groupBy("shard")
    keys = grouped.cogroup(first.groupBy("shard")).applyInArrow(windows, _KEYS)
    second = common.stored(keys.groupBy("bucket").applyInArrow(_answer(1), _MASKS), "substring-windows")
    done = grouped.cogroup(first.unionByName(second).groupBy("shard")).applyInArrow(kept, OUTPUT.replace("kept_text string", "kept_text binary"))
    return done.withColumn("kept_text", F.col("kept_text").cast("string"))
