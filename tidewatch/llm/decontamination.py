"""Benchmark decontamination over a distributed positional inverted index.

The index holds training token postings: per shard of whole documents and per term, the sorted places
of that term. Places are numbered through the shard, with a gap between documents, so that one sorted
list says both document and position and no phrase can span two documents. A phrase is found by
intersecting its terms' lists, each moved back by the term's offset, from the rarest term on;
proximity is the same with a tolerance. Shards are independent, so the search moves the index once
and never the texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import common

#: Free places between two documents of a shard: at least a phrase's length plus its slop.
GAP = 1024
#: Benchmark words that one search takes at a time; a longer benchmark is searched in blocks.
BLOCK_WORDS = 300_000

INDEX_SCHEMA = "shard long, term binary, places binary"

_FOLD = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def fold_words(text: bytes | None) -> list[bytes]:
    """Words of digits, ASCII letters (lower-cased) and everything outside ASCII."""
    return (text or b"").translate(_FOLD).split()


def _coded(places: np.ndarray) -> bytes:
    """A sorted list as 32-bit steps, which compress well."""
    return np.diff(places, prepend=0).astype(np.uint32).tobytes()


def _index_packs(vocabulary: dict[bytes, int] | None):
    """Postings of each shard; with a vocabulary only of its terms. A row with a null term lists the shard's documents."""

    def index(packs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in packs:
            for row in pack.to_pylist():
                words = [fold_words(t) for t in common.unpack(row["sizes"], row["body"])]
                counts = np.fromiter(map(len, words), np.int64, len(words))
                bases = np.cumsum(counts + GAP) - (counts + GAP)
                flat = chain.from_iterable(words)
                if vocabulary is None:
                    terms = defaultdict(lambda: len(terms))
                    ids = np.fromiter(map(terms.__getitem__, flat), np.int64, int(counts.sum()))
                else:
                    terms = vocabulary
                    ids = np.fromiter(map(terms.get, flat, repeat(-1)), np.int64, int(counts.sum()))
                kept = np.flatnonzero(ids >= 0)
                order = kept[np.argsort(ids[kept], kind="stable")]
                places = order + np.repeat(bases - (np.cumsum(counts) - counts), counts)[order]
                ids, names = ids[order], list(terms)
                edges = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
                # The documents come as one list: id present, id, base, number of words.
                docs = np.array([[d is not None for d in row["doc_ids"]], [d or 0 for d in row["doc_ids"]], bases, counts], np.int64)
                out_terms = [None, *(names[i] for i in ids[edges].tolist())]
                out_places = [docs.tobytes(), *(_coded(p) for p in np.split(places, edges[1:]) if len(edges))]
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(out_terms), pa.int64()), pa.array(out_terms, pa.binary()), pa.array(out_places, pa.binary())], ["shard", "term", "places"])

    return index


def build_index(docs: DataFrame, vocabulary: list[bytes] | None = None) -> DataFrame:
    """A stored positional index of docs (doc_id, text): shard, term, places."""
    common.bounded_batches(docs.sparkSession)
    index = _index_packs(None if vocabulary is None else {t: i for i, t in enumerate(vocabulary)})
    return common.stored(common.texts_of(docs).mapInArrow(lambda it: index(common.pack_batches(it)), INDEX_SCHEMA), "postings")


def _index_of_packs(packs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    return common.stored(packs.mapInArrow(_index_packs({t: i for i, t in enumerate(vocabulary)}), INDEX_SCHEMA), "postings")


def _close(lists: list[np.ndarray], offsets: list[int], slop: int) -> np.ndarray:
    """Starts at which every term stands at its offset, give or take slop. Lists are met from the shortest on."""
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    first = order[0]
    starts = lists[first] - offsets[first]
    if slop:
        starts = np.unique((starts[:, None] + np.arange(-slop, slop + 1)).ravel())
    for i in order[1:]:
        if not len(starts):
            break
        at = np.searchsorted(lists[i], starts + (offsets[i] - slop))
        near = lists[i][np.minimum(at, len(lists[i]) - 1)]
        starts = starts[(at < len(lists[i])) & (near <= starts + offsets[i] + slop)]
    return starts


class _Postings:
    def __init__(self, table: pa.Table):
        raw = dict(zip(table["term"].to_pylist(), table["places"].to_pylist(), strict=True))
        self.present, self.ids, self.bases, self.counts = np.frombuffer(raw.pop(None), np.int64).reshape(4, -1)
        self.lists = {t: np.cumsum(np.frombuffer(p, np.uint32), dtype=np.int64) for t, p in raw.items()}

    def starts(self, words: tuple[bytes, ...], slop: int) -> np.ndarray:
        lists = [self.lists.get(w) for w in words]
        return np.zeros(0, np.int64) if any(x is None for x in lists) else _close(lists, list(range(len(words))), slop)

    def documents(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, places, side="right") - 1

    def id(self, i: int) -> int | None:
        return int(self.ids[i]) if self.present[i] else None


def matches(index: DataFrame, phrases: list[tuple[int, str]], slop: int = 0) -> DataFrame:
    """Exact (slop 0) or proximity matches of whole phrases: doc_id, phrase_id, start (in words).

    With a slop, each word may stand up to slop places from where the phrase has it; start is where the
    phrase's first place would be. A phrase without words matches nothing.
    """
    folded = [(i, tuple(fold_words(p.encode()))) for i, p in phrases]
    if any(len(w) + 2 * slop >= GAP for _, w in folded):
        raise ValueError(f"a phrase and its slop must stay below {GAP} words")

    def search(table: pa.Table) -> pa.Table:
        postings = _Postings(table)
        out = []
        for i, words in folded:
            if words:
                starts = postings.starts(words, slop)
                out += [(postings.id(d), i, int(s - postings.bases[d])) for s, d in zip(starts.tolist(), np.maximum(postings.documents(starts), 0).tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "phrase_id", "start"])

    return index.groupBy("shard").applyInArrow(search, "doc_id long, phrase_id long, start long")


def _windows(items: list[tuple[object, bytes]], size: int) -> tuple[dict[tuple[bytes, ...], set[str]], list[bytes]]:
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        words = fold_words(text)
        for s in range(max(1, len(words) - size + 1)) if words else ():
            found[tuple(words[s : s + size])].add(str(item))
    return dict(found), sorted({w for k in found for w in k})


def _hits(windows: dict[tuple[bytes, ...], set[str]], index: DataFrame) -> DataFrame:
    """Per document: presence and id, words, and which of its words lie in an occurrence of a window, with the items."""

    def search(table: pa.Table) -> pa.Table:
        postings = _Postings(table)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[str]] = defaultdict(set)
        for words, owners in windows.items():
            starts = postings.starts(words, 0)
            for s, d in zip(starts.tolist(), postings.documents(starts).tolist(), strict=True):
                spans[d].append((s - int(postings.bases[d]), len(words)))
                items[d] |= owners
        out = []
        shard = table["shard"][0].as_py()
        for d, n in enumerate(postings.counts.tolist()):
            hit = np.zeros(n, bool)
            for s, k in spans.get(d, ()):
                hit[s : s + k] = True
            out.append((shard, d, postings.id(d), n, np.packbits(hit).tobytes() if d in spans else None, sorted(items.get(d, ()))))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["shard", "ord", "doc_id", "n_words", "hit", "items"])

    return index.groupBy("shard").applyInArrow(search, "shard long, ord long, doc_id long, n_words long, hit binary, items array<string>")


@F.pandas_udf(T.LongType())
def _ones(masks):
    """Bits set in the union of a document's masks, one per block of the benchmark."""

    def count(parts) -> int:
        parts = [np.frombuffer(p, np.uint8) for p in parts if p is not None]
        return int(np.unpackbits(np.bitwise_or.reduce(parts)).sum()) if parts else 0

    return masks.map(count)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, bytes]]]:
    """The benchmark in blocks of bounded size, streamed to the driver one at a time as queries are stated."""
    block: list[tuple[object, bytes]] = []
    held = 0
    for row in benchmark.select("item_id", F.col("text").cast("binary").alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL").toLocalIterator():
        block.append((row.item_id, bytes(row.text)))
        held += len(row.text) // 4
        if held >= BLOCK_WORDS:
            yield block
            block, held = [], 0
    yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """Which documents hold passages of the benchmark.

    A window is `window` consecutive words of an item, or all words of a shorter one. A document word in
    any occurrence of a window is hit; a document is contaminated if at least one word in `share` is.
    Returns one row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items. A
    null or empty text has no words, so no hits; items without words, without text or without an id
    match nothing; items that repeat count once per item_id; repeated documents each get their row; an
    empty benchmark leaves all clean and an empty table gives an empty result; other columns are ignored; a
    text beyond the size of a shard makes one of its own and is searched whole. `window` stays below GAP.
    """
    if window >= GAP:
        raise ValueError(f"windows must stay below {GAP} words")
    blocks = _blocks(benchmark)
    windows, vocabulary = _windows(next(blocks), window)
    second = next(blocks, None)
    if second is None:
        found = _hits(windows, build_index(docs, vocabulary))
    else:
        packs = common.packed(docs, "decontamination-packs")
        found = _hits(windows, _index_of_packs(packs, vocabulary))
        for block in chain([second], blocks):
            windows, vocabulary = _windows(block, window)
            found = found.unionByName(_hits(windows, _index_of_packs(packs, vocabulary)))
    merged = found.groupBy("shard", "ord").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("hit").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return (
        merged.withColumn("n_hit", F.when(F.size("hits") > 0, _ones("hits")).otherwise(F.lit(0).cast("long")))
        .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items")
    )

