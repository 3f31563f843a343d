"""N-gram Jaccard join by universe partition and pigeonhole.

Two sets of sizes x <= y link at similarity 0.8 only if their symmetric difference is at most
(x + y) / 9. Within a size band, the universe of shingles is hashed into segments. Differences are
spread over segments, so by the pigeonhole principle a linked pair agrees on one segment exactly, or
differs by at most one element in one of the segments that also send their one-deletion
neighbourhoods (such a segment counts twice). How many segments of either kind a band has is chosen
by cost. Bands have some segments more than the bound needs: each set then leaves out the keys that
most others share (an empty segment, a passage that many documents quote), as far as the bound allows.

Equal sets are one class from the start. Sets that share a key form a group, and groups of one size
class that share their most central member, the hub, are joined, so that a pair of sets meets in few
places. A group's members meet the hub, then each other, by an exact lower bound on their difference
from sketches; what may link is verified on the shingle hashes of the whole texts, the nearest pairs
first, and links are merged into components. Only members that are still apart go on to the next round,
in which each may name more partners, until none holds any back. So a large group of near copies costs
about its size, not its square, and nothing is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm import common
from tidewatch.llm.components import components

#: Keys that a reducer holds at once, on average.
BUCKET_KEYS = 4_000_000
#: Cells of a sketch (shingle counts by the top bits of their hash), and of coarser ones, each summed from the one before.
CELLS, BRIEF, COARSE = 512, 128, 32
#: How many keys' worth a key costs that holds too little to tell documents apart.
WEAK_KEY = 20.0
#: Rows of a block when members of a group are compared.
BLOCK_FEW, BLOCK_MANY = 512, 4096
#: Members of groups that are compared in one task's step, on average.
BUCKET_MEMBERS = 20_000
#: Partners that a member names in the first round, and by what they grow from round to round.
PARTNERS, PARTNERS_GROW = 4, 16
#: Rounds in which a group too large for one task meets one more hub before it is compared in blocks.
HUB_ROUNDS = 3
#: Pairs that are verified together with the text of the one that they share.
BLOCK_PAIRS = 64
#: Texts to fetch, in number, up to which their references are sent to all tasks; beyond it they are joined by shard.
FETCH_BROADCAST = 2_000_000

_DEL, _GUEST = 1, 2


@lru_cache(maxsize=4096)
def band_floor(band: int) -> int:
    return 1 if band == 0 else band_floor(band - 1) * 5 // 4 + 1


@lru_cache(maxsize=65536)
def band_of(size: int) -> int:
    band = 0
    while band_floor(band + 1) <= size:
        band += 1
    return band


def difference(x: int, y: int) -> int:
    """The largest symmetric difference of linked sets of these sizes."""
    return (x + y) // 9


@lru_cache(maxsize=4096)
def allocation(band: int) -> tuple[int, int]:
    """(one-deletion segments, exact segments) of the least expected cost for the band's sets.

    Cost: keys sent, and WEAK_KEY for each key expected to hold at most one element after deletion.
    """
    low, high = band_floor(band), band_floor(band + 1) - 1
    need = difference(high, high) + 1
    size = (low + high) / 2

    def weak(load: float, upto: int) -> float:
        return sum(math.exp(-load) * load**k / math.factorial(k) for k in range(upto + 1))

    best = None
    for deletions in sorted({round(need * k / 24) for k in range(13)} | {0, 1, (need + 1) // 2}):
        if 2 * deletions > need + 1:
            continue
        exact = max(0, need - 2 * deletions)
        if exact:
            exact += 2 + need // 10
        load = size / (deletions + exact)
        cost = exact * (1 + WEAK_KEY * weak(load, 1)) + deletions * (1 + load + WEAK_KEY * weak(load, 2))
        if best is None or cost < best[0]:
            best = (cost, deletions, exact)
    return best[1], best[2]


def spare(size: int, band: int) -> int:
    """Segments that a set of this size may leave out in this band, counted in differences they could absorb."""
    deletions, exact = allocation(band)
    largest = min(size * 5 // 4, band_floor(band + 1) - 1)
    return max(0, 2 * deletions + exact - difference(size, largest) - 1)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, ASCII letters lower-cased."""
    hashes, counts = common.hash_words([t.lower().split() for t in texts])
    _, _, ends = common.spans(counts)
    starts = np.flatnonzero(np.arange(len(hashes)) + words <= ends)
    rolled = np.zeros(len(hashes), np.uint64)
    rolled[starts] = common.window_hashes(hashes, starts, words)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            found = np.sort(rolled[at : at + n - words + 1])
            found = found[np.r_[True, found[1:] != found[:-1]]]
        elif n:
            found = common.window_hashes(hashes[at : at + n], np.zeros(1, np.int64), n)
        else:
            found = np.zeros(0, np.uint64)
        out.append(found)
        at += n
    return out


def sketch(found: np.ndarray) -> bytes:
    """A count that is cut at 255 only lowers the distance of two sketches, which stays a bound."""
    return np.minimum(np.bincount((found >> np.uint64(55)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def _cells(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _stats(words: int):
    def stats(texts: list[bytes]) -> dict[str, pa.Array]:
        sets = shingle_sets(texts, words)
        return {
            "sizes_n": pa.array([[len(s) for s in sets]], pa.list_(pa.int64())),
            "classes": pa.array([[xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]], pa.list_(pa.binary())),
            "sketches": pa.array([[sketch(s) for s in sets]], pa.list_(pa.binary())),
        }

    return stats


def set_keys(found: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """A set's keys in one band, and which of them belong to one-deletion segments."""
    deletions, exact = allocation(band)
    count = deletions + exact
    salt = np.uint64(0x5851F42D4C957F2D * (band + 1) & 0xFFFFFFFFFFFFFFFF)
    h = common.mixed(found + salt)
    seg = ((h >> np.uint64(33)) % np.uint64(count)).astype(np.int64)
    low = np.bincount(seg, weights=(h & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=count).astype(np.uint64)
    high = np.bincount(seg, weights=(h >> np.uint64(32)).astype(np.float64), minlength=count).astype(np.uint64)
    sums = low + (high << np.uint64(32))
    place = salt ^ (np.arange(count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    whole = common.mixed(common.mixed(sums) ^ place)
    is_del = np.arange(count) < deletions
    if not deletions:
        return whole, is_del
    inside = seg < deletions
    less = common.mixed(common.mixed(sums[seg[inside]] - h[inside]) ^ place[seg[inside]])
    return np.concatenate([whole, less]), np.concatenate([is_del, np.ones(len(less), bool)])


def _runs(ref: np.ndarray) -> bytes:
    """A sorted array by its steps and their lengths, compressed."""
    heads = np.flatnonzero(np.r_[True, ref[1:] != ref[:-1]])
    steps, lengths = np.diff(ref[heads], prepend=np.uint32(0)), np.diff(np.r_[heads, len(ref)])
    return np.uint32(len(heads)).tobytes() + pa.Codec("zstd", 1).compress(steps.astype(np.uint32).tobytes() + lengths.astype(np.uint32).tobytes(), asbytes=True)


def _expanded(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw[:4], np.uint32)[0])
    steps, lengths = np.frombuffer(pa.Codec("zstd").decompress(raw[4:], decompressed_size=8 * n, asbytes=True), np.uint32).reshape(2, n)
    return np.repeat(np.cumsum(steps, dtype=np.uint32), lengths)


def _signatures(words: int, buckets: int):
    names = ["bucket", "shard", "tags", "refs"]

    def signatures(pack: pa.Table, reps: pa.Table) -> pa.Table:
        keys, refs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        shard = 0
        if len(pack) and len(reps):
            row = pack.to_pylist()[0]
            shard = row["shard"]
            own = sorted(x & ((1 << common.ORD_BITS) - 1) for x in reps["ref"].to_pylist())
            texts = common.unpack(row["sizes"], row["body"])
            for o, found in zip(own, shingle_sets([texts[o] for o in own], words), strict=True):
                x = len(found)
                for guest in (0, 1):
                    band = band_of(x) + guest
                    if guest and x * 5 // 4 < band_floor(band) or not difference(x, x * 5 // 4):
                        continue
                    k, is_del = set_keys(found, band)
                    keys.append(k)
                    refs.append((o << 2 | guest * _GUEST) | is_del.astype(np.uint32) * np.uint32(_DEL))
        key, ref = np.concatenate(keys), np.concatenate(refs).astype(np.uint32)
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((ref, bucket))
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        tag = (key >> np.uint64(32)).astype(np.uint32)[order]
        ref = ref[order]
        rows = [(b, shard, tag[i:j].tobytes(), _runs(ref[i:j])) for b, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if j > i]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names)

    return signatures


def _groups(table: pa.Table) -> pa.Table:
    """Groups of at least two sets that share a key; the same members in many keys are one group. Units: what leaving the group out costs the member, 1 for each key of an exact segment and 2 for one of a one-deletion segment."""
    refs = [_expanded(x) for x in table["refs"].to_pylist()]
    tag = np.concatenate([np.frombuffer(x, np.uint32) for x in table["tags"].to_pylist()])
    shard = np.repeat(np.array(table["shard"].to_pylist(), np.int64), [len(x) for x in refs])
    ref = np.concatenate(refs)
    member = (shard << (common.ORD_BITS + 1)) | (ref.astype(np.int64) >> 1)  # the last bit says guest
    order = np.lexsort((member, tag))
    tag, member, flag = tag[order], member[order], (ref[order] & _DEL).astype(bool)
    new = np.r_[True, (tag[1:] != tag[:-1]) | (member[1:] != member[:-1])]
    tag, member, flag = tag[new], member[new], np.logical_or.reduceat(flag, np.flatnonzero(new))
    edges = np.flatnonzero(np.r_[True, tag[1:] != tag[:-1]])
    sizes = np.diff(np.r_[edges, len(tag)])
    weight: dict[bytes, list] = {}
    for at, n in zip(edges[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        part = member[at : at + n]
        found = weight.setdefault(xxhash.xxh3_64_digest(part.tobytes()), [part, np.zeros(n, np.int64)])
        found[1] += 1 + flag[at : at + n]
    parts = list(weight.items())
    if not parts:
        return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())], ["gid", "ref", "guest", "units", "size"])
    n = np.array([len(v[0]) for _, v in parts])
    members = np.concatenate([v[0] for _, v in parts])
    return pa.Table.from_arrays(
        [
            pa.array(np.repeat(np.frombuffer(b"".join(k for k, _ in parts), np.int64), n)), pa.array(members >> 1), pa.array((members & 1).astype(bool)),
            pa.array(np.concatenate([v[1] for _, v in parts])), pa.array(np.repeat(n, n).astype(np.int64)),
        ],
        ["gid", "ref", "guest", "units", "size"],
    )


class _Sketches:
    """Sketches of some members, compared in growing detail."""

    def __init__(self, whole: np.ndarray, n: np.ndarray):
        self.n, self.whole = n, whole
        self.brief = whole.reshape(len(n), BRIEF, CELLS // BRIEF).sum(2, dtype=np.int16)
        self.coarse = self.brief.reshape(len(n), COARSE, BRIEF // COARSE).sum(2, dtype=np.int32)

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs (a, b) may link, and the distance of their sketches, which never exceeds the symmetric difference."""
        alive, far = np.arange(len(a)), np.zeros(0, np.int64)
        for cells in (self.coarse, self.brief, self.whole):
            x, y = a[alive], b[alive]
            far = np.abs(cells[x].astype(np.int32) - cells[y]).sum(1, dtype=np.int64)
            keep = 9 * far <= self.n[x] + self.n[y]
            alive, far = alive[keep], far[keep]
        return alive, far


def _nearest(owner: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the k nearest of their owner, ties in the order given."""
    order = np.lexsort((np.arange(len(owner)), far, owner))
    first = np.r_[True, owner[order][1:] != owner[order][:-1]] if len(order) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    keep = np.zeros(len(order), bool)
    keep[order] = rank < k
    return keep


MET = "gid long, a long, b long, provisional boolean"


def _met(gid: np.ndarray, a: np.ndarray, b: np.ndarray, provisional: np.ndarray, cut: np.ndarray) -> pa.Table:
    """Pairs to verify, and a row without a pair for each group that held some back."""
    none = pa.nulls(len(cut), pa.int64())
    parts = [
        pa.table({"gid": pa.array(gid), "a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b)), "provisional": pa.array(provisional)}),
        pa.table({"gid": pa.array(cut), "a": none, "b": none, "provisional": pa.array(np.zeros(len(cut), bool))}),
    ]
    return pa.concat_tables(parts)


def _some_groups(first: bool, partners: int):
    """Pairs within many whole groups that are still apart and may link.

    In the first round members meet their hub; two that are near it are taken to be linked through it
    until it is verified. Else members stand by group and size, and each meets the next one, the one
    after, and so on while sizes allow. Of the pairs that may link, each member of a group's lesser
    components names its `partners` nearest.
    """

    def some(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["n"].to_numpy(), table["gid"].to_numpy()))
        gid, ref, root, n, hub, major = (table[c].to_numpy()[order] for c in ("gid", "ref", "root", "n", "hub", "major"))
        probe = table["probe"].to_numpy().astype(bool)[order]
        cells = _Sketches(_cells(table["sketch"], CELLS)[order], n)
        taken = np.zeros(len(ref), bool)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if first:
            at = np.flatnonzero(ref == hub)
            start = np.searchsorted(gid, gid[at])
            size = np.searchsorted(gid, gid[at], side="right") - start
            own, of = np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size), np.repeat(at, size)
            some = np.flatnonzero(root[own] != root[of])
            x, y = own[some], of[some]
            keep, _ = cells.near(x, y)
            hubs = (x[keep], y[keep])
            taken[x[keep]] = True
            taken[at] = True
        # 9 (y - x) <= x + y: y up to five fourths of x. The run that a member meets ends where its group or this bound does.
        ends = np.searchsorted(gid, gid, side="right")
        at, shift = np.arange(len(ref)), 1
        while len(at):
            at = at[at + shift < ends[at]]
            at = at[4 * n[at + shift] <= 5 * n[at]]
            to = at + shift
            some = (root[at] != root[to]) & (probe[at] | probe[to]) & ~(taken[at] & taken[to])
            if first:  # what was far from the hub has been compared with it
                some &= (ref[at] != hub[at]) & (ref[to] != hub[to])
            x, y = at[some], to[some]
            keep, far = cells.near(x, y)
            out.append((x[keep], y[keep], far))
            shift += 1
        x, y, far = (np.concatenate(c) for c in zip(*out, strict=True))
        keep = np.zeros(len(x), bool)
        for side in (x, y):
            own = np.flatnonzero(root[side] != major[side])
            keep[own] |= _nearest(side[own], far[own], partners)
        cut = np.unique(gid[x[~keep]])
        x, y, provisional = x[keep], y[keep], np.zeros(keep.sum(), bool)
        if first:
            x, y, provisional = np.r_[hubs[0], x], np.r_[hubs[1], y], np.r_[np.ones(len(hubs[0]), bool), provisional]
        return _met(gid[x], ref[x], ref[y], provisional, cut)

    return some


def _block(partners: int):
    """The same for one block of a very large group: its few against its many."""

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        few = table["few"].to_numpy().astype(bool)
        gid, ref, root, n, probe = (table[c].to_numpy() for c in ("gid", "ref", "root", "n", "probe"))
        probe, others = probe.astype(bool), np.flatnonzero(~few)
        cells = _Sketches(_cells(table["sketch"], CELLS), n)
        out_a, out_b, cut = [], [], False
        low, high = np.searchsorted(n[others], -(-4 * n // 5)), np.searchsorted(n[others], 5 * n // 4, side="right")
        for i in np.flatnonzero(few).tolist():
            j = others[low[i] : high[i]]
            j = j[root[j] != root[i]]
            j = j if probe[i] else j[probe[j]]
            keep, far = cells.near(np.full(len(j), i), j)
            cut |= len(keep) > partners
            j = j[keep[np.argsort(far, kind="stable")[:partners]]]
            out_a.append(np.full(len(j), i))
            out_b.append(j)
        a, b = (ref[np.concatenate([np.zeros(0, np.int64), *x])] for x in (out_a, out_b))
        return _met(np.full(len(a), gid[0]), a, b, np.zeros(len(a), bool), gid[:1] if cut else gid[:0])

    return block


def _hub_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gid, ref, hub, n, hub_n = (batch[c].to_numpy() for c in ("gid", "ref", "hub", "n", "hub_n"))
        far = np.abs(_cells(batch["sketch"], CELLS).astype(np.int16) - _cells(batch["hub_sketch"], CELLS)).sum(1, dtype=np.int64)
        keep = 9 * far <= n + hub_n
        yield from _met(gid[keep], ref[keep], hub[keep], np.zeros(keep.sum(), bool), np.unique(gid)).to_batches()


def _with_sketches(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """rows with the sketches of their sets. Only those that are asked for move, as long as the list of them is small."""
    wanted = rows.select("ref").distinct()
    some = stats.join(F.broadcast(wanted), "ref", "left_semi") if wanted.count() <= FETCH_BROADCAST else stats
    return rows.join(some, "ref")


def _compared(apart: DataFrame, stats: DataFrame, rounds: int) -> DataFrame:
    """(gid, a, b, provisional): what the groups that are still apart want verified in this round; a is null where a group holds pairs back.

    Groups of up to BLOCK_MANY members go to tasks many at a time. A larger one meets a hub in each of the
    first rounds, then it is dealt out in blocks.
    """
    spark = apart.sparkSession
    partners = lambda r: PARTNERS * PARTNERS_GROW ** min(max(r, 0), 12)
    left = apart.withColumn("probe", F.col("probe").cast("int"))
    buckets = max(common.part_count(spark), apart.count() // BUCKET_MEMBERS + 1)
    whole = _with_sketches(left.where(F.col("rows") <= BLOCK_MANY).select("gid", "ref", "root", "major", "probe", "n", "hub"), stats)
    met = whole.withColumn("bucket", F.pmod(F.xxhash64("gid"), F.lit(buckets))).groupBy("bucket").applyInArrow(_some_groups(rounds == 0, partners(rounds)), MET)
    large = left.where(F.col("rows") > BLOCK_MANY)
    if large.isEmpty():
        return met
    if rounds < HUB_ROUNDS:
        # The first hub is the group's own; later ones are the most central of those that are still outside its largest component.
        hubs = large.where("ref = hub" if rounds == 0 else "root <> major").groupBy("gid").agg(F.max_by(F.struct("ref", "root", "n"), F.struct("score", F.negative("ref"))).alias("h"))
        hubs = hubs.select("gid", F.col("h.ref").alias("ref"), F.col("h.root").alias("hub_root"), F.col("h.n").alias("hub_n"))
        hubs = _with_sketches(hubs, stats).withColumnsRenamed({"ref": "hub", "sketch": "hub_sketch"})
        # One row for each group of over BLOCK_MANY members.
        asked = large.select("gid", "ref", "root", "n")
        asked = (asked.join(F.broadcast(hubs), "gid") if hubs.count() <= 10_000 else asked.join(hubs, "gid")).where("root <> hub_root")
        return met.unionByName(_with_sketches(asked, stats).select("gid", "ref", "hub", "n", "hub_n", "sketch", "hub_sketch").mapInArrow(_hub_near, MET))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("ref"), n).cast("int")
    dealt = _with_sketches(large.withColumn("few_n", (F.lit(1) + F.floor(F.col("minors") / BLOCK_FEW)).cast("int")).withColumn("many_n", (F.lit(1) + F.floor(F.col("rows") / BLOCK_MANY)).cast("int")), stats)
    columns = ["gid", "ref", "root", "probe", "n", "sketch"]
    few = dealt.where("root <> major").select(*columns, F.lit(1).alias("few"), place("few_n").alias("i"), each("many_n").alias("j"))
    many = dealt.select(*columns, F.lit(0).alias("few"), each("few_n").alias("i"), place("many_n").alias("j"))
    return met.unionByName(few.unionByName(many).groupBy("gid", "i", "j").applyInArrow(_block(partners(rounds - HUB_ROUNDS)), MET))


def _texts(rows: Iterator[tuple[bytes, bytes, np.ndarray]]) -> pa.Table:
    out = []
    codec = pa.Codec("zstd", 1)
    for sizes, body, wanted in rows:
        texts = common.unpack(sizes, body)
        for ref in wanted.tolist():
            text = texts[ref & ((1 << common.ORD_BITS) - 1)]
            out.append((ref, len(text), codec.compress(text, asbytes=True)))
    columns = list(zip(*out, strict=True)) or [[]] * 3
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["ref", "length", "body"])


def _texts_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _texts((r["sizes"], r["body"], np.array(r["wanted"], np.int64)) for r in batch.to_pylist()).to_batches()


def _texts_by_shard(pack: pa.Table, wanted: pa.Table) -> pa.Table:
    both = len(pack) and len(wanted)
    return _texts((r["sizes"], r["body"], wanted["ref"].to_numpy()) for r in (pack.to_pylist() if both else []))


def _fetched(packs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Compressed texts of the wanted documents. Packs stay where they are as long as the list of what is wanted is small."""
    schema = "ref long, length long, body binary"
    wanted = wanted.withColumn("shard", F.shiftright("ref", common.ORD_BITS))
    if wanted.count() <= FETCH_BROADCAST:
        lists = wanted.groupBy("shard").agg(F.collect_list("ref").alias("wanted"))
        return packs.join(F.broadcast(lists), "shard").select("sizes", "body", "wanted").mapInArrow(_texts_near, schema)
    return packs.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(_texts_by_shard, schema)


def _verify(words: int):
    def verify(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        codec = pa.Codec("zstd")
        bodies = [codec.decompress(body, decompressed_size=n, asbytes=True) if n else b"" for body, n in zip(texts["body"].to_pylist(), texts["length"].to_pylist(), strict=True)]
        sets = dict(zip(texts["ref"].to_pylist(), shingle_sets(bodies, words), strict=True)) if bodies else {}
        keep = []
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
            both = np.concatenate([sets[a], sets[b]])
            both.sort(kind="stable")
            n = int((both[1:] == both[:-1]).sum())
            keep.append(100 * n >= 80 * (len(both) - n))
        return pairs.select(["a", "b"]).append_column("link", pa.array(keep, pa.bool_()))

    return verify


def _verified(pairs: DataFrame, packs: DataFrame, words: int) -> DataFrame:
    """(a, b, link) of each pair, judged on the whole texts. Pairs that share a text are judged together, BLOCK_PAIRS at a time, so a hub's text travels once for all of them."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("ref"))
    wanted = common.stored(ends.groupBy("ref").agg(F.count("*").alias("pairs")), "jaccard-wanted")
    texts = common.stored(_fetched(packs, wanted.select("ref")), "jaccard-texts")
    count = lambda s: wanted.select(F.col("ref").alias(s), F.col("pairs").alias(f"n_{s}"))
    sized = pairs.join(count("a"), "a").join(count("b"), "b")
    shared, other = F.when(F.col("n_a") >= F.col("n_b"), F.col("a")).otherwise(F.col("b")), F.when(F.col("n_a") >= F.col("n_b"), F.col("b")).otherwise(F.col("a"))
    blocks = sized.select("a", "b", shared.alias("of"), F.pmod(F.xxhash64(other), F.floor(F.greatest("n_a", "n_b") / BLOCK_PAIRS) + 1).alias("block"))
    blocks = common.stored(blocks, "jaccard-blocks")
    needed = blocks.select(F.col("of").alias("t_of"), F.col("block").alias("t_block"), F.explode(F.array("a", "b")).alias("ref")).distinct().join(texts, "ref")
    done = common.stored(blocks.groupBy("of", "block").cogroup(needed.groupBy("t_of", "t_block")).applyInArrow(_verify(words), "a long, b long, link boolean"), "jaccard-verified")
    common.discard(wanted, texts, blocks)
    return done


def jaccard_join(docs: DataFrame, words: int = 5) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least 0.8.

    A document's set holds its distinct shingles of `words` words (ASCII white space separates them,
    A-Z are lower-cased); fewer words make one shingle of the whole sequence. Returns one row per input
    row: doc_id, n_shingles, component_id, the least doc_id reachable over links, itself included. A
    null or empty text has an empty set and links with nothing; equal texts link; repeated rows and
    repeated ids are documents of their own with that id; a null doc_id never becomes a component_id
    unless it is alone; an empty table gives an empty result; other columns are ignored; a text of any length
    is compared whole, by 64-bit hashes of its shingles.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    schema = common.PACK_SCHEMA + ", sizes_n array<long>, classes array<binary>, sketches array<binary>"
    stats_of = _stats(words)
    packs_all = common.stored(common.texts_of(docs).mapInArrow(lambda it: common.pack_batches(it, stats_of), schema), "jaccard-packs")
    packs = packs_all.select("shard", "sizes", "body")
    total = packs_all.agg(F.sum(F.aggregate("sizes_n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first().n or 0
    rows = packs_all.select("shard", F.posexplode(F.arrays_zip("doc_ids", "sizes_n", "classes", "sketches")).alias("ord", "x")).select(
        (F.shiftleft("shard", common.ORD_BITS) + F.col("ord")).alias("ref"), F.col("x.doc_ids").alias("doc_id"), F.col("x.sizes_n").alias("n"), F.col("x.classes").alias("class"), F.col("x.sketches").alias("sketch")
    )
    classes = common.stored(rows.where("class IS NOT NULL").groupBy("class").agg(F.min("ref").alias("ref"), F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "jaccard-classes")
    # What the result needs of the packs, apart from them, so that the texts can go.
    named_rows = common.stored(rows.select("doc_id", F.col("n").alias("n_shingles"), "class"), "jaccard-rows")

    buckets = max(common.part_count(spark), int(total * 0.6) // BUCKET_KEYS + 1)
    reps = classes.select(F.shiftright("ref", common.ORD_BITS).alias("shard"), "ref")
    sent = packs.groupBy("shard").cogroup(reps.groupBy("shard")).applyInArrow(_signatures(words, buckets), "bucket int, shard long, tags binary, refs binary")
    found = sent.groupBy("bucket").applyInArrow(_groups, "gid long, ref long, guest boolean, units long, size long")
    found = found.groupBy("gid", "ref", "guest").agg(F.sum("units").alias("units"), F.max("size").alias("size"))

    @F.pandas_udf("int")
    def allowed(n, guest):
        return n.combine(guest, lambda x, g: spare(x, band_of(x) + int(g))).astype("int32")

    groups = common.stored(found.join(classes.select("ref", "n"), "ref").withColumn("allowed", allowed("n", "guest")), "jaccard-groups")
    # Each set leaves out its largest groups, as far as it may; in the others it is a probe.
    costly = Window.partitionBy("ref", "guest").orderBy(F.desc("size"), "gid").rowsBetween(Window.unboundedPreceding, 0)
    probes = groups.withColumn("probe", F.sum("units").over(costly) > F.col("allowed")).groupBy("gid", "ref").agg(F.max("probe").alias("probe"), F.max("n").alias("n"), F.max("size").alias("size"), F.sum("units").alias("units"))
    probes = common.stored(probes, "jaccard-probes")
    score = probes.groupBy("ref").agg(F.sum(F.col("units") * F.col("size")).alias("score"))
    asked = probes.groupBy("gid").agg(F.max("probe").alias("any")).where("any").select("gid")
    central = common.stored(probes.join(asked, "gid").join(score, "ref").select("gid", "ref", "probe", "n", "score", F.floor(F.log2("size") / 2).alias("scale")), "jaccard-central")
    hubs = central.groupBy("gid").agg(F.max_by("ref", F.struct("score", F.negative("ref"))).alias("hub"), F.max("scale").alias("scale"))
    joined = central.drop("scale").join(hubs, "gid").groupBy("hub", "scale", "ref").agg(F.max("probe").alias("probe"), F.max("n").alias("n"), F.max("score").alias("score"))
    members = common.stored(joined.withColumn("gid", F.xxhash64("hub", "scale")).drop("scale"), "jaccard-members")
    common.discard(groups, probes, central)
    stats = classes.select("ref", "sketch")

    roots = checked = None
    rounds, again, going = 0, None, not members.isEmpty()
    while going:
        # What is still apart: per group, the component of most members, and the others.
        placed = members if again is None else members.join(again, "gid", "left_semi")
        placed = placed.withColumn("root", F.col("ref")) if roots is None else placed.join(roots.withColumnRenamed("vertex", "ref"), "ref", "left").withColumn("root", F.coalesce("root", "ref"))
        placed = common.stored(placed, "jaccard-placed")
        by_root = placed.groupBy("gid", "root").agg(F.count("*").alias("n"))
        largest = by_root.groupBy("gid").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.count("*").alias("roots"), F.sum("n").alias("rows"), (F.sum("n") - F.max("n")).alias("minors")).where("roots > 1").drop("roots")
        largest = common.stored(largest, "jaccard-largest")
        apart = common.stored(common.join_counted(placed, largest, "gid", placed.count(), keep=True), "jaccard-apart")
        common.discard(placed, largest)
        met = common.stored(_compared(apart, stats, rounds), "jaccard-met")
        common.discard(apart, *([again] if again is not None else []))
        pairs = met.where("a IS NOT NULL").select("a", "b").distinct()
        pairs = common.stored(pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti"), "jaccard-pairs")
        if not pairs.isEmpty():
            done = _verified(pairs, packs, words)
            links = done.where("link").select("a", "b")
            before, roots = roots, components(links if roots is None else links.unionByName(roots.select(F.col("vertex").alias("a"), F.col("root").alias("b"))), "a", "b")
            checked, spent = common.stored(done.select("a", "b", "link") if checked is None else checked.unionByName(done), "jaccard-checked"), [checked] if checked is not None else []
            common.discard(done, *spent, *([before] if before is not None else []))
        # Groups that held pairs back, or took a pair to be linked that isn't, go on.
        again = met.where("a IS NULL").select("gid")
        if rounds == 0 and checked is not None:
            again = again.unionByName(met.where("provisional").join(checked.where("NOT link"), ["a", "b"], "left_semi").select("gid"))
        again = common.stored(again.distinct(), "jaccard-again")
        common.discard(met, pairs)
        rounds, going = rounds + 1, not again.isEmpty()

    common.discard(members, packs_all, *(t for t in (again, checked) if t is not None))
    merged = classes.select("class", "ref", "least")
    merged = merged.withColumn("root", F.col("ref")) if roots is None else merged.join(roots.withColumnRenamed("vertex", "ref"), "ref", "left").withColumn("root", F.coalesce("root", "ref"))
    merged = common.stored(merged.select("class", "root", "least"), "jaccard-merged")
    common.discard(classes, *([roots] if roots is not None else []))
    named = common.stored(merged.join(merged.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("class", "component_id"), "jaccard-named")
    common.discard(merged)
    return named_rows.join(named, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
