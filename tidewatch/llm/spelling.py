"""Spelling variants: words one edit apart, grouped under their most frequent forms.

The vocabulary is cut, in order, into shards; each becomes a compact trie, whose branches end where one word
is left. Tries are broadcast in groups of bounded size. Every word's automaton of Levenshtein distance one
runs through every shard depth-first, many words at a time: states are (word, node, place), with the one
edit still to come or already made, and they are expanded as arrays from a stack. An edit is made at its
last possible place only, so each neighbour is accepted once. Neighbours are reduced where they are found, to
their number and the best one.
"""

from __future__ import annotations

import io
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common

#: Words of a shard, bytes of tries that are broadcast at a time, states expanded at a time, and words that a counting task holds.
SHARD_WORDS, GROUP_BYTES, STATES, HELD_WORDS = 150_000, 48 << 20, 1 << 18, 300_000
SPLIT_BYTES = 1 << 20

_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
_LETTERS = np.array([97 <= b <= 122 for b in range(256)])


def runs(text: bytes) -> Iterator[list[bytes]]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, as UTF-8, some part of the text at a time."""
    try:
        text.decode()
    except UnicodeDecodeError:
        text = text.decode("utf-8", "replace").encode()
    start = 0
    while start < len(text):
        cut = _SPACE.search(text, start + SPLIT_BYTES)
        end = cut.start() if cut else len(text)
        b = np.frombuffer(text[start:end].lower(), np.uint8)
        lead = b == 0xC3  # of these letters, and of no others
        keep = _LETTERS[b] | lead
        keep[1:] |= lead[:-1]
        yield np.where(keep, b, np.uint8(32)).tobytes().split()
        start = end


def damaged(run: bytes, h: int) -> bytes:
    """The run without its code point h % length."""
    s = run.decode()
    at = h % len(s)
    return (s[:at] + s[at + 1 :]).encode()


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3, damage: int = 97) -> DataFrame:
    """Words and their numbers of occurrences, n.

    In a document whose `<doc_id>:<run>` has a crc32 that `damage` divides, a run loses one code point; 0 switches
    that off, and a null doc_id has no damage.
    """
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                start = None if doc_id is None or not damage else crc32(b"%d:" % doc_id)
                for part in runs(text or b""):
                    found = Counter(w for w in part if len(w) >= least_length)
                    if start is not None:
                        for w in [w for w in found if not crc32(w, start) % damage]:
                            n, less = found.pop(w), damaged(w, crc32(w, start))
                            held[less] = held.get(less, 0) + n
                    for w, n in found.items():
                        held[w] = held.get(w, 0) + n
                    if len(held) > HELD_WORDS:
                        yield flush()
                        held = {}
        if held:
            yield flush()

    counted = common.texts_of(docs).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.select(F.col("word").cast("string").alias("word"), "n").where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of symbols (a-z: 0 to 25, U+00C0 on: 26 to 89, 255 after the end), and their lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.array([w.encode("latin-1") for w in words] or [b"\0"]).view(np.uint8).reshape(max(1, len(words)), -1)[: len(words)]
    out = np.where(raw < 0xC0, raw - np.uint8(97), raw - np.uint8(0xC0 - 26))
    return np.where(np.arange(out.shape[1]) < sizes[:, None], out, np.uint8(255)), sizes


_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


class Trie:
    """Sorted distinct words by symbol. Nodes are numbered by level, so that a node's children lie side by side; a node below which there is one word only is a leaf and has no children."""

    FIELDS = ("sym", "size", "n", "leaf", "last", "low", "high", "child", "label")

    def __init__(self, **fields: np.ndarray):
        for k in self.FIELDS:
            setattr(self, k, fields[k])

    @classmethod
    def of(cls, words: list[str], counts: np.ndarray) -> Trie:
        sym, size = symbols(words)
        m, width = sym.shape
        differs = sym[1:] != sym[:-1]
        shared = np.concatenate([[0], np.where(differs.any(1), differs.argmax(1), width), [0]])  # with the word before; then with the one after the last
        unique = np.maximum(shared[:-1], shared[1:]) + 1  # from this depth on a prefix is the word's own
        leaf, last, low, high, child, label = ([] for _ in range(6))
        at, base = np.zeros(m, np.int64), 0  # each word's node on this level, and the level's first node
        alive = np.arange(m)
        nodes = np.array([0])  # the first word of each node of the level
        labels = np.zeros(1, np.uint8)
        depth = 0
        while len(nodes):
            own = np.zeros(len(nodes), bool)
            ended = np.full(len(nodes), -1, np.int32)
            here = alive[size[alive] == depth]
            ended[at[here] - base] = here
            single = alive[(unique[alive] <= depth) & (size[alive] >= depth)] if m > 1 else alive
            own[at[single] - base] = True
            only = np.full(len(nodes), -1, np.int32)
            only[at[single] - base] = single
            go = alive[(size[alive] > depth) & ~own[at[alive] - base]]
            s = sym[go, depth] if len(go) else np.zeros(0, np.uint8)
            new = np.ones(len(go), bool)
            new[1:] = (at[go][1:] != at[go][:-1]) | (s[1:] != s[:-1])
            lo, hi = np.zeros(len(nodes), np.uint64), np.zeros(len(nodes), np.uint64)
            first = go[new]
            parent, bits = at[first] - base, s[new]
            small = bits < 64
            np.bitwise_or.at(lo, parent[small], _BIT[bits[small]])
            np.bitwise_or.at(hi, parent[~small], _BIT[bits[~small] - 64])
            fan = np.bincount(parent, minlength=len(nodes))
            below = base + len(nodes)
            leaf.append(only)
            last.append(ended)
            low.append(lo)
            high.append(hi)
            child.append(below + np.cumsum(fan) - fan)
            label.append(labels)
            at[go] = below + np.cumsum(new) - 1
            alive, nodes, labels, base, depth = go, first, bits, below, depth + 1
        join = lambda x, t: np.concatenate(x).astype(t)
        ends = np.append(join(child, np.int32), np.int32(base))
        return cls(sym=sym, size=size.astype(np.int32), n=np.asarray(counts, np.int64), leaf=join(leaf, np.int32), last=join(last, np.int32), low=join(low, np.uint64), high=join(high, np.uint64), child=ends, label=join(label, np.uint8))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Trie:
        with np.load(io.BytesIO(raw)) as z:
            return cls(**{k: z[k] for k in cls.FIELDS})

    def word(self, i: int) -> str:
        s = self.sym[i, : self.size[i]].astype(np.int32)
        return "".join(map(chr, np.where(s < 26, s + 97, s + 0xC0 - 26).tolist()))

    def step(self, node: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have a child by their symbol, and those children."""
        big = s >= 64
        mask = np.where(big, self.high[node], self.low[node])
        bit = _BIT[s & 63]
        has = (mask & bit) != 0
        node, big, mask, bit = node[has], big[has], mask[has], bit[has]
        before = np.bitwise_count(mask & (bit - np.uint64(1))).astype(np.int64)
        before[big] += np.bitwise_count(self.low[node[big]])
        return has, self.child[node] + before

    def neighbours(self, sym: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, word) at distance one, each once, for queries as `symbols` gives them."""
        width = sym.shape[1]
        sym = np.concatenate([sym, np.full((len(sym), 2), 255, np.uint8)], 1)
        at_end = lambda q, p: sym[q, np.minimum(p, width)]
        zero = np.zeros(len(sym), np.int32)
        stack: list = [(np.arange(len(sym), dtype=np.int32), zero, zero, None)]  # query, node, place, and how much longer the edit made it, if made
        while stack:
            q, node, place, edit = stack.pop()
            if len(q) > STATES // (16 if edit is None else 1):
                half = len(q) // 2
                stack += [(q[half:], node[half:], place[half:], edit), (q[:half], node[:half], place[:half], edit)]
                continue
            only = self.leaf[node]
            done = only >= 0
            if done.any():
                yield self._close(sym, size, q[done], only[done], edit)
                q, node, place = q[~done], node[~done], place[~done]
            if not len(q):
                continue
            s, over = at_end(q, place), place >= size[q]
            if edit is not None:
                word = self.last[node]
                hit = over & (word >= 0)
                if hit.any():
                    yield q[hit], word[hit]
                q, node, place, s = (x[~over] for x in (q, node, place, s))
                has, to = self.step(node, s)
                if len(to):
                    stack.append((q[has], to, place[has] + 1, edit))
                continue
            # The word's symbol is left out, at the end of a run of equal ones.
            out = ~over & (at_end(q, place + 1) != s)
            if out.any():
                stack.append((q[out], node[out], place[out] + 1, -1))
            fan = self.child[node + 1] - self.child[node]
            ends = np.cumsum(fan)
            total = int(ends[-1])
            if not total:
                continue
            src = np.repeat(np.arange(len(q)), fan)
            to = (self.child[node] - ends + fan)[src] + np.arange(total)
            same = self.label[to] == s[src]
            other = ~same
            away, src_a = to[other], src[other]
            if len(away):
                stack.append((q[src_a], away, place[src_a], 1))  # a symbol of the trie is put in
                put = ~over[src_a]
                stack.append((q[src_a][put], away[put], place[src_a][put] + 1, 0))  # or stands for the word's
            if same.any():
                stack.append((q[src[same]], to[same], place[src[same]] + 1, None))

    def _close(self, sym: np.ndarray, size: np.ndarray, q: np.ndarray, w: np.ndarray, edit: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs that meet at a leaf, those at distance one by the edit, if it is made: the rest of both is compared at once."""
        more = self.size[w] - size[q]
        fit = np.abs(more) <= 1 if edit is None else more == edit
        q, w = q[fit], w[fit]
        width = max(sym.shape[1], self.sym.shape[1]) + 1
        wide = lambda x: np.concatenate([x, np.full((len(x), width - x.shape[1]), 255, np.uint8)], 1) if x.shape[1] < width else x
        a, b = wide(sym[q]), wide(self.sym[w])
        longer = size[q] - self.size[w]
        differ = a != b
        first = np.where(differ.any(1), differ.argmax(1), width)
        col = np.arange(width - 1)
        late = col >= first[:, None]
        shift = lambda x, y: ~((x[:, 1:] != y[:, :-1]) & late).any(1)
        ok = np.where(longer == 0, differ.sum(1) == 1, np.where(longer > 0, shift(a, b), shift(b, a)))
        return q[ok], w[ok]


SHARD = "first string, words long, size long, trie binary"


def shards(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Stored tries over ranges of the vocabulary (word, n), each of at most shard_words words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        counts: list[int] = []

        def flush() -> pa.RecordBatch:
            raw = Trie.of(held, np.array(counts)).dump()
            return pa.RecordBatch.from_pydict({"first": [held[0]], "words": [len(held)], "size": [len(raw)], "trie": pa.array([raw], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, shard_words):
                part = batch.slice(at, shard_words)
                if len(held) + part.num_rows > shard_words:
                    yield flush()
                    held, counts = [], []
                held += part["word"].to_pylist()
                counts += part["n"].to_pylist()
        if held:
            yield flush()

    n = words.count()
    ranges = words.select("word", "n").repartitionByRange(max(1, -(-n // shard_words)), "word").sortWithinPartitions("word")
    return common.stored(ranges.mapInArrow(run, SHARD), "tries")


class Nearest:
    """Neighbours of some words over shards that come in the order of their words."""

    def __init__(self, words: list[str], counts: np.ndarray):
        self.sym, self.size = symbols(words)
        self.near = np.zeros(len(words), np.int64)
        self.best = np.zeros(len(words), np.int64)
        self.form: list[str | None] = [None] * len(words)

    def add(self, trie: Trie) -> None:
        found = list(trie.neighbours(self.sym, self.size))
        if not found:
            return
        q, w = (np.concatenate(x) for x in zip(*found, strict=True))
        self.near += np.bincount(q, minlength=len(self.near))
        n = trie.n[w]
        order = np.lexsort((w, -n, q))
        q, w, n = q[order], w[order], n[order]
        lead = np.ones(len(q), bool)
        lead[1:] = q[1:] != q[:-1]
        lead &= n > self.best[q]  # of equal numbers the earlier shard has the lesser word
        self.best[q[lead]] = n[lead]
        for i, j in zip(q[lead].tolist(), w[lead].tolist(), strict=True):
            self.form[i] = trie.word(j)


NEAR = "word string, n long, n_near long, best_n long, best string"


def nearest(words: DataFrame, tries: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per word of the stored table (word, n): n_near, and the near word of largest n (ties: the least word) with its n."""
    spark = words.sparkSession
    spread = words.repartition(common.part_count(spark), "word")
    # The driver holds a name and a size for each shard, and the tries of one group.
    groups: list[list[str]] = []
    held = 0
    for first, size in tries.select("first", "size").orderBy("first").collect():
        if not groups or held + size > group_bytes:
            groups.append([])
            held = 0
        groups[-1].append(first)
        held += size
    parts = []
    for group in groups:
        rows = tries.where(F.col("first").between(group[0], group[-1])).select("first", "trie").collect()
        shared = spark.sparkContext.broadcast([bytes(r.trie) for r in sorted(rows, key=lambda r: r.first)])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            loaded = [Trie.load(raw) for raw in shared.value]
            for batch in batches:
                state = Nearest(batch["word"].to_pylist(), batch["n"].to_numpy())
                for trie in loaded:
                    state.add(trie)
                yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], pa.array(state.near), pa.array(state.best), pa.array(state.form, pa.string())], ["word", "n", "n_near", "best_n", "best"])

        parts.append(common.stored(spread.mapInArrow(run, NEAR), "near"))
        shared.unpersist()
    if not parts:
        return spark.createDataFrame([], NEAR)
    if len(parts) == 1:
        return parts[0]
    every = reduce(DataFrame.unionByName, parts)
    best = F.min(F.when(F.col("best_n") > 0, F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("w"))))
    return every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n", "n_near", F.coalesce(-F.col("b.less"), F.lit(0)).alias("best_n"), F.col("b.w").alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """Stored (word, root) for each word of (word, form): the last word along its forms. Each round halves what is left of the way; a form has more occurrences than its word, so no way is endless."""
    ways = common.stored(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = common.stored(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "ways")
        moved = not after.where("moved").isEmpty()
        common.discard(ways)
        ways = after.drop("moved")
        if not moved:
            return ways


def spelling_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, damage: int = 0, factor: int = 2, shard_words: int = SHARD_WORDS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Group the words of docs (doc_id, text) that are one edit apart.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case, of at least least_length
    code points, that occur at least least_count times in all texts; `damage` as in `word_counts`. Returns one
    row per word: word, form (its near word of largest n, ties to the lesser word, if that n is at least
    `factor` times the word's; else null), root (the last word along the forms), n, n_near, form_n (null
    without a form). factor must be above 1. Null and empty texts have no words; texts of any length are read
    whole; repeated rows count each time; bytes that are no UTF-8 separate words; other columns are ignored; an
    empty table gives an empty result.
    """
    if factor <= 1:
        raise ValueError("factor must be above 1, or forms could lead in circles")
    words = common.stored(word_counts(docs, least_length, least_count, damage), "words")
    tries = shards(words, shard_words)
    near = common.stored(nearest(words, tries, group_bytes), "near-words")
    common.discard(words, tries)
    own = F.col("best_n") >= F.lit(factor) * F.col("n")
    formed = near.select("word", F.when(own, F.col("best")).alias("form"), "n", "n_near", F.when(own, F.col("best_n")).alias("form_n"))
    ways = rooted(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
