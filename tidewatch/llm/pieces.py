"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

All segmentations of a text into pieces form a lattice. Forward filtering sums the weight of every way
to reach each place; backward sampling then draws pieces from the end, each in proportion to the ways
through it, so a segmentation comes with its share of the total weight. Draws are a hash of the row's key
and the place, so the same row gives the same pieces on any cluster. Where no piece can span a boundary
(before a run of blanks, around line feeds) the lattice falls into parts that are filtered once
per distinct part and sampled together. Pieces are turned back into exactly the bytes of the text.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common

#: A public vocabulary; where it lies is a parameter.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Sharpness: weights are probability to this power, so large values give the likeliest segmentation.
ALPHA = 1.5
SEED = 29
#: How the vocabulary writes a blank.
BLANK = "▁"
#: Parts of more bytes are filtered each time instead of being remembered; states that a task remembers.
LONG_PART, MEMORY = 48, 600_000
#: Parts that are sampled together, and bytes of a long part whose pieces are listed together.
CHUNK_PARTS, BLOCK = 100_000, 1 << 16


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as a trie over UTF-8 bytes (blanks as spaces), log weights, byte pieces, what each piece spells, and whether parts may be cut at blanks and line feeds."""

    edges: np.ndarray
    targets: np.ndarray
    piece_at: np.ndarray
    weights: np.ndarray
    bytes_: np.ndarray
    surface: tuple[bytes, ...]
    longest: int
    parted: bool

    @staticmethod
    def load(path: str, alpha: float = ALPHA) -> Vocabulary:
        """Read on the driver. Scores of a merge model are ranks; a piece of rank r counts as likely as 1 / (r + 10)."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces, bytes_, surface = {}, np.zeros(256, np.int64), [b""] * n
        for i in range(n):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                bytes_[int(text[3:5], 16)] = i
                surface[i] = bytes([int(text[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or "\0" in text):
                surface[i] = text.replace(BLANK, " ").encode()
                pieces[surface[i]] = i
        scores = np.array([model.get_score(i) for i in range(n)])
        ranks = bool((scores <= 0).all() and (scores == np.rint(scores)).all())
        return Vocabulary.of(pieces, alpha * (-np.log(10 - scores) if ranks else scores), bytes_, tuple(surface))

    @staticmethod
    def of(pieces: dict[bytes, int], weights: np.ndarray, bytes_: np.ndarray, surface: tuple[bytes, ...]) -> Vocabulary:
        children: dict[int, int] = {}
        piece_at = [-1]
        for piece, i in pieces.items():
            node = 0
            for b in piece:
                node = children.setdefault(node << 8 | b, len(piece_at))
                if node == len(piece_at):
                    piece_at.append(-1)
            piece_at[node] = i
        edges = np.array(sorted(children), np.int64)
        parted = not any(b" " in p.lstrip(b" ") or (len(p) > 1 and b"\n" in p) for p in pieces)
        return Vocabulary(edges, np.array([children[e] for e in edges.tolist()], np.int64), np.array(piece_at), weights, bytes_, surface, max(map(len, pieces), default=1), parted)

    def table(self) -> np.ndarray:
        """The node behind each node and byte; 0 where there is none."""
        out = np.zeros(len(self.piece_at) << 8, np.uint16 if len(self.piece_at) < 1 << 16 else np.int32)
        out[self.edges] = self.targets
        return out

    def options(self, raw: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, byte after the last, piece) of every piece in these bytes. A character without a piece of its own is spelled in byte pieces; a NUL only so."""
        at, node = np.arange(len(raw)), np.zeros(len(raw), np.int64)
        firsts, lasts, pieces = [], [], []
        for depth in range(self.longest):
            to = table[node << 8 | raw[at + depth]]
            hit = to > 0
            at, node = at[hit], to[hit].astype(np.int64)
            found = self.piece_at[node]
            some = found >= 0
            firsts.append(at[some])
            lasts.append(at[some] + depth + 1)
            pieces.append(found[some])
            inside = at + depth + 1 < len(raw)
            at, node = at[inside], node[inside]
        first, last, piece = np.concatenate(firsts), np.concatenate(lasts), np.concatenate(pieces)
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        if not len(heads) or heads[0]:
            heads = np.r_[0, heads]
        after = np.r_[heads[1:], len(raw)]
        ends = np.zeros(len(raw), np.int64)
        ends[heads] = after
        whole = np.zeros(len(raw), bool)
        whole[first[ends[first] == last]] = True
        spelled = np.repeat(~whole[heads], after - heads)
        alone = np.flatnonzero(spelled)
        return np.r_[first, alone], np.r_[last, alone + 1], np.r_[piece, self.bytes_[raw[alone]]]


_PARTS = re.compile(rb" +[^ \n]*|\n|[^ \n]+")


def draw(key: np.ndarray, place: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    """Uniform numbers below 1 from the row's key, the part's place and the step within it."""
    x = key + np.asarray(place, np.uint64) * np.uint64(common.MULTIPLIERS[0]) + np.asarray(step, np.uint64) * np.uint64(common.MULTIPLIERS[1])
    return (common.mixed(common.mixed(x)) >> np.uint64(12)).astype(np.float64) / float(1 << 52)


class Sampler:
    """Remembers the filtered lattice of each distinct part as a table of states, one per byte; every state lists its last pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.table = vocabulary, vocabulary.table()
        self.forget()

    def forget(self) -> None:
        self.ends: dict[bytes, int] = {}
        # State 0 is where parts begin. The options of a state follow each other from `first` on, their shares summed up to 1.
        self.states = 1
        self.first, self.values, self.before, self.piece = np.zeros(1, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, parts: list[bytes]) -> None:
        """Filter new parts together, place by place."""
        v = self.vocabulary
        # Parts stand behind NULs, which no piece holds; a NUL within a part is spelled in bytes.
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        begins = np.cumsum(lengths + 1) - lengths
        raw = np.frombuffer(b"\0" + b"\0".join(parts), np.uint8)
        first, last, piece = v.options(raw, self.table)
        place = np.arange(len(raw)) - np.repeat(begins, lengths + 1) + 1
        keep = place[first] > 0
        first, last, piece = first[keep], last[keep], piece[keep]
        # Place of a boundary within its part: that of the byte before it.
        rank = place[last - 1]
        order = np.lexsort((last, rank))
        first, last, piece, rank = first[order], last[order], piece[order], rank[order]
        weight, log, share = v.weights[piece], np.zeros(len(raw) + 1), np.zeros(len(piece))
        edges = np.searchsorted(rank, np.arange(1, int(lengths.max()) + 2))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if i == j:
                continue
            term, end = log[first[i:j]] + weight[i:j], last[i:j]
            heads = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
            sizes = np.diff(np.r_[heads, j - i])
            top = np.maximum.reduceat(term, heads)
            ways = np.exp(term - np.repeat(top, sizes))
            total = np.add.reduceat(ways, heads)
            log[end[heads]] = top + np.log(total)
            share[i:j] = ways / np.repeat(total, sizes)
        order = np.argsort(last, kind="stable")
        first, last, piece, share = first[order], last[order], piece[order], share[order]
        heads = np.flatnonzero(np.r_[True, last[1:] != last[:-1]])
        sizes = np.diff(np.r_[heads, len(last)])
        sums = np.cumsum(share)
        value = np.minimum(sums - np.repeat(sums[heads] - share[heads], sizes), 1.0)
        value[heads + sizes - 1] = 1.0
        starts = np.zeros(len(raw) + 1, bool)
        starts[begins] = True
        own = np.zeros(len(raw) + 1, np.int64)
        own[last[heads]] = len(self.values) + heads
        self.first = np.r_[self.first, own]
        self.values = np.r_[self.values, value]
        self.before = np.r_[self.before, np.where(starts[first], 0, self.states + first)]
        self.piece = np.r_[self.piece, piece]
        self.ends.update(zip(parts, (self.states + begins + lengths).tolist(), strict=True))
        self.states += len(raw) + 1

    def _long(self, part: bytes, key: np.uint64, place: int) -> np.ndarray:
        """Pieces of one long part, listed block by block on the way there and again on the way back; only the forward weights are held."""
        v = self.vocabulary
        raw = np.frombuffer(part, np.uint8)
        log = array("d", [0.0])
        blocks = range(0, len(raw), BLOCK)

        def listed(low: int) -> list[list[tuple[int, int]]]:
            """(first byte, piece) by end, of ends in this block."""
            high, back = min(low + BLOCK, len(raw)), max(0, low - v.longest)
            # Whole characters on either side, so that a block spells the characters that the whole text does.
            while back and raw[back] & 0xC0 == 0x80:
                back -= 1
            beyond = min(len(raw), high + 8)
            out: list[list[tuple[int, int]]] = [[] for _ in range(high - low)]
            for f, e, p in zip(*(x.tolist() for x in v.options(raw[back:beyond], self.table)), strict=True):
                if low < e + back <= high:
                    out[e + back - low - 1].append((f + back, p))
            return out

        for low in blocks:
            for options in listed(low):
                terms = [log[f] + float(v.weights[p]) for f, p in options]
                top = max(terms, default=-math.inf)
                log.append(top + math.log(sum(math.exp(t - top) for t in terms)) if top > -math.inf else -math.inf)
        out: list[int] = []
        end, step, numbers = len(raw), 0, np.zeros(0)
        for low in reversed(blocks):
            options_of = listed(low)
            while end > low:
                if step % 4096 == 0:
                    numbers = draw(np.array([key]), np.array([place]), np.arange(step, step + 4096))
                left = float(numbers[step % 4096])
                step += 1
                live = [(f, p, log[f] + float(v.weights[p])) for f, p in options_of[end - low - 1] if log[f] > -math.inf]
                for f, p, weight in live:
                    left -= math.exp(weight - log[end])
                    if left < 0:
                        break
                out.append(p)
                end = f
        return np.array(out[::-1], np.int32)

    def encode(self, texts: list[bytes], keys: list[int]) -> list[np.ndarray]:
        """Piece ids of each text under its row's key. An empty text has none."""
        parts: list[bytes] = []
        counts = []
        for text in texts:
            own = (_PARTS.findall(b" " + text) if self.vocabulary.parted else [b" " + text]) if text else []
            parts += own
            counts.append(len(own))
        number = np.array(counts, np.int64)
        key = np.repeat(np.array(keys, np.uint64), number)
        place = np.arange(len(parts)) - np.repeat(np.cumsum(number) - number, number)
        ids, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i in range(0, len(parts), CHUNK_PARTS):
            j = i + CHUNK_PARTS
            found, n = self._some(parts[i:j], key[i:j], place[i:j])
            ids.append(found)
            lengths.append(n)
        ends = np.cumsum(np.concatenate(lengths))
        return np.split(np.concatenate(ids), np.r_[0, ends][np.cumsum(number)][:-1]) if texts else []

    def _some(self, parts: list[bytes], key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.states > MEMORY:
            self.forget()
        new = list({p for p in parts if len(p) <= LONG_PART} - self.ends.keys())
        if new:
            self._learn(new)
        state = np.fromiter(map(self.ends.get, parts, repeat(0)), np.int64, len(parts))
        long_parts = {i: self._long(parts[i], key[i], int(place[i])) for i in np.flatnonzero(state == 0).tolist()}
        at = np.flatnonzero(state)
        state, key, place, step = state[at], key[at], place[at], 0
        lengths = np.zeros(len(parts), np.int64)
        taken = []
        while len(at):
            option, drawn = self.first[state], draw(key, place, step)
            more = np.flatnonzero(self.values[option] <= drawn)
            while len(more):
                option[more] += 1
                more = more[self.values[option[more]] <= drawn[more]]
            taken.append((at, self.piece[option]))
            lengths[at] += 1
            state = self.before[option]
            live = state > 0
            at, state, key, place, step = at[live], state[live], key[live], place[live], step + 1
        for i, ids in long_parts.items():
            lengths[i] = len(ids)
        ends = np.cumsum(lengths)
        out = np.zeros(int(ends[-1]), np.int32)
        for k, (where, ids) in enumerate(taken):
            out[ends[where] - 1 - k] = ids
        for i, ids in long_parts.items():
            out[ends[i] - len(ids) : ends[i]] = ids
        return out, lengths


def decode(ids: np.ndarray, surface: tuple[bytes, ...]) -> bytes:
    """The bytes that the pieces spell, without the blank that encoding puts first."""
    return b"".join(map(surface.__getitem__, ids.tolist()))[1:]


def row_key(doc_id: int | None, text: bytes, seed: int) -> int:
    """The seed of a row: its doc_id, or its text where that is null."""
    return xxhash.xxh3_64_intdigest(b"null" + text if doc_id is None else b"%d" % doc_id, seed)


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """The batch's rows in groups of about a megabyte; a longer text goes alone."""
    ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or b"")
        if held >= 1 << 20 or i == len(texts) - 1:
            yield ids[begin : i + 1], texts[begin : i + 1]
            begin, held = i + 1, 0


def _encoded(sampler: Sampler, ids: list, texts: list, seed: int) -> list:
    found = sampler.encode([t or b"" for t in texts], [row_key(i, t or b"", seed) for i, t in zip(ids, texts, strict=True)])
    return [None if t is None else p for t, p in zip(texts, found, strict=True)]


def _shared(docs: DataFrame, model: str, alpha: float):
    return docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model, alpha))


def encode_pieces(docs: DataFrame, model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Sample a segmentation of every whole text.

    Returns one row per input row: doc_id, pieces (array of ids). A null text has null pieces, an empty
    text none. Rows equal in doc_id and text get equal pieces; a null doc_id takes its text as key; an
    empty table gives an empty result; other columns are ignored; a text of any length is segmented whole. The vocabulary (some MB at most) is read
    on the driver and broadcast; rows are independent, so nothing is shuffled.
    """
    common.bounded_batches(docs.sparkSession)
    shared = _shared(docs, model, alpha)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(shared.value)
        for batch in batches:
            for ids, texts in _grouped(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(_encoded(sampler, ids, texts, seed), pa.list_(pa.int32()))], ["doc_id", "pieces"])

    return common.texts_of(docs).mapInArrow(run, "doc_id long, pieces array<int>")


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the text that `pieces` spell; null pieces give a null text."""
    common.bounded_batches(encoded.sparkSession)
    shared = _shared(encoded, model, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface = shared.value.surface
        for batch in batches:
            texts = [None if p is None else decode(np.array(p, np.int32), surface) for p in batch["pieces"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.binary())], ["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))


def encode_documents(docs: DataFrame, model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Encode and decode in one pass: doc_id, pieces, n_pieces, text (decoded from the pieces), lossless (whether it equals the input). Nulls as in encode_pieces; a null text is lossless."""
    common.bounded_batches(docs.sparkSession)
    shared = _shared(docs, model, alpha)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(shared.value)
        surface = shared.value.surface
        for batch in batches:
            for ids, raw in _grouped(batch):
                pieces = _encoded(sampler, ids, raw, seed)
                texts = [None if p is None else decode(p, surface) for p in pieces]
                columns = [pa.array(ids, pa.int64()), pa.array(pieces, pa.list_(pa.int32())), pa.array([len(p) if p is not None else 0 for p in pieces], pa.int64()), pa.array(texts, pa.binary()), pa.array([a == b for a, b in zip(raw, texts, strict=True)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "pieces", "n_pieces", "text", "lossless"])

    done = common.texts_of(docs).mapInArrow(run, "doc_id long, pieces array<int>, n_pieces long, text binary, lossless boolean")
    return done.withColumn("text", F.col("text").cast("string"))
