"""Language ID by cross-parsing.

Labelled text of each language becomes a suffix automaton. A text is parsed, word by word, into the
longest phrases that the automaton holds; a language whose own text the words resemble needs fewer
phrases. Phrases per letter, times the logarithm of the reference's length, estimate the entropy of the
text under that language; the language with the least wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm import common
from tidewatch.llm.sampling import bounded, held_out

#: Labelled text per language, if the caller states none: documents, and characters.
SAMPLE_DOCS, SAMPLE_CHARS = 200, 60_000
#: Characters of a piece of a sampled document.
PIECE = 1_000
#: Words whose phrase counts a task remembers, and the longest word it does so for.
MEMORY, MEMORY_WORD = 250_000, 48


def clean(token: str) -> str:
    return "".join(c for c in token.lower() if c.isalpha())


class SuffixAutomaton:
    """Accepts every substring of the text it was built from."""

    def __init__(self, text: str):
        step: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new, p = len(step), last
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = twin
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
            last = new
        self.step = step

    def phrases(self, text: str) -> int:
        """How many phrases a greedy parse into longest matches takes; a character that never occurs is one of its own."""
        step, at, n = self.step, -1, 0
        root = step[0]
        for c in text:
            to = step[at].get(c, -1) if at >= 0 else -1
            if to < 0:
                n += 1
                to = root.get(c, -1)
            at = to
        return n


class Identifier:
    def __init__(self, references: dict[str, str]):
        self.langs = sorted(references)
        self.automata = [SuffixAutomaton(references[x]) for x in self.langs]
        self.bits = np.array([math.log2(max(2, len(references[x]))) for x in self.langs])
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.counts = np.zeros((1024, len(self.langs) + 1), np.int64)

    def _parse(self, token: bytes) -> list[int]:
        word = clean(token.decode("utf-8", "replace"))
        if not word:
            return [0] * (len(self.langs) + 1)
        marked = f" {word} "
        return [*(a.phrases(marked) for a in self.automata), len(word)]

    def _learn(self, token: bytes) -> int:
        at = len(self.known)
        if at == len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.counts[at] = self._parse(token)
        self.known[token] = at
        return at

    def totals(self, text: bytes) -> np.ndarray:
        """Phrases under each language, then letters, over the whole text."""
        total = np.zeros(len(self.langs) + 1, np.int64)
        tokens = text.split()
        for start in range(0, len(tokens), 100_000):
            part = tokens[start : start + 100_000]
            if len(self.known) > MEMORY:
                self.forget()
            get, ids = self.known.get, []
            for t in part:
                i = get(t)
                if i is None:
                    if len(t) > MEMORY_WORD:
                        total += self._parse(t)
                        continue
                    i = self._learn(t)
                ids.append(i)
            total += self.counts[np.array(ids, np.int64)].sum(0)
        return total

    def predict(self, text: bytes | None) -> tuple[str, float]:
        total = self.totals(text or b"")
        if not total[-1] or not self.langs:
            return "und", 0.0
        bits = total[:-1] * self.bits / total[-1]
        best = int(np.argmin(bits))
        weight = np.exp2(-(bits - bits[best]) * math.sqrt(min(int(total[-1]), 10_000)))
        return self.langs[best], round(float(1 / weight.sum()), 9)


def references(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Words of labelled documents outside the held-out fold, a bounded sample for each language.

    The sample has the `sample_docs` documents of least hash of doc_id, of any length. Where they hold more than
    `sample_chars` characters, pieces of PIECE characters from all over them are taken in the order of a hash,
    until they reach that bound; words that a piece cuts are left out.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.where("text IS NOT NULL AND lang IS NOT NULL").where(~held_out())
    # One row per label value: as many as there are languages.
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    hashed = bounded(own, "lang", counts, 2 * sample_docs)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id", F.xxhash64("text"))
    some = common.stored(hashed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_docs).drop("n"), "language-sample")
    n_pieces = F.greatest(F.lit(1), F.ceil(F.length("text") / PIECE)).cast("int")
    cut = some.select("lang", "doc_id", F.xxhash64("text").alias("t"), F.explode(F.transform(F.sequence(F.lit(0), n_pieces - 1), lambda i: F.struct(i.alias("i"), (i == n_pieces - 1).alias("last"), F.substring("text", i * PIECE + 1, F.lit(PIECE)).alias("piece")))).alias("p"))
    pieces = cut.select("lang", "doc_id", "t", "p.*").withColumn("h", F.xxhash64("doc_id", "t", "i", F.lit(18)))
    sizes = {r.lang: r.n for r in some.groupBy("lang").agg(F.sum(n_pieces).alias("n")).collect()}
    few = pieces.where(_least("lang", sizes, 3 * (sample_chars // PIECE + 1)))
    line = Window.partitionBy("lang").orderBy("h", "doc_id", "i", "t")
    before = F.coalesce(F.sum(F.length("piece")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = few.withColumn("before", before).where(F.col("before") < sample_chars).orderBy("lang", "h", "doc_id", "i", "t").select("lang", "piece", "i", "last").collect()
    common.discard(some)
    out: dict[str, list[str]] = {x: [] for x in counts}
    for lang, piece, i, last in dict.fromkeys(map(tuple, rows)):
        words = piece.split()
        cut_front, cut_back = i > 0 and not piece[:1].isspace(), not last and not piece[-1:].isspace()
        if len(words) > 2:  # what has no blanks stays as it is
            words = words[cut_front : len(words) - cut_back]
        out[lang] += [w for w in map(clean, words) if w]
    return {x: " " + " ".join(words) + " " for x, words in out.items() if words}


def _least(group: str, counts: dict, n: int) -> Column:
    """About the n rows of least `h` in each group of known size."""
    share = F.lit(1.0)
    for value, size in counts.items():
        share = F.when(F.col(group) == F.lit(value), F.lit(min(1.0, n / max(1, size)))).otherwise(share)
    return F.pmod(F.col("h"), F.lit(1 << 30)) < share * F.lit(float(1 << 30))


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """Predict the language of every document's whole text.

    Learns only from text and non-null lang of rows outside the held-out fold, from a sample bounded as in
    `references`. Returns one row per input
    row: doc_id, held_out, lang_pred, score (0 to 1, the winner's share). lang_pred is `und` with score 0 if
    the text is null, empty or without letters, or if nothing was learned; ties go to the lesser lang value;
    a null doc_id is held out; repeated rows are judged alike; other columns are ignored; an empty table gives an empty result; a text of
    any length is parsed whole, word by word; bytes that are no UTF-8 count as no letters.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(references(docs, sample_docs, sample_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Identifier(shared.value)
        for batch in batches:
            found = [model.predict(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    done = common.texts_of(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return done.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
