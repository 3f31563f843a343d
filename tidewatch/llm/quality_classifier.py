"""Quality classifier: supervised subword embeddings.

A text is the average of the vectors of its words and of the character n-grams inside them, all hashed
into one table; a softmax layer over that average gives the label. Table and layer are learned together
by stochastic gradient descent in numpy, on a bounded sample of labelled documents. Scoring uses that
the softmax of an average is linear below the exponent: each table row is reduced once to its share of
the log odds, in fixed point, so that a document's score doesn't depend on what it is batched with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.sampling import bounded, held_out

#: Rows of the table, width of a vector, lengths of character n-grams.
ROWS, WIDTH, GRAMS = 1 << 17, 12, (3, 4)
#: The sample that is learned from, if the caller states none: documents of each label, and bytes of text in all.
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 12_000_000
EPOCHS, RATE, SEED = 6, 0.5, 11
#: Characters that are hashed together; a longer text goes alone, piece by piece.
CHUNK = 1_000_000
_FIXED = float(1 << 20)


def _decoded(text: bytes) -> str:
    return text.decode("utf-8", "replace")


def _points(text: str) -> np.ndarray:
    """Code points; all white space counts as a blank."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points[(points >= 9) & (points <= 13)] = 32
    return points


def _grams(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each n-gram starts that has no blank inside, and its hash."""
    count = len(points) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(count, n * 0x9E3779B1, np.uint64)
    inner = np.ones(count, bool)
    for k in range(n):
        h = h * np.uint64(0x100000001B3) + points[k : k + count]
        if 0 < k < n - 1:
            inner &= points[k : k + count] != 32
    at = np.flatnonzero(inner)
    return at, common.mixed(h[at])


def _rows(hashes: np.ndarray) -> np.ndarray:
    """Table rows; row 0 stands for the bias."""
    return (hashes % np.uint64(ROWS - 1) + np.uint64(1)).astype(np.int64)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all words and character n-grams, and for each the number of its text."""
    raw = _points(" " + " ".join(texts) + "  ")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    doc = np.r_[0, np.repeat(np.arange(len(texts)), lengths), len(texts) - 1, len(texts) - 1]
    rows, owners = [], []
    for n in GRAMS:
        at, h = _grams(raw, n)
        rows.append(h)
        owners.append(doc[at + 1])
    edge = np.diff((raw == 32).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    base = common.MULTIPLIERS[0]
    np.cumsum((raw + np.uint64(1)) * common._powers(base, len(raw))[: len(raw)], out=sums[1:])
    rows.append(common.mixed((sums[ends] - sums[starts]) * common._powers(pow(base, -1, 1 << 64), len(raw))[starts]))
    owners.append(doc[starts])
    return _rows(np.concatenate(rows)), np.concatenate(owners)


def _long_word(word: str) -> Iterator[np.ndarray]:
    """The same for one word of any length, CHUNK characters at a time."""
    total, scale, base = 0, 1, common.MULTIPLIERS[0]
    padded = f" {word} "
    for at in range(0, len(padded), CHUNK):
        for n in GRAMS:
            yield _rows(_grams(_points(padded[at : at + CHUNK + n - 1]), n)[1])
    for at in range(0, len(word), CHUNK):
        part = _points(word[at : at + CHUNK]) + np.uint64(1)
        total = (total + scale * int((part * common._powers(base, len(part))[: len(part)]).sum(dtype=np.uint64))) % (1 << 64)
        scale = scale * pow(base, len(part), 1 << 64) % (1 << 64)
    yield _rows(common.mixed(np.array([total], np.uint64)))


def long_features(text: str) -> Iterator[np.ndarray]:
    """Table rows of one text of any length, in pieces. Pieces end at white space, or else hold one long word, so they are those of the whole text."""
    at = 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        if end < len(text):
            cut = max(text.rfind(c, at + 1, end) for c in " \t\n\v\f\r")
            if cut < 0:
                found = [i for i in (text.find(c, end) for c in " \t\n\v\f\r") if i >= 0]
                end = min(found, default=len(text))
                word = text[at:end].lstrip(" \t\n\v\f\r")
                if len(word) > CHUNK // 2:
                    yield from _long_word(word)
                    at = end
                    continue
            else:
                end = cut
        yield features([text[at:end]])[0]
        at = end


@dataclass(frozen=True)
class Model:
    """Log odds of label 1 per table row in fixed point; the bias is row 0."""

    odds: np.ndarray

    def log_odds(self, texts: list[bytes]) -> np.ndarray:
        total, count = np.full(len(texts), int(self.odds[0])), np.ones(len(texts), np.int64)
        held: list[tuple[int, str]] = []

        def flush() -> None:
            if not held:
                return
            row, owner = features([t for _, t in held])
            sums = np.zeros(len(row) + 1, np.int64)
            order = np.argsort(owner, kind="stable")
            np.cumsum(self.odds[row[order]], out=sums[1:])
            edges = np.searchsorted(owner[order], np.arange(len(held) + 1))
            index = np.array([i for i, _ in held])
            total[index] += sums[edges[1:]] - sums[edges[:-1]]
            count[index] += np.diff(edges)
            held.clear()

        size = 0
        for i, raw in enumerate(texts):
            text = _decoded(raw)
            if len(text) > CHUNK:
                for row in long_features(text):
                    total[i] += int(self.odds[row].sum())
                    count[i] += len(row)
                continue
            if size + len(text) > CHUNK:
                flush()
                size = 0
            held.append((i, text))
            size += len(text)
        flush()
        return total / count / _FIXED


def fit(texts: list[bytes], labels: list[int], prior: float | None = None) -> Model:
    """Learn from texts labelled 0 or 1. prior: share of label 1 where it differs from the sample's."""
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (ROWS, WIDTH))
    layer = np.zeros((WIDTH, 2))
    bags = []
    for text in texts:
        row = np.concatenate([np.zeros(1, np.int64), *long_features(_decoded(text))])
        rows, n = np.unique(row, return_counts=True)
        bags.append((rows, n / len(row)))
    target = np.eye(2)[np.array(labels, np.int64)] if labels else np.zeros((0, 2))
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)).tolist():
            rate = RATE * (1 - done / steps)
            done += 1
            rows, weight = bags[i]
            mean = weight @ table[rows]
            z = mean @ layer
            p = np.exp(z - z.max())
            wrong = p / p.sum() - target[i]
            back = layer @ wrong
            layer -= rate * np.outer(mean, wrong)
            # The gradient of an average is spread over its features; each takes the step of its own weight.
            table[rows] -= rate * np.sqrt(weight)[:, None] * back
    odds = table @ (layer[:, 1] - layer[:, 0])
    if labels and 0 < sum(labels) < len(labels) and prior is not None:
        share = sum(labels) / len(labels)
        clip = min(max(prior, 1e-3), 1 - 1e-3)
        # The average divides the bias row like any other, so the shift goes to every row.
        odds = odds + np.log(clip / (1 - clip)) - np.log(share / (1 - share))
    elif not labels or sum(labels) in (0, len(labels)):
        odds = np.full(ROWS, 0.0 if not labels else (4.0 if sum(labels) else -4.0))
    return Model(np.rint(odds * _FIXED).astype(np.int64))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample of rows outside the held-out fold.

    In the order of a hash of doc_id, whatever their length: about `sample_docs` documents of each label, up
    to the first with which they would hold more than `sample_bytes`; that one and those after it are left out.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality")).where("quality IN (0, 1)").where(~held_out()).withColumn("quality", F.col("quality").cast("int"))
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    counts = {r.quality: r.n for r in own.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = bounded(own, "quality", counts, sample_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).where("text IS NOT NULL")
    found = texts.join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("doc_id", F.lit(17)))
    # Of an id that repeats, the least text counts. At most a few times sample_docs rows of numbers.
    sizes = found.select("h", "doc_id", F.octet_length("text").alias("n")).groupBy("h", "doc_id").agg(F.max("n").alias("n")).orderBy("h", "doc_id").limit(3 * sample_docs).collect()
    held, ids = 0, []
    for r in sizes:
        held += r.n
        if held > sample_bytes and ids:
            break
        ids.append(r.doc_id)
    spark = docs.sparkSession
    kept = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    rows = found.join(F.broadcast(kept), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"), F.first("h").alias("h")).collect()
    rows.sort(key=lambda r: (r.h, r.doc_id))
    n = sum(counts.values())
    return fit([bytes(r.text) for r in rows], [r.quality for r in rows], counts.get(1, 0) / n if n else None)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row: the probability of label 1, rounded to 9 places. A null text scores as an empty one, which has the bias alone."""
    spark: SparkSession = docs.sparkSession
    common.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model.odds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value)
        for batch in batches:
            z = own.log_odds([t or b"" for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.round(1 / (1 + np.exp(-z)), 9))], ["doc_id", "score"])

    return common.texts_of(docs).mapInArrow(run, "doc_id long, score double")


def filter_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """Rows of docs, all columns, whose text the trained model doesn't reject. Each row is judged by its own text, a null one as an empty one; bytes that are no UTF-8 count as replacement characters."""
    common.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels).odds)

    @F.pandas_udf("double")
    def of(texts):
        z = Model(shared.value).log_odds([t or b"" for t in texts])
        return pd.Series(np.round(1 / (1 + np.exp(-z)), 9))

    return docs.where(of(F.col("text").cast("string").cast("binary")) >= least)


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """Train on labels (doc_id, quality) outside the held-out fold and score every document.

    Returns one row per input row: doc_id, held_out, score, predicted (1 if score >= least). Labels that
    are null, other than 0 or 1, or contradict each other are left out; repeated labels count once; with
    labels of one kind only every text scores near that kind, without labels 0.5; a null doc_id is held
    out; an empty table gives an empty result; other columns, lang and source included, are ignored. A text
    of any length is scored whole, in pieces; bytes that are no UTF-8 count as replacement characters.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
