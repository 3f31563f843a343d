"""Token ids of a corpus in binary files.

Ids are ranked by how often the corpus has them, so that frequent ids become small numbers, and written in a
byte-aligned code of variable length: one to four data bytes a number, and apart from them control bytes
that hold the lengths of four numbers each. A table of 256 rows turns control bytes into lengths, a table of
ranks turns numbers back into ids; both are numpy lookups over a whole file.

A folder holds `ranks.tok` (ids by rank), `part-*.tok` (whole documents in ascending doc_id order) and
`manifest` (Parquet: the files with their numbers of documents and ids).
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm import common

#: A file ends with the document that brings it to so many ids.
FILE_IDS = 2_000_000
#: Bytes of words and ids that a worker remembers, twice, with what Python needs for each word; words of a call of the tokenizer; bytes of a text that are split at a time.
MEMORY_BYTES, WORD_BYTES, CALL_WORDS, SPLIT_BYTES = 96 << 20, 128, 2000, 4 << 20

MAGIC = b"TIDETOK1"
MANIFEST = "name string, part int, seq int, n_docs long, n_ids long, bytes long"

#: Control byte -> lengths of its four numbers, a byte each in one number.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)).reshape(-1).view("<u4")


def encode_numbers(values: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers below 2^32 as control bytes and data bytes."""
    v = np.ascontiguousarray(values, "<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = extra
    control = padded[0::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    starts = np.cumsum(extra, dtype=np.int64) - extra + np.arange(len(v))
    data = np.empty(len(v) + int(extra.sum(dtype=np.int64)), np.uint8)
    data[starts] = v.astype(np.uint8)
    for k in range(1, 4):
        at = np.flatnonzero(extra >= k)
        data[starts[at] + k] = (v[at] >> np.uint32(8 * k)).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def decode_numbers(control: bytes, data: bytes, n: int) -> np.ndarray:
    sizes = LENGTHS.take(np.frombuffer(control, np.uint8)).view(np.uint8)[:n]
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    raw = np.frombuffer(data, np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in range(1, 4):
        at = np.flatnonzero(sizes > k)
        out[at] |= raw[starts[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_file(doc_ids: list[int | None], sizes: np.ndarray, values: np.ndarray) -> bytes:
    """One file: lengths, then null marks, doc_ids, numbers per document and the numbers, then a checksum."""
    parts = [
        np.packbits([d is None for d in doc_ids]).tobytes() if doc_ids else b"",
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        *encode_numbers(sizes),
        *encode_numbers(values),
    ]
    body = MAGIC + struct.pack("<8q", len(doc_ids), len(values), *map(len, parts)) + b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, numbers per document and the numbers of a file; a damaged file is an error."""
    head = len(MAGIC) + 64
    if content[: len(MAGIC)] != MAGIC or len(content) < head + 4 or zlib.crc32(content[:-4]) != struct.unpack("<I", content[-4:])[0]:
        raise ValueError("not a whole token file")
    n_docs, n_ids, *lengths = struct.unpack("<8q", content[len(MAGIC) : head])
    ends = head + np.cumsum(lengths)
    nulls, ids, *coded = (content[e - n : e] for e, n in zip(ends.tolist(), lengths, strict=True))
    none = np.unpackbits(np.frombuffer(nulls, np.uint8))[:n_docs].tolist()
    doc_ids = [None if x else d for d, x in zip(np.frombuffer(ids, "<i8").tolist(), none, strict=True)]
    return doc_ids, decode_numbers(coded[0], coded[1], n_docs), decode_numbers(coded[2], coded[3], n_ids)


_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


#: A word of letters only, which is one unit for the tokenizer, and marks that may follow it, which are units of their own.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())


class Encoder:
    """Ids of texts, each word of which is encoded once as long as it is remembered.

    The tokenizer must fold A-Z, drop white space, split ASCII marks from letters before them and end each unit with
    a token that has its suffix for word ends; then a word's ids don't depend on the words around it.
    Ids are little-endian numbers of `dtype`: 16 bits if the vocabulary allows it, else 32.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel unit
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(self.tokenizer.model.end_of_word_suffix)]] = True
        self.dtype = np.dtype("<u2" if len(self.ends) <= 1 << 16 else "<u4")
        self.forget()

    def forget(self) -> None:
        self.now: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.used = 0

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, words: list[bytes], ids: list[bytes]) -> None:
        self.now.update(zip(words, ids, strict=True))
        self.used += WORD_BYTES * len(words) + sum(map(len, words)) + sum(map(len, ids))

    def _learn(self, words: Iterable[bytes]) -> None:
        """Have words that the memory lacks: from the memory before, by the tokenizer, or from their parts."""
        now, old = self.now, self.old
        back, plain, other, joint, heads, tails = [], [], [], [], [], []
        for w in words:
            if w in old:
                back.append(w)
            elif w.isalpha():
                plain.append(w)
            elif not (head := w.rstrip(_MARKS)) or not (head.isalpha() or _LETTERS.fullmatch(head)):
                other.append(w)
            elif len(head) == len(w):
                plain.append(w)
            else:
                joint.append(w)
                heads.append(head)
                tails.append(w[len(head) :])
        self._keep(back, [old[w] for w in back])
        for at in range(0, len(plain), CALL_WORDS):
            part = plain[at : at + CALL_WORDS]
            ids = np.array(self._encoded([b" ".join(part).decode()])[0], self.dtype)
            ends = np.flatnonzero(self.ends[ids]) + 1  # words of letters in one call: each ends at the next token with the suffix
            if len(ends) != len(part):
                raise ValueError("the tokenizer doesn't end every word with its suffix")
            raw, cuts = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
            self._keep(part, [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)])
        for at in range(0, len(other), CALL_WORDS):
            part = other[at : at + CALL_WORDS]
            self._keep(part, [np.array(x, self.dtype).tobytes() for x in self._encoded([w.decode("utf-8", "replace") for w in part])])
        if joint:
            self._learn({w for w in (*heads, *tails) if w not in now})
            self._keep(joint, [now[h] + now[t] for h, t in zip(heads, tails, strict=True)])

    def _of(self, texts: list[bytes]) -> list[np.ndarray]:
        """Words are told apart in Arrow, so that each is looked up once. What is remembered is renewed when it is full: words that still occur come back from the memory before."""
        if self.used > MEMORY_BYTES:
            self.now, self.old, self.used = {}, self.now, 0
        words = pc.ascii_split_whitespace(pa.array(map(_folded, texts), pa.binary()).view(pa.string()))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.now.get, distinct))
        lacking = [i for i, x in enumerate(found) if x is None]
        self._learn([distinct[i] for i in lacking])
        for i in lacking:
            found[i] = self.now[distinct[i]]
        known = np.frombuffer(b"".join(found), self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        at = coded.indices.to_numpy()
        counts = sizes[at]
        ends = np.cumsum(counts)
        ids = known[np.repeat((np.cumsum(sizes) - sizes)[at] - ends + counts, counts) + np.arange(counts.sum())]
        return np.split(ids, np.concatenate([[0], ends])[words.offsets.to_numpy()[1:-1]])

    def _long(self, text: bytes) -> np.ndarray:
        out, start = [], 0
        while start < len(text):
            cut = _SPACE.search(text, start + SPLIT_BYTES)
            end = cut.start() if cut else len(text)
            out += self._of([text[start:end]])
            start = end
        return np.concatenate(out)

    def ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text; small ones share their lookups, large ones are split."""
        few: list[bytes] = []
        held = 0
        for t in texts:
            if few and held + len(t) > SPLIT_BYTES:
                yield from self._of(few)
                few, held = [], 0
            if len(t) > SPLIT_BYTES:
                yield self._long(t)
            else:
                few.append(t)
                held += len(t)
        if few:
            yield from self._of(few)


def _folded(text: bytes) -> bytes:
    """Added tokens are found in the text as it stands, before letters are folded."""
    return text if b"<|" in text else text.lower()


#: One encoder for all tasks that a Python worker runs.
_ENCODERS: dict[str, Encoder] = {}


def encoder_of(tokenizer: str) -> Encoder:
    if tokenizer not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer] = Encoder(tokenizer)
    return _ENCODERS[tokenizer]


def place_of(path: str):
    """The file system of a path and the path in it; Spark's name of an object store becomes the one that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def _write(path: str, content: bytes) -> None:
    """Under a name of its own first: a reader, or another attempt at the same task, sees whole files only."""
    import uuid

    files, place = place_of(path)
    files.create_dir(place.rpartition("/")[0], recursive=True)
    own = f"{place}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(own) as f:
        f.write(content)
    files.move(own, place)


#: A block becomes one file. Its ids are numbers of `width` bytes; those that it has are `met` as often as `times` says.
BLOCK = "part int, seq int, doc_ids array<long>, sizes binary, width int, ids binary, met array<long>, times array<long>"


def _read(path: str) -> bytes:
    files, place = place_of(path)
    with files.open_input_stream(place, buffer_size=0) as f:
        return f.read()


def encoded(docs: DataFrame, tokenizer: str, end_id: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Stored blocks of whole documents, each of which becomes one file: (part, seq) orders them by doc_id (null first), then by a hash of the text."""
    spark = docs.sparkSession
    common.bounded_batches(spark, 4 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, seq = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        dtype = np.promote_types(encoder.dtype, np.min_scalar_type(end_id)).newbyteorder("<")
        end = np.array([end_id], dtype)
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            counts = np.bincount(ids)
            met = np.flatnonzero(counts)
            columns = {
                "part": pa.array([part], pa.int32()),
                "seq": pa.array([seq], pa.int32()),
                "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                "sizes": pa.array([np.fromiter(map(len, held), "<i8", len(held)).tobytes()], pa.binary()),
                "width": pa.array([dtype.itemsize], pa.int32()),
                "ids": pa.array([ids.tobytes()], pa.binary()),
                "met": pa.array([met], pa.list_(pa.int64())),
                "times": pa.array([counts[met]], pa.list_(pa.int64())),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.ids([t or b"" for t in batch["text"].to_pylist()]), strict=True):
                doc_ids.append(doc_id)
                held.append(np.concatenate([ids, end]))
                total += len(held[-1])
                if total >= file_ids:
                    yield flush()
                    doc_ids, held, total, seq = [], [], 0, seq + 1
        if held:
            yield flush()

    rows = common.texts_of(docs).withColumn("key", F.xxhash64(F.coalesce("text", F.lit(b""))))
    # Rows of one id are told apart by their text, and equal rows by chance, so no range has to hold all of them.
    spread = rows.repartitionByRange(common.part_count(spark), "doc_id", "key", F.rand(7)).sortWithinPartitions("doc_id", "key")
    return common.stored(spread.mapInArrow(run, BLOCK), "token-ids")


def id_counts(blocks: DataFrame) -> DataFrame:
    """How often each id occurs: a task sends one row for each id that it met."""
    return blocks.select(F.arrays_zip("met", "times").alias("x")).select(F.inline("x").alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every whole text of docs (doc_id, text), end each document with end_id, and write token files to a new folder.

    `tokenizer` is the path of a file of the tokenizers library, of the kind that `Encoder` asks for. Returns the manifest.
    Documents go by doc_id (null first), then by a hash of their text; rows equal in both are as good as each
    other. A null or empty text has the end id only; a document of any length stays in one file; repeated rows
    are documents of their own; an empty table gives a folder without parts; other columns are ignored. Of ids
    that occur equally often the lesser comes first. The folder must lie in a file system that all machines
    share and that Arrow knows (file, hdfs, s3, gs). A task that is run again replaces its files by equal ones.
    """
    spark = docs.sparkSession
    blocks = encoded(docs, tokenizer, end_id, file_ids)
    # One number for each id of the vocabulary, however large the corpus.
    counts = id_counts(blocks).orderBy(F.desc("n"), "id").select("id").toPandas()["id"].to_numpy(np.uint32)
    _write(f"{folder}/ranks.tok", pack_file([], np.zeros(0, np.uint32), counts))
    rank_of = np.zeros(int(counts.max()) + 1 if len(counts) else 1, np.uint32)
    rank_of[counts] = np.arange(len(counts), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = f"part-{row['part']:06d}-{row['seq']:06d}.tok"
                ids = np.frombuffer(row["ids"], f"<u{row['width']}")
                content = pack_file(row["doc_ids"], np.frombuffer(row["sizes"], "<i8"), ranks.value[ids])
                _write(f"{folder}/{name}", content)
                yield pa.RecordBatch.from_pydict({"name": [name], "part": pa.array([row["part"]], pa.int32()), "seq": pa.array([row["seq"]], pa.int32()), "n_docs": [len(row["doc_ids"])], "n_ids": [len(ids)], "bytes": [len(content)]})

    blocks.drop("met", "times").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    common.discard(blocks)
    return spark.read.parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder of token files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, of 32 bits).

    Reads the files that the manifest names, however many others lie there; a damaged or missing file is an
    error. A folder without parts gives no rows. A task holds one file and the documents of the present one.
    """
    common.bounded_batches(spark)
    manifest = spark.read.parquet(f"{folder}/manifest")
    # One number per range of documents, of which there are as many as tasks; then each file within its range.
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", before(Window.orderBy("part"), "n")).drop("n")
    starts = manifest.withColumn("within", before(Window.partitionBy("part").orderBy("seq"), "n_ids")).join(F.broadcast(ranges), "part")
    starts = starts.select("name", (F.col("before") + F.col("within")).alias("first")).repartition(common.part_count(spark))
    ids_by_rank = spark.sparkContext.broadcast(unpack_file(_read(f"{folder}/ranks.tok"))[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, name in zip(batch["first"].to_pylist(), batch["name"].to_pylist(), strict=True):
                doc_ids, sizes, values = unpack_file(_read(f"{folder}/{name}"))
                ids = ids_by_rank.value[values].astype("<u4").tobytes()
                sizes = sizes.astype(np.int64)
                ends = np.cumsum(sizes)
                for at in range(0, len(doc_ids), 1024):
                    e, n = ends[at : at + 1024], sizes[at : at + 1024]
                    own = [ids[4 * a : 4 * b] for a, b in zip((e - n).tolist(), e.tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids[at : at + 1024], pa.int64()), "start": pa.array(first + e - n, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids": pa.array(own, pa.binary())})

    return starts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
