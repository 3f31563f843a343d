"""Repair of conversations: which turns to keep, give another role, delete or add, so that roles alternate.

A conversation's turns become a signature, one letter each for role and fault. Distinct signatures, sorted,
form a prefix trie: a walk over it computes a layer of a dynamic program (least cost to reach each state of
the role grammar) for each prefix once, and emits the cheapest edits wherever a signature ends. Only
signatures gather, a byte a turn; texts are read once more, in order, to write the repaired turns.

Edits: keep (K) costs 0, another role (R: user or assistant) 1, delete (D) 2, insert (I: an empty turn of user
or assistant) 5; a truncated turn that stays costs 5 more; blank and repeated turns must be deleted. Roles must
spell `(s?(ua)+)?` by their initials: system, user, assistant.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm import common

BLANKS = " \t\n\x0b\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: States: nothing yet, only a system turn, last a user's, last an assistant's. State -> initial -> state.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
#: In this order one pass over them closes a layer, as no chain of useful insertions is longer than two.
INSERTIONS = ((0, 2), (1, 2), (3, 2), (2, 3))
NEVER = 1 << 60


def _edges(code: str) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, state before, state after, cost) for a turn of this code, the letters in ASCII order: `-` must go; a capital is truncated; x is any other role."""
    out = [("D", s, s, DELETE) for s in range(4)]
    if code != "-":
        extra = TRUNCATED if code.isupper() else 0
        out += [("K", s, to[code.lower()], extra) for s, to in enumerate(MOVES) if code.lower() in to]
        out += [("R", s, to[r], extra + REROLE) for s, to in enumerate(MOVES) for r in "ua" if r in to]
    return tuple(out)


EDGES = {c: _edges(c) for c in "-suaxSUAX"}


def _closed(costs: list[int]) -> tuple[int, ...]:
    for s, t in INSERTIONS:
        costs[t] = min(costs[t], costs[s] + INSERT)
    return tuple(costs)


FIRST = _closed([0, NEVER, NEVER, NEVER])


def _layer(before: tuple[int, ...], code: str) -> tuple[int, ...]:
    costs = [NEVER] * 4
    for _, s, t, w in EDGES[code]:
        costs[t] = min(costs[t], before[s] + w)
    return _closed(costs)


def _answer(signature: str, layers: list[tuple[int, ...]]) -> tuple[int, str]:
    """The least cost, and the ASCII-least letters that have it: states on cheapest ways are marked from the end, then walked from the start."""
    cost = min(layers[-1][s] for s in FINAL)
    marked = [0] * len(layers)
    now = sum(1 << s for s in FINAL if layers[-1][s] == cost)
    for i in range(len(signature), -1, -1):
        costs = layers[i]
        for s, t in reversed(INSERTIONS):
            if now >> t & 1 and costs[s] + INSERT == costs[t]:
                now |= 1 << s
        marked[i] = now
        if i:
            now = 0
            for _, s, t, w in EDGES[signature[i - 1]]:
                if marked[i] >> t & 1 and layers[i - 1][s] + w == costs[t]:
                    now |= 1 << s
    out, i, s = [], 0, 0
    while i < len(signature) or s not in FINAL or layers[i][s] != cost:
        spent = layers[i][s]
        steps = [("I", i, t) for a, t in INSERTIONS if a == s and marked[i] >> t & 1 and spent + INSERT == layers[i][t]]
        if i < len(signature):
            steps += [(x, i + 1, t) for x, a, t, w in EDGES[signature[i]] if a == s and marked[i + 1] >> t & 1 and spent + w == layers[i + 1][t]]
        letter, i, s = min(steps)
        out.append(letter)
    return cost, "".join(out)


def solve(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) for sorted signatures. The branch of the prefix trie that leads to the present one is held; sorted order visits the trie depth-first, so a branch that is left never comes back."""
    branch, layers = "", [FIRST]
    for signature in signatures:
        shared = 0
        for a, b in zip(branch, signature):
            if a != b:
                break
            shared += 1
        del layers[shared + 1 :]
        for code in signature[shared:]:
            layers.append(_layer(layers[-1], code))
        branch = signature
        yield (signature, *_answer(signature, layers))


def _rows(turns: DataFrame) -> DataFrame:
    """Turns in plain types, nulls in role and text as one space; `lost` turns only say that their conversation exists."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    lost = F.col("lost") if "lost" in turns.columns else F.lit(False)
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), lost.alias("lost"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults by crc32 of `conv_id:turn` (a null is one space) modulo 20: 0 is lost, 1 has an empty text, 2 loses `.!?`, 3 comes twice, 4 is a user's."""
    rows = _rows(turns.select("conv_id", "turn", "role", "text"))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("h", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20)
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("h") == 0).alias("lost"), twice.alias("copy")).drop("copy")


SUMMARY = "conv_id long, signature string, gaps long, blank long, duplicate long, truncated long, illegal long"


def summaries(turns: DataFrame) -> DataFrame:
    """One row per conversation: its signature, and its faults in numbers."""
    rows = _rows(turns).repartition(common.part_count(turns.sparkSession), "conv_id")
    rows = rows.withColumns({"role": F.when(~F.col("lost"), F.col("role")), "text": F.when(~F.col("lost"), F.col("text"))})
    seen = F.row_number().over(Window.partitionBy("conv_id", "lost", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(F.col("lost"), 4).when(end == "", 1).when(seen, 2).when(~end.isin(".", "!", "?"), 3).otherwise(0)
    # Of equal rows of one turn, the one that is no duplicate comes first.
    judged = rows.withColumn("seen", seen).withColumn("fault", fault.cast("int")).sortWithinPartitions("conv_id", F.desc("lost"), F.asc_nulls_first("turn"), "role", "text", "seen")
    slim = judged.select("conv_id", "turn", "fault", F.left("role", F.lit(1)).alias("initial"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("signature", pa.string()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))])
        codes, counts, illegal, turns, least, most, before = bytearray(), [0] * 5, 0, 0, None, None, None
        conv, begun, out = None, False, []
        for batch in batches:
            for c, turn, fault, initial in zip(*(batch[k].to_pylist() for k in ("conv_id", "turn", "fault", "initial")), strict=True):
                if not begun or c != conv:
                    if begun:
                        out.append((conv, codes.decode(), most - least + 1 - turns if turns else 0, *counts[1:4], illegal))
                    codes, counts, illegal, turns, least, most, before = bytearray(), [0] * 5, 0, 0, None, None, None
                    conv, begun = c, True
                counts[fault] += 1
                if fault == 4:
                    continue
                if turn is not None and turn != most:
                    least, most, turns = turn if least is None else least, turn, turns + 1
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                code = "-" if fault in (1, 2) else initial if initial in ("s", "u", "a") else "x"
                codes += (code.upper() if fault == 3 else code).encode()
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
            out = []
        if begun:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (conv, codes.decode(), most - least + 1 - turns if turns else 0, *counts[1:4], illegal), strict=True))], schema)

    return slim.mapInArrow(run, SUMMARY)


def answers(counted: DataFrame) -> DataFrame:
    """Adds cost and audit to distinct signatures (signature, rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[int] = []

        def sorted_signatures() -> Iterator[str]:
            for batch in batches:
                rows.extend(batch["rows"].to_pylist())
                yield from batch["signature"].to_pylist()

        out = []
        for i, found in enumerate(solve(sorted_signatures())):
            out.append((*found, rows[i]))
            if len(out) == 1000:
                yield _answers(out)
                out = []
        if out:
            yield _answers(out)

    spread = counted.repartitionByRange(common.part_count(counted.sparkSession), "signature").sortWithinPartitions("signature")
    return spread.mapInArrow(run, "signature string, cost long, audit string, rows long")


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    signature, cost, audit, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(signature, pa.string()), pa.array(cost, pa.int64()), pa.array(audit, pa.string()), pa.array(n, pa.int64())], ["signature", "cost", "audit", "rows"])


def plans(turns: DataFrame) -> DataFrame:
    """Stored, one row per conversation: the columns of `summaries`, cost and audit."""
    found = common.stored(summaries(turns), "conversations")
    solved = common.stored(answers(found.groupBy("signature").agg(F.count("*").alias("rows"))), "signatures")
    done = common.stored(common.join_counted(found, solved, "signature", found.count()), "plans")
    common.discard(found, solved)
    return done


def repaired(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), role, text. A partition holds whole conversations, one after the other, each in order."""
    rows = _rows(turns).where("NOT lost").withColumn("audit", F.lit(None).cast("string"))
    none = F.lit(None).cast("string")
    heads = planned.select("conv_id", F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"), F.lit(False).alias("lost"), "audit")
    both = heads.unionByName(rows).withColumn("turns", F.col("audit").isNull())
    spread = both.repartition(common.part_count(turns.sparkSession), "conv_id")
    ordered = spread.sortWithinPartitions("conv_id", "turns", F.asc_nulls_first("turn"), "role", "text").select("conv_id", "audit", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, place, odd = None, "", 0, 0, 0
        out: list[tuple] = []

        def given() -> str:
            return "user" if (place - odd) % 2 == 0 else "assistant"

        def inserted() -> None:
            nonlocal at, place
            while at < len(audit) and audit[at] == "I":
                out.append((conv, place, given(), ""))
                at, place = at + 1, place + 1

        for batch in batches:
            for c, new, role, text in zip(*(batch[k].to_pylist() for k in ("conv_id", "audit", "role", "text")), strict=True):
                if new is not None:  # a conversation begins; what the one before adds at its end comes first
                    inserted()
                    conv, audit, at, place = c, new, 0, 0
                    odd = (len(audit) - audit.count("D")) % 2  # an odd number of turns begins with the system's
                    continue
                inserted()
                letter = audit[at]
                at += 1
                if letter != "D":
                    out.append((conv, place, role if letter == "K" else given(), text))
                    place += 1
            if out:
                yield _turns(out)
                out.clear()
        inserted()
        if out:
            yield _turns(out)

    return ordered.mapInArrow(run, "conv_id long, place long, role string, text string")


def _turns(rows: list[tuple]) -> pa.RecordBatch:
    conv, place, role, text = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(place, pa.int64()), pa.array(role, pa.string()), pa.array(text, pa.string())], ["conv_id", "place", "role", "text"])


def digests(fixed: DataFrame) -> DataFrame:
    """conv_id and the hash of its `role:text` lines, for turns in the partitions and order of `repaired`; a conversation streams through, whatever its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            ids, hashes = [], []
            for c, place, role, text in zip(*(batch[k].to_pylist() for k in ("conv_id", "place", "role", "text")), strict=True):
                if place == 0:
                    if state:
                        ids.append(conv)
                        hashes.append(state.hexdigest())
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return fixed.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans and repaired turns of conversations (conv_id, turn, role, text, and maybe lost).

    The first DataFrame has one row per conversation: conv_id, signature, gaps (turn numbers missing between
    the least and the largest), blank, duplicate, truncated (turns by their first fault), illegal (neighbours whose
    role initials are not su, ua or au), cost and audit (the ASCII-least letters of the cheapest edits, in order).
    The second holds the turns after the edits: conv_id, place, role, text. Turns go by turn (null first), then
    role, then text; a null role or text counts as one space; equal rows are turns of their own, of which the
    later are duplicates; turns with `lost` true are left out, but their conversation counts; one without turns
    has zeros and an empty audit; rows without conv_id are one conversation; a text of any length stays whole;
    other columns are ignored; an empty table gives empty results. A conversation is one task's work, as its
    result depends on all its turns in order, but a task holds only a batch of turns and a letter for each.
    """
    common.bounded_batches(turns.sparkSession)
    planned = plans(turns)
    return planned, repaired(turns, planned)


def digest(planned: DataFrame, fixed: DataFrame) -> DataFrame:
    """One row per conversation: the columns of the plan but the signature, and the hash of the repaired turns."""
    hashes = digests(fixed).withColumnRenamed("conv_id", "of")
    joined = planned.join(hashes, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
