"""Chat formatting by a finite-state machine over roles, in DataFrame functions only.

The template is data: the strings around each role's text, the control strings to escape and which
roles are learned. Each conversation becomes an array of segments (text, loss); their concatenation is
the formatted text. The machine walks the turns in order and says whether their order is valid.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Declarative template. Every control string holds a character of `escapes`, and escaped texts hold none of these, so texts can't imitate markers."""

    begin: str = "<s>"
    open_role: str = "[INST role="
    close_role: str = "]"
    end_turn: str = "</s>"
    learned: tuple[str, ...] = ("assistant",)
    #: The escape sign comes first; each sign is replaced by the escape sign and its number.
    escapes: tuple[str, ...] = ("~", "<", "[", "]")
    #: state -> role -> next state; a missing entry is an invalid turn, which leaves the state as it is.
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "ready", "user": "asked"},
        "ready": {"user": "asked"},
        "asked": {"assistant": "answered", "tool": "asked"},
        "answered": {"user": "asked", "tool": "asked"},
    })
    final: tuple[str, ...] = ("answered",)


def escape(text: Column, template: Template) -> Column:
    for i, sign in enumerate(template.escapes):
        text = F.replace(text, F.lit(sign), F.lit(f"{template.escapes[0]}{i}"))
    return text


def unescape(text: Column, template: Template) -> Column:
    for i, sign in reversed(list(enumerate(template.escapes))):
        text = F.replace(text, F.lit(f"{template.escapes[0]}{i}"), F.lit(sign))
    return text


def _next_state(state: Column, role: Column, template: Template) -> Column:
    out = None
    for a, row in template.moves.items():
        for r, b in row.items():
            hit = (state == a) & (role == r)
            out = F.when(hit, F.lit(b)) if out is None else out.when(hit, F.lit(b))
    return out


def chat_format(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Format conversations (conv_id, turn, role, text).

    Returns one row per conv_id: segments (array of text, loss), valid, n_invalid, first_invalid_turn. Turns
    go by turn (null first), then role, then text. A null text or role counts as empty; a role without a
    move is invalid but still formatted; repeated rows are turns of their own; rows with a null conv_id form
    one conversation; a conversation is valid if every turn is and the last state is final; an empty table
    gives an empty result; other columns are ignored. A text of any length stays whole; a conversation is one
    row of its aggregation.
    """
    rows = turns.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def step(acc: Column, t: Column) -> Column:
        moved = _next_state(acc["state"], t["role"], template)
        return F.struct(
            F.coalesce(moved, acc["state"]).alias("state"),
            (acc["n_invalid"] + F.when(moved.isNull(), F.lit(1)).otherwise(F.lit(0))).alias("n_invalid"),
            F.when(acc["n_invalid"] > 0, acc["at"]).when(moved.isNull(), t["turn"]).alias("at"),
        )

    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n_invalid"), F.lit(None).cast("long").alias("at"))
    walked = grouped.withColumn("walk", F.aggregate("turns", start, step))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(template.begin + template.open_role), escape(t["role"], template), F.lit(template.close_role)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(t["text"], template).alias("text"), t["role"].isin(*template.learned).alias("loss")),
        F.struct(F.lit(template.end_turn).alias("text"), F.lit(False).alias("loss")),
    )))
    return walked.select("conv_id", segments.alias("segments"), ((F.col("walk.n_invalid") == 0) & F.col("walk.state").isin(*template.final)).alias("valid"), F.col("walk.n_invalid").cast("long").alias("n_invalid"), F.col("walk.at").alias("first_invalid_turn"))


def formatted_text(segments: Column | str) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def parse(formatted: Column, template: Template = Template()) -> Column:
    """Turns (role, text) read back from formatted text."""
    mark = template.begin + template.open_role
    parts = F.filter(F.split(formatted, r"\Q" + mark + r"\E", -1), lambda p: F.length(p) > 0)
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(p, template.close_role, 1), template).alias("role"),
        unescape(F.regexp_replace(F.substr(p, F.locate(template.close_role, p) + len(template.close_role)), r"\Q" + template.end_turn + r"\E\z", ""), template).alias("text"),
    ))


def digest(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests that are read back from the segments: what was said by the formatted text, what is learned by the loss flags."""
    read = formatted.select("conv_id", "segments", "valid", formatted_text("segments").alias("whole"))
    read = read.select("*", parse(F.col("whole"), template).alias("turns"), unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""), template).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("whole").cast("long").alias("formatted_chars"), "valid",
    )


def oracle(template: Template = Template()) -> str:
    """DuckDB SQL for the digest of all conversations and conversation -1."""
    escaped = lambda c: "length(" + c + ") + " + " + ".join(f"(length({c}) - length(replace({c}, '{s}', '')))" for s in template.escapes)
    fixed = len(template.begin + template.open_role + template.close_role + template.end_turn)
    learned = ", ".join(f"'{r}'" for r in template.learned)
    moves = " ".join(f"WHEN p = '{a}' AND role = '{r}' THEN true" for a, r in _pairs(template))
    return f"""
WITH rows AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), ordered AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), 'start') AS p,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back FROM rows
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role IN ({learned}) THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role IN ({learned}) THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum({fixed} + {escaped('role')} + {escaped('text')}) AS BIGINT) AS formatted_chars,
       bool_and(CASE {moves} ELSE false END) AND bool_or(back = 1 AND role = 'assistant') AS valid
FROM ordered GROUP BY conv_id"""


def _pairs(template: Template) -> list[tuple[str, str]]:
    """Valid (role before, role) pairs; enough to say whether a conversation is valid as long as each state follows from the last role."""
    after = {"start": ("start",), "ready": ("system",), "asked": ("user", "tool"), "answered": ("assistant",)}
    return [(p, r) for state, row in template.moves.items() for p in after[state] for r in row]
