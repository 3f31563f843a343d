"""Bindings: the supplied tables in the roles that the operators expect, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.calendar import instant
from tidewatch.operators.scoring import Vocabulary

Query = Callable[[SparkSession, str], DataFrame]

#: The instant at which all clock-driven queries stand; after the last row.
AS_OF = "2024-01-31 00:00:00"
POSITIVE, NEGATIVE = ("tion", "there", "eau", "ung"), ("whe", "reth", "ment", "isch")
VOCABULARY = Vocabulary(
    own="E1",
    entities={"E1": ("there",), "E2": ("reth", "that"), "E3": ("eau",), "E4": ("ción",)},
    industry=("hing", "onn", "ique", "keit"),
    events=(("crisis", ("stoth", "euxleaux"), 35), ("financial", ("erhe",), 25), ("supply", ("nden",), 22), ("partnership", ("ouer",), 20), ("product", ("release",), 18), ("market", ("and",), 14)),
    positive=POSITIVE, negative=NEGATIVE, bonuses={"en": 15, "fr": 8}, excluded=("worthless",), official=("src1",),
)
RULES = (("risk", ("stoth", "whe"), 40), ("finance", ("erhe",), 32), ("opportunity", ("tion",), 26), ("market", ("eau", "and"), 18))
#: Key media: their name as it is, and a second name in any case.
MEDIA = (("src3", "Third"), ("src7", "SEVENTH"))

NEWS = """news AS (
  SELECT doc_id AS ordinal, CAST(doc_id AS VARCHAR) AS id, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS content, lang AS cat, source AS source_name,
         CASE doc_id % 5 WHEN 2 THEN 'There Daily' WHEN 3 THEN 'Seventh Wire' WHEN 4 THEN '' END AS media, CASE doc_id % 9 WHEN 4 THEN 'Reth' WHEN 5 THEN '' END AS brand,
         CASE WHEN doc_id % 3 = 0 THEN 'https://news.google.com/r/' || doc_id WHEN doc_id % 7 = 0 THEN '' ELSE 'https://site' || (doc_id % 5) || '.example/a/' || doc_id END AS link,
         TIMESTAMP '2024-01-31 00:00:00' - to_hours(CAST((doc_id * 7) % 2160 AS BIGINT)) AS pub
  FROM documents)"""

#: White space of any script, named for the oracle's regular expressions.
WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
DOMAINS = (("site1.example", "Site One"), ("site2", "Second Site"), ("herald.example", "Tide Herald"), ("harbour.example", "Harbour Daily"))

FEED = """feed AS (
  SELECT doc_id AS ordinal, '<b>' || left(split_part(coalesce(text, ''), chr(10), 1), 60) || '</b>' || CASE doc_id % 5 WHEN 0 THEN ' - Harbour Daily' WHEN 1 THEN ' – 12345' WHEN 2 THEN ' — Nameless Post' ELSE '' END AS title,
    '<p> ' || coalesce(text, '') || '</p>' AS content,
    CASE WHEN doc_id % 11 = 0 THEN 'https://www.MSN.com/n/' || doc_id WHEN doc_id % 3 = 0 THEN 'https://news.google.com/r/' || doc_id ELSE 'https://www.site' || (doc_id % 4) || '.example/a/' || doc_id END AS link,
    CASE doc_id % 7 WHEN 0 THEN 'The Tide Herald' WHEN 1 THEN 'me@host.example' WHEN 2 THEN ' Jane Roe ' WHEN 3 THEN 'http://x.example' END AS author,
    CASE WHEN doc_id % 13 = 0 THEN 'e' END AS filter, lang AS cat, source AS label, TIMESTAMP '2024-01-31 00:00:00' - to_hours(CAST((doc_id * 7) % 2160 AS BIGINT)) AS pub
  FROM documents)"""

REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL where it has one."""

    def add(f: Query) -> Query:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    number = F.col("doc_id")
    link = F.when(number % 3 == 0, F.concat(F.lit("https://news.google.com/r/"), number)).when(number % 7 == 0, "").otherwise(F.concat(F.lit("https://site"), number % 5, F.lit(".example/a/"), number))
    text = F.coalesce("text", F.lit(""))
    return d.select(
        number.alias("ordinal"), number.cast("string").alias("id"), F.substring_index(text, "\n", 1).alias("title"), text.alias("content"), F.col("lang").alias("cat"), F.col("source").alias("source_name"),
        F.when(number % 5 == 2, "There Daily").when(number % 5 == 3, "Seventh Wire").when(number % 5 == 4, "").alias("media"), F.when(number % 9 == 4, "Reth").when(number % 9 == 5, "").alias("brand"),
        link.alias("link"), F.timestamp_add("HOUR", (-(number * 7) % 2160).cast("int"), instant(AS_OF)).cast("timestamp_ntz").alias("pub"),
    )


def sql_terms(text: str, terms) -> str:
    """How many terms a text contains."""
    return "(" + " + ".join(f"CAST(contains({text}, '{t}') AS BIGINT)" for t in terms) + ")"


def sql_any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


#: The medium, or else the source.
SQL_SHOWN = "coalesce(nullif(media, ''), nullif(source_name, ''))"


def sql_key_media(shown: str = SQL_SHOWN) -> str:
    return "coalesce(" + " OR ".join(f"contains({shown}, '{a}') OR contains(lower({shown}), lower('{b}'))" for a, b in MEDIA) + ", false)"


def sql_alias(text: str, aliases) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '(^|[^a-z0-9]){a}($|[^a-z0-9])')" if a.isascii() else f"contains({text}, '{a}')" for a in aliases) + ")"


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as landed feed rows: tags in titles, suffixes, authors, dates in several forms, some missing."""
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    case = lambda by, values: F.coalesce(*(F.when(n % by == k, v) for k, v in values.items()))
    pub = F.timestamp_add("HOUR", (-(n * 7) % 2160).cast("int"), instant(AS_OF)).cast("timestamp_ntz")
    rfc = lambda ts, zone: F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss "), F.lit(zone))
    iso = F.date_format(pub, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    local = F.timestamp_add("HOUR", F.lit(8), pub)
    return table(spark, sf_dir, "documents").select(
        n.alias("ordinal"), F.concat(F.lit("<b>"), F.left(F.substring_index(text, "\n", 1), F.lit(60)), F.lit("</b>"), F.coalesce(case(5, {0: F.lit(" - Harbour Daily"), 1: F.lit(" – 12345"), 2: F.lit(" — Nameless Post")}), F.lit(""))).alias("title"),
        F.concat(F.lit("<p> "), text, F.lit("</p>")).alias("content"),
        F.when(n % 11 == 0, F.concat(F.lit("https://www.MSN.com/n/"), n)).when(n % 3 == 0, F.concat(F.lit("https://news.google.com/r/"), n)).otherwise(F.concat(F.lit("https://www.site"), n % 4, F.lit(".example/a/"), n)).alias("link"),
        case(7, {0: F.lit("The Tide Herald"), 1: F.lit("me@host.example"), 2: F.lit(" Jane Roe "), 3: F.lit("http://x.example")}).alias("author"),
        case(6, {1: rfc(pub, "GMT"), 2: iso, 3: rfc(local, "+0800"), 4: F.lit("some day"), 5: F.date_format(pub, "yyyy-MM-dd HH:mm:ss")}).alias("published"),
        F.when(n % 12 != 0, iso).alias("updated"), F.lit(None).cast("string").alias("created"),
        F.when(n % 13 == 0, "e").alias("filter"), F.col("lang").alias("cat"), F.lit(None).cast("string").alias("brand"), F.col("source").alias("label"),
    )


def sql_stripped(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def sql_known(text: str, names) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, '{k}') OR contains('{k}', {text}) THEN '{v}'" for k, v in names) + " END"


def shared_folder(spark) -> str:
    """The folder that all machines share. Where the session names none, one machine with all executors in it gets a temporary one; a cluster gets an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return (named or f"{tempfile.gettempdir()}/checkpoints").rstrip("/")
