"""Text columns: cleaning, keys, ids, vocabulary matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation that title comparison ignores, beside white space. Fixed values.
TITLE_MARKS = r"\-–—_:：，,。.!！?？()（）「」『』"
AGGREGATOR = "news.google.com"
#: Words that don't make titles alike. Fixed values.
STOP_WORDS = (
    "the", "and", "for", "that", "with", "this", "are", "has", "have", "from",
    "will", "its", "new", "said", "says", "amid", "after", "over", "into", "more",
    "also", "been", "their", "about", "which", "would", "could", "during",
)


def or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def strip_tags(html: Column) -> Column:
    """Without tags; entities and script bodies stay."""
    return stripped(F.regexp_replace(or_empty(html), "<[^>]+>", ""))


def stripped(text: Column) -> Column:
    """Without white space of any script at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def title_key(title: Column, length: int = 30) -> Column:
    """Letters, digits and underscores only, lower case, cut to a length."""
    return F.left(F.lower(F.regexp_replace(or_empty(title), r"[^\p{L}\p{N}_]+", "")), F.lit(length))


def loose_title_key(title: Column) -> Column:
    """Lower case without white space and common punctuation, at full length."""
    return F.regexp_replace(F.lower(or_empty(title)), rf"(?U)[\s{TITLE_MARKS}]", "")


def article_id(link: Column, title: Column) -> Column:
    return F.left(F.md5(F.concat(F.coalesce(F.nullif(link, F.lit("")), title, F.lit("")), F.lit("v1"))), F.lit(20))


def content_hash(*parts: Column) -> Column:
    """16 hex digits over all parts; a null counts as empty, and parts can't run into each other."""
    return F.left(F.md5(F.concat_ws("\u001f", *(or_empty(p.cast("string")) for p in parts))), F.lit(16))


def story_id(title: Column, own_id: Column) -> Column:
    key = title_key(title, 120)
    return F.when(key == "", own_id).otherwise(F.sha2(key, 256))


def shard_of(own_id: Column) -> Column:
    return F.when(own_id.rlike("^[0-9a-f]"), F.substring(own_id, 1, 1)).otherwise("0")


def visible(*parts: Column) -> Column:
    """The searched text: all parts, lower case."""
    return F.lower(F.concat_ws(" ", *(or_empty(p) for p in parts)))


def matched(text: Column, terms: Sequence[str]) -> Column:
    """The terms that text contains, each once, in vocabulary order."""
    return F.array_compact(F.array(*(F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in terms)).cast("array<string>"))


def hits(text: Column, terms: Sequence[str]) -> Column:
    """How many terms text contains: a sum of plain predicates, which stays in generated code."""
    return sum((F.contains(text, F.lit(t)).cast("long") for t in terms), F.lit(0).cast("long"))


def sentiment(text: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    p, n = hits(text, positive), hits(text, negative)
    return F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral")


def mentions(text: Column, alias: str) -> Column:
    """An ASCII alias stands between characters other than a-z and 0-9; any other alias anywhere."""
    if alias.isascii():
        escaped = "".join("\\" + c if not c.isalnum() and c != " " else c for c in alias)
        # The plain search spares most texts the expression.
        return F.contains(text, F.lit(alias)) & text.rlike(f"(^|[^a-z0-9]){escaped}($|[^a-z0-9])")
    return F.contains(text, F.lit(alias))


def safe_url(link: Column) -> Column:
    """http or https, a host, no user or password, and inside, after blanks at the ends, no white space or control characters."""
    clean = stripped(or_empty(link))
    return clean.rlike(r"^(?i:https?)://(?::?@)?(?:\[[^\]/?#@]+\]|[^\[\]/?#@:]+)(?::[^/?#@]*)?(?:[/?#].*)?$") & ~clean.rlike(r"(?U)[\s\x00-\x1f\x7f]")


def safe_link(link: Column) -> Column:
    """The link without blanks around it, null if it isn't safe."""
    return F.when(safe_url(link), stripped(or_empty(link)))


def host(link: Column) -> Column:
    return F.regexp_extract(or_empty(link), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def from_aggregator(link: Column) -> Column:
    return F.contains(F.lower(or_empty(link)), F.lit(AGGREGATOR))


def title_suffix(title: Column) -> Column:
    """What stands behind the last dash, if it has 2 to 40 characters."""
    return F.regexp_extract(or_empty(title), r"[-–—]\s*([^-–—]{2,40})$", 1)


def summary(text: Column, length: int = 300) -> Column:
    return F.left(F.trim(collapsed(text)), F.lit(length))


def collapsed(text: Column) -> Column:
    """White space of any script as single blanks."""
    return F.regexp_replace(or_empty(text), r"(?U)\s+", " ")


def labelled(title: Column, source: Column, kind: Column, form: str = "%s (source: %s; type: %s)", unknown: str = "unknown source", length: int = 300) -> Column:
    """A line that names title, source and kind, cut to a length."""
    return F.left(F.format_string(form, F.trim(collapsed(title)), F.coalesce(F.nullif(source, F.lit("")), F.lit(unknown)), kind), F.lit(length))


def bullets(text: Column, sign: str = "•") -> Column:
    return F.filter(F.transform(F.split(or_empty(text), sign, -1), lambda x: F.trim(x)), lambda x: x != "")


def overlap(a: Column, b: Column) -> Column:
    """Shared share of two keyword sets, of the smaller; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def keywords(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct words of at least three letters, of a-z and Chinese only, that are no stop words. A word that holds a digit or any other letter doesn't count at all."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(or_empty(text)), F.lit(r"(?<![\p{L}\p{N}_])[a-z\x{4e00}-\x{9fff}]{3,}(?![\p{L}\p{N}_])"), F.lit(0)))
    return F.array_except(words, F.array(*map(F.lit, stop)).cast("array<string>"))
