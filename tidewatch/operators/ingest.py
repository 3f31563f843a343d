"""Landed feed rows to articles: cleaning, filters, media names; and which articles a view takes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import calendar as C
from tidewatch.functions import text as T
from tidewatch.functions.columns import held, named
from tidewatch.operators.scoring import _contains, shown_medium
from tidewatch.operators.vocabulary import matcher

#: What stands behind the last dash of a title.
_SUFFIX = r"(?U)\s*[-–—]\s*([^-–—]{2,40})\s*$"
UNKNOWN = "unknown"


def either(a: Column, b: str) -> Column:
    """Whether one holds the other."""
    return F.contains(a, F.lit(b)) | F.contains(F.lit(b), a)


def known_name(text: Column, names: Sequence[tuple[str, str]]) -> Column:
    """The name of the first entry (key, name) whose key holds text or is held by it; null if none."""
    out = F.lit(None).cast("string")
    for key, name in reversed(names):
        out = F.when(either(text, key), name).otherwise(out)
    return out


def title_media(title: Column, names: Sequence[str]) -> Column:
    """The medium that a title's suffix names: a known one, or the suffix itself if it has 2 to 30 characters and isn't a number."""
    found = T.stripped(F.regexp_extract(title, _SUFFIX, 1))
    own = F.when((F.length(found) >= 2) & (F.length(found) <= 30) & ~found.rlike("^[0-9]+$"), found)
    return F.when(found != "", F.coalesce(known_name(found, [(n, n) for n in names]), own))


def author_media(author: Column, names: Sequence[str]) -> Column:
    """The medium that an author field names: no address, no aggregator, below 40 characters."""
    author = T.or_empty(author)
    fit = (author != "") & (F.length(author) < 40) & ~F.contains(author, F.lit("@")) & ~F.contains(F.lower(author), F.lit("google"))
    own = F.when((F.length(author) >= 2) & ~F.startswith(author, F.lit("http")), author)
    return F.when(fit, F.coalesce(known_name(author, [(n, n) for n in names]), own))


def link_media(link: Column, domains: Sequence[tuple[str, str]]) -> Column:
    """The medium of a link's host, or the host itself; none for the aggregator."""
    host = F.regexp_replace(T.host(link), r"www\.", "")
    return F.when((host != "") & ~F.contains(host, F.lit("google")), F.coalesce(known_name(host, domains), host))


def media_name(title: Column, author: Column, link: Column, domains: Sequence[tuple[str, str]]) -> Column:
    """Title, then author, then host, then unknown; known media come in the order of `domains` (domain, name)."""
    names = list(dict.fromkeys(name for _, name in domains))
    return F.coalesce(title_media(title, names), author_media(author, names), link_media(link, domains), F.lit(UNKNOWN))


def without_suffix(title: Column, media: Column) -> Column:
    """The title without the suffix that names its medium."""
    found = T.stripped(F.regexp_extract(title, _SUFFIX, 1))
    same = (found != "") & (media != UNKNOWN) & (F.contains(found, media) | F.contains(media, found))
    return F.when(same, T.stripped(F.regexp_replace(title, _SUFFIX, ""))).otherwise(title)


def on_portal(link: Column, portal: str = "msn.com") -> Column:
    return F.contains(F.lower(T.or_empty(link)), F.lit(portal))


def without_portal(rows: DataFrame, portal: str = "msn.com") -> DataFrame:
    """Stored articles but those that a portal republished."""
    return rows.where(~on_portal(F.col("link"), portal))


def without_phrases(rows: DataFrame, phrases: DataFrame, *parts: str) -> DataFrame:
    """Rows whose parts hold none of the phrases (column `phrase`), found in one pass over the rows whatever the number of phrases. An empty table of phrases leaves all rows; empty and null phrases count for nothing."""
    found = matcher(phrases.select(F.lower("phrase").alias("term")))
    return rows.where(F.size(found(T.visible(*map(F.col, parts)))) == 0)


def articles(landed: DataFrame, domains: Sequence[tuple[str, str]], excluded: Sequence[str], positive: Sequence[str], negative: Sequence[str], cut: int = 500) -> DataFrame:
    """Articles of landed feed rows (ordinal, title, content, link, author, published, updated, created, label, cat, brand, filter).

    In this order: tags go; rows without a title, without their source's filter word, from the portal, with an
    excluded phrase or without a date are dropped; the medium is named; the title loses the suffix that names
    it; the id follows. A missing date is never filled in. One projection and filters: nothing is shuffled.
    """
    rows = held(landed, __title=T.strip_tags(F.col("title")), __content=F.left(T.strip_tags(F.col("content")), F.lit(cut)))
    word = T.or_empty(F.col("filter"))
    rows = rows.where((F.col("__title") != "") & ((word == "") | F.contains("__title", word)) & ~on_portal(F.col("link")) & ~_contains(T.visible(F.col("__title"), F.col("__content")), tuple(excluded)))
    rows = held(rows, pub=C.first_date(F.col("published"), F.col("updated"), F.col("created")), media=media_name(F.col("__title"), T.stripped(T.or_empty(F.col("author"))), F.col("link"), domains)).where("pub IS NOT NULL")
    rows = held(rows, __short=without_suffix(F.col("__title"), F.col("media")))
    title, content = F.col("__short"), F.col("__content")
    return rows.select(
        T.article_id(F.col("link"), title).alias("id"), "ordinal", title.alias("title"), content.alias("content"), "link", "pub", T.sentiment(T.visible(title, content), positive, negative).alias("sentiment"), "cat", "brand",
        F.col("label").alias("source_name"), "media", T.stripped(T.or_empty(F.col("author"))).alias("raw_author"), F.lit("feed").alias("date_source"),
    )


def article_hash(pub: Column, *fields: Column) -> Column:
    """Hash over the date and the stable fields of an article: title, content, link, sentiment, cat, brand, source, media, author, push count."""
    return T.content_hash(F.date_format(pub, "yyyy-MM-dd'T'HH:mm:ss+00:00"), *fields)


def reporter(author: Column, media: Sequence[str]) -> Column:
    """A person's name in an author field: two to four Chinese characters, or capitalised words; null for media and addresses."""
    a = T.stripped(T.or_empty(author))
    person = a.rlike("^[\u4e00-\u9fa5]{2,4}$") | a.rlike("^[A-Z][a-z]+( [A-Z][a-z]+)+$")
    medium = F.lit(False)
    for name in media:
        medium = medium | either(a, name)
    return F.when((F.length(a) >= 2) & (F.length(a) <= 15) & ~F.contains(a, F.lit("@")) & ~F.contains(a, F.lit("http")) & ~medium & person, a)


def highlights(subject: Column, words: Sequence[str]) -> Column:
    return T.matched(subject, words)


def in_forum(link: Column, media: Column, hosts: Sequence[str], names: Sequence[str]) -> Column:
    """Whether an article comes from a forum: by its link or by its medium."""
    return _contains(F.lower(T.or_empty(link)), tuple(hosts)) | _contains(F.lower(T.or_empty(media)), (*hosts, *names))


def own_release(cat: str, excluded: Sequence[str], names: Sequence[str], forums: tuple[Sequence[str], Sequence[str]], wire: tuple[Sequence[str], Sequence[str]], brief: str, blocked: Sequence[str]) -> Column:
    """An article about the own brand: of its category, without excluded phrases, naming it, from no forum, no intraday brief of one wire, and no blocked word in its title."""
    text = T.visible(F.col("title"), F.col("content"))
    title = T.or_empty(F.col("title"))
    wired = _contains(F.lower(T.or_empty(F.col("link"))), tuple(wire[0])) | _contains(F.lower(T.or_empty(F.col("media"))), (*wire[0], *wire[1]))
    return F.coalesce(F.col("cat") == cat, F.lit(False)) & ~_contains(text, tuple(excluded)) & _contains(text, tuple(names)) & ~in_forum(F.col("link"), F.col("media"), *forums) & ~(wired & F.contains(title, F.lit(brief))) & ~_contains(title, tuple(blocked))


def briefing_candidate(own_cat: str, own: Column, rival_cat: str, brief: str, forums: tuple[Sequence[str], Sequence[str]], listings: Sequence[str], tracked: Sequence[str]) -> Column:
    """The own brand by its rule; a rival's article if it names a tracked term and is no brief, forum post or listing."""
    text = T.visible(F.col("title"), F.col("content"))
    rival = (F.col("cat") == rival_cat) & ~F.contains(T.or_empty(F.col("title")), F.lit(brief)) & ~in_forum(F.col("link"), F.col("media"), *forums) & ~_contains(text, tuple(listings)) & _contains(text, tuple(tracked))
    return F.when(F.col("cat") == own_cat, own).otherwise(F.coalesce(rival, F.lit(False)))


def rival_news(cat: str, brand: str | None, forums: tuple[Sequence[str], Sequence[str]]) -> Column:
    keep = (F.col("cat") == cat) & ~in_forum(F.col("link"), F.col("media"), *forums)
    return keep if brand is None else keep & (F.col("brand") == brand)


def since(ts: Column, as_of: Column, period: str, offset: int) -> Column:
    """Whether ts falls in a period of a viewer's own zone: today, month and year by calendar, week as the last seven days, all."""
    if period == "all":
        return F.lit(True)
    if period == "week":
        return ts >= C.shifted(as_of, -7 * 24)
    return ts >= C.local_start(as_of, {"today": "DAY", "month": "MONTH", "year": "YEAR"}[period], offset)


def matching(rows: DataFrame, query: str = "", media: str = "all", sentiment: str = "all", lexicon: tuple[Sequence[str], Sequence[str]] = ((), ()), nameless: str = UNKNOWN) -> DataFrame:
    """The rows that meet all stated conditions; what is empty or `all` adds none.

    The query is searched in title, content, medium, source and brand; the medium falls back to the source, and
    then to a name for those that have neither. A stored sentiment counts before a computed one.
    """
    words = query.strip().lower()
    shown = F.coalesce(shown_medium(rows), F.lit(nameless))
    if media != "all":
        rows = rows.where(shown == media)
    if words:
        rows = rows.where(F.contains(T.visible(F.col("title"), F.col("content"), shown, F.col("source_name"), named(rows, "brand")), F.lit(words)))
    if sentiment != "all":
        rows = held(rows, __seen=T.visible(F.col("title"), F.col("content")))
        computed = T.sentiment(F.col("__seen"), *lexicon)
        rows = rows.where((F.coalesce(F.nullif(F.col("sentiment"), F.lit("")), computed) if "sentiment" in rows.columns else computed) == sentiment).drop("__seen")
    return rows
