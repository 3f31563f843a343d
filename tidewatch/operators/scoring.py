"""Rule scores, briefing scores and the digest, over vocabularies that are data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import text as T
from tidewatch.functions.columns import held, named as column


@dataclass(frozen=True)
class Vocabulary:
    """Own and tracked entities (code -> aliases), industry terms, events (kind, terms, weight), signs of impact, category bonuses."""

    own: str
    entities: dict[str, tuple[str, ...]]
    industry: tuple[str, ...]
    events: tuple[tuple[str, tuple[str, ...], int], ...]
    positive: tuple[str, ...]
    negative: tuple[str, ...]
    bonuses: dict[str, int]
    excluded: tuple[str, ...] = ()
    official: tuple[str, ...] = ()


def rule_scores(articles: DataFrame, v: Vocabulary, own_weight: int = 55, other_weight: int = 35, threshold: int = 20) -> DataFrame:
    """Judges title, content, source, medium and brand, which are empty where the column is missing; the category is no part of the text.

    Adds relevance, event, importance, impact, entities, matched terms, reasons and flags. No join, no shuffle; each step is computed once, whatever is filtered later.
    """
    rows = held(articles, __text=T.visible(F.col("title"), F.col("content"), F.col("source_name"), column(articles, "media"), column(articles, "brand")))
    text = F.col("__text")
    named = F.array_compact(F.array(*(F.when(_any(text, a), F.lit(code)) for code, a in v.entities.items())).cast("array<string>"))
    ranked = sorted(v.events, key=lambda e: -e[2])
    which = F.lit(-1)
    for i, (_, terms, _) in reversed(list(enumerate(ranked))):
        which = F.when(_contains(text, terms), i).otherwise(which)
    found = {"__named": named, "__industry": T.matched(text, v.industry), "__pos": T.matched(text, v.positive), "__neg": T.matched(text, v.negative), "__event": which, "__out": _contains(text, v.excluded)}
    rows = held(rows, **found)
    own, some = F.array_contains("__named", v.own), F.size("__named") > 0
    bonus, event, weight, terms = F.lit(0), F.lit("other"), F.lit(0), F.array().cast("array<string>")
    for cat, points in v.bonuses.items():
        bonus = F.when(F.col("cat") == cat, points).otherwise(bonus)
    for i, (kind, words, points) in enumerate(ranked):
        here = F.col("__event") == i
        event, weight, terms = F.when(here, kind).otherwise(event), F.when(here, points).otherwise(weight), F.when(here, T.matched(text, words)).otherwise(terms)
    relevance = F.when(own, own_weight).when(some, other_weight).otherwise(0) + F.least(F.lit(30), 6 * F.size("__industry")) + bonus
    official = F.lit(False)
    for prefix in v.official:
        official = official | F.coalesce(F.startswith(F.col("source_name"), F.lit(prefix)), F.lit(False))
    pos, neg = F.size("__pos") > 0, F.size("__neg") > 0
    impact = F.when(neg & ~pos, "risk").when(pos & ~neg, "opportunity").when(pos & neg, "mixed").otherwise("neutral")
    kept = lambda x, none: F.when(F.col("__out"), none).otherwise(x)
    none = F.array().cast("array<string>")
    matched = F.slice(F.array_sort(F.array_distinct(F.concat("__industry", terms, "__neg", "__pos"))), 1, 20)
    reasons = F.array_compact(F.array(
        F.when(own, "own entity"), F.when(some & ~own, "tracked entity"), F.when(F.size("__industry") > 0, "industry"), F.when(F.col("__event") >= 0, F.concat(F.lit("event: "), event)),
    ))
    rows = held(
        rows, relevance=kept(F.least(F.lit(100), relevance), 0).cast("long"), event=kept(event, "other"), __weight=kept(weight + F.when(official, 8).otherwise(0), 0), impact=kept(impact, "neutral"),
        entities=kept(F.col("__named"), none), matched_terms=kept(matched, none), reasons=kept(reasons, F.array(F.lit("excluded phrase"))),
    )
    # Halves go to the even number; in whole hundredths, so that no binary fraction decides.
    importance = F.least(F.lit(100), F.bround((F.col("relevance") * 55 + F.col("__weight") * 100).cast("decimal(10,0)") / 100, 0).cast("long"))
    rows = held(rows, importance=importance, relevant=F.col("relevance") >= threshold)
    return rows.withColumn("review", (F.col("importance") >= 70) | (F.col("event") == "crisis")).drop("__text", "__weight", *found)


def _any(text: Column, aliases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for a in aliases:
        found = found | T.mentions(text, a)
    return found


def _contains(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(text, F.lit(p))
    return found


Rules = tuple[tuple[str, tuple[str, ...], int], ...]


def shown_medium(rows: DataFrame) -> Column:
    """The medium, or else the source; null if neither is stated."""
    return F.coalesce(F.nullif(column(rows, "media"), F.lit("")), F.nullif(F.col("source_name"), F.lit("")))


def briefing_marks(articles: DataFrame, rules: Rules, own: tuple[str, ...], media: tuple[tuple[str, str], ...]) -> DataFrame:
    """Adds what a briefing needs of an article's text, so that the text itself can stay behind: kind and base (of the best rule), own, key_medium. Media are given by a name as it is and one in any case."""
    rows = held(articles, __text=T.visible(F.col("title"), F.col("content")), __shown=shown_medium(articles))
    text, shown = F.col("__text"), F.col("__shown")
    kind, base, key = F.lit("news"), F.lit(8), F.lit(False)
    for k, terms, points in sorted(rules, key=lambda r: r[2]):
        hit = _contains(text, terms)
        kind, base = F.when(hit, k).otherwise(kind), F.when(hit, points).otherwise(base)
    for name, second in media:
        key = key | F.contains(shown, F.lit(name)) | F.contains(F.lower(shown), F.lit(second.lower()))
    return held(rows, kind=kind, base=base, own=_contains(text, own), key_medium=F.coalesce(key, F.lit(False))).drop("__text", "__shown")


def briefing_best(marked: DataFrame, as_of: Column, n: int) -> DataFrame:
    """The n best of marked articles: rule, recency, own mention and key media, and why; articles that match no rule stay out."""
    rows = held(marked.where("kind <> 'news'"), __age=F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.col("pub"), as_of)))
    recency = F.when(F.col("__age") <= 24 * 3600, 24).when(F.col("__age") <= 72 * 3600, 16).when(F.col("__age") <= 168 * 3600, 8).otherwise(0)
    score = F.col("base") + recency + F.when(F.col("own"), 20).otherwise(0) + F.when(F.col("key_medium"), 8).otherwise(0)
    reasons = F.array_compact(F.array(F.col("kind"), F.when(F.col("__age") <= 24 * 3600, "last 24 hours"), F.when(F.col("own"), "own mention"), F.when(F.col("key_medium"), "key media")))
    return rows.select("id", "ordinal", "pub", "cat", "kind", score.cast("long").alias("score"), "own", reasons.alias("reasons")).orderBy(F.desc("score"), "ordinal").limit(n)


def briefing(articles: DataFrame, as_of: Column, rules: Rules, own: tuple[str, ...], media: tuple[tuple[str, str], ...], n: int) -> DataFrame:
    return briefing_best(briefing_marks(articles, rules, own, media), as_of, n)


def suggestion(kind: Column, own: Column, actions: dict[str, tuple[str, str]], default: str) -> Column:
    """What to do about an item: per kind one action for the own brand and one for others."""
    out = F.lit(default)
    for name, (mine, other) in actions.items():
        out = F.when((kind == name) & own, mine).when(kind == name, other).otherwise(out)
    return out


def label(value: Column, labels: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for name, shown in labels.items():
        out = F.when(value == name, shown).otherwise(out)
    return out


def digest(scored: DataFrame, since: Column, sent: DataFrame, tracked: tuple[str, ...], n: int) -> DataFrame:
    """The n most important new stories: recent, relevant, not negative, none about tracked entities, none sent before.

    Each story shows its most important article; if that one's link is the aggregator's, the first direct
    link in order of importance takes its place.
    """
    about = F.exists("entities", lambda e: e.isin(*tracked)) if tracked else F.lit(False)
    rows = scored.where(F.col("pub") > since).where(F.col("relevant") & (F.col("impact") != "risk") & ~about)
    rows = rows.withColumn("story", T.story_id(F.col("title"), F.col("id"))).join(sent.select("story"), "story", "left_anti")
    order = F.struct(F.negative("importance").alias("i"), F.col("ordinal").alias("o"))
    direct = (F.coalesce(F.col("link"), F.lit("")) != "") & ~T.from_aggregator(F.col("link"))
    best = rows.groupBy("story").agg(F.min_by(F.struct("id", "link", "importance", "ordinal"), order).alias("b"), F.min_by(F.when(direct, F.col("link")), F.when(direct, order)).alias("direct"))
    link = F.when(T.from_aggregator(F.col("b.link")), F.coalesce("direct", "b.link")).otherwise(F.col("b.link"))
    return best.select("story", "b.id", "b.importance", "b.ordinal", link.alias("link")).orderBy(F.desc("importance"), "ordinal").limit(n)


def first_match(text: Column, names: tuple[tuple[str, str], ...], default: str | None, regex: bool = False) -> Column:
    """The label of the first pattern, in order, that text holds; patterns are plain, or expressions without regard to case."""
    out = F.lit(default)
    for pattern, shown in reversed(names):
        out = F.when(text.rlike(f"(?i){pattern}") if regex else F.contains(text, F.lit(pattern)), shown).otherwise(out)
    return out


def first_of(text: Column, terms: dict[str, tuple[str, ...]]) -> Column:
    """The first key, in order, one of whose terms text contains; null if none."""
    out = F.lit(None).cast("string")
    for key, words in reversed(list(terms.items())):
        out = F.when(_contains(text, words), key).otherwise(out)
    return out


def ranked_desc(rows: DataFrame, by: str, tie: str) -> DataFrame:
    """Positional rank over a table as small as a dimension."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), tie)).cast("long"))
