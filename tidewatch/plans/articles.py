"""Queries over landed feed rows and article lists: ingest, media, candidates, rivals, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import calendar as C
from tidewatch.functions import text as T
from tidewatch.operators import ingest, merge, scoring, worker
from tidewatch.plans.news import _LOOSE, V, _merge_sql, _scored, _scores_sql
from tidewatch.plans.tables import AS_OF, DOMAINS, FEED, MEDIA, NEGATIVE, NEWS, POSITIVE, RULES, WS, feed, news, query, sql_any, sql_key_media, sql_known, sql_stripped, sql_terms, table

_NAMES = [(name, name) for _, name in DOMAINS]
_AT = f"TIMESTAMP '{AS_OF}'"
_MEDIA_SQL = f"""{FEED}, cleaned AS (SELECT *, {sql_stripped("regexp_replace(title, '<[^>]+>', '', 'g')")} AS t, left({sql_stripped("regexp_replace(content, '<[^>]+>', '', 'g')")}, 500) AS b, {sql_stripped("coalesce(author, '')")} AS who FROM feed),
parts AS (SELECT *, {sql_stripped(f"regexp_extract(t, '[-–—]{WS}*([^-–—]{{2,40}}){WS}*$', 1)")} AS suffix, replace(regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '') AS host FROM cleaned),
named AS (SELECT *, CASE WHEN suffix <> '' THEN coalesce({sql_known('suffix', _NAMES)}, CASE WHEN length(suffix) BETWEEN 2 AND 30 AND NOT regexp_matches(suffix, '^[0-9]+$') THEN suffix END) END AS by_title,
  CASE WHEN who <> '' AND length(who) < 40 AND NOT contains(who, '@') AND NOT contains(lower(who), 'google') THEN coalesce({sql_known('who', _NAMES)}, CASE WHEN length(who) >= 2 AND NOT starts_with(who, 'http') THEN who END) END AS by_author,
  CASE WHEN host <> '' AND NOT contains(host, 'google') THEN coalesce({sql_known('host', DOMAINS)}, host) END AS by_link FROM parts),
media AS (SELECT *, coalesce(by_title, by_author, by_link, 'unknown') AS media FROM named)"""


def _media(spark, sf_dir):
    names = list(dict.fromkeys(name for _, name in DOMAINS))
    f, title, author = feed(spark, sf_dir), T.strip_tags(F.col("title")), T.stripped(T.or_empty(F.col("author")))
    return f.select("*", ingest.title_media(title, names).alias("by_title"), ingest.author_media(author, names).alias("by_author"), ingest.link_media(F.col("link"), DOMAINS).alias("by_link"), ingest.media_name(title, author, F.col("link"), DOMAINS).alias("media"))


@query(f"WITH {_MEDIA_SQL} SELECT ordinal, by_title, by_author, by_link, media FROM media")
def media_names(spark, sf_dir):
    """The medium by title, author and host, and which of them counts."""
    return _media(spark, sf_dir).select("ordinal", "by_title", "by_author", "by_link", "media")


@query(f"""WITH {_MEDIA_SQL}, kept AS (SELECT *, CASE WHEN suffix <> '' AND media <> 'unknown' AND (contains(suffix, media) OR contains(media, suffix)) THEN {sql_stripped(f"regexp_replace(t, '{WS}*[-–—]{WS}*([^-–—]{{2,40}}){WS}*$', '')")} ELSE t END AS short FROM media
  WHERE t <> '' AND (filter IS NULL OR contains(t, filter)) AND NOT contains(lower(link), 'msn.com') AND NOT contains(lower(t || ' ' || b), 'worthless') AND ordinal % 12 <> 0)
SELECT left(md5(CASE WHEN link <> '' THEN link ELSE short END || 'v1'), 20) AS id, ordinal, short AS title, b AS content, pub, media, who AS raw_author,
  CASE WHEN {sql_terms("lower(short || ' ' || b)", POSITIVE)} > {sql_terms("lower(short || ' ' || b)", NEGATIVE)} THEN 'positive' WHEN {sql_terms("lower(short || ' ' || b)", NEGATIVE)} > {sql_terms("lower(short || ' ' || b)", POSITIVE)} THEN 'negative' ELSE 'neutral' END AS sentiment FROM kept""")
def ingest_articles(spark, sf_dir):
    """Landed rows to articles by the whole chain."""
    return ingest.articles(feed(spark, sf_dir), DOMAINS, V.excluded, POSITIVE, NEGATIVE).select("id", "ordinal", "title", "content", "pub", "media", "raw_author", "sentiment")


@query(f"WITH {NEWS} SELECT id FROM news WHERE NOT contains(lower(title || ' ' || content), 'worthless') AND NOT contains(lower(title || ' ' || content), 'stoth')")
def excluded_articles(spark, sf_dir):
    """Articles without any phrase of a table of phrases."""
    phrases = spark.createDataFrame([("Worthless",), ("stoth",)], "phrase string")
    return ingest.without_phrases(news(spark, sf_dir), phrases, "title", "content").select("id")


@query(f"WITH {FEED} SELECT contains(link, 'google') AS redirected, count(*) AS n_articles FROM feed WHERE NOT contains(lower(link), 'msn.com') GROUP BY 1")
def portal_cleanup(spark, sf_dir):
    """What stays when a portal's articles are removed."""
    return ingest.without_portal(feed(spark, sf_dir)).groupBy(F.contains("link", F.lit("google")).alias("redirected")).agg(F.count("*").alias("n_articles"))


_FORUMS, _WIRE, _BRIEF, _BLOCKED, _LISTINGS, _TRACKED = (("site4",), ("src2",)), (("site3",), ("src3",)), "ung", ("isch", "ment"), ("reth",), ("eau", "hing")
_FORUM_SQL = f"({sql_any('lower(link)', _FORUMS[0])} OR {sql_any('lower(source_name)', (*_FORUMS[0], *_FORUMS[1]))})"
_TEXT = "lower(title || ' ' || content)"
_OWN_SQL = f"coalesce(cat = 'en', false) AND NOT {sql_any(_TEXT, V.excluded)} AND {sql_any(_TEXT, ('there', 'tion'))} AND NOT coalesce({_FORUM_SQL}, false) AND NOT ((contains(lower(link), 'site3') OR coalesce({sql_any('lower(source_name)', ('site3', 'src3'))}, false)) AND contains(title, '{_BRIEF}')) AND NOT {sql_any('title', _BLOCKED)}"


def _viewed(spark, sf_dir):
    return news(spark, sf_dir).withColumn("media", F.col("source_name"))


def _own():
    return ingest.own_release("en", V.excluded, ("there", "tion"), _FORUMS, _WIRE, _BRIEF, _BLOCKED)


@query(f"WITH {NEWS} SELECT id, {_OWN_SQL} AS own, CASE WHEN cat = 'en' THEN {_OWN_SQL} ELSE coalesce(cat = 'fr' AND NOT contains(title, '{_BRIEF}') AND NOT coalesce({_FORUM_SQL}, false) AND NOT {sql_any(_TEXT, _LISTINGS)} AND {sql_any(_TEXT, _TRACKED)}, false) END AS candidate FROM news")
def candidates(spark, sf_dir):
    """Own releases, and what a briefing may take."""
    return _viewed(spark, sf_dir).select("id", _own().alias("own"), ingest.briefing_candidate("en", _own(), "fr", _BRIEF, _FORUMS, _LISTINGS, _TRACKED).alias("candidate"))


def _since_sql(period: str) -> str:
    local = f"({_AT} + INTERVAL 9 HOUR)"
    return {"today": f"date_trunc('day', {local}) - INTERVAL 9 HOUR", "week": f"{_AT} - INTERVAL 7 DAY", "month": f"date_trunc('month', {local}) - INTERVAL 9 HOUR", "year": f"date_trunc('year', {local}) - INTERVAL 9 HOUR"}[period]


_PERIODS = ("today", "week", "month", "year")


@query(f"WITH {NEWS} SELECT id, source_name = 'src1' AS one_brand, " + ", ".join(f"pub >= {_since_sql(p)} AS in_{p}" for p in _PERIODS) + f" FROM news WHERE cat = 'de' AND NOT coalesce({_FORUM_SQL}, false)")
def rival_feed(spark, sf_dir):
    """Rivals' articles and the periods they fall in, in a zone nine hours ahead."""
    rows = _viewed(spark, sf_dir).withColumn("brand", F.col("source_name")).where(ingest.rival_news("de", None, _FORUMS))
    return rows.select("id", F.coalesce(ingest.rival_news("de", "src1", _FORUMS), F.lit(False)).alias("one_brand"), *(ingest.since(F.col("pub"), C.instant(AS_OF), p, 9).alias(f"in_{p}") for p in _PERIODS))


@query(f"WITH {NEWS} SELECT id, pub FROM news WHERE pub >= TIMESTAMP '2024-01-10 16:00:00' ORDER BY pub DESC, ordinal LIMIT 2000")
def feed_window(spark, sf_dir):
    """A feed from a fixed day on, the newest 2,000: the cap is the feature."""
    return merge.by_date(news(spark, sf_dir).where(F.col("pub") >= C.instant("2024-01-10 16:00:00"))).limit(2000).select("id", "pub")


@query(f"WITH {NEWS} SELECT id, row_number() OVER (ORDER BY coalesce(CASE WHEN ordinal % 9 <> 0 THEN pub END, TIMESTAMP '1970-01-01') DESC, ordinal) <= 50 AS shown FROM news WHERE cat = 'es'")
def community_slice(spark, sf_dir):
    """Every article of one category; shown are the first 50, newest first, undated last."""
    rows = news(spark, sf_dir).where("cat = 'es'").withColumn("pub", F.when(F.col("ordinal") % 9 != 0, F.col("pub")))
    shown = merge.by_date(rows).limit(50).select("ordinal", F.lit(True).alias("__shown"))
    return rows.join(F.broadcast(shown), "ordinal", "left").select("id", F.coalesce("__shown", F.lit(False)).alias("shown"))


_BRANDS = (("src1|first", "First"), ("THERE D", "Second"), ("src", "Other source"))


@query(f"WITH {NEWS}, n AS (SELECT id, brand, coalesce(source_name, '') || ' ' || coalesce(media, '') AS names FROM news) SELECT id, coalesce(nullif(brand, ''), CASE WHEN regexp_matches(names, '(?i)src1|first') THEN 'First' WHEN regexp_matches(names, '(?i)there d') THEN 'Second' WHEN regexp_matches(names, '(?i)src') THEN 'Other source' ELSE 'other' END) AS brand FROM n")
def brand_case(spark, sf_dir):
    """A stated brand, else the first of several ordered patterns in the names of source and medium."""
    names = F.concat_ws(" ", T.or_empty(F.col("source_name")), T.or_empty(F.col("media")))
    return news(spark, sf_dir).select("id", F.coalesce(F.nullif("brand", F.lit("")), scoring.first_match(names, _BRANDS, "other", regex=True)).alias("brand"))


_CODES = {"1101": ("reth", "1101"), "2202": ("eau", "ung"), "3303": ("tion",)}
_AUTHORS = ("王小明", "Jane Roe", "jane roe", "Tide Herald", "Herald", "李", "me@x", "http://x", "Ann  Lee", " 陳大文 ", "司馬相如先", "Jane")
_AUTHOR_SQL = f"""authors AS (SELECT doc_id, CASE CAST(doc_id % {len(_AUTHORS) + 2} AS INT) {" ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_AUTHORS))} WHEN {len(_AUTHORS)} THEN 'Ann ' || upper(left(lang, 1)) || lower(substr(lang, 2)) END AS author FROM documents),
bare AS (SELECT *, {sql_stripped("coalesce(author, '')")} AS a FROM authors)"""
_MEDIUM_SQL = " OR ".join(f"contains(a, '{n}') OR contains('{n}', a)" for _, n in DOMAINS)


@query(f"WITH {_AUTHOR_SQL} SELECT doc_id, CASE WHEN length(a) BETWEEN 2 AND 15 AND NOT contains(a, '@') AND NOT contains(a, 'http') AND NOT ({_MEDIUM_SQL}) AND regexp_full_match(a, '[\\x{{4e00}}-\\x{{9fa5}}]{{2,4}}|[A-Z][a-z]+( [A-Z][a-z]+)+') THEN a END AS reporter FROM bare")
def reporters(spark, sf_dir):
    """Author fields in the forms that feeds have, by document: which of them name a person."""
    n = F.col("doc_id") % (len(_AUTHORS) + 2)
    author = F.coalesce(*(F.when(n == i, a) for i, a in enumerate(_AUTHORS)), F.when(n == len(_AUTHORS), F.concat(F.lit("Ann "), F.initcap("lang"))))
    return table(spark, sf_dir, "documents").select("doc_id", ingest.reporter(author, [n for _, n in DOMAINS]).alias("reporter"))


@query(f"WITH {NEWS} SELECT id, CASE " + " ".join(f"WHEN {sql_any(_TEXT, w)} THEN '{c}'" for c, w in _CODES.items()) + " END AS code, concat_ws(',', " + ", ".join(f"CASE WHEN contains(content, '{w}') THEN '{w}' END" for w in POSITIVE) + f") AS highlights, {sql_any('content', POSITIVE)} AS highlighted, CAST(len([x for x in string_split(content, '.') if trim(x) <> '']) AS INT) AS n_bullets, left(trim(regexp_replace(title, '{WS}+', ' ', 'g')) || ' (source: ' || coalesce(nullif(source_name, ''), 'unknown source') || '; type: ' || coalesce(cat, 'none') || ')', 300) AS line FROM news")
def text_marks(spark, sf_dir):
    """Codes by ordered terms, highlighted terms, bullets, and a line that names title, source and kind."""
    text = T.visible(F.col("title"), F.col("content"))
    marked = ingest.highlights(F.col("content"), POSITIVE)
    return news(spark, sf_dir).select("id", scoring.first_of(text, _CODES).alias("code"), F.array_join(marked, ",").alias("highlights"), (F.size(marked) > 0).alias("highlighted"), F.size(T.bullets(F.col("content"), "[.]")).alias("n_bullets"), T.labelled(F.col("title"), F.col("source_name"), F.coalesce("cat", F.lit("none"))).alias("line"))


def _matched_sql() -> str:
    ranked = sorted(V.events, key=lambda e: -e[2])
    given = lambda terms: "[" + ", ".join(f"CASE WHEN contains(t, '{t}') THEN '{t}' END" for t in terms) + "]"
    event = "CASE " + " ".join(f"WHEN event = '{k}' THEN {given(w)}" for k, w, _ in ranked) + " ELSE [] END"
    return f"[x for x in list_concat({given(V.industry)}, {event}, {given(V.negative)}, {given(V.positive)}) if x IS NOT NULL]"


@query(f"""WITH {_scores_sql()} SELECT id, CASE WHEN ex THEN '' ELSE array_to_string(list_slice(list_sort(list_distinct({_matched_sql()})), 1, 20), ',') END AS matched_terms,
CASE WHEN ex THEN 'excluded phrase' ELSE array_to_string([x for x in [CASE WHEN contains(',' || entities || ',', ',{V.own},') THEN 'own entity' END, CASE WHEN entities <> '' AND NOT contains(',' || entities || ',', ',{V.own},') THEN 'tracked entity' END, CASE WHEN {sql_any('t', V.industry)} THEN 'industry' END, CASE WHEN event <> 'other' THEN 'event: ' || event END] if x IS NOT NULL], ',') END AS reasons FROM rated""")
def rule_reasons(spark, sf_dir):
    """What a rule score rests on: matched terms, sorted, 20 at most, and reasons."""
    return _scored(spark, sf_dir).select("id", F.array_join("matched_terms", ",").alias("matched_terms"), F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {NEWS}, fixes AS (SELECT DISTINCT regexp_replace(lower(title), '{_LOOSE}', '', 'g') AS fixed FROM news WHERE ordinal % 97 = 0)," + _merge_sql(f"regexp_replace(lower(title), '{_LOOSE}', '', 'g')", "n.id").replace(f"WITH {NEWS},", "").replace("FROM news)", "FROM view_news)").replace("JOIN news f", "JOIN view_news f").replace("JOIN news n", "JOIN view_news n").replace(" k AS", " view_news AS (SELECT ordinal, id, title, CASE WHEN fixed IS NOT NULL THEN 'https://fixed.example/' ELSE link END AS link, CASE WHEN fixed IS NOT NULL THEN TIMESTAMP '2024-01-02 03:04:05' WHEN ordinal % 10 <> 0 THEN pub END AS pub FROM news LEFT JOIN fixes ON fixed = regexp_replace(lower(title), '" + _LOOSE + "', '', 'g')), k AS", 1))
def corrected_view(spark, sf_dir):
    """A list as it is shown: corrected, merged by loose title, dates at the epoch left out, newest first."""
    n = news(spark, sf_dir).withColumn("pub", F.when(F.col("ordinal") % 10 != 0, F.col("pub")).otherwise(C.instant("1970-01-01 00:00:00")))
    key = T.loose_title_key(F.col("title"))
    fixes = n.where("ordinal % 97 = 0").select(key.alias("key")).distinct().select("key", C.instant("2024-01-02 03:04:05").alias("pub"), F.lit("https://fixed.example/").alias("link"))
    return merge.merged_view(n, fixes).select("id", "title", "link", "pub", "n_merged", "ordinal")


_DAY = f"(date_trunc('day', {_AT} + INTERVAL 8 HOUR) - INTERVAL 8 HOUR)"
_TODAY_SQL = f"""WITH {NEWS}, recent AS (SELECT * REPLACE ({_AT} - to_hours(CAST(ordinal % 24 AS BIGINT)) AS pub) FROM news), keyed AS (SELECT *, regexp_replace(lower(title), '{_LOOSE}', '', 'g') AS key, link <> '' AND NOT contains(lower(link), 'news.google.com') AS direct FROM recent),
g AS (SELECT key, min(ordinal) AS o1, min(CASE WHEN direct THEN ordinal END) AS o2, min(pub) AS pub FROM keyed WHERE key <> '' GROUP BY key),
won AS (SELECT n.id, n.title, n.content, n.cat, n.source_name, n.media, g.pub, g.o1 AS ordinal FROM g JOIN news f ON f.ordinal = g.o1 JOIN news n ON n.ordinal = CASE WHEN contains(lower(f.link), 'news.google.com') AND o2 IS NOT NULL THEN o2 ELSE o1 END WHERE g.pub >= {_DAY}),
t AS (SELECT *, lower(title || ' ' || content) AS t, greatest(0, date_diff('second', pub, {_AT})) AS age FROM won),
s AS (SELECT *, CASE {" ".join(f"WHEN {sql_any('t', w)} THEN '{k}'" for k, w, _ in RULES)} ELSE 'news' END AS kind, CAST(CASE {" ".join(f"WHEN {sql_any('t', w)} THEN {p}" for _, w, p in RULES)} ELSE 8 END
 + CASE WHEN age <= 86400 THEN 24 WHEN age <= 259200 THEN 16 WHEN age <= 604800 THEN 8 ELSE 0 END + CASE WHEN contains(t, 'release') THEN 20 ELSE 0 END + CASE WHEN {sql_key_media()} THEN 8 ELSE 0 END AS BIGINT) AS score FROM t),
top AS (SELECT * FROM s WHERE kind <> 'news' ORDER BY score DESC, ordinal LIMIT 6)"""
_ACTIONS = {"risk": ("answer", "watch"), "finance": ("check figures", "compare figures"), "opportunity": ("amplify", "compare products"), "market": ("assess", "assess")}


def _today(spark, sf_dir):
    """Deduplicated, of today, scored, the best six: the limit is the feature.

    Texts are judged where they are read; the merge moves marks instead. A story of today has articles of
    today only, so older texts needn't be looked at.
    """
    start = C.local_start(C.instant(AS_OF), "DAY")
    recent = news(spark, sf_dir).withColumn("pub", F.timestamp_add("HOUR", (-F.col("ordinal") % 24).cast("int"), C.instant(AS_OF)).cast("timestamp_ntz"))
    marked = scoring.briefing_marks(recent.withColumn("content", F.when(F.col("pub") >= start, F.col("content"))), RULES, ("release",), MEDIA)
    merged = merge.merge_titles(marked, T.loose_title_key(F.col("title")), False, "kind", "base", "own", "key_medium")
    return scoring.briefing_best(merged.where(F.col("pub") >= start), C.instant(AS_OF), 6)


@query(f"""{_TODAY_SQL} SELECT id, kind, score, array_to_string([x for x in [kind, CASE WHEN age <= 86400 THEN 'last 24 hours' END, CASE WHEN contains(t, 'release') THEN 'own mention' END, CASE WHEN {sql_key_media()} THEN 'key media' END] if x IS NOT NULL], ',') AS reasons,
 CASE {" ".join(f"WHEN kind = '{k}' AND contains(t, 'release') THEN '{a}' WHEN kind = '{k}' THEN '{b}'" for k, (a, b) in _ACTIONS.items())} ELSE 'look into' END AS action FROM top""")
def today_briefing(spark, sf_dir):
    top = _today(spark, sf_dir)
    return top.select("id", "kind", "score", F.array_join("reasons", ",").alias("reasons"), scoring.suggestion(F.col("kind"), F.col("own"), _ACTIONS, "look into").alias("action"))


@query(f"{_TODAY_SQL} SELECT count(*) AS important, count(*) FILTER (WHERE kind = 'risk') AS risks, count(*) FILTER (WHERE cat = 'fr') AS rivals FROM top")
def briefing_summary(spark, sf_dir):
    return _today(spark, sf_dir).agg(F.count("*").alias("important"), F.count_if(F.col("kind") == "risk").alias("risks"), F.count_if(F.col("cat") == "fr").alias("rivals"))


_LABELS = {"crisis": "Risk", "financial": "Financial", "supply": "Supply chain", "product": "Product", "partnership": "Partnership", "market": "Market"}


@query(f"WITH {_scores_sql()} SELECT id, CASE event " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LABELS.items()) + " ELSE 'News' END AS label, CASE cat WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'en' THEN 3 ELSE 4 END AS place FROM rated")
def event_labels(spark, sf_dir):
    """Labels with a default, and a display order that is stated, not derived."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ("fr", "de", "en"))), F.col("cat")).cast("int"), F.lit(0)), F.lit(4))
    return _scored(spark, sf_dir).select("id", scoring.label(F.col("event"), _LABELS, "News").alias("label"), order.alias("place"))


@query(f"WITH {_scores_sql()} SELECT id, left(trim(regexp_replace(title, '{WS}+', ' ', 'g')) || ' (source: ' || coalesce(nullif(source_name, ''), 'unknown source') || '; type: ' || event || ')', 300) AS summary, event, replace(replace(entities, 'E1', 'Own'), 'E2', 'Second') AS entities, impact, importance, 0.55::DOUBLE AS confidence, CASE WHEN importance >= 70 OR event = 'crisis' THEN 'look at it' ELSE '' END AS action FROM rated")
def rules_only(spark, sf_dir):
    """What stands in for a model's output where there is none."""
    out = worker.rules_output(_scored(spark, sf_dir), {"E1": "Own", "E2": "Second"}, "look at it")
    return out.withColumn("entities", F.array_join("entities", ",")).drop("bullets")


@query(rf"""WITH {NEWS} SELECT id, left(md5(strftime(pub, '%Y-%m-%dT%H:%M:%S+00:00') || chr(31) || title || chr(31) || content || chr(31) || link || chr(31) || 'neutral' || chr(31) || coalesce(cat, '') || chr(31) || '' || chr(31) || coalesce(source_name, '') || chr(31) || coalesce(source_name, '') || chr(31) || '' || chr(31) || CAST(ordinal % 3 AS VARCHAR)), 16) AS h FROM news""")
def full_hash(spark, sf_dir):
    """The content hash over the date and all ten stable fields."""
    none = F.lit(None).cast("string")
    fields = [F.col("title"), F.col("content"), F.col("link"), F.lit("neutral"), F.col("cat"), none, F.col("source_name"), F.col("source_name"), none, F.col("ordinal") % 3]
    return news(spark, sf_dir).select("id", ingest.article_hash(F.col("pub"), *fields).alias("h"))
