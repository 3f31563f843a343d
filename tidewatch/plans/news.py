"""Queries over articles: cleaning, keys, scores, merging, the digest, facets."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import calendar as C
from tidewatch.functions import numbers as N
from tidewatch.functions import text as T
from tidewatch.operators import ingest, merge, scoring, vocabulary
from tidewatch.plans.tables import AS_OF, MEDIA, NEGATIVE, NEWS, POSITIVE, RULES, SQL_SHOWN, VOCABULARY, WS, news, query, shared_folder, sql_alias, sql_any, sql_key_media, sql_known, sql_stripped, sql_terms, table

V = VOCABULARY
_LOOSE = WS[:-1] + T.TITLE_MARKS + "]"


@query(f"SELECT page_id, {sql_stripped("regexp_replace(html, '<[^>]+>', '', 'g')")} AS clean FROM pages")
def clean_html_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("clean"))


@query(rf"WITH {NEWS} SELECT id, left(lower(regexp_replace(title, '[^\p{{L}}\p{{N}}_]+', '', 'g')), 30) AS short_key, left(lower(regexp_replace(title, '[^\p{{L}}\p{{N}}_]+', '', 'g')), 120) AS long_key, regexp_replace(lower(title), '{_LOOSE}', '', 'g') AS loose_key FROM news")
def title_keys(spark, sf_dir):
    return news(spark, sf_dir).select("id", T.title_key(F.col("title")).alias("short_key"), T.title_key(F.col("title"), 120).alias("long_key"), T.loose_title_key(F.col("title")).alias("loose_key"))


@query(rf"""WITH {NEWS}, k AS (SELECT *, left(lower(regexp_replace(title, '[^\p{{L}}\p{{N}}_]+', '', 'g')), 120) AS key FROM news)
SELECT id, left(md5(CASE WHEN link <> '' THEN link ELSE title END || 'v1'), 20) AS article_id, CASE WHEN key = '' THEN id ELSE sha256(key) END AS story_id,
  left(md5(strftime(pub, '%Y-%m-%d %H:%M:%S') || chr(31) || title || chr(31) || content || chr(31) || link || chr(31) || coalesce(cat, '')), 16) AS h, CASE WHEN regexp_matches(id, '^[0-9a-f]') THEN left(id, 1) ELSE '0' END AS shard FROM k""")
def article_ids(spark, sf_dir):
    n = news(spark, sf_dir)
    return n.select("id", T.article_id(F.col("link"), F.col("title")).alias("article_id"), T.story_id(F.col("title"), F.col("id")).alias("story_id"), T.content_hash(F.date_format("pub", "yyyy-MM-dd HH:mm:ss"), F.col("title"), F.col("content"), F.col("link"), F.col("cat")).alias("h"), T.shard_of(F.col("id")).alias("shard"))


@query(f"""WITH {NEWS}, t AS (SELECT {sql_terms("lower(title || ' ' || content)", POSITIVE)} AS p, {sql_terms("lower(title || ' ' || content)", NEGATIVE)} AS n FROM news)
SELECT CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment, count(*) AS n_articles, CAST(sum(p) AS BIGINT) AS n_positive, CAST(sum(n) AS BIGINT) AS n_negative FROM t GROUP BY 1""")
def lexicon_sentiment(spark, sf_dir):
    t = T.visible(F.col("title"), F.col("content"))
    return news(spark, sf_dir).select(T.sentiment(t, POSITIVE, NEGATIVE).alias("sentiment"), T.hits(t, POSITIVE).alias("p"), T.hits(t, NEGATIVE).alias("n")).groupBy("sentiment").agg(F.count("*").alias("n_articles"), F.sum("p").alias("n_positive"), F.sum("n").alias("n_negative"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS code, count(*) AS n_articles, CAST(count(DISTINCT source) AS BIGINT) AS n_sources FROM documents WHERE {sql_alias('lower(text)', a)} HAVING count(*) > 0" for c, a in V.entities.items()))
def alias_entities(spark, sf_dir):
    found = F.array_compact(F.array(*(F.when(scoring._any(F.lower("text"), a), F.lit(c)) for c, a in V.entities.items())))
    return table(spark, sf_dir, "documents").select(F.explode(found).alias("code"), "source").groupBy("code").agg(F.count("*").alias("n_articles"), F.countDistinct("source").alias("n_sources"))


def _scores_sql() -> str:
    named = ", ".join(f"CASE WHEN {sql_alias('t', a)} THEN '{c}' END" for c, a in V.entities.items())
    own = sql_alias("t", V.entities[V.own])
    some = "(" + " OR ".join(sql_alias("t", a) for a in V.entities.values()) + ")"
    bonus = "CASE " + " ".join(f"WHEN cat = '{c}' THEN {p}" for c, p in V.bonuses.items()) + " ELSE 0 END"
    ranked = sorted(V.events, key=lambda e: -e[2])
    event = "CASE WHEN ex THEN 'other' " + " ".join(f"WHEN {sql_any('t', w)} THEN '{k}'" for k, w, _ in ranked) + " ELSE 'other' END"
    weight = "CASE WHEN ex THEN 0 " + " ".join(f"WHEN {sql_any('t', w)} THEN {p}" for _, w, p in ranked) + " ELSE 0 END"
    return f"""{NEWS}, texts AS (SELECT *, lower(title || ' ' || content || ' ' || coalesce(source_name, '') || ' ' || coalesce(media, '') || ' ' || coalesce(brand, '')) AS t FROM news), flagged AS (SELECT *, {sql_any('t', V.excluded)} AS ex FROM texts),
scored AS (SELECT *, CAST(CASE WHEN ex THEN 0 ELSE least(100, CASE WHEN {own} THEN 55 WHEN {some} THEN 35 ELSE 0 END + least(30, 6 * {sql_terms('t', V.industry)}) + {bonus}) END AS BIGINT) AS relevance, {event} AS event, {weight} AS weight,
  CASE WHEN NOT ex AND starts_with(source_name, 'src1') THEN 8 ELSE 0 END AS extra, {sql_terms('t', V.positive)} AS pos, {sql_terms('t', V.negative)} AS neg, CASE WHEN ex THEN '' ELSE concat_ws(',', {named}) END AS entities FROM flagged),
rated AS (SELECT *, CAST(least(100, round_even((relevance * 55 + (weight + extra) * 100) / 100.0, 0)) AS BIGINT) AS importance,
  CASE WHEN ex THEN 'neutral' WHEN neg > 0 AND pos = 0 THEN 'risk' WHEN pos > 0 AND neg = 0 THEN 'opportunity' WHEN pos > 0 AND neg > 0 THEN 'mixed' ELSE 'neutral' END AS impact FROM scored)"""


def _scored(spark, sf_dir):
    return scoring.rule_scores(news(spark, sf_dir), V)


@query(f"WITH {_scores_sql()} SELECT id, relevance, event, importance, impact, entities, relevance >= 20 AS relevant, importance >= 70 OR event = 'crisis' AS review FROM rated")
def rule_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "relevance", "event", "importance", "impact", F.array_join("entities", ",").alias("entities"), "relevant", "review")


@query(f"WITH {_scores_sql()} SELECT id AS job_id, importance AS priority, event, 'pending' AS status, CAST(0 AS BIGINT) AS attempts FROM rated WHERE relevance >= 20")
def job_build(spark, sf_dir):
    return _scored(spark, sf_dir).where("relevant").select(F.col("id").alias("job_id"), F.col("importance").alias("priority"), "event", F.lit("pending").alias("status"), F.lit(0).cast("long").alias("attempts"))


_DIRECT = "link <> '' AND NOT contains(lower(link), 'news.google.com')"


@query(rf"""WITH {_scores_sql()}, rows AS (SELECT *, CASE WHEN left(lower(regexp_replace(title, '[^\p{{L}}\p{{N}}_]+', '', 'g')), 120) = '' THEN id ELSE sha256(left(lower(regexp_replace(title, '[^\p{{L}}\p{{N}}_]+', '', 'g')), 120)) END AS story FROM rated),
sent AS (SELECT DISTINCT story FROM rows WHERE ordinal % 11 = 0),
live AS (SELECT * FROM rows WHERE pub > TIMESTAMP '{AS_OF}' - INTERVAL 960 HOUR AND relevance >= 20 AND impact <> 'risk' AND NOT contains(entities, 'E4') AND story NOT IN (SELECT story FROM sent)),
best AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY importance DESC, ordinal) AS r, first_value(link) OVER (PARTITION BY story ORDER BY CASE WHEN {_DIRECT} THEN 0 ELSE 1 END, importance DESC, ordinal) AS l, count(*) FILTER (WHERE {_DIRECT}) OVER (PARTITION BY story) AS d FROM live)
SELECT story, id, importance, ordinal, CASE WHEN contains(lower(link), 'news.google.com') AND d > 0 THEN l ELSE link END AS link FROM best WHERE r = 1 ORDER BY importance DESC, ordinal LIMIT 20""")
def digest_select(spark, sf_dir):
    """The 20 stories of a digest: the limit is the feature."""
    scored = _scored(spark, sf_dir)
    sent = news(spark, sf_dir).where("ordinal % 11 = 0").select(T.story_id(F.col("title"), F.col("id")).alias("story"))
    return scoring.digest(scored, C.shifted(C.instant(AS_OF), -960), sent, ("E4",), 20)


@query(f"""WITH {NEWS}, t AS (SELECT *, lower(title || ' ' || content) AS t, greatest(0, date_diff('second', pub, TIMESTAMP '{AS_OF}')) AS age FROM news),
s AS (SELECT id, ordinal, pub, CASE {" ".join(f"WHEN {sql_any('t', w)} THEN '{k}'" for k, w, _ in RULES)} ELSE 'news' END AS kind, CAST(CASE {" ".join(f"WHEN {sql_any('t', w)} THEN {p}" for _, w, p in RULES)} ELSE 8 END
 + CASE WHEN age <= 86400 THEN 24 WHEN age <= 259200 THEN 16 WHEN age <= 604800 THEN 8 ELSE 0 END + CASE WHEN contains(t, 'release') THEN 20 ELSE 0 END + CASE WHEN {sql_key_media()} THEN 8 ELSE 0 END AS BIGINT) AS score FROM t)
SELECT * FROM s WHERE kind <> 'news' ORDER BY score DESC, ordinal LIMIT 6""")
def briefing_top(spark, sf_dir):
    """The 6 items of a briefing: the limit is the feature."""
    return scoring.briefing(news(spark, sf_dir), C.instant(AS_OF), RULES, ("release",), MEDIA, 6).select("id", "ordinal", "pub", "kind", "score")


def _merge_sql(key: str, new_id: str) -> str:
    return f"""WITH {NEWS}, k AS (SELECT *, {key} AS key, {_DIRECT} AS direct FROM news),
g AS (SELECT key, min(ordinal) AS o1, min(CASE WHEN direct THEN ordinal END) AS o2, min(pub) AS first_pub, count(*) AS n_merged FROM k WHERE key <> '' GROUP BY key),
w AS (SELECT g.*, CASE WHEN contains(lower(f.link), 'news.google.com') AND o2 IS NOT NULL THEN o2 ELSE o1 END AS o FROM g JOIN news f ON f.ordinal = o1)
SELECT {new_id} AS id, n.title, n.link, first_pub AS pub, n_merged, o1 AS ordinal FROM w JOIN news n ON n.ordinal = o"""


@query(_merge_sql(r"left(lower(regexp_replace(title, '[^\p{L}\p{N}_]+', '', 'g')), 120)", "CASE WHEN n_merged > 1 THEN left(md5(CASE WHEN n.link <> '' THEN n.link ELSE n.title END || 'v1'), 20) ELSE n.id END"))
def title_merge(spark, sf_dir):
    return merge.merge_titles(news(spark, sf_dir), T.title_key(F.col("title"), 120), True).select("id", "title", "link", "pub", "n_merged", "ordinal")


@query(_merge_sql(f"regexp_replace(lower(title), '{_LOOSE}', '', 'g')", "n.id"))
def loose_dedupe(spark, sf_dir):
    return merge.merge_titles(news(spark, sf_dir), T.loose_title_key(F.col("title")), False).select("id", "title", "link", "pub", "n_merged", "ordinal")


@query(f"""WITH {NEWS}, fixes AS (SELECT DISTINCT regexp_replace(lower(title), '{_LOOSE}', '', 'g') AS key FROM news WHERE ordinal % 97 = 0)
SELECT id, f.key IS NOT NULL AS corrected, CASE WHEN f.key IS NOT NULL THEN TIMESTAMP '2024-01-02 03:04:05' ELSE pub END AS pub, CASE WHEN f.key IS NOT NULL THEN 'https://fixed.example/' ELSE link END AS link
FROM news LEFT JOIN fixes f ON regexp_replace(lower(title), '{_LOOSE}', '', 'g') = f.key""")
def verified_corrections(spark, sf_dir):
    n = news(spark, sf_dir)
    key = T.loose_title_key(F.col("title"))
    fixes = n.where("ordinal % 97 = 0").select(key.alias("key")).distinct().select("key", C.instant("2024-01-02 03:04:05").alias("pub"), F.lit("https://fixed.example/").alias("link"))
    return merge.corrected(n, fixes, key).select("id", "corrected", "pub", "link")


@query(f"""WITH {NEWS}, old AS (SELECT id, md5(CASE WHEN ordinal % 10 = 1 THEN title || '!' ELSE title END) AS h FROM news WHERE ordinal % 5 <> 0)
SELECT CASE WHEN o.h IS NULL THEN 'added' WHEN o.h = md5(n.title) THEN 'skipped' ELSE 'updated' END AS action, count(*) AS n_rows FROM news n LEFT JOIN old o USING (id) GROUP BY 1""")
def incremental_diff(spark, sf_dir):
    n = news(spark, sf_dir)
    old = n.where("ordinal % 5 <> 0").select("id", F.md5(F.when(F.col("ordinal") % 10 == 1, F.concat("title", F.lit("!"))).otherwise(F.col("title"))).alias("h"))
    return merge.changes(n.select("id", F.md5("title").alias("h")), old).groupBy("action").agg(F.count("*").alias("n_rows"))


@query(f"""WITH {NEWS}, e AS (SELECT id, md5(title) AS h, strftime(CASE WHEN ordinal % 4 = 0 THEN pub + INTERVAL 5 DAY ELSE pub END, '%Y%m%d') AS t, left(md5(id), 1) AS shard FROM news),
r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY t DESC, id) AS r FROM e WHERE t >= '20231215') SELECT id, h, t, shard FROM r WHERE r <= 6000""")
def index_prune_cap(spark, sf_dir):
    """The newest 6,000 entries of each shard: the cap is the feature."""
    n = news(spark, sf_dir)
    entry = lambda df, pub: df.select("id", F.md5("title").alias("h"), F.date_format(pub, "yyyyMMdd").alias("t"))
    old = entry(n.where("ordinal % 4 <> 0"), F.col("pub"))
    new = entry(n.where("ordinal % 3 = 0 OR ordinal % 4 = 0"), F.when(F.col("ordinal") % 4 == 0, C.shifted(F.col("pub"), 120)).otherwise(F.col("pub")))
    return merge.update_index(old, new, "20231215", 6000).select("id", "h", "t", "shard")


@query(f"""WITH {NEWS}, s AS (SELECT sha256(title) AS story, max(strftime(pub, '%Y%m%d')) AS v FROM news WHERE title <> '' GROUP BY 1) SELECT story, v FROM s WHERE v >= '20240117' ORDER BY v DESC, story LIMIT 1000""")
def sent_set_update(spark, sf_dir):
    """Stories sent in the last 14 days, the newest 1,000: the cap is the feature."""
    s = news(spark, sf_dir).where("title <> ''").groupBy(F.sha2("title", 256).alias("story")).agg(F.max(F.date_format("pub", "yyyyMMdd")).alias("v"))
    return s.where("v >= '20240117'").orderBy(F.desc("v"), "story").limit(1000)


_SEARCHED = f"lower(title || ' ' || content || ' ' || coalesce({SQL_SHOWN}, 'unknown') || ' ' || coalesce(source_name, '') || ' ' || coalesce(brand, ''))"


@query(f"""WITH {NEWS} SELECT 'medium' AS search, id FROM news WHERE {SQL_SHOWN} = 'src1' AND contains({_SEARCHED}, 'tion') AND {sql_terms("lower(title || ' ' || content)", POSITIVE)} > {sql_terms("lower(title || ' ' || content)", NEGATIVE)}
UNION ALL SELECT 'words', id FROM news WHERE contains({_SEARCHED}, 'seventh wire') UNION ALL SELECT 'brand', id FROM news WHERE contains({_SEARCHED}, 'there daily src') AND contains({_SEARCHED}, 'reth') UNION ALL SELECT 'nameless', id FROM news WHERE coalesce({SQL_SHOWN}, 'unknown') = 'unknown'""")
def search_filter(spark, sf_dir):
    """Searches by medium, sentiment and words, which look into title, content, medium, source and brand."""
    n = news(spark, sf_dir)
    found = {
        "medium": ingest.matching(n, " TION ", "src1", "positive", lexicon=(POSITIVE, NEGATIVE)), "words": ingest.matching(n, "Seventh Wire"),
        "brand": ingest.matching(ingest.matching(n, "there daily SRC"), "reth"), "nameless": ingest.matching(n, media="unknown"),
    }
    parts = [df.select(F.lit(name).alias("search"), "id") for name, df in found.items()]
    return reduce(DataFrame.unionByName, parts)


@query(f"WITH {NEWS} SELECT cat, count(*) AS n_articles FROM news GROUP BY 1")
def search_all(spark, sf_dir):
    """A search that states nothing takes every article."""
    return ingest.matching(news(spark, sf_dir), "  ", "all", "all").groupBy("cat").agg(F.count("*").alias("n_articles"))


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def distinct_sources(spark, sf_dir):
    """The options of a filter, in the order of a collation for traditional Chinese."""
    return table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source").distinct().orderBy(F.collate("source", "zh_Hant"))


_NAMES = ("src1", "src2", "src3", "src", "none")


@query("WITH m AS (SELECT * FROM (VALUES (0, 'src1'), (1, 'src2'), (2, 'src3'), (3, 'src'), (4, 'none')) v(o, name)), c AS (SELECT o, name, count(source) AS n FROM m LEFT JOIN documents ON contains(source, name) GROUP BY o, name), t AS (SELECT greatest(count(*), 1) AS total FROM documents) SELECT name, n AS n_articles, CAST(floor(100.0 * n / total + 0.5) AS BIGINT) AS pct, row_number() OVER (ORDER BY n DESC, o) AS rank, n / greatest((SELECT max(n) FROM c), 1) AS bar FROM c, t")
def media_exposure(spark, sf_dir):
    """A short list of names is matched by expressions in one pass, so a name without articles keeps its zero."""
    d = table(spark, sf_dir, "documents")
    counts = d.agg(F.count("*").alias("total"), *(F.count_if(F.contains("source", F.lit(m))).alias(f"n{i}") for i, m in enumerate(_NAMES)))
    rows = counts.select("total", F.inline(F.array(*(F.struct(F.lit(i).alias("o"), F.lit(m).alias("name"), F.col(f"n{i}").alias("n_articles")) for i, m in enumerate(_NAMES)))))
    most = F.greatest(F.max("n_articles").over(Window.partitionBy()), F.lit(1))
    return scoring.ranked_desc(rows, "n_articles", "o").select("name", "n_articles", N.share(F.col("n_articles"), F.col("total")).alias("pct"), "rank", (F.col("n_articles") / most).alias("bar"))


_HOST = r"regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www\.', '', 'g')"
_SITES = (("site1", "First"), ("site2.example.org.tw", "Second"), (".org", "Org"))


@query(f"WITH p AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT page_id, host, CASE WHEN host <> '' AND NOT contains(host, 'google') THEN coalesce({sql_known('host', _SITES)}, host) END AS media FROM p")
def domain_lookup(spark, sf_dir):
    """A known host holds the link's or is held by it; the first entry wins."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(T.host(F.col("url")), r"www\.", "").alias("host"), ingest.link_media(F.col("url"), _SITES).alias("media"))


_BAD = ("javascript:alert(1)", "https://user@host.example/", "http://a b.example/", "ftp://x.example/", "https:///nohost", "HTTPS://ok.example", "  https://blanks.example/a ", "https://in　side.example/", "http://:80/", "https://host.example:443/x", "https://@host.example/", "https://u:p@host.example/", "https://[::1]/", "")


@query(f"WITH u AS (SELECT page_id AS n, url FROM pages UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}, '{u}')" for i, u in enumerate(_BAD)) + f") v), c AS (SELECT n, {sql_stripped('url')} AS url FROM u) " + r"SELECT CAST(n AS BIGINT) AS n, regexp_matches(url, '^[hH][tT][tT][pP][sS]?://(:?@)?(\[[^\]/?#@]+\]|[^\[\]/?#@:]+)(:[^/?#@]*)?([/?#].*)?$') AND NOT regexp_matches(url, '[\x00-\x20\x7f]|" + WS + "') AS safe FROM c")
def safe_urls(spark, sf_dir):
    bad = spark.createDataFrame([(-i - 1, u) for i, u in enumerate(_BAD)], "n long, url string")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("n"), "url").unionByName(bad).select("n", T.safe_url(F.col("url")).alias("safe"))


@query(f"WITH {NEWS}, n AS (SELECT *, coalesce(regexp_extract(title, '[-–—]\\s*([^-–—]{{2,40}})$', 1), '') AS suffix FROM news) SELECT id, suffix, left(trim(regexp_replace(content, '{WS}+', ' ', 'g')), 300) AS summary, CASE WHEN contains(lower(title), 'tion') THEN 'A' WHEN contains(lower(title), 'eau') THEN 'B' ELSE 'other' END AS brand FROM n")
def text_pack(spark, sf_dir):
    n = news(spark, sf_dir)
    return n.select("id", T.title_suffix(F.col("title")).alias("suffix"), T.summary(F.col("content")).alias("summary"), scoring.first_match(F.lower("title"), (("tion", "A"), ("eau", "B")), "other").alias("brand"))


@query(f"WITH {NEWS} SELECT id, title AS name, CASE cat WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE 'other' END AS category, strftime(pub, '%Y-%m-%d') AS day, link FROM news")
def export_projection(spark, sf_dir):
    return news(spark, sf_dir).select("id", F.col("title").alias("name"), F.when(F.col("cat") == "en", "English").when(F.col("cat") == "fr", "French").otherwise("other").alias("category"), F.date_format("pub", "yyyy-MM-dd").alias("day"), "link")


_KEYWORDS = f"""s AS (SELECT ordinal, [x for x in list_distinct(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+')) if regexp_full_match(x, '[a-z\\x{{4e00}}-\\x{{9fff}}]{{3,}}') AND x NOT IN ({', '.join(map(repr, T.STOP_WORDS))})] AS k FROM news)"""


@query(f"""WITH {NEWS}, {_KEYWORDS},
k AS (SELECT ordinal, len(k) AS n, unnest(k) AS word FROM s WHERE len(k) > 0),
p AS (SELECT a.ordinal, count(*) / least(min(a.n), min(b.n)) AS share FROM k a JOIN k b ON a.word = b.word AND a.ordinal <> b.ordinal WHERE b.ordinal % 20 = 0 GROUP BY a.ordinal, b.ordinal)
SELECT ordinal, ordinal IN (SELECT ordinal FROM p WHERE share >= 0.5) AS similar FROM news""")
def title_similarity(spark, sf_dir):
    """Every title against a stated set of selected ones, those whose id is divisible by 20."""
    titles = news(spark, sf_dir).select("ordinal", T.keywords(F.col("title")).alias("k"))
    return merge.similar(titles, titles.where("ordinal % 20 = 0"), folder=f"{shared_folder(spark)}/similar-{uuid.uuid4().hex}")


@query(f"""WITH RECURSIVE {NEWS}, {_KEYWORDS}, n AS (SELECT ordinal, k, row_number() OVER (ORDER BY ordinal) AS i FROM s),
w AS (SELECT i, len(k) AS n, unnest(k) AS word FROM n), p AS (SELECT b.i, a.i AS before FROM w a JOIN w b ON a.word = b.word AND a.i < b.i GROUP BY 1, 2 HAVING count(*) / least(min(a.n), min(b.n)) >= 0.5),
q AS (SELECT i, ordinal, coalesce(list(before), []) AS before FROM n LEFT JOIN p USING (i) GROUP BY ALL),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS taken UNION ALL SELECT q.i, CASE WHEN list_has_any(taken, before) THEN taken ELSE list_append(taken, q.i) END FROM r JOIN q ON q.i = r.i + 1)
SELECT ordinal, list_contains((SELECT taken FROM r ORDER BY i DESC LIMIT 1), i) AS selected FROM q""")
def title_selection(spark, sf_dir):
    """Every title in order, taken unless it is like one taken before."""
    titles = news(spark, sf_dir).select("ordinal", T.keywords(F.col("title")).alias("k"))
    return merge.selected(titles, f"{shared_folder(spark)}/selection-{uuid.uuid4().hex}")


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS term FROM documents), t AS (SELECT term FROM w ORDER BY md5(term) LIMIT 10000)
SELECT term, count(*) AS n_documents FROM t JOIN documents ON contains(lower(text), term) GROUP BY term""")
def vocabulary_counts(spark, sf_dir):
    """How many documents contain each of 10,000 terms that were drawn from them; the number of terms is the feature, the documents are all there are."""
    d = table(spark, sf_dir, "documents")
    words = d.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("term")).distinct()
    terms = words.orderBy(F.md5("term")).limit(10_000)
    return vocabulary.term_hits(d.select(F.lower("text").alias("text")), "text", terms).groupBy("term").agg(F.count("*").alias("n_documents"))


_ALIASES = ("there", "that", "reth", "eau", "ción", "und", "the", "le", "é")


@query(" UNION ALL ".join(f"SELECT '{a}' AS term, count(*) AS n_documents FROM documents WHERE {sql_alias('lower(text)', (a,))} HAVING count(*) > 0" for a in _ALIASES))
def alias_counts(spark, sf_dir):
    """A table of aliases: those of ASCII between other characters than letters and digits, others anywhere."""
    terms = spark.createDataFrame([(a,) for a in _ALIASES], "term string")
    d = table(spark, sf_dir, "documents").select(F.lower("text").alias("text"))
    return vocabulary.term_hits(d, "text", terms, whole_words=True).groupBy("term").agg(F.count("*").alias("n_documents"))
