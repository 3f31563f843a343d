"""Queries over quotes, figures, jobs, locks, sources, sinks and copies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.functions import calendar as C
from tidewatch.functions import numbers as N
from tidewatch.operators import copying, finance, jobs, verify, worker
from tidewatch.plans.figures import _ANNUAL, _MONTHLY, _PIVOT, CODES, annual, monthly
from tidewatch.plans.operations import _JOBS, _jobs
from tidewatch.plans.tables import AS_OF, FEED, feed, query, shared_folder, sql_stripped, table
from tidewatch.sources import landing, sinks

_AT = f"TIMESTAMP '{AS_OF}'"


@query("""WITH q AS (SELECT user_id, event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS z, CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE floor(value) END AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f AS (SELECT *, coalesce(z, y) AS price FROM q WHERE r = 1), c AS (SELECT *, CASE WHEN y <> 0 THEN round(price - y, 2) ELSE 0.0 END AS change FROM f)
SELECT user_id, round(price, 2) AS price, change, CASE WHEN y <> 0 THEN round(change / y * 100, 2) ELSE 0.0 END AS pct, event_id * 1000000 AS volume FROM c""")
def quote_derive(spark, sf_dir):
    """Quotes as text: the first row of a code counts, a dash is no price."""
    n = F.col("event_id")
    z, y = F.when(n % 4 == 0, "-").otherwise(F.col("value").cast("string")), F.when(n % 9 == 0, F.lit("0")).otherwise(F.floor("value").cast("string"))
    rows = table(spark, sf_dir, "events").select("user_id", n.alias("ordinal"), z.alias("z"), y.alias("y"), F.concat(n.cast("string"), F.lit(",000")).alias("v"))
    return finance.quotes(rows, "user_id")


_NAMES = {"revenue": ("Turnover", "Revenue"), "gross": ("Gross", "GrossProfit"), "operating": ("Operating",), "net": ("Parent", "Net", "Profit")}
_LONG = """SELECT l_orderkey, 'Revenue' AS type, 'Turnover' AS origin, CASE WHEN l_linenumber % 5 = 0 THEN 0.0 ELSE l_extendedprice END AS value, l_orderkey * 100 + l_linenumber * 10 AS ordinal FROM lineitem
UNION ALL SELECT l_orderkey, 'GrossProfit', CASE WHEN l_linenumber % 2 = 0 THEN 'Gross' END, l_extendedprice / 2, l_orderkey * 100 + l_linenumber * 10 + 1 FROM lineitem
UNION ALL SELECT l_orderkey, 'Operating', NULL, l_quantity, l_orderkey * 100 + l_linenumber * 10 + 2 FROM lineitem
UNION ALL SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN 'Parent' WHEN l_linenumber = 2 THEN 'Net' ELSE 'Profit' END, NULL, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE l_tax * 1000 END, l_orderkey * 100 + l_linenumber * 10 + 3 FROM lineitem"""


def _last(name: str) -> str:
    return f"nullif(arg_max(value, row(ordinal, value)) FILTER (WHERE type = '{name}' OR origin = '{name}'), 0)"


@query(f"WITH m AS ({_LONG}), w AS (SELECT l_orderkey, " + ", ".join(f"CAST(trunc(coalesce({', '.join(map(_last, names))}, 0)) AS BIGINT) AS {k}" for k, names in _NAMES.items()) + " FROM m GROUP BY 1) SELECT l_orderkey, revenue, gross, operating, net, " + ", ".join(f"CASE WHEN revenue = 0 THEN 0.0 ELSE round({k} / revenue * 100, 2) END AS {k}_margin" for k in ("gross", "operating", "net")) + " FROM w")
def quarter_aliases(spark, sf_dir):
    """Figures under several names, the first that is neither missing nor 0, cut to whole numbers."""
    item = table(spark, sf_dir, "lineitem")
    n, at = F.col("l_linenumber"), F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10
    row = lambda i, kind, origin, value: F.struct(kind.alias("type"), origin.cast("string").alias("origin"), value.cast("double").alias("value"), (at + i).alias("ordinal"))
    rows = F.array(
        row(0, F.lit("Revenue"), F.lit("Turnover"), F.when(n % 5 == 0, 0.0).otherwise(F.col("l_extendedprice"))),
        row(1, F.lit("GrossProfit"), F.when(n % 2 == 0, "Gross"), F.col("l_extendedprice") / 2),
        row(2, F.lit("Operating"), F.lit(None), F.col("l_quantity")),
        row(3, F.when(n == 1, "Parent").when(n == 2, "Net").otherwise("Profit"), F.lit(None), F.when(n == 1, 0.0).otherwise(F.col("l_tax") * 1000)),
    )
    return finance.quarter_figures(item.select("l_orderkey", F.inline(rows)), "l_orderkey", _NAMES)


_FLOWS = (("by name", ["purchase", "click"], (), ()), ("similar", ["absent"], ("i",), ("s",)), ("none", ["absent"], (), ()))


def _flow_sql(label: str, names: list[str], holds: tuple, without: tuple) -> str:
    at = " ".join(f"WHEN name = '{n}' THEN {i}" for i, n in enumerate(names, 1))
    like = " OR ".join(f"contains(name, '{x}')" for x in holds) or "false"
    no = "".join(f" AND NOT contains(name, '{x}')" for x in without)
    return f"SELECT '{label}' AS kind, day, name, buy, sell, round(buy - sell, 2) AS net FROM (SELECT *, CASE {at} WHEN ({like}){no} THEN {len(names) + 1} END AS p FROM l) WHERE p IS NOT NULL QUALIFY row_number() OVER (ORDER BY p, first) = 1"


@query("WITH e AS (SELECT event_type AS name, strftime(ts, '%Y-%m-%d') AS day, value AS buy, round(value / 2, 2) AS sell, event_id FROM events), d AS (SELECT * FROM e WHERE day = (SELECT max(day) FROM e)), l AS (SELECT name, day, arg_max(buy, event_id) AS buy, arg_max(sell, event_id) AS sell, min(event_id) AS first FROM d GROUP BY name, day) " + " UNION ALL ".join(f"(SELECT * FROM ({_flow_sql(*f)}))" for f in _FLOWS))
def chosen_flows(spark, sf_dir):
    """One kind of institution: by its names in order, else the first name that is like it."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("value").alias("buy"), F.round(F.col("value") / 2, 2).alias("sell"), F.col("event_id").alias("ordinal"))
    out = None
    for label, names, holds, without in _FLOWS:
        one = finance.chosen_flow(e, names, holds, without).select(F.lit(label).alias("kind"), "day", "name", "buy", "sell", "net")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_MONTHLY}, {_ANNUAL} SELECT year, {_PIVOT} FROM annual GROUP BY 1 ORDER BY year DESC LIMIT 5")
def annual_last(spark, sf_dir):
    """The last five years of the wide series: the cap is the feature."""
    return finance.newest_labels(finance.aligned(annual(spark, sf_dir), "year", CODES, "revenue"), "year", 5)


@query(f"""WITH {_MONTHLY}, j AS (SELECT m.revenue, b.revenue AS base, round((m.revenue - b.revenue) * 100.0 / nullif(b.revenue, 0), 2) AS yoy FROM monthly m LEFT JOIN monthly b ON b.code = m.code AND b.year = m.year - 1 AND b.month = m.month)
SELECT greatest(max(greatest(revenue, coalesce(base, 0))), 1.0) AS top, least(min(yoy), 0.0) AS low, greatest(max(yoy), 0.0) AS high FROM j""")
def chart_scale(spark, sf_dir):
    return finance.chart_scale(finance.monthly_yoy(monthly(spark, sf_dir), 1 << 30), ["revenue", "base"], "yoy")


_FIGURE = "CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'NT$' || o_custkey || ',' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '.' || (o_orderkey % 10) WHEN 1 THEN '-' || o_custkey WHEN 2 THEN '+' || o_custkey || ' %' WHEN 3 THEN 'none' WHEN 4 THEN '1.' || o_custkey || '.3' WHEN 5 THEN '' END"


@query(f"""WITH t AS (SELECT o_orderkey, {_FIGURE} AS text FROM orders), d AS (SELECT *, regexp_replace(coalesce(text, ''), '[^0-9.-]', '', 'g') AS digits FROM t)
SELECT o_orderkey, CASE WHEN contains(digits, '.') AND try_cast(digits AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'int' END AS kind, coalesce(try_cast(digits AS DOUBLE), 0.0) AS value FROM d""")
def number_kinds(spark, sf_dir):
    """Figures as text, by order: with a point they are floats, without one integers, and 0 if they are none."""
    text = F.expr(_FIGURE.replace("VARCHAR", "STRING"))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.kind_parsed(text).alias("p")).select("o_orderkey", "p.kind", "p.value")


@query("""WITH x AS (SELECT o_orderkey, o_totalprice AS p, o_totalprice * (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END) AS v, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN round(o_totalprice - 150000, 2) ELSE floor((o_totalprice - 150000) / 100) END AS d FROM orders)
SELECT o_orderkey, CASE WHEN v >= 1e9 THEN printf('%.1fB', round(v / 1e9, 1)) WHEN v >= 1e6 THEN printf('%.0fM', round(v / 1e6, 0)) ELSE printf('%.0fK', round(v / 1e3, 0)) END AS magnitude,
 CASE WHEN v >= 1e8 THEN printf('%.1f億', round(v / 1e8, 1)) WHEN v >= 1e4 THEN printf('%.0f萬', round(v / 1e4, 0)) ELSE CAST(CAST(trunc(v) AS BIGINT) AS VARCHAR) END AS myriads,
 CASE WHEN d IS NULL THEN '—' ELSE CASE WHEN d > 0 THEN '+' ELSE '' END || CASE WHEN abs(d) >= 10000 THEN printf('%.0f萬', round(abs(d) / 10000, 0)) WHEN abs(d) >= 1000 THEN printf('%.1f千', round(abs(d) / 1000, 1)) ELSE CAST(CAST(trunc(abs(d)) AS BIGINT) AS VARCHAR) END END AS net,
 round(p - d, 2) AS day_change, CASE WHEN d > 0 THEN d ELSE p + 1 END AS payout FROM x""")
def number_labels(spark, sf_dir):
    k = F.col("o_orderkey")
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"), (F.col("o_totalprice") * F.when(k % 3 == 0, 1).when(k % 3 == 1, 1000).otherwise(1000000)).alias("v"), F.when(k % 5 != 0, F.when(k % 2 == 0, F.round(F.col("o_totalprice") - 150000, 2)).otherwise(F.floor((F.col("o_totalprice") - 150000) / 100).cast("double"))).alias("d"))
    v, d = F.col("v"), F.col("d")
    return x.select("o_orderkey", N.magnitude(v).alias("magnitude"), N.myriads(v).alias("myriads"), N.signed_thousands(d).alias("net"), N.day_change(d, F.col("p")).alias("day_change"), N.payout_total(d, F.col("p"), F.lit(1.0)).alias("payout"))


@query(f"WITH {FEED} SELECT ordinal, CASE WHEN ordinal % 6 IN (1, 2, 3, 5) THEN pub END AS published, CASE WHEN ordinal % 12 <> 0 THEN pub END AS ts FROM feed")
def feed_dates(spark, sf_dir):
    """Dates in the forms that feeds use, in UTC: the published one alone, and the first of three fields that is one."""
    dates = [F.col(c) for c in ("published", "updated", "created")]
    return feed(spark, sf_dir).select("ordinal", C.first_date(dates[0]).alias("published"), C.first_date(*dates).alias("ts"))


@query(f"""SELECT event_id, coalesce(strftime(ts + INTERVAL 8 HOUR, '%-m/%-d'), '') AS day, CASE WHEN event_id % 10 = 0 THEN 'unknown' WHEN date_trunc('day', ts + INTERVAL 8 HOUR) = date_trunc('day', TIMESTAMP '2024-01-20 12:00:00' + INTERVAL 8 HOUR) THEN strftime(ts + INTERVAL 8 HOUR, '%H:%M') ELSE strftime(ts + INTERVAL 8 HOUR, '%-m/%-d %H:%M') END AS updated,
CASE event_id % 4 WHEN 0 THEN 2024 WHEN 1 THEN 113 + 1912 WHEN 2 THEN 2021 ELSE 0 END AS paid FROM events""")
def day_labels(spark, sf_dir):
    n, ts = F.col("event_id"), F.col("ts")
    day, local = F.when(n % 4 == 0, "2024-05-06").otherwise("n/a"), F.when(n % 4 == 1, "113年").when(n % 4 == 2, "2021").otherwise("none")
    return table(spark, sf_dir, "events").select("event_id", C.short_day(ts).alias("day"), C.updated_label(F.when(n % 10 != 0, ts), C.instant("2024-01-20 12:00:00")).alias("updated"), C.payout_year(day, local).alias("paid"))


@query(f"""WITH {_JOBS}, r AS (SELECT *, status = 'processing' AND owner = 'w1' AND job_id % 3 <> 2 AND job_id % 8 <> 5 AS own FROM jobs)
SELECT job_id, CASE WHEN own THEN 'completed' ELSE status END AS status, CASE WHEN own THEN NULL ELSE owner END AS owner, CASE WHEN own THEN {_AT} END AS completed_at, CASE WHEN NOT own THEN last_error END AS last_error FROM r""")
def job_complete(spark, sf_dir):
    """Only the present owner's jobs that have a result are completed."""
    j = _jobs(spark, sf_dir)
    return worker.complete(j, C.instant(AS_OF), "w1", j.where("job_id % 3 <> 2 AND job_id % 8 <> 5").select("job_id")).select("job_id", "status", "owner", "completed_at", "last_error")


@query(f"WITH {_JOBS} SELECT job_id, priority AS importance, CASE WHEN priority >= 70 THEN 'pending' ELSE 'not_required' END AS review_status FROM jobs WHERE status = 'processing' AND owner = 'w1'")
def job_insights(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    return worker.insights(j, j.select("job_id", F.col("priority").alias("importance")), "w1").select("job_id", "importance", "review_status")


@query(f"""WITH l AS (SELECT n_nationkey AS k, n_name AS name, 'old' || n_nationkey AS owner, CASE WHEN n_nationkey % 4 <> 0 THEN {_AT} + to_minutes(CAST(n_nationkey - 10 AS BIGINT)) END AS until FROM nation WHERE n_nationkey % 5 <> 0),
w AS (SELECT n_name AS name, 'new' || n_nationkey AS token FROM nation WHERE n_nationkey % 3 <> 0), b AS (SELECT coalesce(l.name, w.name) AS name, l.k, l.owner, l.until, w.token, w.token IS NOT NULL AND (l.until IS NULL OR l.until <= {_AT}) AS granted FROM l FULL JOIN w ON l.name = w.name)
SELECT name, granted, CASE WHEN granted THEN token ELSE owner END AS owner, CASE WHEN granted THEN {_AT} + INTERVAL 15 MINUTE ELSE until END AS expires_at FROM b WHERE NOT (k IS NOT NULL AND NOT granted AND k % 2 = 0)""")
def lock_decisions(spark, sf_dir):
    """Locks after requests for them and after releases: who holds the token releases, a lock that was taken over stays."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    at = C.instant(AS_OF)
    locks = n.where("k % 5 <> 0").select("name", F.concat(F.lit("old"), "k").alias("owner"), F.when(F.col("k") % 4 != 0, F.timestamp_add("MINUTE", (F.col("k") - 10).cast("int"), at).cast("timestamp_ntz")).alias("expires_at"))
    wanted = n.where("k % 3 <> 0").select("name", F.concat(F.lit("new"), "k").alias("token"))
    given = n.where("k % 2 = 0").select("name", F.concat(F.lit("old"), "k").alias("token"))
    return worker.released(worker.acquired(locks, wanted, at), given).select("name", "granted", "owner", "expires_at")


_PLAIN = "CASE event_id % 6 WHEN 0 THEN 'not json' WHEN 1 THEN '[1, 2]' ELSE '{\"summary\": \" Text ' || event_id || ' \", \"eventType\": \"' || event_type || '\", \"impact\": \"risk\", \"importanceScore\": ' || (event_id % 300 - 100) || ', \"confidence\": \"' || (event_id % 4) / 2 || '\", \"entities\": [\"a\", \"b\"], \"bullets\": [\"1\", \"2\", \"3\", \"4\", \"5\", \"6\"]}' END"


@query("""SELECT event_id, event_id % 6 > 1 AS valid, CASE WHEN event_id % 6 > 1 THEN 'Text ' || event_id ELSE '' END AS summary, CASE WHEN event_id % 6 > 1 AND event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS event, CASE WHEN event_id % 6 > 1 THEN 'risk' ELSE 'neutral' END AS impact,
CASE WHEN event_id % 6 > 1 THEN greatest(0, least(100, event_id % 300 - 100)) ELSE 0 END AS importance, CASE WHEN event_id % 6 > 1 THEN least(1.0, (event_id % 4) / 2) ELSE 0.0 END AS confidence, CASE WHEN event_id % 6 > 1 THEN 5 ELSE 0 END AS n_bullets FROM events""")
def output_check(spark, sf_dir):
    """Model output as JSON text, some of it in a fence, some of it none."""
    body = F.expr(_PLAIN.replace("(event_id % 4) / 2", "CAST((event_id % 4) / 2 AS STRING)"))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("output"))
    return worker.checked_output(rows, "output", ("click", "view"), ("risk", "opportunity")).select("event_id", "valid", "summary", "event", "impact", "importance", "confidence", F.size("bullets").alias("n_bullets"))


_MODES = {"morning": ("REGION_2", "REGION_0"), "afternoon": ("REGION_1",)}


@query("WITH c AS (SELECT n_name AS label, r_name AS cat FROM nation JOIN region ON n_regionkey = r_regionkey) " + " UNION ALL ".join(f"SELECT '{m}' AS mode, label, list_position([{', '.join(repr(x) for x in cats)}], cat) AS place FROM c WHERE cat IN ({', '.join(repr(x) for x in cats)})" for m, cats in _MODES.items()) + " UNION ALL SELECT 'any', label, 0 FROM c")
def source_modes(spark, sf_dir):
    """The sources of each mode; a mode that isn't listed takes all."""
    r = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("cat"))
    catalogue = table(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("label"), "cat")
    out = None
    for mode in (*_MODES, "any"):
        one = landing.sources(catalogue, _MODES, mode).select(F.lit(mode).alias("mode"), "label", "place")
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) SELECT event_id FROM r WHERE r <= 30")
def first_entries(spark, sf_dir):
    """The first 30 entries of each source: the cap is the feature."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_id").alias("ordinal"))
    return landing.first_entries(e, "user_id", 30).select("event_id")


@query("SELECT c_custkey AS id, 'second' AS origin FROM customer WHERE c_custkey % 2 = 0")
def source_fallback(spark, sf_dir):
    """The first of several sources that has any rows."""
    c = table(spark, sf_dir, "customer")
    rows = lambda where, name: c.where(where).select(F.col("c_custkey").alias("id"), F.lit(name).alias("origin"))
    return landing.by_priority(rows("c_custkey < 0", "first"), rows("c_custkey % 2 = 0", "second"), rows("true", "third"))


@query("SELECT event_id, user_id FROM events WHERE event_id = 17")
def point_lookup(spark, sf_dir):
    """One row by its id: an equality that reaches the scan."""
    return table(spark, sf_dir, "events").where("event_id = 17").select("event_id", "user_id")


_PLAIN_CELL = sql_stripped("regexp_replace(x, '<[^>]+>', '', 'g')")


@query(f"""WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(?:ul|article)\\b.*?</(?:ul|article)\\s*>')) AS r, generate_subscripts(regexp_extract_all(html, '(?is)<(?:ul|article)\\b.*?</(?:ul|article)\\s*>'), 1) - 1 AS row FROM pages)
SELECT page_id, CAST(row AS INT) AS row, array_to_string([{_PLAIN_CELL} for x in regexp_extract_all(r, '(?is)<(?:li|h1)\\b[^>]*>(.*?)</(?:li|h1)\\s*>', 1)], '|') AS cells FROM r""")
def page_rows(spark, sf_dir):
    """Cells by rows in the markup of landed pages, whose bytes are decoded first."""
    pages = table(spark, sf_dir, "pages").select("page_id", landing.decoded(F.encode("html", "UTF-8")).alias("html"))
    return landing.html_cells(pages, "ul|article", "li|h1").select("page_id", "row", F.array_join("cells", "|").alias("cells"))


@query(f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">.*?</a>')) AS x, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">.*?</a>'), 1) - 1 AS place FROM pages)
SELECT page_id, CAST(place AS INT) AS place, regexp_extract(x, 'href="([^"]*)"', 1) AS href, {_PLAIN_CELL} AS text FROM a""")
def page_links(spark, sf_dir):
    return landing.html_links(table(spark, sf_dir, "pages").select("page_id", "html"))


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 6 = 0 THEN 1.0 ELSE c_acctbal END AS balance FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def sink_upsert(spark, sf_dir):
    """Two writes to one table: fields of the second over those of the first, nulls aside; written again, nothing changes."""
    root, c = _folder(spark), table(spark, sf_dir, "customer")
    first = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    second = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit("new").alias("segment"), F.when(F.col("c_custkey") % 2 == 0, 1.0).otherwise(F.col("c_acctbal")).alias("balance"))
    for rows in (first, second, second):
        sinks.upsert(rows, root, "id")
    return sinks.current(spark, root)


@query("SELECT c_mktsegment AS code, CASE WHEN c_mktsegment = 'BUILDING' THEN 'second' ELSE 'first' END AS run, count(*) AS n FROM customer GROUP BY 1, 2")
def sink_snapshot(spark, sf_dir):
    """A second snapshot replaces only the codes that it holds."""
    path, c = f"{_folder(spark)}/s", table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("code"))
    sinks.snapshot(c.withColumn("run", F.lit("first")), path, "code")
    sinks.snapshot(c.where("code = 'BUILDING'").withColumn("run", F.lit("second")), path, "code")
    return spark.read.schema("c_custkey long, run string, code string").parquet(path).groupBy("code", "run").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES (1, true, 5), (2, false, 5)) v(run, wrote, n)")
def sink_if_changed(spark, sf_dir):
    """A table is written only if something changed."""
    path, r = f"{_folder(spark)}/t", table(spark, sf_dir, "region")
    runs = [(1, sinks.write_if_changed(r, r, path)), (2, sinks.write_if_changed(r, r.limit(0), path))]
    n = spark.read.schema(r.schema).parquet(path).agg(F.count("*").cast("int").alias("n"))
    return spark.createDataFrame(runs, "run int, wrote boolean").join(n)


@query("SELECT n_name AS Name, CAST(n_regionkey AS VARCHAR) AS Region FROM nation")
def sink_export(spark, sf_dir):
    """Chosen columns under other names as text, read back."""
    path = f"{_folder(spark)}/csv"
    sinks.export_csv(table(spark, sf_dir, "nation"), path, {"n_name": "Name", "n_regionkey": "Region"})
    return spark.read.schema("Name string, Region string").option("header", True).csv(path)


@query("SELECT * FROM (VALUES (1, true, 5), (2, false, 5)) v(run, ran, n)")
def one_time_fix(spark, sf_dir):
    """A correction behind a marker runs once."""
    base, r = _folder(spark), table(spark, sf_dir, "region")
    runs = [(i, sinks.once(spark, f"{base}/done", lambda: r.write.mode("append").parquet(f"{base}/t"))) for i in (1, 2)]
    n = spark.read.schema(r.schema).parquet(f"{base}/t").agg(F.count("*").cast("int").alias("n"))
    return spark.createDataFrame(runs, "run int, ran boolean").join(n)


@query("""SELECT run, c.name AS collection, CASE WHEN run = 2 THEN 'skipped' WHEN run = 1 AND c.name = 'broken' THEN 'failed' ELSE 'copied' END AS status, c.n AS n_rows FROM (VALUES (1), (2), (3)) r(run),
(SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'customer', count(*) FROM customer) c""")
def gated_copy(spark, sf_dir):
    """A copy, the same resumed, and one under other parameters, which starts afresh."""
    root = _folder(spark)
    tables = [("orders", table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")), ("customer", table(spark, sf_dir, "customer"))]
    out = None
    for run, cutoff in ((1, "2024-01"), (2, "2024-01"), (3, "2024-02")):
        report = copying.copy(spark, tables, root, copying.fingerprint(cutoff=cutoff, tables=[n for n, _ in tables])).select(F.lit(run).alias("run"), "collection", "status", "n_rows")
        out = report if out is None else out.unionByName(report)
    return out


@query("SELECT count(*) FILTER (WHERE n_nationkey % 9 = 0 OR n_nationkey % 10 = 0) AS unknown, count(*) FILTER (WHERE n_nationkey % 7 = 0) AS unclassified, count(*) FILTER (WHERE n_nationkey % 4 = 0 AND n_nationkey % 3 <> 0) AS with_children, count(*) FILTER (WHERE n_nationkey % 3 = 0) AS unverifiable, true AS blocked FROM nation")
def copy_gate(spark, sf_dir):
    """What stands against a copy; what couldn't be checked counts against it."""
    k = F.col("n_nationkey")
    found = table(spark, sf_dir, "nation").select(F.when(k % 9 == 0, "strange").when(k % 10 != 0, "news").alias("collection"), F.when(k % 7 == 0, "unclassified").otherwise("preserve").alias("class"), F.when(k % 3 != 0, F.when(k % 4 == 0, 1).otherwise(0)).alias("children"))
    return copying.gate(found, ("news",))


@query("SELECT * FROM (VALUES ('copy, well', false), ('copy, halted', true), ('same', false), ('changed', true)) v(report, failed)")
def copy_verdicts(spark, sf_dir):
    report = lambda *s: spark.createDataFrame([(f"c{i}", x, 1) for i, x in enumerate(s)], copying.REPORT)
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    verdict = lambda copy: copying.verify_failed(verify.compared(n, copy, "n_nationkey"))
    parts = {"copy, well": copying.copy_failed(report("copied", "skipped")), "copy, halted": copying.copy_failed(report("copied", "halted")), "same": verdict(n), "changed": verdict(n.where("n_nationkey > 0"))}
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("report"), "failed")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'BUILDING' AS asked, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'all', count(*) FROM customer")
def notice_filter(spark, sf_dir):
    """Notices of one code, and of all."""
    c = table(spark, sf_dir, "customer").select("c_mktsegment")
    count = lambda code: jobs.of_code(c, "c_mktsegment", code).agg(F.count("*").alias("n")).select(F.lit(code or "all").alias("asked"), "n")
    return count("BUILDING").unionByName(count(None))


@query("""WITH p AS (SELECT CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS INT) AS page, o_orderkey FROM orders), n AS (SELECT page, count(*) AS n, bool_or(o_orderkey = 4321) AS bad FROM p GROUP BY page), f AS (SELECT max(page) FILTER (bad) AS page FROM n)
SELECT run, n.page, CASE WHEN run = 1 AND n.page = f.page THEN 'failed' WHEN run = 1 AND n.page > f.page THEN 'halted' WHEN run = 2 AND (f.page IS NULL OR n.page < f.page) OR run = 3 THEN 'skipped' ELSE 'copied' END AS status, CASE WHEN run > 1 OR f.page IS NULL OR n.page < f.page THEN n END AS n_rows FROM n, f, (VALUES (1), (2), (3)) r(run)""")
def paged_copy(spark, sf_dir):
    """A copy by pages of 1,000 orders that fails on one page, the same taken up again, and once more when all is done."""
    root, o = _folder(spark), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    broken = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 4321, F.raise_error(F.lit("unreadable"))).otherwise(F.col("o_orderstatus")))
    run, out = copying.fingerprint(table="orders", page=1000), None
    for i, rows in enumerate((broken, o, o), 1):
        report = copying.copy_pages(spark, "orders", rows, root, run, "o_orderkey", 1000).select(F.lit(i).alias("run"), "page", "status", "n_rows")
        out = report if out is None else out.unionByName(report)
    return out
