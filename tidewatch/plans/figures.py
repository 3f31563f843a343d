"""Queries over company figures: growth, pivots, margins, payouts, quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import calendar as C
from tidewatch.functions import numbers as N
from tidewatch.operators import finance
from tidewatch.plans.tables import query, table

CODES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

_MONTHLY = "monthly AS (SELECT c_mktsegment AS code, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"
_ANNUAL = "annual AS (SELECT code, year, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS months FROM monthly GROUP BY 1, 2)"


def monthly(spark, sf_dir):
    money = F.col("o_totalprice").cast("decimal(18,2)")
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("code"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.sum(money).cast("double").alias("revenue"))


def annual(spark, sf_dir):
    return monthly(spark, sf_dir).groupBy("code", "year").agg(F.sum(F.col("revenue").cast("decimal(18,2)")).cast("double").alias("revenue"), F.count("*").alias("months"))


@query(f"""WITH {_MONTHLY}, j AS (SELECT m.*, b.revenue AS base, row_number() OVER (PARTITION BY m.code ORDER BY m.year DESC, m.month DESC) AS r FROM monthly m LEFT JOIN monthly b ON b.code = m.code AND b.year = m.year - 1 AND b.month = m.month)
SELECT code, year, month, revenue, base, round((revenue - base) * 100.0 / nullif(base, 0), 2) AS yoy FROM j WHERE r <= 12""")
def monthly_yoy(spark, sf_dir):
    return finance.monthly_yoy(monthly(spark, sf_dir))


@query(f"""WITH {_MONTHLY}, {_ANNUAL}, j AS (SELECT *, lag(revenue) OVER (PARTITION BY code ORDER BY year) AS base, row_number() OVER (PARTITION BY code ORDER BY year DESC) AS r FROM annual)
SELECT code, year, revenue, months, base, round((revenue - base) * 100.0 / nullif(base, 0), 2) AS yoy, CASE WHEN months < 12 THEN 'partial' ELSE 'full' END AS coverage FROM j WHERE r <= 10""")
def annual_yoy(spark, sf_dir):
    return finance.annual_yoy(annual(spark, sf_dir))


_PIVOT = ", ".join(f"sum(CASE WHEN code = '{c}' THEN revenue END) AS {c}" for c in CODES)


@query(f"WITH {_MONTHLY} SELECT printf('%04d-%02d', year, month) AS label, {_PIVOT} FROM monthly GROUP BY 1")
def monthly_pivot(spark, sf_dir):
    m = monthly(spark, sf_dir).withColumn("label", F.format_string("%04d-%02d", "year", "month"))
    return finance.aligned(m, "label", CODES, "revenue")


@query(f"WITH {_MONTHLY}, {_ANNUAL} SELECT year, {_PIVOT} FROM annual GROUP BY 1")
def annual_pivot(spark, sf_dir):
    return finance.aligned(annual(spark, sf_dir), "year", CODES, "revenue")


@query("""WITH r AS (SELECT o_orderkey, o_totalprice, o_custkey % 10 AS code, CAST(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS DATE) AS period FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY code, period ORDER BY o_orderkey) AS n FROM r) SELECT code, period, o_orderkey AS ordinal, o_totalprice AS value FROM f WHERE n = 1 AND year(period) >= 1995""")
def reported_period_shift(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("code"), C.reported_period(F.col("o_orderdate")).alias("period"), F.col("o_orderkey").alias("ordinal"), F.col("o_totalprice").alias("value"))
    return finance.first_per_period(o, ["code", "period"]).where(F.year("period") >= 1995).select("code", "period", "ordinal", "value")


_METRICS = (("revenue", "l_extendedprice"), ("gross", "l_extendedprice * (1 - l_discount)"), ("operating", "l_extendedprice * (1 - l_discount) * (1 - l_tax)"), ("net", "l_quantity"))


@query("WITH m AS (" + " UNION ALL ".join(f"SELECT l_orderkey, '{k}' AS type, {e} AS value, l_orderkey * 10 + l_linenumber AS ordinal FROM lineitem" for k, e in _METRICS) + """),
w AS (SELECT l_orderkey, """ + ", ".join(f"arg_max(value, row(ordinal, value)) FILTER (WHERE type = '{k}') AS {k}" for k, _ in _METRICS) + """ FROM m GROUP BY 1)
SELECT l_orderkey, revenue, """ + ", ".join(f"CASE WHEN coalesce(revenue, 0) = 0 THEN 0.0 ELSE round(coalesce({k}, 0) * 100 / revenue, 2) END AS {k}_margin" for k in ("gross", "operating", "net")) + " FROM w")
def quarter_margins(spark, sf_dir):
    pairs = ", ".join(f"'{k}', {e}" for k, e in _METRICS)
    m = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_orderkey * 10 + l_linenumber AS ordinal", f"stack({len(_METRICS)}, {pairs}) AS (type, value)")
    return finance.margins(m, "l_orderkey")


@query("""WITH r AS (SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(l_tax * 10 AS DECIMAL(18,2)) AS cash, CAST(l_discount * 10 AS DECIMAL(18,2)) AS stock, strftime(l_shipdate, '%Y-%m-%d') AS day, l_orderkey * 10 + l_linenumber AS ordinal FROM lineitem)
SELECT year, CAST(sum(cash) AS DOUBLE) AS cash, CAST(sum(stock) AS DOUBLE) AS stock, arg_min(day, row(ordinal, day)) AS day, CAST(sum(cash) + sum(stock) AS DOUBLE) AS total FROM r WHERE year >= 1994 GROUP BY 1 HAVING sum(cash) + sum(stock) <> 0""")
def yearly_payouts(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), (F.col("l_tax") * 10).alias("cash"), (F.col("l_discount") * 10).alias("stock"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    done = finance.payouts(r, 1994)
    return done.select("year", *(F.col(c).cast("double").alias(c) for c in ("cash", "stock", "total")), "day")


@query("""WITH e AS (SELECT event_type AS name, strftime(ts, '%Y-%m-%d') AS day, value AS buy, round(value / 2, 2) AS sell, event_id FROM events), d AS (SELECT * FROM e WHERE day = (SELECT max(day) FROM e)),
l AS (SELECT name, arg_max(buy, event_id) AS buy, arg_max(sell, event_id) AS sell FROM d GROUP BY name) SELECT name, buy, sell, round(buy - sell, 2) AS net, CAST(CASE name WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 END AS BIGINT) AS priority FROM l""")
def latest_net_flows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("value").alias("buy"), F.round(F.col("value") / 2, 2).alias("sell"), F.col("event_id").alias("ordinal"))
    return finance.net_flows(e, ["purchase", "click"])


@query("""WITH q AS (SELECT user_id, value AS close, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
p AS (SELECT user_id, max(CASE WHEN r = 1 THEN close END) AS close, max(CASE WHEN r = 2 THEN close END) AS before FROM q WHERE r <= 2 GROUP BY 1),
c AS (SELECT *, coalesce(round(close - before, 2), 0.0) AS change FROM p) SELECT user_id, close, before, change, CASE WHEN coalesce(before, 0) = 0 THEN 0.0 ELSE round(change / before * 100, 2) END AS pct FROM c""")
def last_two_change(spark, sf_dir):
    q = table(spark, sf_dir, "events").select("user_id", "ts", F.col("value").alias("close"), F.col("event_id").alias("ordinal"))
    return finance.last_two(q, "user_id", F.struct("ts", "ordinal"))


@query("""SELECT event_id, l.wd < 5 AND l.m BETWEEN 540 AND 815 AS open, CASE WHEN value < 5 THEN true WHEN NOT (l.wd < 5 AND l.m BETWEEN 540 AND 815) THEN false ELSE (event_id % 60) * 60 > 1800 END AS stale
FROM (SELECT event_id, value, {'wd': isodow(ts + INTERVAL 8 HOUR) - 1, 'm': hour(ts + INTERVAL 8 HOUR) * 60 + minute(ts + INTERVAL 8 HOUR)} AS l FROM events)""")
def quote_staleness(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    updated = F.when(F.col("value") >= 5, F.timestamp_add("MINUTE", (-(F.col("event_id") % 60)).cast("int"), F.col("ts")).cast("timestamp_ntz"))
    return e.select("event_id", C.market_open(F.col("ts")).alias("open"), C.quote_stale(updated, F.col("ts")).alias("stale"))


@query("""WITH n AS (SELECT o_orderkey, o_totalprice, printf('%,d', CAST(floor(o_totalprice) AS BIGINT)) AS text FROM orders)
SELECT o_orderkey, CAST(regexp_replace(text, '[^0-9.-]', '', 'g') AS DOUBLE) AS parsed, CAST(replace(text, ',', '') AS BIGINT) AS grouped, CASE WHEN o_totalprice > 150000 THEN 'up' WHEN o_totalprice < 150000 THEN 'down' ELSE 'flat' END AS direction,
 CASE WHEN o_orderkey % 50 = 0 THEN '-' WHEN o_orderkey % 50 >= 30 THEN 'high' WHEN o_orderkey % 50 >= 15 THEN 'middle' ELSE 'low' END AS band FROM n""")
def number_pack(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.format_number(F.floor("o_totalprice"), 0).alias("text"))
    return o.select("o_orderkey", N.parsed(F.col("text")).alias("parsed"), N.grouped_int(F.col("text")).alias("grouped"), N.direction(F.col("o_totalprice") - 150000).alias("direction"), N.band(F.col("o_orderkey") % 50).alias("band"))
