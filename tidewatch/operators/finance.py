"""Company figures: growth, pivots, margins, payouts, quotes and net flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import numbers as N


def first_per_period(records: DataFrame, keys: list[str]) -> DataFrame:
    """The first record (by ordinal) of each period wins."""
    return records.groupBy(*keys).agg(F.min_by(F.struct(*records.columns), "ordinal").alias("r")).select("r.*")


def monthly_yoy(monthly: DataFrame, last: int = 12) -> DataFrame:
    """Growth against the same month of the year before, by calendar: a missing or zero base gives null. The last months of each code."""
    base = monthly.select("code", (F.col("year") + 1).alias("year"), "month", F.col("revenue").alias("base"))
    joined = monthly.join(base, ["code", "year", "month"], "left").withColumn("yoy", N.growth(F.col("revenue"), F.col("base")))
    newest = Window.partitionBy("code").orderBy(F.desc("year"), F.desc("month"))
    return joined.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= last).drop("r")


def annual_yoy(annual: DataFrame, last: int = 10) -> DataFrame:
    """Growth against the year before that is present, whatever it is; years of less than 12 months are partial."""
    by_year = Window.partitionBy("code").orderBy("year")
    grown = annual.withColumn("base", F.lag("revenue").over(by_year)).withColumn("yoy", N.growth(F.col("revenue"), F.col("base")))
    newest = Window.partitionBy("code").orderBy(F.desc("year"))
    return grown.withColumn("coverage", F.when(F.col("months") < 12, "partial").otherwise("full")).withColumn("r", F.row_number().over(newest)).where(F.col("r") <= last).drop("r")


def aligned(series: DataFrame, label: str, codes: list[str], value: str) -> DataFrame:
    """One column per code, one row per label; a stated list of codes spares a pass over the data."""
    return series.groupBy(label).pivot("code", codes).agg(F.sum(value))


def margins(metrics: DataFrame, key: str) -> DataFrame:
    """Long metrics (key, type, value, ordinal) to one row per key; the last value of a type wins (the larger of two in one place); margins are 0 without revenue."""
    value = lambda name: F.max_by(F.when(F.col("type") == name, F.col("value")), F.when(F.col("type") == name, F.struct("ordinal", "value")))
    wide = metrics.groupBy(key).agg(value("revenue").alias("revenue"), value("gross").alias("gross"), value("operating").alias("operating"), value("net").alias("net"))
    margin = lambda c: F.when(F.coalesce("revenue", F.lit(0.0)) == 0, 0.0).otherwise(F.round(F.coalesce(c, F.lit(0.0)) * 100 / F.col("revenue"), 2))
    return wide.select(key, "revenue", margin("gross").alias("gross_margin"), margin("operating").alias("operating_margin"), margin("net").alias("net_margin"))


def payouts(records: DataFrame, from_year: int) -> DataFrame:
    """Yearly cash, stock and total in decimals; years without any, or before from_year, are dropped; the first day stays."""
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("decimal(18,2)")
    yearly = records.where(F.col("year") >= from_year).groupBy("year").agg(money("cash").alias("cash"), money("stock").alias("stock"), F.min_by("day", F.struct("ordinal", "day")).alias("day"))
    return yearly.withColumn("total", (F.col("cash") + F.col("stock")).cast("decimal(18,2)")).where("total <> 0")


def last_two(quotes: DataFrame, key: str, order: Column) -> DataFrame:
    """Change and percent between the last two closes of each key; a single close has none. One shuffle: the rank's limit cuts groups to two rows on either side of it."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    top = quotes.select(key, "close", newest.alias("r")).where("r <= 2")
    both = top.groupBy(key).agg(F.max(F.when(F.col("r") == 1, F.col("close"))).alias("close"), F.max(F.when(F.col("r") == 2, F.col("close"))).alias("before"))
    change = F.round(F.col("close") - F.col("before"), 2)
    pct = F.when(F.coalesce("before", F.lit(0.0)) == 0, 0.0).otherwise(F.round(F.col("change") / F.col("before") * 100, 2))
    return both.select(key, "close", "before").withColumn("change", F.coalesce(change, F.lit(0.0))).withColumn("pct", pct)


def quotes(rows: DataFrame, key: str, codes: list[str] | None = None) -> DataFrame:
    """First row per key (by ordinal): price, or the close before it where there is none ('-' or empty), its change, the percent from the rounded change, and volume in single units.

    Columns z (price), y (close before) and v (volume in thousands) are text as quoted.
    """
    wanted = rows if codes is None else rows.where(F.col(key).isin(*codes))
    first = wanted.groupBy(key).agg(F.min_by(F.struct("z", "y", "v"), F.col("ordinal")).alias("q"))
    number = lambda c: F.when(F.col(f"q.{c}").isin("", "-"), F.lit(None)).otherwise(F.col(f"q.{c}")).try_cast("double")
    before = F.coalesce(number("y"), F.lit(0.0))
    priced = first.select(key, before.alias("before"), F.coalesce(number("z"), before).alias("price"), F.coalesce(N.grouped_int(F.col("q.v")), F.lit(0).cast("long")).alias("v"))
    change = F.when(F.col("before") != 0, F.round(F.col("price") - F.col("before"), 2)).otherwise(0.0)
    pct = F.when(F.col("before") != 0, F.round(F.col("change") / F.col("before") * 100, 2)).otherwise(0.0)
    return priced.withColumn("change", change).select(key, F.round("price", 2).alias("price"), "change", pct.alias("pct"), (F.col("v") * 1000).alias("volume"))


def quarter_figures(metrics: DataFrame, key: str, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Long metrics (key, type, origin, value, ordinal) to whole figures and margins per key.

    A metric goes by its type and by its origin; the last value under a name wins. Of a figure's aliases the
    first that is neither missing nor 0 counts; figures are cut to whole numbers, margins are 0 without
    revenue. `aliases` has revenue, gross, operating and net.
    """
    names = list(dict.fromkeys(a for group in aliases.values() for a in group))
    named = {a: (F.col("type") == a) | (F.coalesce(F.col("origin"), F.lit("")) == a) for a in names}
    wide = metrics.groupBy(key).agg(*(F.max_by(F.when(hit, F.col("value")), F.when(hit, F.struct("ordinal", "value"))).alias(f"m{i}") for i, hit in enumerate(named.values())))
    at = {a: F.col(f"m{i}") for i, a in enumerate(names)}
    whole = lambda group: F.coalesce(N.nonzero(*(at[a] for a in group)), F.lit(0.0)).cast("long")
    figures = wide.select(key, *(whole(group).alias(name) for name, group in aliases.items()))
    margin = lambda c: F.when(F.col("revenue") == 0, 0.0).otherwise(F.round(F.col(c) / F.col("revenue") * 100, 2))
    return figures.select("*", *(margin(c).alias(f"{c}_margin") for c in ("gross", "operating", "net")))


def chosen_flow(rows: DataFrame, names: list[str], holds: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> DataFrame:
    """Buy, sell and net of one kind of institution on the last day: the first of `names` that is present, else the first name that holds one of `holds` and none of `without`."""
    day = rows.agg(F.max("day").alias("day"))
    last = rows.join(F.broadcast(day), "day").groupBy("name", "day").agg(F.max_by(F.struct("buy", "sell"), "ordinal").alias("r"), F.min("ordinal").alias("first"))
    at = F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col("name")).cast("int"), F.lit(0))
    similar = F.lit(False)
    for part in holds:
        similar = similar | F.contains("name", F.lit(part))
    for part in without:
        similar = similar & ~F.contains("name", F.lit(part))
    ranked = last.withColumn("priority", F.coalesce(at, F.when(similar, len(names) + 1))).where("priority IS NOT NULL")
    best = ranked.agg(F.min_by(F.struct("day", "name", "r"), F.struct("priority", "first")).alias("b")).where("b IS NOT NULL")
    return best.select("b.day", "b.name", "b.r.buy", "b.r.sell", F.round(F.col("b.r.buy") - F.col("b.r.sell"), 2).alias("net"))


def newest_labels(series: DataFrame, label: str, n: int) -> DataFrame:
    """The last n labels of a series that has one row per label."""
    return series.orderBy(F.desc(label)).limit(n)


def chart_scale(series: DataFrame, bars: list[str], line: str) -> DataFrame:
    """One row: the top of the bars, 1 at least, and the span of the line with 0 in it (-10 to 10 without a line)."""
    top = F.greatest(F.max(F.greatest(F.lit(0.0), *(F.coalesce(b, F.lit(0.0)) for b in bars))), F.lit(1.0))
    return series.agg(top.alias("top"), F.coalesce(F.least(F.min(line), F.lit(0.0)), F.lit(0.0)).alias("low0"), F.coalesce(F.greatest(F.max(line), F.lit(0.0)), F.lit(0.0)).alias("high0"), F.count(line).alias("n")).select(
        "top", F.when(F.col("n") == 0, -10.0).otherwise(F.col("low0")).alias("low"), F.when(F.col("n") == 0, 10.0).otherwise(F.col("high0")).alias("high")
    )


def net_flows(rows: DataFrame, priority: list[str]) -> DataFrame:
    """Buy, sell and net of each name on the last day, its last row; names in order of priority first."""
    day = rows.agg(F.max("day").alias("day"))
    last = rows.join(F.broadcast(day), "day").groupBy("name").agg(F.max_by(F.struct("buy", "sell"), "ordinal").alias("r"))
    at = F.array_position(F.array(*map(F.lit, priority)), F.col("name")).cast("long")
    return last.select("name", "r.buy", "r.sell", F.round(F.col("r.buy") - F.col("r.sell"), 2).alias("net"), F.when(at > 0, at).alias("priority"))
