"""Calendar columns for a fixed offset from UTC. Instants are timestamp_ntz in UTC; `as_of` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours by which local time is ahead of UTC; there is no summer time.
OFFSET_HOURS = 8


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def shifted(ts: Column, hours: int) -> Column:
    return ts + F.expr(f"INTERVAL '{hours}' HOUR")


def local_start(ts: Column, unit: str, offset: int = OFFSET_HOURS) -> Column:
    """Start of the local DAY, WEEK (Monday) or MONTH that holds ts, as an instant."""
    return shifted(F.date_trunc(unit, shifted(ts, offset)).cast("timestamp_ntz"), -offset)


def retention_cutoff(ts: Column, offset: int = OFFSET_HOURS) -> Column:
    """Start of the local month before the one that holds ts."""
    first = F.add_months(F.date_trunc("MONTH", shifted(ts, offset)), -1).cast("timestamp_ntz")
    return shifted(first, -offset)


def within_age(ts: Column, as_of: Column, max_days: int = 60) -> Column:
    """Ages count in whole days, so anything younger than max_days + 1 days is kept. Null for a null, which no filter keeps, so that a filter reaches the scan."""
    return ts > as_of - F.expr(f"INTERVAL '{max_days + 1}' DAY")


def market_open(ts: Column, offset: int = OFFSET_HOURS) -> Column:
    """Monday to Friday, 09:00 to 13:35 local, whole minutes."""
    local = shifted(ts, offset)
    minute = F.hour(local) * 60 + F.minute(local)
    return (F.weekday(local) < 5) & minute.between(540, 815)


def quote_stale(updated: Column, as_of: Column, minutes: int = 30) -> Column:
    """No quote is stale; while the market is closed none is; else one older than this."""
    age = F.timestamp_diff("SECOND", updated, as_of)
    return F.when(updated.isNull(), True).when(~market_open(as_of), False).otherwise(age > minutes * 60)


def reported_period(day: Column) -> Column:
    """Figures are reported in the month after their own: first day of the month before, null if there is no date."""
    return F.add_months(F.trunc(day, "MONTH"), -1)


def iso_day(text: Column) -> Column:
    """Day, month and year in order of year first, as yyyy-mm-dd; '' for anything else. Not checked against the calendar.

    Three numbers between dashes, slashes or dots, padded or not, or seven or eight digits. Years below 1911,
    and those of seven digits, count from 1911.
    """
    clean = F.translate(F.trim(F.coalesce(text, F.lit(""))), "-.", "//")
    part = lambda i: F.trim(F.get(F.split(clean, "/"), F.lit(i))).try_cast("int")
    year = F.when(part(0) < 1911, part(0) + 1911).otherwise(part(0))
    split = F.format_string("%d-%02d-%02d", year, part(1), part(2))
    digits = F.regexp_replace(clean, "[^0-9]", "")
    tail = lambda i: F.concat(F.lit("-"), F.substring(digits, i, 2), F.lit("-"), F.substring(digits, i + 2, 2))
    short = F.concat((F.substring(digits, 1, 3).try_cast("int") + 1911).cast("string"), tail(4))
    joined = F.when(F.length(digits) == 7, short).when(F.length(digits) == 8, F.concat(F.substring(digits, 1, 4), tail(5))).otherwise("")
    return F.when(clean.rlike(r"^\s*[0-9]+\s*/\s*[0-9]+\s*/\s*[0-9]+\s*$"), split).when(F.contains(clean, F.lit("/")), "").otherwise(joined)


def payout_year(day: Column, local_year: Column) -> Column:
    """The year that a day starts with; else that of a local year, which counts from 1911 and is paid in the year after."""
    n = F.coalesce(F.regexp_replace(local_year, "[^0-9]", "").try_cast("int"), F.lit(0))
    return F.when(day.rlike("^[0-9]{4}"), F.substring(day, 1, 4).try_cast("int")).when((n > 0) & (n < 1912), n + 1912).otherwise(n)


#: Forms in which feeds write instants, weekday and name of zone aside.
FEED_FORMATS = ("d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm xx")


def feed_instant(text: Column) -> Column:
    """One feed date as an instant in UTC; null if it is none. An ISO form without zone is UTC."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]+,\s*", ""), r"\s*(?:GMT|UTC|UT|Z)$", " +0000")
    named = [F.try_to_timestamp(bare, F.lit(f)) for f in FEED_FORMATS]
    iso = F.when(text.rlike(r"^\s*[0-9]{4}-"), F.trim(text).try_cast("timestamp"))
    zone = F.current_timezone()
    utc = lambda t: F.convert_timezone(zone, F.lit("UTC"), t.cast("timestamp_ntz"))
    plain = F.when(text.rlike(r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9:.]+)?\s*$"), F.trim(text).try_cast("timestamp_ntz"))
    return F.coalesce(plain, *(utc(t) for t in (iso, *named)))


def first_date(*columns: Column) -> Column:
    """The first that is an instant: published, then updated, then created."""
    return F.coalesce(*map(feed_instant, columns))


def short_day(ts: Column, offset: int = OFFSET_HOURS) -> Column:
    """Local month and day without leading zeros; '' if there is none."""
    return F.coalesce(F.date_format(shifted(ts, offset), "M/d"), F.lit(""))


def updated_label(ts: Column, as_of: Column, unknown: str = "unknown", offset: int = OFFSET_HOURS) -> Column:
    """Local time of an update; with its day, unless that is today's."""
    local = shifted(ts, offset)
    same = F.date_trunc("DAY", local) == F.date_trunc("DAY", shifted(as_of, offset))
    return F.when(ts.isNull(), unknown).when(same, F.date_format(local, "HH:mm")).otherwise(F.date_format(local, "M/d HH:mm"))
