"""Number columns: tolerant parsing, rounding rules, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """What is left without anything but digits, signs and points; 0 if that is no number."""
    return F.coalesce(F.regexp_replace(text, "[^0-9.-]", "").try_cast("double"), F.lit(0.0))


def grouped_int(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("long")


def nonzero(*values: Column) -> Column:
    """The first that is neither null nor 0."""
    return F.coalesce(*(F.nullif(v, F.lit(0).cast("double")) for v in values))


def share(part: Column, whole: Column) -> Column:
    """Whole percent, halves up; an empty whole counts as 1."""
    return F.floor(100.0 * part / F.greatest(whole, F.lit(1)) + 0.5).cast("long")


def growth(now: Column, before: Column) -> Column:
    """Percent, two places; null without a base."""
    return F.round((now - before) * 100.0 / F.nullif(before, F.lit(0).cast("double")), 2)


def kind_parsed(text: Column) -> Column:
    """As `parsed`, with what kind of number it is: a point makes a float, anything else an integer."""
    left = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9.-]", "")
    return F.struct(F.when(F.contains(left, F.lit(".")) & left.try_cast("double").isNotNull(), "float").otherwise("int").alias("kind"), parsed(text).alias("value"))


def magnitude(x: Column, steps: tuple[tuple[float, int, str], ...] = ((1e9, 1, "B"), (1e6, 0, "M"), (0.0, 0, "K")), base: float = 1e3) -> Column:
    """A number in the first unit (least value, places, sign) that it reaches; the last unit, of least 0, counts in `base`. Halves go up."""
    out = None
    for least, places, sign in reversed(steps):
        shown = F.format_string(f"%.{places}f%s", F.round(x / (least or base), places), F.lit(sign))
        out = shown if out is None else F.when(x >= least, shown).otherwise(out)
    return out


def myriads(x: Column) -> Column:
    """In units of 10^8 and 10^4, whole below."""
    return F.when(x >= 1e8, F.format_string("%.1f億", F.round(x / 1e8, 1))).when(x >= 1e4, F.format_string("%.0f萬", F.round(x / 1e4, 0))).otherwise(x.cast("long").cast("string"))


def signed_thousands(x: Column) -> Column:
    """Of the absolute value, in units of 10^4 and 10^3; a plus before what is positive, a dash for nothing."""
    n = F.abs(x)
    shown = F.when(n >= 10000, F.format_string("%.0f萬", F.round(n / 10000, 0))).when(n >= 1000, F.format_string("%.1f千", F.round(n / 1000, 1))).otherwise(n.cast("long").cast("string"))
    return F.when(x.isNull(), "—").otherwise(F.concat(F.when(x > 0, "+").otherwise(""), shown))


def day_change(opened: Column, closed: Column) -> Column:
    """Close less open in two places; null if either is missing."""
    return F.round(closed - opened, 2)


def payout_total(total: Column, cash: Column, stock: Column) -> Column:
    """The stated total where it is positive, else what it consists of."""
    return F.when(total > 0, total).otherwise(cash + stock)


def direction(x: Column) -> Column:
    return F.when(x > 0, "up").when(x < 0, "down").otherwise("flat")


def band(x: Column, high: float = 30, middle: float = 15) -> Column:
    """high, middle or low; a dash for nothing or 0."""
    return F.when(x.isNull() | (x == 0), "-").when(x >= high, "high").when(x >= middle, "middle").otherwise("low")
