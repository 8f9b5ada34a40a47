"""Exact order statistics of decimals, and one text for each value.

Values are counted in units of their last digit, as integers of 38 digits, so nothing is
rounded: a quartile is an exact number of quarters of a unit, and the deviation from a
median one of eighths.  Results are decimals with three more places than the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendersift.functions.robust import running_counts
from tendersift.storage import stored

#: Values have so many digits at most, and so many of them after the point.
DIGITS, PLACES = 28, 8
_INTEGER = "decimal(38,0)"


def units(value: Column, places: int) -> Column:
    """A decimal of up to DIGITS digits as its number of units of 10^-places."""
    if not 0 <= places <= PLACES:
        raise ValueError(f"values have 0 to {PLACES} places")
    return (value.cast(f"decimal({DIGITS},{places})") * F.lit(10**places).cast(f"decimal({places + 1},0)")).cast(_INTEGER)


def of_units(number: Column, places: int) -> Column:
    """The decimal of a number of units."""
    digits = F.lpad(F.abs(number).cast("string"), 38, "0")
    text = F.concat(F.when(number < 0, "-").otherwise(""), F.substring(digits, 1, 38 - places), F.lit("."), F.substring(digits, 39 - places, places))
    return text.cast(f"decimal(38,{places})")


def canonical_text(value: Column) -> Column:
    """The shortest plain notation of a decimal: no exponent, no zeros at its end, no sign of zero; the same text for equal values of any scale."""
    plain = F.format_string("%s", F.when(value == 0, F.lit("0")).otherwise(value.cast("string")))
    short = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    return F.when(value.isNotNull(), short)


def _at(place: Column) -> Column:
    """The value at a place (from 0) of its group."""
    return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("value")))


def _quantile(numerator: int, denominator: int) -> Column:
    """denominator times the type-7 quantile at numerator / denominator, an integer number of units."""
    rest = F.max((F.col("size") - 1) * numerator % denominator)
    low = _at(F.expr(f"(size - 1) * {numerator} div {denominator}"))
    high = F.coalesce(_at(F.expr(f"(size - 1) * {numerator} div {denominator} + 1")), low)
    return (low * denominator + (high - low) * rest).cast(_INTEGER)


def summaries(counts: DataFrame, places: int) -> DataFrame:
    """group, size, least, q1, median, q3, most, iqr and mad of counts(group, value, n), decimals of places + 3 places without rounding.

    The values are decimals without nulls.  Quantiles are of type 7, mad is the median of the
    distances from the median.  No task orders a large group (robust.running_counts).
    """
    whole = stored(counts.select("group", units(F.col("value"), places).alias("value"), F.col("n").cast("bigint").alias("n")), "unit-counts")
    runs = running_counts(whole, ["group"]).groupBy("group")
    found = runs.agg(F.max("size").alias("size"), F.min("value").alias("least"), F.max("value").alias("most"), _quantile(1, 4).alias("q1"), _quantile(2, 4).alias("median"), _quantile(3, 4).alias("q3"))
    found = stored(found, "exact-quartiles")
    away = whole.join(found.select("group", "median"), "group").groupBy("group", F.abs(F.col("value") * 4 - F.col("median")).cast(_INTEGER).alias("value")).agg(F.sum("n").alias("n"))
    spread = running_counts(stored(away, "exact-deviations"), ["group"]).groupBy("group").agg(_quantile(1, 2).alias("mad"))
    thousandths = {"least": 1000, "q1": 250, "median": 250, "q3": 250, "most": 1000, "iqr": 250, "mad": 125}
    rows = found.join(spread, "group").withColumn("iqr", F.col("q3") - F.col("q1"))
    return rows.select("group", "size", *[of_units((F.col(x) * m).cast(_INTEGER), places + 3).alias(x) for x, m in thousandths.items()])


def positions(targets: DataFrame, counts: DataFrame, ident: list[str], places: int) -> DataFrame:
    """ident, peers, less and equal of targets(ident, group, value) among counts(group, value, n), compared as decimals; a value that no member has stands between its neighbours."""
    c = F.col
    asked = targets.select(*ident, "group", units(c("value"), places).alias("value"))
    known = counts.select("group", units(c("value"), places).alias("value"), c("n").cast("bigint").alias("n"))
    every = known.union(asked.select("group", "value", F.lit(0).cast("bigint")).distinct()).groupBy("group", "value").agg(F.sum("n").alias("n"))
    runs = running_counts(stored(every, "unit-counts"), ["group"])
    return asked.join(runs, ["group", "value"]).select(*ident, c("size").alias("peers"), c("before").alias("less"), c("n").alias("equal"))
