"""Money as integer cents: parsing, display, penny-exact allocation. All are Column expressions but the last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_cents(amount: Column) -> Column:
    """Dollars (numeric) to cents, halves away from zero."""
    return F.round(amount * 100).cast("long")


def parse_money(text: Column) -> Column:
    """Money text to cents: null, blank, dashes and malformed text are 0; a dash at either end or parentheses negate; halves round up."""
    plain = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    negative = plain.startswith("-") | plain.endswith("-") | (plain.startswith("(") & plain.endswith(")"))
    digits = F.regexp_replace(plain, r"[^0-9.]", "")
    value = digits.try_cast("decimal(26,6)")
    cents = F.round(value * 100, 0).cast("long")
    return F.coalesce(F.when(negative, -cents).otherwise(cents), F.lit(0).cast("long"))


def display(cents: Column) -> Column:
    """Cents as ``$1,234.56``, negative ones as ``-$1,234.56``."""
    amount = F.format_number((F.abs(cents) / 100).cast("decimal(26,2)"), 2)
    return F.concat(F.when(cents < 0, F.lit("-$")).otherwise(F.lit("$")), amount)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0.0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def east_of(total: Column, east: Column, west: Column) -> Column:
    """East's cents of ``total`` for integer weights, by the largest remainder: shares round down, a cent left over goes to the
    larger remainder, east first; zero weights split in halves with the odd cent to east. West is total less east, so the sum holds for negative totals too."""
    weights = (east + west).cast("decimal(38,0)")
    scaled = total.cast("decimal(38,0)") * east.cast("decimal(38,0)")
    rest = F.pmod(scaled, weights)
    low = ((scaled - rest) / weights).cast("long")
    up = (rest * 2 >= weights) & (rest > 0)
    half = F.floor((total + F.pmod(total, F.lit(2))) / 2).cast("long")
    return F.when(weights == 0, half).otherwise(low + up.cast("long"))


def largest_remainder(parts: DataFrame, keys: list[str], total: str, weight: str, order: str, out: str = "part") -> DataFrame:
    """Split ``total`` of each group of ``keys`` over its rows by integer ``weight``: floors first, then one cent each by falling
    remainder (ties by ``order``). Groups of weight 0 split evenly."""
    group = Window.partitionBy(*keys)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    empty = F.sum(wide(weight)).over(group) == 0
    w = F.when(empty, F.lit(1).cast("decimal(38,0)")).otherwise(wide(weight))
    sized = parts.withColumn("_w", w).withColumn("_all", F.sum("_w").over(group)).withColumn("_scaled", wide(total) * F.col("_w"))
    sized = sized.withColumn("_rest", F.pmod("_scaled", "_all")).withColumn("_low", ((F.col("_scaled") - F.col("_rest")) / F.col("_all")).cast("long"))
    left = F.col(total) - F.sum("_low").over(group)
    place = F.row_number().over(group.orderBy(F.desc("_rest"), order))
    return sized.withColumn("_left", left).withColumn("_place", place).withColumn(out, F.col("_low") + (F.col("_place") <= F.col("_left")).cast("long")).drop("_w", "_all", "_scaled", "_rest", "_low", "_left", "_place")
