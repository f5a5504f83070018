"""Exact quantiles of groups of any size in bounded memory, by histograms that narrow to the wanted ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut

#: Bits that one round settles: a task's partial histogram has at most 2**DIGIT bins for each group and wanted prefix.
DIGIT = 12


def exact(rows: DataFrame, keys: list[str], value: Column, shares: list[float], of: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """(keys, n, quantiles): for each group the quantiles at ``shares``, linear between neighbours, of the integers ``value`` (nulls take no part; they span less than 2**63), each sent
    through the rising function ``of`` first. The values' bits are settled from the top, ``DIGIT`` a round: a histogram of the
    rows that still share a wanted rank's prefix tells the next bits. No group is sorted or held by a task; keys may be null."""
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    own = rows.select(key.alias("key"), value.cast("long").alias("v")).where("v IS NOT NULL")
    low, high = own.agg(F.min("v"), F.max("v")).first()
    if low is None:
        low = high = 0
    own = own.select("key", (F.col("v") - low).alias("u"))
    rounds = max(1, -(-(high - low).bit_length() // DIGIT))
    sizes = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    places = [F.floor((F.col("n") - 1) * s).cast("long") for s in shares]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(p, F.least(p + 1, F.col("n") - 1)) for p in places])))
    sizes = cut(sizes)
    wanted = sizes.select("key", F.explode(ranks).alias("rank")).withColumns({"prefix": F.lit(0).cast("long"), "left": F.col("rank")})
    for k in range(rounds):
        shift = DIGIT * (rounds - 1 - k)
        part = own.withColumn("prefix", F.shiftright("u", shift + DIGIT) if k else F.lit(0).cast("long")).withColumn("next", F.shiftright("u", shift))
        if k:
            part = part.join(wanted.select("key", "prefix").distinct(), ["key", "prefix"], "left_semi")
        bins = part.groupBy("key", "prefix", "next").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("key", "prefix").orderBy("next"))
        bins = bins.withColumn("upto", upto)
        inside = (F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n"))
        wanted = cut(wanted.join(bins, ["key", "prefix"]).where(inside).select("key", "rank", F.col("next").alias("prefix"), (F.col("left") - F.col("upto") + F.col("n")).alias("left")))
    found = wanted.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", of(F.col("prefix") + low).cast("double").alias("v")))).alias("at"))  # two ranks for each share
    rest = [F.pmod((F.col("n") - 1) * F.lit(float(s)), F.lit(1.0)) for s in shares]
    each = [F.col("at")[p] + (F.col("at")[F.least(p + 1, F.col("n") - 1)] - F.col("at")[p]) * r for p, r in zip(places, rest, strict=True)]
    return sizes.join(found, "key").select(*[F.col("key")[c].alias(c) for c in keys], "n", F.array(*each).alias("quantiles"))
