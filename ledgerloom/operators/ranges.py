"""Joins of points to the intervals that hold them, as equi-joins on bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day(date: Column) -> Column:
    return F.unix_date(date).cast("long")


def in_intervals(points: DataFrame, at: Column, intervals: DataFrame, start: Column, finish: Column, keys: list[str] | None = None) -> DataFrame:
    """All pairs of a point and an interval with start <= at <= finish (integers; nulls meet nothing) and equal ``keys``. Intervals may overlap and be of any length:
    one of length n goes into bins of the least power of two above n, so it lies in two of them at most and none is multiplied by its length. A point looks into one bin of
    each width that occurs (64 at most); pairs that share a bin are tested exactly."""
    keys = keys or []
    inner = intervals.withColumns({"_start": start.cast("long"), "_finish": finish.cast("long")}).where("_start <= _finish")
    inner = inner.withColumn("_width", F.length(F.bin(F.col("_finish") - F.col("_start"))))
    widths = [r[0] for r in inner.select("_width").distinct().collect()]  # 64 at most
    if not widths:
        return points.join(intervals.where(F.lit(False)), keys) if keys else points.crossJoin(intervals.where(F.lit(False)))
    shifted = lambda c: F.expr(f"shiftright({c}, _width)")
    inner = inner.withColumn("_bin", F.explode(F.array_distinct(F.array(shifted("_start"), shifted("_finish")))))
    outer = points.withColumn("_at", at.cast("long")).where("_at IS NOT NULL").withColumn("_width", F.explode(F.array(*map(F.lit, sorted(widths)))))
    met = outer.withColumn("_bin", shifted("_at")).join(inner, [*keys, "_width", "_bin"]).where("_at BETWEEN _start AND _finish")
    return met.drop("_at", "_start", "_finish", "_width", "_bin")


def sums_in_intervals(points: DataFrame, at: str, values: list[str], intervals: DataFrame, start: Column, finish: Column) -> DataFrame:
    """``intervals`` that hold at least one date of ``points`` (one row a date; nulls meet nothing), with the sums of the integer ``values`` from start to finish (dates) and ``n_points``. Sums run over the calendar from the first
    date to the last, and an interval takes the difference of two of its days, so no interval meets the days it holds. A sum of nulls alone is null."""
    dated = points.where(F.col(at).isNotNull())
    bounds = dated.agg(F.min(at).alias("_first"), F.max(at).alias("_last"))  # one row
    days = bounds.select(F.explode(F.sequence(F.date_sub("_first", 1), "_last")).alias("_day")).join(dated, F.col("_day") == F.col(at), "left")
    upto = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)  # the calendar: one row a day
    known = {f"_n_{c}": F.count(c).over(upto) for c in values}
    run = days.select("_day", F.count(at).over(upto).alias("_n"), *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"_s_{c}") for c in values], *[v.alias(n) for n, v in known.items()])
    side = lambda s: run.select(*[F.col(c).alias(f"{c}{s}") for c in run.columns])
    kept = intervals.withColumns({"_start": start, "_finish": finish}).crossJoin(F.broadcast(bounds)).where("_start <= _finish AND _start <= _last AND _finish >= _first")
    met = kept.withColumns({"_from": F.date_sub(F.greatest("_start", "_first"), 1), "_to": F.least("_finish", "_last")}).join(side("_a"), F.col("_from") == F.col("_day_a")).join(side("_b"), F.col("_to") == F.col("_day_b"))
    between = lambda c: F.col(f"{c}_b") - F.col(f"{c}_a")
    return met.where(between("_n") > 0).select(*intervals.columns, *[F.when(between(f"_n_{c}") > 0, between(f"_s_{c}")).alias(c) for c in values], between("_n").alias("n_points"))
