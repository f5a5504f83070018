"""Cost at completion by method, periods, and how a remainder spreads over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates


def _band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")


def truncated(value: Column) -> Column:
    return value.cast("long")


def earned_value(bac: Column, ac: Column, ev: Column, spi: Column, factor: Column) -> Column:
    """struct<eac, etc, var, cpi, score, band>: without costs the budget; with earned value by CPI (and SPI); else by a performance factor."""
    tracked = F.coalesce(ev > 0, F.lit(False))
    cpi = F.when(tracked, F.try_divide(ev.cast("double"), ac.cast("double"))).otherwise(factor)
    by_spi = ac + truncated(F.try_divide((bac - ev).cast("double"), cpi * spi))
    by_cpi = F.when(cpi > 0, truncated(F.try_divide(bac.cast("double"), cpi))).otherwise(bac)
    by_factor = ac + F.when(factor > 0, truncated(F.try_divide((bac - ac).cast("double"), factor))).otherwise(bac - ac)
    eac = F.when(ac == 0, bac).when(tracked & F.coalesce(spi > 0, F.lit(False)), by_spi).when(tracked, by_cpi).otherwise(by_factor)
    score = F.when(cpi.between(0.9, 1.1), 0.85).when(cpi.between(0.8, 1.2), 0.7).otherwise(0.5) * F.when(tracked, 1.0).otherwise(0.8)
    # without any cost the middle band is given whatever the score
    return F.struct(
        eac.alias("eac"), F.when(ac == 0, bac).otherwise(F.greatest(F.lit(0), eac - ac)).alias("etc"), (bac - eac).alias("var"), F.when(ac != 0, F.round(cpi, 4)).alias("cpi"),
        F.when(ac == 0, 0.5).otherwise(F.round(score, 3)).alias("score"), F.when(ac == 0, "medium").otherwise(_band(score)).alias("band"),
    )


def three_point(low: Column, likely: Column, high: Column, ac: Column) -> Column:
    """PERT: struct<eac, etc, sd, low68, high68, low95, high95, score, band>; the estimates are put in order first."""
    v = F.array_sort(F.array(low, likely, high))
    o, m, p = (F.get(v, F.lit(k)) for k in range(3))
    eac, sd = truncated((o + 4 * m + p) / 6), truncated((p - o) / 6)
    spread = F.when(m > 0, F.try_divide((p - o).cast("double"), m.cast("double"))).otherwise(1.0)
    return F.struct(
        eac.alias("eac"), F.greatest(F.lit(0), eac - ac).alias("etc"), sd.alias("sd"), (eac - sd).alias("low68"), (eac + sd).alias("high68"), (eac - 2 * sd).alias("low95"), (eac + 2 * sd).alias("high95"),
        F.round(F.greatest(F.lit(0.3), F.least(F.lit(0.95), 1 - spread * 0.3)), 3).alias("score"), F.when(spread < 0.15, "high").when(spread < 0.35, "medium").otherwise("low").alias("band"),
    )


def parametric(quantity: Column, rate: Column, complexity: Column, ac: Column, bac: Column) -> Column:
    """Quantity times unit rate times complexity: struct<eac, etc, var, label, score, band>."""
    eac = truncated(truncated(quantity * rate) * complexity)
    off = F.abs(complexity - 1.0)
    label = F.when(complexity <= 0.95, "Low").when(complexity <= 1.05, "Normal").when(complexity <= 1.2, "High").otherwise("Very High")
    return F.struct(
        eac.alias("eac"), F.greatest(F.lit(0), eac - ac).alias("etc"), (bac - eac).alias("var"), label.alias("label"),
        F.round(F.greatest(F.lit(0.5), 0.95 - off * 0.3), 3).alias("score"), F.when(off < 0.1, "high").when(off < 0.25, "medium").otherwise("low").alias("band"),
    )


def manual(eac: Column, ac: Column, bac: Column) -> Column:
    return F.struct(eac.alias("eac"), F.greatest(F.lit(0), eac - ac).alias("etc"), (bac - eac).alias("var"), F.lit(0.9).alias("score"), F.lit("high").alias("band"))


def spine(groups: DataFrame, start: str, end: str, as_of: str, grain: str) -> DataFrame:
    """One row for each group and week or month from ``start`` to ``end``: period_start, period_end, period_type, period_number, label."""
    first = dates.week_start if grain == "week" else dates.month_start
    step = F.expr("interval 7 days" if grain == "week" else "interval 1 month")
    each = groups.withColumn("period_start", F.explode(F.sequence(first(F.lit(start).cast("date")), F.lit(end).cast("date"), step)))
    last = F.date_add("period_start", 6) if grain == "week" else F.last_day("period_start")
    each = each.withColumn("period_end", last)
    day = F.lit(as_of).cast("date")
    kind = F.when(F.col("period_end") < day, "past").when(F.col("period_start") > day, "future").otherwise("current")
    number = (F.datediff("period_start", first(F.lit(start).cast("date"))) / 7 + 1) if grain == "week" else (F.months_between("period_start", first(F.lit(start).cast("date"))) + 1)
    label = dates.iso_label(F.col("period_start")) if grain == "week" else F.date_format("period_start", "yyyy-MM")
    return each.withColumns({"period_type": kind, "period_number": number.cast("int"), "period_label": label})


def curve_weight(method: str, i: Column, n: Column) -> Column:
    """Weight of the i-th (from 0) of n periods."""
    if method == "front_loaded":
        return (n - i).cast("double")
    if method == "back_loaded":
        return (i + 1).cast("double")
    if method == "s_curve":
        x = (i + 0.5) / n
        return F.greatest(F.exp(-((x - 0.4) * (x - 0.4)) / (2 * 0.25 * 0.25)), F.lit(0.1))
    return F.lit(1.0)


def distributed(periods: DataFrame, keys: list[str], etc: str, method: str = "linear") -> DataFrame:
    """``forecast_cents``: ``etc`` over each group's future periods, to the cent; the last future period takes what rounding leaves
    (linear: the first ones take a cent each). Groups without a future period get none."""
    future = F.col("period_type") == "future"
    group = Window.partitionBy(*keys, "period_type")
    order = group.orderBy("period_start")
    sized = periods.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(group)})
    if method == "linear":
        part = F.expr(f"{etc} div _n") + (F.col("_i") < F.pmod(F.col(etc), F.col("_n"))).cast("long")
    else:
        sized = sized.withColumn("_w", curve_weight(method, F.col("_i"), F.col("_n")))
        sized = sized.withColumn("_part", truncated(F.col(etc) * F.col("_w") / F.sum("_w").over(group.orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
        before = F.coalesce(F.sum("_part").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        part = F.when(F.col("_i") == F.col("_n") - 1, F.col(etc) - before).otherwise(F.col("_part"))
    return sized.withColumn("forecast_cents", F.when(future, part).otherwise(0).cast("long")).drop("_i", "_n", "_w", "_part")


def blended(periods: DataFrame, keys: list[str]) -> DataFrame:
    """Actuals up to now, forecasts from now on, and their running total."""
    mixed = F.when(F.col("period_type") == "past", F.col("actual_cents")).when(F.col("period_type") == "current", F.col("actual_cents") + F.col("forecast_cents")).otherwise(F.col("forecast_cents"))
    total = F.sum("blended_cents").over(Window.partitionBy(*keys).orderBy("period_start").rowsBetween(Window.unboundedPreceding, 0))
    return periods.withColumn("blended_cents", mixed).withColumn("cumulative_cents", total)


def period_forecast(costs: DataFrame, plans: DataFrame, key: str, start: str, end: str, as_of: str, grain: str = "week", method: str = "linear") -> DataFrame:
    """Actuals of ``costs`` (key, date, amount_cents) and the spread of ``plans`` (key, etc_cents) by period. Dates map to their period, so no range join is needed.
    Sides of costs (east_cents, west_cents) give ``actual_east_cents`` and ``actual_west_cents``; a ``west_ratio`` of plans parts each period's forecast, whose east side takes the rest."""
    first = dates.week_start if grain == "week" else dates.month_start
    sums = {"actual_cents": "amount_cents"} | {f"actual_{c}": c for c in ("east_cents", "west_cents") if c in costs.columns}
    actual = costs.groupBy(key, first(F.col("date")).alias("period_start")).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    rows = spine(plans, start, end, as_of, grain).join(actual, [key, "period_start"], "left")
    known = {c: F.when(F.col("period_type") != "future", F.coalesce(c, F.lit(0))).otherwise(0).cast("long") for c in sums}
    spread = distributed(rows.withColumns(known), [key], "etc_cents", method)
    if "west_ratio" in plans.columns:
        west = truncated(F.col("forecast_cents") * F.col("west_ratio"))
        spread = spread.withColumns({"forecast_west_cents": west, "forecast_east_cents": F.col("forecast_cents") - west})
    return blended(spread, [key])
