"""Schedule analytics: progress, earned value and expected cost of activities, by division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import elapsed
from ..functions.money import safe_ratio
from . import fuzzy


def day(at: str) -> Column:
    return F.lit(at).cast("date")


def with_progress(activities: DataFrame, at: str) -> DataFrame:
    """``progress`` (0 to 1), ``is_complete`` and ``is_active`` at a day; both bounds count."""
    return activities.withColumns({
        "progress": elapsed(F.col("start_date"), F.col("finish_date"), day(at)),
        "is_complete": F.col("finish_date") < day(at),
        "is_active": day(at).between(F.col("start_date"), F.col("finish_date")),
    })


def weight() -> Column:
    """Duration-scaled weight, doubled on the critical path."""
    return F.when(F.col("is_critical"), 2.0).otherwise(1.0) * F.sqrt(F.greatest(F.col("duration_days"), F.lit(1)) / 10.0)


def division_progress(activities: DataFrame, at: str) -> DataFrame:
    rows = with_progress(activities, at).withColumn("w", weight())
    return rows.groupBy("division").agg(
        F.count(F.lit(1)).alias("n_activities"), F.count_if("is_complete").alias("n_complete"), F.count_if("is_active").alias("n_active"), F.count_if("is_critical").alias("n_critical"),
        F.sum(F.col("duration_days").cast("long")).alias("duration_days"), F.min("start_date").alias("first_start"), F.max("finish_date").alias("last_finish"), F.round(safe_ratio(F.sum(F.col("w") * F.col("progress")), F.sum("w")), 6).alias("progress"),
    )


def schedule_forecast(progress: DataFrame, amounts: DataFrame) -> DataFrame:
    """From (division, progress) and (division, bac, ac): cost at completion = costs over progress, at least the costs and at most three budgets; under 1 % progress the larger of budget and costs."""
    met = progress.join(amounts, "division")
    grown = F.least(F.greatest(F.floor(F.try_divide(F.col("ac").cast("double"), F.col("progress"))).cast("long"), F.col("ac")), F.col("bac") * 3)
    eac = F.when(F.col("progress") < 0.01, F.greatest("bac", "ac")).otherwise(F.greatest(grown, F.col("ac")))
    return met.select("division", "bac", "ac", "progress", eac.alias("eac"), (F.col("bac") - eac).alias("variance"))


def allocated(activities: DataFrame, budgets: DataFrame, key: str = "division") -> DataFrame:
    """``expected_cost``: the budget of each key over its activities by duration times weight times intensity."""
    w = F.col("duration_days") * F.col("cost_weight") * F.col("intensity")
    sized = activities.withColumn("_w", w.cast("double")).withColumn("_all", F.sum("_w").over(Window.partitionBy(key)))
    return sized.join(budgets, key).withColumn("expected_cost", F.col("budget") * safe_ratio(F.col("_w"), F.col("_all"))).drop("_w", "_all")


def expected(allocations: DataFrame, at: str, key: str = "division") -> DataFrame:
    """Expected cost to date and to go."""
    rows = with_progress(allocations, at)
    done = F.when(F.col("is_complete"), F.col("expected_cost")).when(F.col("is_active"), F.col("expected_cost") * F.least(F.lit(1.0), F.col("progress"))).otherwise(0.0)
    togo = F.when(F.col("is_complete"), 0.0).when(F.col("is_active"), F.col("expected_cost") * (1 - F.col("progress"))).otherwise(F.col("expected_cost"))
    return rows.groupBy(key).agg(F.sum(done).alias("expected_to_date"), F.sum(togo).alias("expected_remaining"))


def expected_in_period(allocations: DataFrame, first: str, last: str, key: str = "division") -> DataFrame:
    """Expected cost within a period, by days of overlap (both ends count)."""
    overlap = F.datediff(F.least("finish_date", day(last)), F.greatest("start_date", day(first))) + 1
    share = F.least(F.lit(1.0), overlap / F.greatest(F.col("duration_days"), F.lit(1)))
    return allocations.where((F.col("start_date") <= day(last)) & (F.col("finish_date") >= day(first))).groupBy(key).agg(F.sum(F.col("expected_cost") * share).alias("expected_in_period"))


def earned_value(allocations: DataFrame, actual: DataFrame, at: str) -> DataFrame:
    """Planned and earned value, their variances and indices, three forecasts. Earned counts activities that are complete in full and active ones by half (the 50/50 rule)."""
    rows = with_progress(allocations, at)
    pv = F.sum((F.col("budget_cents") * F.col("progress")).cast("long"))
    ev = F.sum(F.when(F.col("is_complete"), F.col("budget_cents")).when(F.col("is_active"), F.expr("budget_cents div 2")).otherwise(0))
    sums = rows.groupBy("division").agg(F.sum("budget_cents").alias("bac"), pv.alias("pv"), ev.alias("ev")).join(actual.select("division", F.col("actual_cents").alias("ac")), "division", "left").na.fill(0, ["ac"])
    cpi, spi = safe_ratio(F.col("ev"), F.col("ac")), safe_ratio(F.col("ev"), F.col("pv"))
    out = sums.withColumns({"sv": F.col("ev") - F.col("pv"), "cv": F.col("ev") - F.col("ac"), "cpi": cpi, "spi": spi})
    by_cpi = F.when(F.col("cpi") > 0, (F.col("bac") / F.col("cpi")).cast("long")).otherwise(F.col("bac"))
    return out.withColumns({"eac_cpi": by_cpi, "eac_remaining": F.col("ac") + F.col("bac") - F.col("ev"), "cpi": F.round("cpi", 6), "spi": F.round("spi", 6)})


def months_of(first: Column, last: Column) -> Column:
    """The first days of the months that a range of days touches."""
    return F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))


def days_in(month: Column, first: Column, last: Column) -> Column:
    """Days of a range, both ends counted, that lie in the month with this first day."""
    return F.datediff(F.least(last, F.last_day(month)), F.greatest(first, month)) + 1


def remaining_by_period(activities: DataFrame, at: str) -> DataFrame:
    """Share of each division's remaining days that fall into each month after a day. A month is one row of an activity, not each of its days."""
    rows = activities.where(F.col("finish_date") > day(at)).withColumn("_from", F.greatest(F.col("start_date"), F.date_add(day(at), 1)))
    parts = rows.select("division", "_from", "finish_date", F.explode(months_of(F.col("_from"), F.col("finish_date"))).alias("m"))
    months = parts.groupBy("division", F.date_format("m", "yyyy-MM").alias("month")).agg(F.sum(days_in(F.col("m"), F.col("_from"), F.col("finish_date"))).cast("long").alias("days"))
    return months.withColumn("share", F.round(F.col("days") / F.sum("days").over(Window.partitionBy("division")), 8))


def prorated(amounts: DataFrame, key: str) -> DataFrame:
    """(key, month, cents): weekly amounts by their days in each month; what rounding leaves goes to the month with most days (the earlier on ties)."""
    end = F.date_add("week_start", 6)
    parts = amounts.withColumn("m", F.explode(months_of(F.col("week_start"), end))).withColumns({"days": days_in(F.col("m"), F.col("week_start"), end), "month": F.date_format("m", "yyyy-MM")})
    parts = parts.groupBy(key, "week_start", "month", "days").agg(F.sum("cents").alias("cents")).withColumn("part", F.expr("cents * days div 7"))
    week = Window.partitionBy(key, "week_start")
    most = F.row_number().over(week.orderBy(F.desc("days"), "month")) == 1
    return parts.withColumns({"_most": most, "_left": F.col("cents") - F.sum("part").over(week)}).withColumn("part", F.col("part") + F.when(F.col("_most"), F.col("_left")).otherwise(0)).groupBy(key, "month").agg(F.sum("part").alias("cents"))


def matched_divisions(activities: DataFrame, divisions: DataFrame, cutoff: float = 50.0) -> DataFrame:
    """Activities with the division (of a small list with the order ``place``) that is most like their name and work breakdown, and the score;
    null and 0 below ``cutoff``. Letter case counts for nothing."""
    asked = F.lower(F.trim(F.concat_ws(" ", "name", "wbs")))
    listed = divisions.select(F.lower("division").alias("_told"), "place", F.col("division").alias("gmp_division"))
    rows = activities.withColumn("_asked", asked)
    best = fuzzy.best_match(rows, "_asked", listed, "_told", fuzzy.token_set_ratio, cutoff, "place").join(listed.drop("place"), "_told")
    return rows.join(best.select("_asked", "gmp_division", F.col("score").alias("match_score")), "_asked", "left").na.fill({"match_score": 0.0}).drop("_asked")
