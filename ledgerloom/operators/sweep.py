"""Schedule, cost and budget features of every division and month by one sweep over starts and finishes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import safe_ratio
from . import ranges

#: The features look at the schedule on this day of a month, counted from its first; months that a velocity looks back over, and days of each.
MIDDLE, BACK, MONTH_DAYS = 15, 6, 30
#: Expected costs below this are what running sums leave of nothing.
NOISE = 1e-4
#: Types of the lines' constants and slopes, in cents and cents a day.
MONEY, SLOPE = "decimal(28, 10)", "decimal(28, 14)"
COUNTS = ("active", "critical", "complete", "floats")


def as_of(month: Column) -> Column:
    return F.date_add(month, MIDDLE)


def month_seen(day: Column) -> Column:
    """The first month whose middle isn't before ``day``."""
    return F.when(F.dayofmonth(day) <= MIDDLE + 1, F.trunc(day, "MM")).otherwise(F.add_months(F.trunc(day, "MM"), 1))


def events(activities: DataFrame, origin: Column) -> DataFrame:
    """(division, month, deltas): what each activity changes from a month on. Its start adds it to the active ones and begins a line of expected cost; the day after
    its finish takes both away and adds it to the complete ones with its whole cost. Costs are lines a + b * t in days t since ``origin``, so the sums of all lines
    tell the cost at any day, and no activity is repeated for the months it lasts. Both are decimals: what a line adds at its start goes whole at its end, in any order of sums."""
    slope = F.col("expected_cost") / F.greatest(F.datediff("finish_date", "start_date"), F.lit(1))
    at = F.datediff("start_date", origin)
    critical = F.coalesce(F.col("is_critical"), F.lit(False)).cast("long")
    change = lambda day, sign, done: F.struct(
        month_seen(day).alias("month"), F.lit(sign).cast("long").alias("active"), (critical * sign).alias("critical"), F.lit(done).cast("long").alias("complete"), (F.col("float_days").cast("long") * sign).alias("floats"),
        ((-slope * at * sign).cast(MONEY) + (F.col("expected_cost") * done).cast(MONEY)).alias("a"), (slope * sign).cast(SLOPE).alias("b"),
    )
    each = activities.select("division", F.explode(F.array(change(F.col("start_date"), 1, 0), change(F.date_add("finish_date", 1), -1, 1))).alias("e")).select("division", "e.*")
    return each.groupBy("division", "month").agg(*[F.sum(c).alias(c) for c in (*COUNTS, "a", "b")])


def running(rows: DataFrame, keys: list[str], columns: tuple[str, ...]) -> DataFrame:
    upto = Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.sum(c).over(upto) for c in columns})


def least_floats(activities: DataFrame) -> DataFrame:
    """(month, min_float): the least float of any active activity in each month, by a sweep for each float value; rows are months times values."""
    both = F.array(F.struct(month_seen(F.col("start_date")).alias("month"), F.lit(1).alias("n")), F.struct(month_seen(F.date_add("finish_date", 1)).alias("month"), F.lit(-1).alias("n")))
    each = activities.select(F.col("float_days").cast("long").alias("f"), F.explode(both).alias("e")).groupBy("f", "e.month").agg(F.sum("e.n").alias("n"))
    order = Window.partitionBy("f").orderBy("month")
    held = each.withColumns({"n": F.sum("n").over(order), "until": F.add_months(F.lead("month").over(order), -1)}).where("n > 0 AND month <= until")  # nothing is active after the last change
    return held.select("f", F.explode(F.sequence("month", "until", F.expr("interval 1 month"))).alias("month")).groupBy("month").agg(F.min("f").alias("min_float"))


def schedule_features(activities: DataFrame, monthly: DataFrame, budgets: DataFrame, phases: DataFrame) -> DataFrame:
    """One row of features for each (division, month) of ``monthly``, seen in the month's middle, at four levels: project and its phases and activities, the
    division's schedule, its costs, its budget. ``activities`` has division, start_date, finish_date, is_critical, float_days, phase, expected_cost; ``monthly`` division, month,
    cents; ``budgets`` division, budget; ``phases`` phase, place, first_start, last_finish. Divisions without activities have zeros there; months without an active phase
    have phase NONE. Dates are those of whole days; activities without both dates take no part. Sums over the project have one row a month."""
    dated = activities.where("start_date IS NOT NULL AND finish_date IS NOT NULL")
    bounds = dated.agg(F.min("start_date").alias("origin"), F.max("finish_date").alias("finish"), F.count(F.lit(1)).alias("n_all"))  # one row
    changes = events(dated.crossJoin(F.broadcast(bounds.select("origin"))), F.col("origin"))
    own = monthly.select("division", "month", "cents", F.lit(True).alias("told"))
    months = own.select("month").distinct()
    # the project: sums over divisions, swept over the months that occur
    total = changes.groupBy("month").agg(*[F.sum(c).alias(c) for c in COUNTS])
    project = total.join(months.withColumn("told", F.lit(True)), "month", "full").na.fill(0, list(COUNTS))
    project = running(project.withColumn("k", F.lit(0)), ["k"], COUNTS).where("told").drop("told", "k").crossJoin(F.broadcast(bounds))
    t = as_of(F.col("month"))
    days = F.datediff("finish", "origin")
    met = ranges.in_intervals(months.withColumn("t", t), ranges.day(F.col("t")), phases, ranges.day(F.col("first_start")), ranges.day(F.col("last_finish")))
    current = met.groupBy("month").agg(F.count(F.lit(1)).alias("phases_active_count"), F.min_by(F.struct("phase", "first_start", "last_finish"), "place").alias("p"))
    project = project.join(current, "month", "left").join(least_floats(dated), "month", "left")
    project = project.select(
        "month", t.alias("as_of_date"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.datediff(t, "origin") / F.greatest(days, F.lit(1)))).alias("project_pct_complete"),
        F.datediff(t, "origin").alias("project_days_elapsed"), F.greatest(F.lit(0), F.datediff("finish", t)).alias("project_days_remaining"), days.alias("project_total_days"),
        F.coalesce("p.phase", F.lit("NONE")).alias("current_phase"), F.coalesce(F.datediff(t, "p.first_start") / F.greatest(F.datediff("p.last_finish", "p.first_start"), F.lit(1)), F.lit(0.0)).alias("phase_pct_complete"),
        F.coalesce(F.datediff("p.last_finish", t), F.lit(0)).alias("phase_days_remaining"), F.coalesce("phases_active_count", F.lit(0)).alias("phases_active_count"),
        F.col("active").alias("total_active_activities"), F.col("critical").alias("critical_path_activities"), F.col("complete").alias("activities_completed_to_date"), (F.col("n_all") - F.col("complete")).alias("activities_remaining"),
        safe_ratio(F.col("floats"), F.col("active")).alias("avg_float"), F.coalesce("min_float", F.lit(0)).alias("min_float"), "origin",
    )
    # divisions: costs and schedule changes in one sweep
    sums = (*COUNTS, "a", "b", "spent")
    rows = own.withColumn("spent", F.col("cents")).join(changes, ["division", "month"], "full").na.fill(0, list(sums))
    by = Window.partitionBy("division").orderBy("month")
    rows = running(rows, ["division"], sums).where("told").withColumn("mean_cost", F.avg("cents").over(by.rowsBetween(-(BACK - 1), 0)))
    trade = dated.groupBy("division").agg(F.count(F.lit(1)).alias("n"), F.min("start_date").alias("first"), F.max("finish_date").alias("last"), F.sum(F.col("expected_cost").cast(MONEY)).cast("double").alias("whole"), F.collect_set("phase").alias("phases"))  # phases: a configured list
    rows = rows.join(project, "month").join(trade, "division", "left").join(budgets, "division", "left").na.fill(0, ["n", "budget"]).na.fill(0.0, ["whole"])
    at = F.col("as_of_date")
    line = (F.col("a") + F.col("b") * F.datediff(at, "origin")).cast("double")
    rows = rows.withColumn("expected", F.when(F.abs(line) < NOISE, 0.0).otherwise(line))
    rest = F.col("whole") - F.col("expected")
    cpi = F.when(F.col("spent") > 0, F.col("expected") / F.col("spent")).otherwise(1.0)
    rows = rows.withColumn("forecast", F.col("spent") + F.when(F.col("expected") > 0, rest / F.greatest(F.lit(0.5), F.least(F.lit(2.0), cpi))).otherwise(rest))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return rows.select(
        "division", "month", *[c for c in project.columns if c not in ("month", "origin")],
        F.col("active").alias("trade_activities_active"), F.col("complete").alias("trade_activities_complete"), (F.col("n") - F.col("complete")).alias("trade_activities_remaining"),
        F.coalesce(F.array_contains("phases", F.col("current_phase")), F.lit(False)).alias("trade_phase_active"), share(F.col("expected"), F.col("budget")).alias("trade_expected_pct_complete"),
        F.coalesce(F.floor(F.datediff("last", "first") / 2).cast("int") + F.datediff("first", at), F.lit(0)).alias("trade_days_to_peak"), F.greatest(F.lit(0), F.coalesce(F.datediff(at, "first"), F.lit(0))).alias("trade_days_since_start"),
        F.col("spent").alias("trade_actual_cost"), F.col("cents").alias("trade_cost_this_period"), F.col("expected").alias("trade_expected_cost"), (F.col("spent") - F.col("expected")).alias("trade_schedule_variance"),
        share(F.col("spent") - F.col("expected"), F.col("expected")).alias("trade_variance_pct"), (F.col("mean_cost") / MONTH_DAYS).alias("trade_cost_velocity"),
        F.col("budget").alias("trade_gmp_budget"), (F.col("budget") - F.col("spent")).alias("trade_budget_remaining"), share(F.col("spent"), F.col("budget")).alias("trade_actual_pct_spent"),
        F.col("forecast").alias("trade_forecast_at_completion"), (F.col("forecast") - F.col("budget")).alias("trade_budget_variance"),
    )
