"""Phases, schedule summaries and features, matching of activities to divisions, and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.money import safe_ratio
from . import fuzzy
from .schedule import day, days_in, weight, with_progress

#: The order of phases.
ORDER = ("MOBILIZATION", "SITE_PREP", "FOUNDATION", "STRUCTURE", "ENVELOPE", "MEP_ROUGH", "FINISHES", "SITE_FINISHES", "OTHER")
#: Fixed value: least likeness of an activity's text and a division.
LIKE = 60.0


def place_of(phase: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ORDER)), phase).cast("int")


def phase_rollup(activities: DataFrame) -> DataFrame:
    """(phase, place, first_start, last_finish, n_activities, trades) in the fixed order of phases; ``trades`` are the distinct divisions."""
    rolled = activities.groupBy("phase").agg(F.min("start_date").alias("first_start"), F.max("finish_date").alias("last_finish"), F.count(F.lit(1)).alias("n_activities"), F.array_sort(F.collect_set("division")).alias("trades"))
    return rolled.withColumn("place", place_of(F.col("phase")))


def phases_at(activities: DataFrame, at: str) -> DataFrame:
    """One row: how many activities are active on a day, the first of their phases in the fixed order, and all of them."""
    live = activities.where(day(at).between(F.col("start_date"), F.col("finish_date")))
    every = F.array_sort(F.collect_set(F.struct(place_of(F.col("phase")).alias("place"), "phase")))
    return live.agg(F.count(F.lit(1)).alias("n_active"), F.min_by("phase", place_of(F.col("phase"))).alias("current_phase"), F.array_join(F.transform(every, lambda p: p["phase"]), ",").alias("active_phases"))


def with_trade(phases: DataFrame, trade: str) -> DataFrame:
    """The phases in which a trade works."""
    return phases.where(F.array_contains("trades", trade))


def overlaps(phases: DataFrame) -> DataFrame:
    """(phase, next_phase, overlap_days, in_sequence): each phase and the next in the fixed order; a sound sequence overlaps by 20 to 40 days. There are nine phases."""
    one = phases.select("phase", "place", "first_start", "last_finish")
    two = phases.select(F.col("phase").alias("next_phase"), (F.col("place") - 1).alias("place"), F.col("first_start").alias("next_start"), F.col("last_finish").alias("next_finish"))
    days = F.greatest(F.lit(0), F.datediff(F.least("last_finish", "next_finish"), F.greatest("first_start", "next_start")))
    return one.join(two, "place").select("phase", "next_phase", days.alias("overlap_days"), days.between(20, 40).alias("in_sequence"))


def project_summary(activities: DataFrame, at: str) -> DataFrame:
    """(division, n, complete, active, critical, first_start, last_finish, progress): a row for each division, and one with a null division for the project."""
    rows = with_progress(activities, at).withColumn("w", weight())
    return rows.groupingSets([["division"], []], "division").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_complete").alias("complete"), F.count_if("is_active").alias("active"), F.count_if("is_critical").alias("critical"),
        F.min("start_date").alias("first_start"), F.max("finish_date").alias("last_finish"), F.round(safe_ratio(F.sum(F.col("w") * F.col("progress")), F.sum("w")), 6).alias("progress"),
    )


def completion(progress: DataFrame, at: str, most: int = 730) -> DataFrame:
    """``forecast_finish``: the pace so far carried on, at most ``most`` days after the day; without progress, or when done, the planned finish."""
    elapsed = F.datediff(day(at), F.col("first_start"))
    left = F.ceil(elapsed * (1 - F.col("progress")) / F.col("progress"))
    carried = F.date_add(day(at), F.least(F.lit(most), left).cast("int"))
    return progress.withColumn("forecast_finish", F.when((F.col("progress") > 0) & (F.col("progress") < 1) & (elapsed > 0), carried).otherwise(F.col("last_finish")))


def earned_by_progress(allocations: DataFrame, actual: DataFrame, at: str) -> DataFrame:
    """Planned and earned value by division with three forecasts: earned value is the budget times the progress reported (``reported``, 0 to 1), planned value
    the budget times the progress due. Forecasts: budget over CPI; costs and the budget to go; costs and the budget to go over CPI times SPI."""
    rows = with_progress(allocations, at)
    cents = lambda share: F.sum(F.floor(F.col("budget_cents") * share).cast("long"))
    sums = rows.groupBy("division").agg(F.sum("budget_cents").alias("bac"), cents(F.col("progress")).alias("pv"), cents(F.col("reported")).alias("ev"))
    sums = sums.join(actual.select("division", F.col("actual_cents").alias("ac")), "division", "left").na.fill(0, ["ac"])
    out = sums.withColumns({"sv": F.col("ev") - F.col("pv"), "cv": F.col("ev") - F.col("ac"), "cpi": safe_ratio(F.col("ev"), F.col("ac")), "spi": safe_ratio(F.col("ev"), F.col("pv"))})
    togo, pace = F.col("bac") - F.col("ev"), F.col("cpi") * F.col("spi")
    out = out.withColumns({
        "eac_cpi": F.when(F.col("cpi") > 0, F.floor(F.col("bac") / F.col("cpi")).cast("long")).otherwise(F.col("bac")), "eac_budget": F.col("ac") + togo,
        "eac_pace": F.when(pace > 0, F.col("ac") + F.floor(togo / pace).cast("long")).otherwise(F.col("bac")),
    })
    return out.withColumns({"etc": F.greatest(F.lit(0), F.col("eac_cpi") - F.col("ac")), "vac": F.col("bac") - F.col("eac_cpi"), "cpi": F.round("cpi", 6), "spi": F.round("spi", 6)})


def final_cost(expected: DataFrame) -> DataFrame:
    """From (division, budget, spent, expected_to_date, expected_remaining): the cost at completion, the schedule's variance and a status. What remains is divided by CPI, held
    within 0.5 and 2; the plain variant scales the budget by spent over expected."""
    cpi = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.coalesce(F.try_divide(F.col("expected_to_date"), F.col("spent").cast("double")), F.lit(1.0))))
    ratio = F.try_divide(F.col("spent").cast("double"), F.col("expected_to_date"))
    status = F.when(ratio > 1.05, "over").when(ratio < 0.95, "under").otherwise("on_track")
    return expected.select("division", F.round(F.col("spent") - F.col("expected_to_date"), 4).alias("variance"), F.round(F.col("spent") + F.col("expected_remaining") / cpi, 4).alias("fac"), F.round(F.col("budget") * F.coalesce(ratio, F.lit(1.0)), 4).alias("fac_scaled"), status.alias("status"))


def division_of(task: Column, prefixes: dict[str, str], keywords: dict[str, str]) -> Column:
    """struct<division, confidence, method> of a task: a prefix that is a whole code (0.95) or begins the text (0.90), else a keyword that is a word (0.80) or part of one (0.75)."""
    found = lambda name, sure, how: F.struct(F.lit(name).alias("division"), F.lit(sure).alias("confidence"), F.lit(how).alias("method"))
    upper, steps = F.upper(F.trim(task)), []
    steps += [(F.split(upper, r"[-\s]")[0] == p, found(d, 0.95, "prefix")) for p, d in prefixes.items()]
    steps += [(upper.startswith(p), found(d, 0.90, "prefix_partial")) for p, d in prefixes.items()]
    steps += [(upper.rlike(rf"(^|[^A-Z]){k}([^A-Z]|$)"), found(d, 0.80, "keyword")) for k, d in keywords.items()]
    steps += [(upper.contains(k), found(d, 0.75, "keyword_partial")) for k, d in keywords.items()]
    out = found(None, 0.0, "none")
    for test, value in reversed(steps):
        out = F.when(test, value).otherwise(out.cast("struct<division:string,confidence:double,method:string>"))
    return out


def activity_matches(activities: DataFrame, divisions: DataFrame, prefixes: dict[str, str], keywords: dict[str, str]) -> DataFrame:
    """(activity_id, name, division, source, confidence) of each distinct activity. Rules come in their order: the first prefix that its id begins with, else the first keyword in its name, of those rules whose division ``divisions``
    (division, place) lists: as it is (0.95, 0.80), or as part of a listed one's name or the other way round (0.90, 0.75; the first of such). Else the division whose name is most like id and name, from ``LIKE`` on; its score. Letter case never counts."""
    spark = activities.sparkSession
    rules = [(kind, k, key.upper(), name.lower(), sure) for kind, sure, table in (("prefix_match", 0.95, prefixes), ("keyword_match", 0.80, keywords)) for k, (key, name) in enumerate(table.items())]
    rules = spark.createDataFrame(rules, "source string, nth int, key string, target string, sure double")
    low = F.lower("division")
    partial = F.contains(low, F.col("target")) | F.contains(F.col("target"), low)
    resolved = rules.join(divisions.select("division", "place"), partial).withColumn("_same", low == F.col("target"))  # rules and divisions: configured lists
    resolved = resolved.groupBy("source", "nth", "key", "sure").agg(F.max(F.struct("_same", (-F.col("place")).alias("p"), "division")).alias("d"))
    resolved = resolved.select("nth", "source", "key", F.col("d.division").alias("division"), (F.col("sure") - F.when(F.col("d._same"), 0.0).otherwise(0.05)).alias("confidence"))
    sorted_rules = fuzzy.listed(resolved, ["nth", "source", "key", "division", "confidence"]).select(F.sort_array("_l").alias("_l"))

    asked = activities.select("activity_id", "name").distinct().crossJoin(F.broadcast(sorted_rules))  # one row
    code, name = F.upper(F.coalesce("activity_id", F.lit(""))), F.upper(F.coalesce("name", F.lit("")))
    asked = asked.withColumns({"_id": code, "_name": name})
    by_id = F.filter("_l", lambda r: (r["source"] == "prefix_match") & F.startswith(F.col("_id"), r["key"]))
    by_name = F.filter("_l", lambda r: (r["source"] == "keyword_match") & F.contains(F.col("_name"), r["key"]))
    asked = asked.withColumn("_hit", F.coalesce(F.get(by_id, F.lit(0)), F.get(by_name, F.lit(0)))).withColumn("_text", F.when(F.col("_hit").isNull() & (F.trim("_name") != ""), text.for_matching(F.concat_ws(" ", "activity_id", "name"))))
    plain = divisions.select(text.for_matching(F.col("division")).alias("_plain"), "division", "place")
    plain = plain.where(F.col("_plain") != "").groupBy("_plain").agg(F.min("place").alias("place"), F.min_by("division", "place").alias("_division"))
    like = fuzzy.best_match(asked, "_text", plain, "_plain", fuzzy.token_set_ratio, LIKE, "place").join(plain.select("_plain", "_division"), "_plain")
    met = asked.drop("_l").join(like.select("_text", "_division", "score"), "_text", "left")
    return met.select(
        "activity_id", "name", F.coalesce("_hit.division", "_division").alias("division"), F.when(F.col("_hit").isNotNull(), F.col("_hit.source")).when(F.col("_division").isNotNull(), "fuzzy_match").otherwise("none").alias("source"),
        F.round(F.coalesce(F.col("_hit.confidence"), F.col("score") / 100, F.lit(0.0)), 6).alias("confidence"),
    )


def period_features(activities: DataFrame, months: DataFrame) -> DataFrame:
    """(division, month, …): schedule features at the middle of each month: activities that are active, starting, finishing, complete and critical, active days
    in the month, days since the first and to the last peak. Every activity meets only the months it touches; the peak is the start of the busiest month."""
    touched = activities.withColumn("month", F.explode(F.sequence(F.trunc("start_date", "MM"), F.trunc("finish_date", "MM"), F.expr("interval 1 month"))))
    middle = F.date_add(F.col("month"), 15)
    sums = touched.groupBy("division", "month").agg(
        F.count_if(middle.between(F.col("start_date"), F.col("finish_date"))).alias("n_active"), F.count_if(F.trunc("start_date", "MM") == F.col("month")).alias("n_starting"),
        F.count_if(F.trunc("finish_date", "MM") == F.col("month")).alias("n_finishing"), F.count_if(F.col("is_critical")).alias("n_critical"),
        F.sum(days_in(F.col("month"), F.col("start_date"), F.col("finish_date"))).cast("long").alias("active_days"),
    )
    peak = sums.groupBy("division").agg(F.max(F.struct("active_days", (-F.unix_date("month")).alias("early"), "month")).alias("p")).select("division", F.col("p.month").alias("peak"))
    return sums.join(months, "month").join(peak, "division").withColumn("days_to_peak", F.datediff("peak", F.date_add(F.col("month"), 15))).drop("peak")


def predicted(features: DataFrame, weights: dict[str, float], keys: list[str], order: str) -> DataFrame:
    """(keys, predicted): a linear prediction from the newest row of each key, never below 0."""
    newest = features.groupBy(*keys).agg(F.max_by(F.struct(*weights), order).alias("x"))
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.col("x")[name] * w
    return newest.select(*keys, F.greatest(F.lit(0.0), F.round(total, 6)).alias("predicted"))
