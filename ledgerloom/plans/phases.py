"""Queries on phases, schedule summaries, earned value by progress and schedule features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import phases, recon, schedule
from ..sources import tables
from .base import registered
from .costs import ACTUALS, WITH

query, QUERIES, ORACLE_SQL = registered()
AT = "1996-06-15"
NAMES = "['" + "', '".join(phases.ORDER) + "']"
PHASED = f"phased AS (SELECT *, {NAMES}[CAST(1 + activity_id % 9 AS INTEGER)] AS phase, CAST(1 + activity_id % 9 AS INTEGER) AS place FROM activities)"
ROLLED = f"{PHASED}, rolled AS (SELECT phase, place, min(start_date) AS first_start, max(finish_date) AS last_finish, count(*) AS n_activities, array_to_string(list_sort(list(DISTINCT division)), ',') AS trades FROM phased GROUP BY ALL)"


def _phased(spark: SparkSession, sf: str) -> DataFrame:
    return tables.activities(spark, sf).withColumn("phase", F.element_at(F.array(*map(F.lit, phases.ORDER)), (1 + F.col("activity_id") % 9).cast("int")))


@query(f"{WITH}{ROLLED} SELECT * FROM rolled")
def phase_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return phases.phase_rollup(_phased(spark, sf)).withColumn("trades", F.array_join("trades", ","))


@query(f"{WITH}{PHASED}, l AS (SELECT * FROM phased WHERE DATE '{AT}' BETWEEN start_date AND finish_date) SELECT count(*) AS n_active, arg_min(phase, place) AS current_phase, (SELECT string_agg(phase, ',' ORDER BY place) FROM (SELECT DISTINCT phase, place FROM l)) AS active_phases FROM l")
def phases_at(spark: SparkSession, sf: str) -> DataFrame:
    return phases.phases_at(_phased(spark, sf), AT)


@query(f"{WITH}{ROLLED} SELECT phase, n_activities FROM rolled WHERE list_contains(string_split(trades, ','), 'PROMO')")
def phases_with_trade(spark: SparkSession, sf: str) -> DataFrame:
    return phases.with_trade(phases.phase_rollup(_phased(spark, sf)), "PROMO").select("phase", "n_activities")


@query(f"""{WITH}{ROLLED}, p AS (SELECT place, min(first_start) AS first_start, any_value(phase) AS phase, first_start + CAST(100 AS INTEGER) AS last_finish FROM rolled GROUP BY ALL),
q AS (SELECT phase, place, DATE '1995-01-01' + CAST(place * 70 AS INTEGER) AS s, DATE '1995-01-01' + CAST(place * 70 + 60 + place * 8 AS INTEGER) AS f FROM rolled)
SELECT a.phase, b.phase AS next_phase, CAST(greatest(0, least(a.f, b.f) - greatest(a.s, b.s)) AS INTEGER) AS overlap_days, greatest(0, least(a.f, b.f) - greatest(a.s, b.s)) BETWEEN 20 AND 40 AS in_sequence FROM q a JOIN q b ON b.place = a.place + 1""")
def phase_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    rolled = phases.phase_rollup(_phased(spark, sf))
    start = F.date_add(F.lit("1995-01-01").cast("date"), F.col("place") * 70)
    return phases.overlaps(rolled.withColumns({"first_start": start, "last_finish": F.date_add(start, 60 + F.col("place") * 8)}))


DUE = f"""due AS (SELECT *, CASE WHEN DATE '{AT}' < start_date THEN 0.0::DOUBLE WHEN DATE '{AT}' >= finish_date THEN 1.0::DOUBLE ELSE (DATE '{AT}' - start_date)::DOUBLE / greatest(1, duration_days) END AS progress,
  finish_date < DATE '{AT}' AS is_complete, DATE '{AT}' BETWEEN start_date AND finish_date AS is_active, CASE WHEN is_critical THEN 2.0 ELSE 1.0 END * sqrt(greatest(duration_days, 1) / 10.0) AS w FROM activities)"""
SUMMED = f"""{DUE}, summed AS (SELECT division, count(*) AS n, count(*) FILTER (is_complete) AS complete, count(*) FILTER (is_active) AS active, count(*) FILTER (is_critical) AS critical, min(start_date) AS first_start, max(finish_date) AS last_finish,
  round(sum(w * progress) / sum(w), 6) AS progress FROM due GROUP BY GROUPING SETS ((division), ()))"""


@query(f"{WITH}{SUMMED} SELECT * FROM summed")
def project_summary(spark: SparkSession, sf: str) -> DataFrame:
    return phases.project_summary(tables.activities(spark, sf), AT)


@query(f"""{WITH}{SUMMED} SELECT division, progress, CASE WHEN progress > 0 AND progress < 1 AND DATE '{AT}' > first_start
  THEN DATE '{AT}' + CAST(least(730, ceil((DATE '{AT}' - first_start) * (1 - progress) / progress)) AS INTEGER) ELSE last_finish END AS forecast_finish FROM summed""")
def completion_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return phases.completion(phases.project_summary(tables.activities(spark, sf), AT), AT).select("division", "progress", "forecast_finish")


BUDGETED = f"""{DUE}, b AS (SELECT *, 1000 * (1 + activity_id % 50) AS budget_cents, activity_id % 11 / 10.0::DOUBLE AS reported FROM due)"""


@query(f"""{WITH}{ACTUALS}, {BUDGETED}, s AS (SELECT division, CAST(sum(budget_cents) AS BIGINT) AS bac, CAST(sum(CAST(floor(budget_cents * progress) AS BIGINT)) AS BIGINT) AS pv, CAST(sum(CAST(floor(budget_cents * reported) AS BIGINT)) AS BIGINT) AS ev FROM b GROUP BY division),
m AS (SELECT s.*, coalesce(actual_cents // 1000, 0) AS ac FROM s LEFT JOIN actuals USING (division)),
r AS (SELECT *, CASE WHEN ac = 0 THEN 0 ELSE ev::DOUBLE / ac END AS cpi, CASE WHEN pv = 0 THEN 0 ELSE ev::DOUBLE / pv END AS spi FROM m),
e AS (SELECT *, CASE WHEN cpi > 0 THEN CAST(floor(bac / cpi) AS BIGINT) ELSE bac END AS eac_cpi, CASE WHEN cpi * spi > 0 THEN ac + CAST(floor((bac - ev) / (cpi * spi)) AS BIGINT) ELSE bac END AS eac_pace FROM r)
SELECT division, bac, pv, ev, ac, ev - pv AS sv, ev - ac AS cv, round(cpi, 6) AS cpi, round(spi, 6) AS spi, eac_cpi, ac + bac - ev AS eac_budget, eac_pace, greatest(0, eac_cpi - ac) AS etc, bac - eac_cpi AS vac FROM e""")
def earned_value_by_progress(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.activities(spark, sf).withColumns({"budget_cents": 1000 * (1 + F.col("activity_id") % 50), "reported": F.col("activity_id") % 11 / 10.0})
    actual = recon.actuals(tables.costs(spark, sf), tables.breakdown(spark, sf), "2000-01-01").withColumn("actual_cents", F.expr("actual_cents div 1000"))
    return phases.earned_by_progress(rows, actual, AT)


@query(f"""{WITH}{BUDGETED}, x AS (SELECT division, sum(budget_cents) AS budget, sum(CAST(floor(budget_cents * reported) AS BIGINT)) AS spent, sum(budget_cents * progress) AS td, sum(budget_cents * (1 - progress)) AS tr FROM b GROUP BY division),
c AS (SELECT *, greatest(0.5, least(2.0, coalesce(td / nullif(spent::DOUBLE, 0), 1.0))) AS cpi, spent::DOUBLE / nullif(td, 0) AS ratio FROM x)
SELECT division, round(spent - td, 4) AS variance, round(spent + tr / cpi, 4) AS fac, round(budget * coalesce(ratio, 1.0), 4) AS fac_scaled, CASE WHEN ratio > 1.05 THEN 'over' WHEN ratio < 0.95 THEN 'under' ELSE 'on_track' END AS status FROM c""")
def final_cost_by_schedule(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.activities(spark, sf).withColumns({"budget_cents": 1000 * (1 + F.col("activity_id") % 50), "reported": F.col("activity_id") % 11 / 10.0})
    due = schedule.with_progress(rows, AT)
    sums = due.groupBy("division").agg(
        F.sum("budget_cents").alias("budget"), F.sum(F.floor(F.col("budget_cents") * F.col("reported")).cast("long")).alias("spent"), F.sum(F.col("budget_cents") * F.col("progress")).alias("expected_to_date"), F.sum(F.col("budget_cents") * (1 - F.col("progress"))).alias("expected_remaining")
    )
    return phases.final_cost(sums)


PREFIXES, KEYWORDS = {"RED": "Reds", "SM": "Smalls"}, {"BOLT": "Fixings", "RIN": "Rings"}


@query("""WITH n AS (SELECT DISTINCT p_name AS task, upper(trim(p_name)) AS u FROM part)
SELECT task, CASE WHEN string_split_regex(u, '[-\\s]')[1] = 'RED' THEN 'Reds' WHEN string_split_regex(u, '[-\\s]')[1] = 'SM' THEN 'Smalls' WHEN starts_with(u, 'RED') THEN 'Reds' WHEN starts_with(u, 'SM') THEN 'Smalls'
    WHEN regexp_matches(u, '(^|[^A-Z])BOLT([^A-Z]|$)') THEN 'Fixings' WHEN regexp_matches(u, '(^|[^A-Z])RIN([^A-Z]|$)') THEN 'Rings' WHEN contains(u, 'BOLT') THEN 'Fixings' WHEN contains(u, 'RIN') THEN 'Rings' END AS division,
  CASE WHEN string_split_regex(u, '[-\\s]')[1] IN ('RED', 'SM') THEN 0.95::DOUBLE WHEN starts_with(u, 'RED') OR starts_with(u, 'SM') THEN 0.9::DOUBLE
    WHEN regexp_matches(u, '(^|[^A-Z])(BOLT|RIN)([^A-Z]|$)') THEN 0.8::DOUBLE WHEN contains(u, 'BOLT') OR contains(u, 'RIN') THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM n""")
def activity_divisions(spark: SparkSession, sf: str) -> DataFrame:
    names = tables.read(spark, sf, "part").select(F.col("p_name").alias("task")).distinct()
    return names.withColumn("m", phases.division_of(F.col("task"), PREFIXES, KEYWORDS)).select("task", "m.division", "m.confidence")


FEATURES = """spine AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1997-12-01', INTERVAL 1 MONTH)) AS DATE) AS month),
t AS (SELECT *, CAST(unnest(generate_series(date_trunc('month', start_date), date_trunc('month', finish_date), INTERVAL 1 MONTH)) AS DATE) AS month FROM activities),
s AS (SELECT division, month, count(*) FILTER (month + 15 BETWEEN start_date AND finish_date) AS n_active, count(*) FILTER (date_trunc('month', start_date) = month) AS n_starting, count(*) FILTER (date_trunc('month', finish_date) = month) AS n_finishing,
  count(*) FILTER (is_critical) AS n_critical, CAST(sum(least(finish_date, last_day(month)) - greatest(start_date, month) + 1) AS BIGINT) AS active_days FROM t GROUP BY ALL),
p AS (SELECT division, month AS peak FROM s QUALIFY row_number() OVER (PARTITION BY division ORDER BY active_days DESC, month) = 1),
f AS (SELECT s.*, CAST(peak - (month + 15) AS INTEGER) AS days_to_peak FROM s JOIN spine USING (month) JOIN p USING (division))"""


def _features(spark: SparkSession, sf: str) -> DataFrame:
    months = spark.range(1).select(F.explode(F.expr("sequence(DATE '1995-01-01', DATE '1997-12-01', interval 1 month)")).alias("month"))
    return phases.period_features(tables.activities(spark, sf), months)


@query(f"{WITH}{FEATURES} SELECT * FROM f")
def schedule_features(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf)


@query(f"{WITH}{FEATURES}, n AS (SELECT * FROM f QUALIFY month = max(month) OVER (PARTITION BY division)) SELECT division, greatest(0.0, round(n_active * 2.5::DOUBLE + active_days * -0.1::DOUBLE + n_critical * 1.0::DOUBLE, 6)) AS predicted FROM n")
def schedule_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return phases.predicted(_features(spark, sf), {"n_active": 2.5, "active_days": -0.1, "n_critical": 1.0}, ["division"], "month")
