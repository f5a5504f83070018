"""Queries on the schedule: progress, earned value, expected cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import schedule
from ..sources import tables
from .costs import WITH
from .base import registered

query, QUERIES, ORACLE_SQL = registered()
AT = "1998-07-01"


PROGRESS = f"""prog AS (SELECT *, CASE WHEN DATE '{AT}' < start_date THEN 0.0::DOUBLE WHEN DATE '{AT}' >= finish_date THEN 1.0::DOUBLE ELSE (DATE '{AT}' - start_date)::DOUBLE / duration_days END AS progress,
  finish_date < DATE '{AT}' AS is_complete, DATE '{AT}' BETWEEN start_date AND finish_date AS is_active,
  CASE WHEN is_critical THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * sqrt(greatest(duration_days, 1) / 10.0::DOUBLE) AS w FROM activities)"""


@query(f"""{WITH}{PROGRESS} SELECT division, count(*) AS n_activities, count(*) FILTER (is_complete) AS n_complete, count(*) FILTER (is_active) AS n_active, count(*) FILTER (is_critical) AS n_critical,
  CAST(sum(duration_days) AS BIGINT) AS duration_days, min(start_date) AS first_start, max(finish_date) AS last_finish, round(sum(w * progress) / sum(w), 6) AS progress FROM prog GROUP BY division""")
def schedule_progress(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.division_progress(tables.activities(spark, sf), AT)


def _progress_amounts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    progress = schedule.with_progress(tables.activities(spark, sf), AT).groupBy("division").agg((F.floor(F.avg("progress") * 1000) / 1000).alias("progress"))
    ac = tables.costs(spark, sf).groupBy("division").agg(F.sum("amount_cents").alias("ac"))
    return progress, tables.budgets(spark, sf).groupBy("division").agg(F.sum("current_budget_cents").alias("bac")).join(ac, "division")


@query(f"""{WITH}{PROGRESS}, p AS (SELECT division, floor(avg(progress) * 1000) / 1000 AS progress FROM prog GROUP BY division), a AS (SELECT division, CAST(sum(amount_cents) AS BIGINT) AS ac FROM costs GROUP BY division),
b AS (SELECT division, CAST(sum(current_budget_cents) AS BIGINT) AS bac FROM budgets GROUP BY division),
e AS (SELECT division, bac, ac, progress, CASE WHEN progress < 0.01 THEN greatest(bac, ac) ELSE greatest(least(greatest(CAST(floor(ac::DOUBLE / progress) AS BIGINT), ac), bac * 3), ac) END AS eac FROM p JOIN a USING (division) JOIN b USING (division))
SELECT *, bac - eac AS variance FROM e""")
def schedule_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.schedule_forecast(*_progress_amounts(spark, sf))


def _budgeted(spark: SparkSession, sf: str) -> DataFrame:
    return tables.activities(spark, sf).withColumn("budget_cents", F.col("duration_days").cast("long") * 10000 + 5000)


@query(f"""{WITH}{PROGRESS}, b AS (SELECT *, duration_days::BIGINT * 10000 + 5000 AS budget_cents FROM prog), a AS (SELECT division, CAST(sum(amount_cents) AS BIGINT) AS actual_cents FROM costs GROUP BY division),
s AS (SELECT division, CAST(sum(budget_cents) AS BIGINT) AS bac, CAST(sum(CAST(trunc(budget_cents * progress) AS BIGINT)) AS BIGINT) AS pv, CAST(sum(CASE WHEN is_complete THEN budget_cents WHEN is_active THEN budget_cents // 2 ELSE 0 END) AS BIGINT) AS ev FROM b GROUP BY division),
t AS (SELECT s.*, coalesce(actual_cents, 0) AS ac FROM s LEFT JOIN a USING (division)),
i AS (SELECT *, CASE WHEN ac = 0 THEN 0.0::DOUBLE ELSE ev::DOUBLE / ac END AS c, CASE WHEN pv = 0 THEN 0.0::DOUBLE ELSE ev::DOUBLE / pv END AS s FROM t)
SELECT division, bac, pv, ev, ac, ev - pv AS sv, ev - ac AS cv, round(c, 6) AS cpi, round(s, 6) AS spi, CASE WHEN c > 0 THEN CAST(trunc(bac / c) AS BIGINT) ELSE bac END AS eac_cpi, ac + bac - ev AS eac_remaining FROM i""")
def schedule_earned_value(spark: SparkSession, sf: str) -> DataFrame:
    actual = tables.costs(spark, sf).groupBy("division").agg(F.sum("amount_cents").alias("actual_cents"))
    return schedule.earned_value(_budgeted(spark, sf), actual, AT)


def _allocated(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.activities(spark, sf).withColumns({"cost_weight": F.lit(1.0), "intensity": F.when(F.col("is_critical"), 1.5).otherwise(1.0)})
    budget = tables.budgets(spark, sf).groupBy("division").agg(F.sum("current_budget_cents").cast("double").alias("budget"))
    return schedule.allocated(rows, budget)


ALLOCATED = f"""{WITH}{PROGRESS}, bud AS (SELECT division, sum(current_budget_cents)::DOUBLE AS budget FROM budgets GROUP BY division),
al AS (SELECT *, budget * (duration_days * CASE WHEN is_critical THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) / sum(duration_days * CASE WHEN is_critical THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) OVER (PARTITION BY division) AS expected_cost FROM prog JOIN bud USING (division))"""


@query(f"""{ALLOCATED} SELECT division, CAST(round(sum(CASE WHEN is_complete THEN expected_cost WHEN is_active THEN expected_cost * progress ELSE 0 END) / 1000) AS BIGINT) AS expected_to_date,
  CAST(round(sum(CASE WHEN is_complete THEN 0 WHEN is_active THEN expected_cost * (1 - progress) ELSE expected_cost END) / 1000) AS BIGINT) AS expected_remaining FROM al GROUP BY division""")
def expected_cost(spark: SparkSession, sf: str) -> DataFrame:
    sums = schedule.expected(_allocated(spark, sf), AT)
    return sums.select("division", *[F.round(F.col(c) / 1000).cast("long").alias(c) for c in ("expected_to_date", "expected_remaining")])


@query(f"""{ALLOCATED} SELECT division, CAST(round(sum(expected_cost * least(1.0::DOUBLE, (least(finish_date, DATE '1998-07-31') - greatest(start_date, DATE '1998-07-01') + 1) / greatest(duration_days, 1)::DOUBLE)) / 1000) AS BIGINT) AS expected_in_period
FROM al WHERE start_date <= DATE '1998-07-31' AND finish_date >= DATE '1998-07-01' GROUP BY division""")
def expected_cost_in_period(spark: SparkSession, sf: str) -> DataFrame:
    sums = schedule.expected_in_period(_allocated(spark, sf), "1998-07-01", "1998-07-31")
    return sums.select("division", F.round(F.col("expected_in_period") / 1000).cast("long").alias("expected_in_period"))


@query(f"""{WITH}d AS (SELECT division, unnest(generate_series(greatest(start_date, DATE '{AT}' + 1), finish_date, INTERVAL 1 DAY)) AS d FROM activities WHERE finish_date > DATE '{AT}'),
m AS (SELECT division, strftime(d, '%Y-%m') AS month, count(*) AS days FROM d GROUP BY ALL) SELECT *, round(days::DOUBLE / sum(days) OVER (PARTITION BY division)::DOUBLE, 8) AS share FROM m""")
def remaining_work_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.remaining_by_period(tables.activities(spark, sf), AT)


@query(f"""{WITH}w AS (SELECT division, CAST(date_trunc('week', date) AS DATE) AS week_start, CAST(sum(abs(amount_cents)) AS BIGINT) AS cents FROM costs GROUP BY ALL),
d AS (SELECT *, unnest(generate_series(week_start, week_start + 6, INTERVAL 1 DAY)) AS d FROM w), p AS (SELECT division, week_start, cents, strftime(d, '%Y-%m') AS month, count(*) AS days FROM d GROUP BY ALL),
q AS (SELECT *, cents * days // 7 AS part, row_number() OVER (PARTITION BY division, week_start ORDER BY days DESC, month) = 1 AS most FROM p),
r AS (SELECT *, part + CASE WHEN most THEN cents - sum(part) OVER (PARTITION BY division, week_start) ELSE 0 END AS given FROM q) SELECT division, month, CAST(sum(given) AS BIGINT) AS cents FROM r GROUP BY ALL""")
def weeks_prorated_to_months(spark: SparkSession, sf: str) -> DataFrame:
    weeks = tables.costs(spark, sf).groupBy("division", dates.week_start(F.col("date")).alias("week_start")).agg(F.sum(F.abs("amount_cents")).alias("cents"))
    return schedule.prorated(weeks, "division")


@query(f"""{WITH[:-2]} SELECT division, count(*) AS n, count(*) FILTER (start_date <= DATE '1998-12-31' AND finish_date >= DATE '1998-01-01') AS overlapping, count(*) FILTER (is_critical AND DATE '{AT}' BETWEEN start_date AND finish_date) AS critical_active FROM activities GROUP BY division""")
def activity_filters(spark: SparkSession, sf: str) -> DataFrame:
    day = schedule.day
    overlap = (F.col("start_date") <= day("1998-12-31")) & (F.col("finish_date") >= day("1998-01-01"))
    return tables.activities(spark, sf).groupBy("division").agg(F.count(F.lit(1)).alias("n"), F.count_if(overlap).alias("overlapping"), F.count_if(F.col("is_critical") & day(AT).between(F.col("start_date"), F.col("finish_date"))).alias("critical_active"))
