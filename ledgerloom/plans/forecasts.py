"""Queries on forecasts: methods, spreads, periods, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import largest_remainder
from ..operators import forecast
from ..sources import tables
from .costs import AS_OF, WITH
from .base import registered

query, QUERIES, ORACLE_SQL = registered()


def _amounts(spark: SparkSession, sf: str) -> DataFrame:
    bac = tables.budgets(spark, sf).groupBy("budget_code").agg(F.sum("current_budget_cents").alias("bac"), F.sum("committed_cents").alias("ev"))
    ac = tables.costs(spark, sf).groupBy(F.col("cost_code").alias("budget_code")).agg(F.sum("amount_cents").alias("ac"))
    return bac.join(ac, "budget_code", "left").na.fill(0, ["ac"])


AMOUNTS = f"""{WITH}amounts AS (SELECT budget_code, CAST(sum(current_budget_cents) AS BIGINT) AS bac, CAST(sum(committed_cents) AS BIGINT) AS ev, CAST(coalesce(any_value(a), 0) AS BIGINT) AS ac
  FROM budgets LEFT JOIN (SELECT cost_code AS budget_code, sum(amount_cents) AS a FROM costs GROUP BY 1) USING (budget_code) GROUP BY budget_code)"""


@query(f"""{AMOUNTS} SELECT budget_code, CASE WHEN ac = 0 THEN bac ELSE CAST(trunc(bac::DOUBLE / (ev::DOUBLE / ac::DOUBLE)) AS BIGINT) END AS eac,
  CASE WHEN ac = 0 THEN bac ELSE greatest(0, CAST(trunc(bac::DOUBLE / (ev::DOUBLE / ac::DOUBLE)) AS BIGINT) - ac) END AS etc, round(ev::DOUBLE / ac::DOUBLE, 4) AS cpi,
  CASE WHEN ac = 0 THEN 0.5::DOUBLE WHEN ev::DOUBLE / ac BETWEEN 0.9 AND 1.1 THEN 0.85::DOUBLE WHEN ev::DOUBLE / ac BETWEEN 0.8 AND 1.2 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS score FROM amounts WHERE ac > 0 AND ev > 0""")
def forecast_evm(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("double")
    rows = _amounts(spark, sf).where((F.col("ac") > 0) & (F.col("ev") > 0)).withColumn("f", forecast.earned_value(F.col("bac"), F.col("ac"), F.col("ev"), none, F.lit(1.0)))
    return rows.select("budget_code", "f.eac", "f.etc", "f.cpi", "f.score")


@query(f"""{AMOUNTS}, v AS (SELECT budget_code, ac, list_sort([ev, bac, bac * 13 // 10]) AS l FROM amounts), e AS (SELECT *, CAST(trunc((l[1] + 4 * l[2] + l[3]) / 6.0::DOUBLE) AS BIGINT) AS eac, CAST(trunc((l[3] - l[1]) / 6.0::DOUBLE) AS BIGINT) AS sd FROM v)
SELECT budget_code, eac, greatest(0, eac - ac) AS etc, sd, eac - 2 * sd AS low95, eac + 2 * sd AS high95,
  CASE WHEN (l[3] - l[1])::DOUBLE / l[2] < 0.15 THEN 'high' WHEN (l[3] - l[1])::DOUBLE / l[2] < 0.35 THEN 'medium' ELSE 'low' END AS band FROM e""")
def forecast_pert(spark: SparkSession, sf: str) -> DataFrame:
    rows = _amounts(spark, sf).withColumn("f", forecast.three_point(F.expr("bac * 13 div 10"), F.col("bac"), F.col("ev"), F.col("ac")))
    return rows.select("budget_code", "f.eac", "f.etc", "f.sd", "f.low95", "f.high95", "f.band")


@query(f"""{WITH[:-2]} SELECT budget_id, CAST(trunc(CAST(trunc((budget_id % 97) * (current_budget_cents // 30)) AS BIGINT) * 1.15::DOUBLE) AS BIGINT) AS eac, 'High' AS label,
  current_budget_cents - CAST(trunc(CAST(trunc((budget_id % 97) * (current_budget_cents // 30)) AS BIGINT) * 1.15::DOUBLE) AS BIGINT) AS var FROM budgets""")
def forecast_parametric(spark: SparkSession, sf: str) -> DataFrame:
    f = forecast.parametric(F.col("budget_id") % 97, F.expr("current_budget_cents div 30"), F.lit(1.15), F.lit(0), F.col("current_budget_cents"))
    return tables.budgets(spark, sf).withColumn("f", f).select("budget_id", "f.eac", "f.label", "f.var")


START, END, NOW = "1999-09-01", "2000-06-30", "2000-01-05"


def _plans(spark: SparkSession, sf: str) -> DataFrame:
    return tables.budgets(spark, sf).groupBy("division").agg(F.sum("committed_cents").alias("etc_cents"))


def _periods_sql(grain: str, weight: str | None) -> str:
    step = "INTERVAL 7 DAY" if grain == "week" else "INTERVAL 1 MONTH"
    end = "s + INTERVAL 6 DAY" if grain == "week" else "last_day(s)"
    label = "CAST(isoyear(s) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(s) AS VARCHAR), 2, '0')" if grain == "week" else "strftime(s, '%Y-%m')"
    if weight is None:
        part = "etc_cents // n + CASE WHEN i < etc_cents % n THEN 1 ELSE 0 END"
    else:
        part = "CASE WHEN i = n - 1 THEN etc_cents - coalesce(sum(p) OVER (PARTITION BY division, period_type ORDER BY period_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE p END"
    w = weight or "1"
    return f"""{WITH}plans AS (SELECT division, CAST(sum(committed_cents) AS BIGINT) AS etc_cents FROM budgets GROUP BY division),
sp AS (SELECT division, etc_cents, s AS period_start, CAST({end} AS DATE) AS period_end, {label} AS period_label FROM (SELECT *, CAST(unnest(generate_series(date_trunc('{grain}', DATE '{START}'), DATE '{END}', {step})) AS DATE) AS s FROM plans)),
ty AS (SELECT *, CASE WHEN period_end < DATE '{NOW}' THEN 'past' WHEN period_start > DATE '{NOW}' THEN 'future' ELSE 'current' END AS period_type FROM sp),
nu AS (SELECT *, row_number() OVER (PARTITION BY division, period_type ORDER BY period_start) - 1 AS i, count(*) OVER (PARTITION BY division, period_type) AS n FROM ty),
we AS (SELECT *, {w} AS wt FROM nu),
pa AS (SELECT *, CAST(trunc(etc_cents * wt / sum(wt) OVER (PARTITION BY division, period_type ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS BIGINT) AS p FROM we),
fo AS (SELECT *, CAST(CASE WHEN period_type = 'future' THEN {part} ELSE 0 END AS BIGINT) AS forecast_cents FROM pa),
ac AS (SELECT division, CAST(date_trunc('{grain}', date) AS DATE) AS period_start, CAST(sum(amount_cents) AS BIGINT) AS a FROM costs GROUP BY ALL),
bl AS (SELECT fo.*, CASE WHEN period_type <> 'future' THEN coalesce(a, 0) ELSE 0 END AS actual_cents FROM fo LEFT JOIN ac USING (division, period_start))
SELECT division, period_start, period_end, period_label, period_type, actual_cents, forecast_cents, actual_cents + forecast_cents AS blended_cents,
  CAST(sum(actual_cents + forecast_cents) OVER (PARTITION BY division ORDER BY period_start) AS BIGINT) AS cumulative_cents FROM bl"""


COLUMNS = ["division", "period_start", "period_end", "period_label", "period_type", "actual_cents", "forecast_cents", "blended_cents", "cumulative_cents"]


def _periods(spark: SparkSession, sf: str, grain: str, method: str) -> DataFrame:
    return forecast.period_forecast(tables.costs(spark, sf), _plans(spark, sf), "division", START, END, NOW, grain, method).select(*COLUMNS)


@query(_periods_sql("week", None))
def periods_weekly_linear(spark: SparkSession, sf: str) -> DataFrame:
    return _periods(spark, sf, "week", "linear")


@query(_periods_sql("month", "(n - i)::DOUBLE"))
def periods_monthly_front(spark: SparkSession, sf: str) -> DataFrame:
    return _periods(spark, sf, "month", "front_loaded")


@query(_periods_sql("month", "(i + 1)::DOUBLE"))
def periods_monthly_back(spark: SparkSession, sf: str) -> DataFrame:
    return _periods(spark, sf, "month", "back_loaded")


@query()
def periods_weekly_s_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _periods(spark, sf, "week", "s_curve")


@query(f"""{WITH}p AS (SELECT division, budget_code, sum(current_budget_cents)::HUGEINT AS weight FROM budgets GROUP BY ALL), t AS (SELECT division, CAST(sum(amount_cents) AS BIGINT) AS total FROM costs GROUP BY division),
q AS (SELECT division, budget_code, total, weight, sum(weight) OVER (PARTITION BY division) AS al FROM p JOIN t USING (division)),
r AS (SELECT *, ((total * weight) % al + al) % al AS rest FROM q), l AS (SELECT *, (total * weight - rest) // al AS low FROM r)
SELECT division, budget_code, total, CAST(low + CASE WHEN row_number() OVER (PARTITION BY division ORDER BY rest DESC, budget_code) <= total - sum(low) OVER (PARTITION BY division) THEN 1 ELSE 0 END AS BIGINT) AS part FROM l""")
def allocation_largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    parts = tables.budgets(spark, sf).groupBy("division", "budget_code").agg(F.sum("current_budget_cents").alias("weight"))
    total = tables.costs(spark, sf).groupBy("division").agg(F.sum("amount_cents").alias("total"))
    return largest_remainder(parts.join(total, "division"), ["division"], "total", "weight", "budget_code").select("division", "budget_code", "total", "part")


@query(f"""{AMOUNTS} SELECT CAST(sum(bac) AS BIGINT) AS bac_cents, CAST(sum(ac) AS BIGINT) AS ac_cents, CAST(sum(greatest(0, bac - ev)) AS BIGINT) AS etc_cents, CAST(sum(ac) + sum(greatest(0, bac - ev)) AS BIGINT) AS eac_cents,
  CAST(sum(bac) - sum(ac) - sum(greatest(0, bac - ev)) AS BIGINT) AS variance_cents, round(sum(ev)::DOUBLE / sum(ac)::DOUBLE, 6) AS cpi, round(least(100.0, greatest(0.0, sum(ac)::DOUBLE / (sum(ac) + sum(greatest(0, bac - ev)))::DOUBLE * 100)), 6) AS progress_pct FROM amounts""")
def dashboard_kpis(spark: SparkSession, sf: str) -> DataFrame:
    etc = F.greatest(F.lit(0), F.col("bac") - F.col("ev"))
    one = _amounts(spark, sf).agg(F.sum("bac").alias("bac_cents"), F.sum("ac").alias("ac_cents"), F.sum(etc).alias("etc_cents"), F.sum("ev").alias("ev"))
    out = one.withColumn("eac_cents", F.col("ac_cents") + F.col("etc_cents"))
    share = F.try_divide(F.col("ac_cents").cast("double"), F.col("eac_cents").cast("double")) * 100
    return out.select("bac_cents", "ac_cents", "etc_cents", "eac_cents", (F.col("bac_cents") - F.col("eac_cents")).alias("variance_cents"), F.round(F.try_divide(F.col("ev").cast("double"), F.col("ac_cents").cast("double")), 6).alias("cpi"), F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), share)), 6).alias("progress_pct"))


@query(f"""{WITH}s AS (SELECT division, CAST(strftime(date, '%Y') AS INTEGER) AS year, CAST(sum(amount_cents) AS BIGINT) AS eac FROM costs GROUP BY ALL)
SELECT division, year, eac, row_number() OVER (PARTITION BY division ORDER BY year DESC) = 1 AS is_current, eac - lag(eac) OVER (PARTITION BY division ORDER BY year) AS change FROM s""")
def forecast_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = tables.costs(spark, sf).groupBy("division", F.year("date").alias("year")).agg(F.sum("amount_cents").alias("eac"))
    by = Window.partitionBy("division")
    return rows.withColumns({"is_current": F.row_number().over(by.orderBy(F.desc("year"))) == 1, "change": F.col("eac") - F.lag("eac").over(by.orderBy("year"))})


@query(f"""{AMOUNTS}, w AS (SELECT budget_code, bac, CAST(DATE '{AS_OF}' + 7 * i::INTEGER AS DATE) AS week, i FROM amounts, (SELECT unnest(generate_series(0, 51)) AS i))
SELECT budget_code, week, bac * (i + 1) // 52 AS expected_cents, bac * (i + 1) // 52 * 9 // 10 AS low_cents, bac * (i + 1) // 52 * 11 // 10 AS high_cents FROM w""")
def training_curve(spark: SparkSession, sf: str) -> DataFrame:
    rows = _amounts(spark, sf).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(51)))).withColumn("e", F.expr("bac * (i + 1) div 52"))
    return rows.select("budget_code", F.date_add(F.lit(AS_OF).cast("date"), F.col("i") * 7).alias("week"), F.col("e").alias("expected_cents"), F.expr("e * 9 div 10").alias("low_cents"), F.expr("e * 11 div 10").alias("high_cents"))
