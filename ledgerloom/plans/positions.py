"""Queries on forecasts in all ways, tie-outs by row, periods by side, and the project's figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forecast, kpis, recon
from ..sources import tables
from ..sources.tables import east_sql
from .base import registered
from .controls import ORACLE_SQL as CONTROLS
from .controls import change_order_ceilings
from .costs import AS_OF, WITH
from .forecasts import END, NOW, START, _periods_sql, _plans

query, QUERIES, ORACLE_SQL = registered()
EARLY = "1992-06-30"


def _ways_sql(day: str) -> str:
    return f"""SELECT DATE '{day}' AS day, division, sov_cents AS gmp_cents, coalesce(ae, 0) AS ae, coalesce(aw, 0) AS aw, coalesce(ce, 0) AS ce, coalesce(committed - ce, 0) AS cw, coalesce(pe, 0) AS pe, coalesce(pw, 0) AS pw
FROM breakdown LEFT JOIN (SELECT *, a - ae AS aw FROM (SELECT division, a, {east_sql('a', 'coalesce(east_funded_cents, 0)', 'coalesce(west_funded_cents, 0)')} AS ae
  FROM (SELECT division, CAST(sum(amount_cents) AS BIGINT) AS a FROM costs WHERE date <= DATE '{day}' AND division <> 'PROMO' GROUP BY 1) LEFT JOIN breakdown USING (division))) USING (division) LEFT JOIN com USING (division) LEFT JOIN pred USING (division)"""


@query(f"""{WITH}pred AS (SELECT division, CAST(greatest(0, coalesce(sum(amount_cents) FILTER (zone = 'EAST'), 0)) AS BIGINT) AS pe, CAST(greatest(0, coalesce(sum(amount_cents) FILTER (zone = 'WEST'), 0)) AS BIGINT) AS pw
  FROM costs WHERE date BETWEEN DATE '{AS_OF}' - 28 AND DATE '{AS_OF}' AND division > 'F' AND division <> 'PROMO' GROUP BY 1),
com AS (SELECT division, committed, {east_sql('committed', 'coalesce(east_funded_cents, 0)', 'coalesce(west_funded_cents, 0)')} AS ce FROM (SELECT division, CAST(sum(committed_cents) AS BIGINT) AS committed FROM budgets GROUP BY 1) LEFT JOIN breakdown USING (division)),
base AS ({_ways_sql(EARLY)} UNION ALL {_ways_sql(AS_OF)}),
w AS (SELECT *, greatest(0, ce - ae) AS le, greatest(0, cw - aw) AS lw, unnest(['actuals_only', 'model', 'commitments', 'max']) AS way FROM base),
e AS (SELECT *, CASE way WHEN 'commitments' THEN ae + le WHEN 'max' THEN CASE WHEN ae > 0 OR pe > 0 THEN greatest(ae + pe, ae + le) ELSE ae + pe END ELSE ae + pe END AS ee,
  CASE way WHEN 'commitments' THEN aw + lw WHEN 'max' THEN CASE WHEN aw > 0 OR pw > 0 THEN greatest(aw + pw, aw + lw) ELSE aw + pw END ELSE aw + pw END AS ew FROM w)
SELECT day, division, gmp_cents, le AS left_east_cents, lw AS left_west_cents, way, ee AS eac_east_cents, ew AS eac_west_cents, ee + ew AS eac_total_cents, gmp_cents - ee - ew AS surplus_cents FROM e""")
def recon_ways(spark: SparkSession, sf: str) -> DataFrame:
    """All ways to forecast on two days, one early, when most of what is committed isn't spent. Predictions are what the last four weeks cost, by side; one division has none, and one neither costs nor predictions."""
    costs = tables.cost_rows(spark, sf).withColumn("excluded", F.col("division") == "PROMO")
    last = costs.where((F.col("date") <= F.lit(AS_OF).cast("date")) & (F.col("date") >= F.date_sub(F.lit(AS_OF).cast("date"), 28)) & (F.col("division") > "F") & ~F.col("excluded"))
    side = lambda z: F.greatest(F.lit(0), F.coalesce(F.sum(F.when(F.col("zone") == z, F.col("amount_cents"))), F.lit(0)))
    predictions = last.groupBy("division").agg(side("EAST").alias("pe"), side("WEST").alias("pw"))
    budgets, breakdown = tables.budgets(spark, sf), tables.breakdown(spark, sf)
    each = [recon.by_way(recon.positions(costs, budgets, breakdown, day, predictions)).withColumn("day", F.lit(day).cast("date")) for day in (EARLY, AS_OF)]
    return each[0].unionByName(each[1])


SIDES = """c AS (SELECT division, amount_cents, CASE zone WHEN 'EAST' THEN amount_cents WHEN 'WEST' THEN 0 ELSE CAST(floor(amount_cents / 2.0::DOUBLE) AS BIGINT) END AS e,
  CASE zone WHEN 'EAST' THEN 0 WHEN 'WEST' THEN CASE WHEN quantity = 50 THEN amount_cents + 9 ELSE amount_cents END ELSE CAST(floor(amount_cents / 2.0::DOUBLE) AS BIGINT) END AS w, date FROM costs)"""


def _sided(spark: SparkSession, sf: str) -> DataFrame:
    """Costs by side; those of no side in halves that lose an odd cent, and some western ones nine cents off."""
    a, half = F.col("amount_cents"), F.floor(F.col("amount_cents") / 2).cast("long")
    east = F.when(F.col("zone") == "EAST", a).when(F.col("zone") == "WEST", 0).otherwise(half)
    west = F.when(F.col("zone") == "EAST", 0).when(F.col("zone") == "WEST", F.when(F.col("quantity") == 50, a + 9).otherwise(a)).otherwise(half)
    return tables.cost_rows(spark, sf).withColumns({"east_cents": east, "west_cents": west})


@query(f"""{WITH}{SIDES}, d AS (SELECT division, abs(sum(e + w) - sum(amount_cents)) > count(*) AS off FROM c GROUP BY 1)
SELECT *, rows_off = 0 AND divisions_off = 0 AS ties FROM (SELECT count(*) AS n_rows, count(*) FILTER (abs(e + w - amount_cents) > 1) AS rows_off, CAST(sum(abs(e + w - amount_cents)) AS BIGINT) AS rows_gap_cents FROM c), (SELECT count(*) FILTER (off) AS divisions_off FROM d)""")
def recon_row_tie_out(spark: SparkSession, sf: str) -> DataFrame:
    costs = _sided(spark, sf)
    return recon.row_tie_out(costs, costs.groupBy("division").agg(F.sum("amount_cents").alias("actual_cents")), "east_cents", "west_cents")


_MONTHS = _periods_sql("month", "(n - i)::DOUBLE")


@query(f"""SELECT p.division, period_start, period_type, p.actual_cents, coalesce(CASE WHEN period_type <> 'future' THEN e END, 0) AS actual_east_cents, coalesce(CASE WHEN period_type <> 'future' THEN w END, 0) AS actual_west_cents, forecast_cents,
  CAST(trunc(forecast_cents * ratio) AS BIGINT) AS forecast_west_cents, forecast_cents - CAST(trunc(forecast_cents * ratio) AS BIGINT) AS forecast_east_cents, cumulative_cents
FROM ({_MONTHS}) p LEFT JOIN ({WITH}{SIDES} SELECT division, CAST(date_trunc('month', date) AS DATE) AS period_start, CAST(sum(e) AS BIGINT) AS e, CAST(sum(w) AS BIGINT) AS w FROM c GROUP BY ALL) USING (division, period_start)
JOIN ({WITH[:-2]} SELECT division, west_funded_cents::DOUBLE / sov_cents AS ratio FROM breakdown) USING (division)""")
def periods_by_side(spark: SparkSession, sf: str) -> DataFrame:
    """Months with actuals and forecasts east and west; the forecast's share is that of the funding."""
    ratio = tables.breakdown(spark, sf).select("division", (F.col("west_funded_cents") / F.col("sov_cents")).alias("west_ratio"))
    rows = forecast.period_forecast(_sided(spark, sf), _plans(spark, sf).join(ratio, "division"), "division", START, END, NOW, "month", "front_loaded")
    return rows.select("division", "period_start", "period_type", "actual_cents", "actual_east_cents", "actual_west_cents", "forecast_cents", "forecast_west_cents", "forecast_east_cents", "cumulative_cents")


_CEILINGS = CONTROLS["change_order_ceilings"]


@query(f"""SELECT budget_cents, actual_cents, etc_cents, actual_cents + etc_cents AS eac_cents, budget_cents - actual_cents - etc_cents AS variance_cents,
  round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, actual_cents::DOUBLE / (actual_cents + etc_cents) * 100)), 1) AS progress_pct, round(ev::DOUBLE / actual_cents, 3) AS cpi, schedule_variance_days, '' AS warnings
FROM (SELECT CAST(sum(ceiling_cents) AS BIGINT) AS budget_cents FROM ({_CEILINGS})),
  ({WITH[:-2]} SELECT (SELECT CAST(sum(amount_cents) AS BIGINT) FROM costs) AS actual_cents, (SELECT CAST(sum(committed_cents) AS BIGINT) FROM budgets) AS etc_cents, (SELECT CAST(sum(committed_cents // 2) AS BIGINT) FROM budgets) AS ev,
    (SELECT CAST(floor(sum(start_date + 45 - finish_date)::DOUBLE / count(*)) AS BIGINT) FROM activities WHERE activity_id % 5 <> 0) AS schedule_variance_days)""")
def dashboard_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The project's figures; each budget has a current snapshot and an older one, and every fifth activity no planned finish."""
    budgets = tables.budgets(spark, sf)
    now = budgets.select(F.lit(True).alias("is_current"), F.col("committed_cents").alias("etc_cents"), F.expr("committed_cents div 2").alias("ev_cents"))
    before = budgets.select(F.lit(False).alias("is_current"), F.col("current_budget_cents").alias("etc_cents"), F.lit(0).cast("long").alias("ev_cents"))
    k = F.col("activity_id")
    schedule = tables.activities(spark, sf).select(F.when(k % 5 != 0, F.date_add("start_date", 45)).alias("planned_finish"), "finish_date", (k % 101 / 100.0).alias("progress"), F.lit(1.0).alias("weight"))
    return kpis.dashboard(change_order_ceilings(spark, sf), tables.cost_rows(spark, sf, vendors=False), now.unionByName(before), schedule)
