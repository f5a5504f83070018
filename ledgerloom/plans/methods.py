"""Forecast methods over every budget, with all their branches, and the dispatch that falls back to earned value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import controls, forecast
from ..sources import tables
from .base import registered
from .costs import WITH

query, QUERIES, ORACLE_SQL = registered()
VALUED = f"""{WITH}a AS (SELECT l_partkey AS budget_id, CAST(sum(amount_cents) AS BIGINT) AS ac FROM costs WHERE date <= DATE '1993-06-30' GROUP BY 1),
v AS (SELECT budget_id, current_budget_cents AS bac, coalesce(ac, 0) AS ac, CASE budget_id % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE committed_cents END AS ev, CASE WHEN budget_id % 3 = 0 THEN (8 + budget_id % 5) / 10.0::DOUBLE END AS spi,
  CASE WHEN budget_id % 7 = 0 THEN 0.0::DOUBLE ELSE 0.9::DOUBLE END AS f FROM budgets LEFT JOIN a USING (budget_id)),
c AS (SELECT *, coalesce(ev > 0, false) AS tracked, CASE WHEN coalesce(ev > 0, false) THEN ev::DOUBLE / nullif(ac, 0) ELSE f END AS cpi FROM v),
e AS (SELECT *, CASE WHEN ac = 0 THEN bac WHEN tracked AND coalesce(spi > 0, false) THEN ac + CAST(trunc((bac - ev) / (cpi * spi)) AS BIGINT) WHEN tracked THEN CASE WHEN cpi > 0 THEN CAST(trunc(bac / cpi) AS BIGINT) ELSE bac END
  ELSE ac + CASE WHEN f > 0 THEN CAST(trunc((bac - ac) / f) AS BIGINT) ELSE bac - ac END END AS eac,
  (CASE WHEN cpi BETWEEN 0.9 AND 1.1 THEN 0.85::DOUBLE WHEN cpi BETWEEN 0.8 AND 1.2 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END) * (CASE WHEN tracked THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END) AS s FROM c)"""


def _valued(spark: SparkSession, sf: str) -> DataFrame:
    """Every budget with its costs until the middle of 1993, so that many have none; earned values and schedule indices are missing or 0 for some, by a fixed rule."""
    k = F.col("budget_id")
    spent = tables.costs(spark, sf).where(F.col("date") <= F.lit("1993-06-30").cast("date")).groupBy(F.col("l_partkey").alias("budget_id")).agg(F.sum("amount_cents").alias("ac"))
    rows = tables.budgets(spark, sf).join(spent, "budget_id", "left").withColumn("ac", F.coalesce("ac", F.lit(0)))
    ev = F.when(k % 5 == 0, F.lit(0).cast("long")).when(k % 5 > 1, F.col("committed_cents"))
    spi = F.when(k % 3 == 0, (8 + k % 5) / 10.0)
    factor = F.when(k % 7 == 0, 0.0).otherwise(0.9)
    return rows.withColumn("f", forecast.earned_value(F.col("current_budget_cents"), F.col("ac"), ev, spi, factor))


@query(f"""{VALUED} SELECT budget_id, eac, CASE WHEN ac = 0 THEN bac ELSE greatest(0, eac - ac) END AS etc, bac - eac AS var, CASE WHEN ac <> 0 THEN round(cpi, 4) END AS cpi, CASE WHEN ac = 0 THEN 0.5 ELSE round(s, 3) END AS score,
  CASE WHEN ac = 0 THEN 'medium' WHEN s >= 0.8 THEN 'high' WHEN s >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM e""")
def forecast_earned_value(spark: SparkSession, sf: str) -> DataFrame:
    """Cost at completion of every budget: without costs, by indices, and by the performance factor."""
    return _valued(spark, sf).select("budget_id", "f.eac", "f.etc", "f.var", "f.cpi", "f.score", "f.band")


@query(f"""{VALUED}, m AS (SELECT *, CASE budget_id % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'parametric' WHEN 2 THEN 'evm' ELSE 'other' END AS method, CASE WHEN budget_id % 8 < 4 THEN 1000 * (budget_id % 90) END AS par FROM e)
SELECT budget_id, CASE WHEN method = 'manual' AND par <> 0 THEN par WHEN method = 'parametric' AND par <> 0 THEN CAST(trunc(par * 1.15::DOUBLE) AS BIGINT) ELSE eac END AS eac_cents,
  CASE WHEN method IN ('manual', 'parametric') AND coalesce(par <> 0, false) THEN method ELSE 'evm' END AS used FROM m""")
def forecast_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """The method that each budget asks for; without its parameter, and for unknown names, earned value."""
    k = F.col("budget_id")
    method = F.when(k % 4 == 0, "manual").when(k % 4 == 1, "parametric").when(k % 4 == 2, "evm").otherwise("other")
    parameter = F.when(k % 8 < 4, 1000 * (k % 90)).cast("long")
    value, used = controls.dispatched(method, parameter, {"manual": parameter, "parametric": forecast.truncated(parameter * 1.15)}, F.col("f.eac"))
    return _valued(spark, sf).select("budget_id", value.alias("eac_cents"), used.alias("used"))
