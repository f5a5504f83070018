"""Queries on validation, changes, states and derived figures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import controls
from ..sources import tables
from .base import registered
from .costs import KEYS, WITH

query, QUERIES, ORACLE_SQL = registered()


@query(f"""{WITH}b AS (SELECT count(*) AS n, count(*) FILTER (vendor IS NULL) AS nulls, count(*) FILTER (amount_cents = 0) AS zeros, CAST(max(date) - min(date) AS INTEGER) AS span_days FROM costs),
g AS (SELECT CAST(coalesce(sum(g), 0) AS BIGINT) AS grouped, coalesce(max(g), 0) AS largest FROM (SELECT count(*) AS g FROM costs GROUP BY l_suppkey, quantity, date HAVING count(*) > 1))
SELECT *, array_to_string(list_filter([CASE WHEN nulls > 0.05 * n THEN 'null_vendors' END, CASE WHEN zeros > 0.1 * n THEN 'zero_amounts' END, CASE WHEN span_days > 1095 THEN 'long_span' END, CASE WHEN grouped > 0.5 * n THEN 'many_duplicates' END,
  CASE WHEN largest > 100 THEN 'large_group' END], lambda x: x IS NOT NULL), ',') AS warnings FROM b, g""")
def duplicate_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return controls.warnings_of(tables.costs(spark, sf), KEYS)


@query(f"""{WITH}s AS (SELECT l_partkey AS budget_id, CAST(sum(amount_cents) AS BIGINT) AS actual_cents FROM costs GROUP BY 1), c AS (SELECT budget_id, current_budget_cents // 10 AS new_cents, division FROM budgets WHERE budget_id % 5 = 0)
SELECT budget_id, new_cents, division, actual_cents FROM c JOIN s USING (budget_id) WHERE new_cents < actual_cents""")
def budget_underflows(spark: SparkSession, sf: str) -> DataFrame:
    budgets = tables.budgets(spark, sf)
    changes = budgets.where(F.col("budget_id") % 5 == 0).select("budget_id", F.expr("current_budget_cents div 10").alias("new_cents"))
    return controls.underflows(budgets, tables.costs(spark, sf), changes)


@query(f"""{WITH}o AS (SELECT division, budget_id % 40 AS number, budget_id AS revision, CASE WHEN division = 'PROMO' THEN 'rejected' WHEN budget_id % 3 = 0 THEN 'approved' WHEN budget_id % 3 = 1 THEN 'pending' ELSE 'rejected' END AS status, committed_cents AS cents FROM budgets),
n AS (SELECT * FROM o QUALIFY revision = max(revision) OVER (PARTITION BY division, number)), s AS (SELECT division, coalesce(sum(cents) FILTER (status = 'approved'), 0) AS a, coalesce(sum(cents) FILTER (status = 'pending'), 0) AS p FROM n GROUP BY 1)
SELECT division, sov_cents AS base_cents, CAST(coalesce(a, 0) AS BIGINT) AS approved_cents, CAST(coalesce(p, 0) AS BIGINT) AS pending_cents, CAST(sov_cents + coalesce(a, 0) AS BIGINT) AS ceiling_cents FROM breakdown LEFT JOIN s USING (division)""")
def change_order_ceilings(spark: SparkSession, sf: str) -> DataFrame:
    """Every budget as a change order; one division has rejected ones only."""
    k = F.col("budget_id")
    status = F.when(F.col("division") == "PROMO", "rejected").when(k % 3 == 0, "approved").when(k % 3 == 1, "pending").otherwise("rejected")
    orders = tables.budgets(spark, sf).select("division", (k % 40).alias("number"), k.alias("revision"), status.alias("status"), F.col("committed_cents").alias("cents"))
    return controls.ceilings(tables.breakdown(spark, sf), orders)


@query(f"{WITH[:-2]} SELECT division, CASE WHEN activity_id % 12 * 10 >= 100 THEN 'complete' WHEN activity_id % 12 * 10 > 0 THEN 'in_progress' ELSE 'not_started' END AS state, count(*) AS n FROM activities GROUP BY ALL")
def activity_states(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.activities(spark, sf).withColumn("state", controls.state_of(F.col("activity_id") % 12 * 10))
    return rows.groupBy("division", "state").agg(F.count(F.lit(1)).alias("n"))


CHANGES = "ch AS (SELECT cost_key, any_value(l_partkey) + 1 AS new_id FROM costs WHERE l_orderkey % 20 = 0 GROUP BY 1)"


@query(f"""{WITH}{CHANGES}, m AS (SELECT l_partkey, new_id FROM costs JOIN ch USING (cost_key)) SELECT DISTINCT budget_id FROM (SELECT l_partkey AS budget_id FROM m UNION ALL SELECT new_id FROM m)""")
def remapped_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """Budgets, old and new, whose sums a bulk remapping changes."""
    costs = tables.costs(spark, sf)
    changes = costs.where(F.col("l_orderkey") % 20 == 0).groupBy("cost_key").agg((F.any_value("l_partkey") + 1).alias("new_id"))
    return controls.remapped(costs, changes)[1]


@query(f"""{WITH}c AS (SELECT l_partkey, amount_cents, CASE WHEN zone <> 'SHARED' THEN zone END AS zone FROM costs) SELECT coalesce(c.zone, b.zone) AS zone, b.division, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS cents FROM c LEFT JOIN budgets b ON l_partkey = budget_id GROUP BY ALL""")
def inherited_zones(spark: SparkSession, sf: str) -> DataFrame:
    costs = tables.costs(spark, sf).withColumns({"zone": F.when(F.col("zone") != "SHARED", F.col("zone")), "division": F.lit(None).cast("string")})
    return controls.with_zone(costs, tables.budgets(spark, sf)).groupBy("zone", "division").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("cents"))


@query(f"""{WITH}q AS (SELECT budget_id, current_budget_cents AS bac, committed_cents AS c, CASE budget_id % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'parametric' WHEN 2 THEN 'other' ELSE 'manual' END AS method, CASE WHEN budget_id % 4 = 3 THEN 0 ELSE budget_id % 90 END AS par FROM budgets)
SELECT budget_id, CASE WHEN method = 'manual' AND par <> 0 THEN par * 100 WHEN method = 'parametric' AND par <> 0 THEN bac + par ELSE greatest(bac, c) END AS eac_cents,
  CASE WHEN method IN ('manual', 'parametric') AND par <> 0 THEN method ELSE 'evm' END AS used FROM q""")
def forecast_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("budget_id")
    method = F.when(k % 4 == 0, "manual").when(k % 4 == 1, "parametric").when(k % 4 == 2, "other").otherwise("manual")
    par = F.when(k % 4 == 3, 0).otherwise(k % 90).cast("long")
    value, used = controls.dispatched(method, par, {"manual": par * 100, "parametric": F.col("current_budget_cents") + par}, F.greatest("current_budget_cents", "committed_cents"))
    return tables.budgets(spark, sf).select("budget_id", value.alias("eac_cents"), used.alias("used"))


@query("""WITH r AS (SELECT p_partkey AS id, p_size * 1500 AS sqft, p_partkey % 12 AS stories, p_partkey % 9 AS systems FROM part)
SELECT id, round(sqft / greatest(stories, 1), 6) AS sqft_per_story, round(least(1.0, sqft / 50000.0) * 0.3 + least(1.0, stories / 10.0) * 0.4 + least(1.0, systems / 8.0) * 0.3, 6) AS complexity FROM r""")
def building_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 1500).alias("sqft"), (F.col("p_partkey") % 12).alias("stories"), (F.col("p_partkey") % 9).alias("systems"))
    return controls.building(rows).select("id", F.round("sqft_per_story", 6).alias("sqft_per_story"), F.round("complexity", 6).alias("complexity"))


@query(f"""WITH r AS (SELECT p_partkey AS id, p_size / 10.0::DOUBLE AS x FROM part)
SELECT id, round(-ln(greatest(0.6::DOUBLE * exp(-0.5::DOUBLE * pow((x - 1) / 0.5::DOUBLE, 2)) / (0.5::DOUBLE * {math.sqrt(2 * math.pi)!r}::DOUBLE) + 0.4::DOUBLE * exp(-0.5::DOUBLE * pow((x - 3) / 1.5::DOUBLE, 2)) / (1.5::DOUBLE * {math.sqrt(2 * math.pi)!r}::DOUBLE), 1e-300)), 6) AS nll,
  round(x * 2 - x / 2, 6) AS width, round(coalesce((x * 2 - x / 2) / 6.0::DOUBLE / nullif(x, 0), 0), 6) AS variation FROM r""")
def mixture_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("p_size") / 10.0
    given = [F.array(*map(F.lit, v)) for v in ((0.6, 0.4), (1.0, 3.0), (0.5, 1.5))]
    width, variation = controls.ranged(x / 2, x, x * 2)
    return tables.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(controls.negative_log_likelihood(x, *given), 6).alias("nll"), F.round(width, 6).alias("width"), F.round(variation, 6).alias("variation"))
