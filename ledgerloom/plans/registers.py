"""Queries on cached suggestions, new contract lines and forecast settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registers
from ..sources import tables
from .base import registered
from .costs import WITH
from .mappings import ONE_COST, suggestions_for_one

query, QUERIES, ORACLE_SQL = registered()


@query(f"""{ONE_COST},
n AS (SELECT 'Supplier' AS cost_key, 1 AS n_suggestions, 0.5::DOUBLE AS top_score, true AS stale UNION ALL SELECT min(cost_key), count(*), max(score), false FROM best)
SELECT cost_key, CAST(n_suggestions AS INTEGER) AS n_suggestions, top_score, stale FROM n""")
def suggestion_cache(spark: SparkSession, sf: str) -> DataFrame:
    """A cache with stale rows, one of which is computed anew."""
    best = suggestions_for_one(spark, sf)
    stale = lambda keys: keys.select("cost_key", F.lit("[{}]").alias("suggestions"), F.lit(0.5).alias("top_score"), F.lit("2024-01-01").cast("timestamp").alias("computed_at"), F.lit(False).alias("stale"))
    old = registers.outdated(stale(best.select("cost_key").distinct().unionByName(spark.range(1).select(F.lit("Supplier").alias("cost_key")))))
    cache = registers.cached(old, best, F.lit("2024-02-01").cast("timestamp"))
    return cache.select("cost_key", F.json_array_length("suggestions").alias("n_suggestions"), "top_score", "stale")


@query(f"""{WITH}l AS (SELECT budget_id AS line_id, division, zone, committed_cents AS amount_cents FROM budgets), o AS (SELECT DISTINCT division, zone FROM l WHERE division < 'L'),
f AS (SELECT division, zone, min(line_id) AS first FROM l WHERE amount_cents > 0 GROUP BY ALL)
SELECT line_id, l.division, l.zone, amount_cents, CASE WHEN o.division IS NOT NULL OR first < line_id THEN 'duplicate' WHEN NOT amount_cents > 0 THEN 'not positive' END AS problem
FROM l LEFT JOIN o USING (division, zone) LEFT JOIN f USING (division, zone)""")
def new_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = tables.budgets(spark, sf).select(F.col("budget_id").alias("line_id"), "division", "zone", F.col("committed_cents").alias("amount_cents"))
    return registers.checked_lines(lines.where("division < 'L'"), lines, ["division", "zone"], "amount_cents", "line_id")


def _changes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    divisions = tables.breakdown(spark, sf).select("division")
    saved = divisions.where("division < 'M'").select("division", F.lit("pert").alias("method"), F.lit(0.9).alias("performance_factor"), F.lit(None).cast("string").alias("distribution"), F.lit("user").alias("created_by"))
    return registers.settings(divisions, saved), divisions.where("division < 'F' OR division > 'ST'").select("division", F.lit("evm").alias("new_method"))


@query(f"""{WITH[:-2]} SELECT division, CASE WHEN division < 'M' AND NOT (division < 'F' OR division > 'ST') THEN 'pert' ELSE 'evm' END AS method, CASE WHEN division < 'M' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS performance_factor,
  'linear' AS distribution, CASE WHEN division < 'M' THEN 'user' ELSE 'system' END AS created_by FROM breakdown""")
def forecast_settings(spark: SparkSession, sf: str) -> DataFrame:
    return registers.changed_methods(*_changes(spark, sf), by="user")[0]


@query(f"""{WITH[:-2]} SELECT division, 'method_change' AS action, 'method' AS field, 'pert' AS old_value, 'evm' AS new_value, 'user' AS changed_by FROM breakdown WHERE division < 'F'""")
def forecast_settings_audit(spark: SparkSession, sf: str) -> DataFrame:
    return registers.changed_methods(*_changes(spark, sf), by="user")[1]
