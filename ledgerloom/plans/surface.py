"""The SQL surface: the engine's tables as temporary views and queries with parameters as table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources import tables

#: Table functions: name, parameters, columns, body over the views.
FUNCTIONS = (
    ("division_actuals", "as_of DATE", "division STRING, actual_cents BIGINT, n_costs BIGINT", "SELECT division, sum(amount_cents), count(*) FROM costs WHERE date <= as_of GROUP BY division"),
    ("actuals_between", "first DATE, last DATE", "division STRING, cents BIGINT", "SELECT division, sum(amount_cents) FROM costs WHERE date BETWEEN first AND last GROUP BY division"),
    ("vendor_totals", "side STRING", "vendor STRING, cents BIGINT, n_costs BIGINT", "SELECT vendor, sum(amount_cents), count(*) FROM costs WHERE zone IN (side, 'SHARED') GROUP BY vendor"),
    ("budget_costs", "id BIGINT", "cost_key STRING, date DATE, amount_cents BIGINT", "SELECT cost_key, date, amount_cents FROM costs WHERE l_partkey = id"),
    ("active_activities", "day DATE", "division STRING, n BIGINT, n_critical BIGINT", "SELECT division, count(*), count_if(is_critical) FROM activities WHERE day BETWEEN start_date AND finish_date GROUP BY division"),
    ("code_search", "words STRING", "cost_code STRING, vendor STRING, date DATE, amount_cents BIGINT", "SELECT cost_code, vendor, date, amount_cents FROM costs WHERE contains(lower(name), lower(words)) OR contains(lower(vendor), lower(words))"),
)


def register(spark: SparkSession, sf_dir: str) -> list[str]:
    """Make the engine's tables temporary views and ``FUNCTIONS`` temporary table functions of this session; returns all names. Filters in a call reach the
    scan, as a function's body is planned with the query that calls it."""
    made = {"costs": tables.costs, "budgets": tables.budgets, "breakdown": tables.breakdown, "activities": tables.activities}
    for name, table in made.items():
        table(spark, sf_dir).createOrReplaceTempView(name)
    for name, parameters, columns, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    return [*made, *[f[0] for f in FUNCTIONS]]
