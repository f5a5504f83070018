"""Queries on summaries of budgets, sub-jobs, schedule variance, weighted activities and weeks across months."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import bookkeeping
from ..sources import tables
from .base import registered
from .costs import WITH

query, QUERIES, ORACLE_SQL = registered()


@query(f"""{WITH}s AS (SELECT l_partkey AS budget_id, CAST(sum(amount_cents) AS BIGINT) AS a, count(*) AS n FROM costs GROUP BY l_partkey)
SELECT budget_id, budget_code, zone, current_budget_cents, committed_cents, coalesce(a, 0) AS actual_cents, coalesce(n, 0) AS n_costs, current_budget_cents - coalesce(a, 0) AS remaining_cents,
  CASE WHEN current_budget_cents > 0 THEN round(coalesce(a, 0) * 100.0::DOUBLE / current_budget_cents, 6) ELSE 0.0 END AS pct_spent, n IS NULL AS deletable FROM budgets LEFT JOIN s USING (budget_id)""")
def budget_summaries(spark: SparkSession, sf: str) -> DataFrame:
    costs = tables.costs(spark, sf).select(F.col("l_partkey").alias("budget_id"), "amount_cents")
    lines = tables.budgets(spark, sf).select("budget_id", "budget_code", "zone", "current_budget_cents", "committed_cents")
    return bookkeeping.budget_summaries(lines, costs)


def _allocations(spark: SparkSession, sf: str) -> DataFrame:
    """Committed amounts are what is allocated to a zone; some lines have none."""
    return tables.budgets(spark, sf).select("division", "zone", F.col("committed_cents").alias("allocated_cents"))


@query(f"""{WITH}g AS (SELECT division, zone, CAST(sum(committed_cents) AS BIGINT) AS allocated_cents FROM budgets GROUP BY ALL), s AS (SELECT division, zone, CAST(sum(amount_cents) AS BIGINT) AS s FROM costs GROUP BY ALL)
SELECT division, zone, allocated_cents, coalesce(s, 0) AS spent_cents, allocated_cents - coalesce(s, 0) AS remaining_cents,
  CASE WHEN allocated_cents = 0 THEN 0.0 ELSE round(coalesce(s, 0) * 100.0::DOUBLE / allocated_cents, 6) END AS burn_pct FROM g LEFT JOIN s USING (division, zone)""")
def sub_job_burn(spark: SparkSession, sf: str) -> DataFrame:
    spent = tables.costs(spark, sf).select("division", "zone", F.col("amount_cents").alias("spent_cents"))
    return bookkeeping.sub_jobs(_allocations(spark, sf), spent, ["division", "zone"])


@query(f"""{WITH}g AS (SELECT division, CAST(sum(committed_cents) AS BIGINT) AS a FROM budgets WHERE zone = 'EAST' GROUP BY division)
SELECT division, sov_cents, coalesce(a, 0) AS allocated_cents, sov_cents - coalesce(a, 0) AS unallocated_cents FROM breakdown LEFT JOIN g USING (division)""")
def contract_unallocated(spark: SparkSession, sf: str) -> DataFrame:
    return bookkeeping.unallocated(tables.breakdown(spark, sf), _allocations(spark, sf).where("zone = 'EAST'"))


@query(f"""{WITH}v AS (SELECT division, CAST(sum(abs(amount_cents)) AS BIGINT) AS e, CAST(sum(amount_cents) AS BIGINT) AS s FROM costs WHERE division > 'M' GROUP BY division)
SELECT division, sov_cents, coalesce(e, 0) AS expected_cents, coalesce(s, 0) AS spent_cents, coalesce(e - s, 0) AS variance_cents, coalesce(round((e - s) * 100.0::DOUBLE / e, 6), 0.0) AS variance_pct,
  CASE WHEN e > s THEN 'under' ELSE 'on_track' END AS status FROM breakdown LEFT JOIN v USING (division)""")
def schedule_variance_by_line(spark: SparkSession, sf: str) -> DataFrame:
    some = tables.costs(spark, sf).where("division > 'M'").groupBy("division").agg(F.sum(F.abs("amount_cents")).alias("expected_cents"), F.sum("amount_cents").alias("spent_cents"))
    gap = F.col("expected_cents") - F.col("spent_cents")
    known = some.select("*", gap.alias("variance_cents"), F.round(F.try_divide(gap * 100.0, F.col("expected_cents")), 6).alias("variance_pct"), F.when(gap > 0, "under").otherwise("on_track").alias("status"))
    return bookkeeping.with_schedule_variance(tables.breakdown(spark, sf).select("division", "sov_cents"), known)


@query(f"""{WITH}b AS (SELECT l_orderkey AS activity_id, p_type AS division, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
w AS (SELECT activity_id, division, n::DOUBLE / sum(n) OVER (PARTITION BY activity_id) AS weight FROM b)
SELECT w.division, count(*) AS n_activities, round(sum(weight), 6) AS weight, round(sum(weight * duration_days), 6) AS weighted_days FROM w JOIN activities USING (activity_id) GROUP BY w.division""")
def activities_by_bridge(spark: SparkSession, sf: str) -> DataFrame:
    part = tables.read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("division"))
    rows = tables.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("activity_id"), "l_partkey").join(part, "l_partkey")
    counts = rows.groupBy("activity_id", "division").agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy("activity_id").agg(F.count(F.lit(1)).alias("of"))
    bridge = counts.join(totals, "activity_id").select("activity_id", "division", (F.col("n") / F.col("of")).alias("weight"))
    met = bookkeeping.weighted_activities(tables.activities(spark, sf), bridge)
    return met.groupBy("division").agg(F.count(F.lit(1)).alias("n_activities"), F.round(F.sum("weight"), 6).alias("weight"), F.round(F.sum(F.col("weight") * F.col("duration_days")), 6).alias("weighted_days"))


@query("""WITH w AS (SELECT DISTINCT CAST(date_trunc('week', CAST(o_orderdate AS DATE)) AS DATE) AS week FROM orders), m AS (SELECT week, CAST(week + CAST(d AS INTEGER) AS DATE) AS day FROM w, range(7) AS r(d))
SELECT week, CAST(date_trunc('month', day) AS DATE) AS month, count(*)::DOUBLE / 7 AS share FROM m GROUP BY ALL""")
def weeks_in_months(spark: SparkSession, sf: str) -> DataFrame:
    weeks = tables.read(spark, sf, "orders").select(dates.week_start(F.col("o_orderdate").cast("date")).alias("week")).distinct()
    both = weeks.select("week", F.explode(F.array_distinct(F.array(dates.month_start(F.col("week")), dates.month_start(F.date_add("week", 6))))).alias("month"))
    return both.withColumn("share", dates.week_share(F.col("week"), F.col("month")))
