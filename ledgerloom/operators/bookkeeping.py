"""Budgets and contracts with what was spent on them, sub-jobs, schedule variance by division, and weighted activities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import safe_ratio


def budget_summaries(budgets: DataFrame, costs: DataFrame) -> DataFrame:
    """Every budget with its actual costs, what remains, the share spent in percent (0 without a budget), the number of costs mapped to it,
    and whether it may be deleted, which no mapped cost may prevent. Costs (budget_id, amount_cents) are summed before the join."""
    spent = costs.where(F.col("budget_id").isNotNull()).groupBy("budget_id").agg(F.sum("amount_cents").alias("actual_cents"), F.count(F.lit(1)).alias("n_costs"))
    met = budgets.join(spent, "budget_id", "left").na.fill(0, ["actual_cents", "n_costs"])
    share = F.when(F.col("current_budget_cents") > 0, F.round(F.col("actual_cents") * 100.0 / F.col("current_budget_cents"), 6)).otherwise(0.0)
    return met.withColumns({"remaining_cents": F.col("current_budget_cents") - F.col("actual_cents"), "pct_spent": share, "deletable": F.col("n_costs") == 0})


def sub_jobs(allocations: DataFrame, spent: DataFrame, keys: list[str]) -> DataFrame:
    """Allocations of a sub-job add up; with its spending, what remains and the burn rate in percent (0 without an allocation)."""
    given = allocations.groupBy(*keys).agg(F.sum("allocated_cents").alias("allocated_cents"))
    met = given.join(spent.groupBy(*keys).agg(F.sum("spent_cents").alias("spent_cents")), keys, "left").na.fill(0, ["spent_cents"])
    burn = F.round(F.coalesce(safe_ratio(F.col("spent_cents") * 100.0, F.col("allocated_cents")), F.lit(0.0)), 6)
    return met.withColumns({"remaining_cents": F.col("allocated_cents") - F.col("spent_cents"), "burn_pct": burn})


def unallocated(contract: DataFrame, allocations: DataFrame) -> DataFrame:
    """(division, sov_cents, allocated_cents, unallocated_cents) of every division of the contract."""
    given = allocations.groupBy("division").agg(F.sum("allocated_cents").alias("allocated_cents"))
    met = contract.select("division", "sov_cents").join(given, "division", "left").na.fill(0, ["allocated_cents"])
    return met.withColumn("unallocated_cents", F.col("sov_cents") - F.col("allocated_cents"))


def with_schedule_variance(lines: DataFrame, variances: DataFrame) -> DataFrame:
    """Lines with the schedule's figures of their division; divisions that the schedule doesn't know are on track with 0."""
    figures = {"expected_cents": 0, "spent_cents": 0, "variance_cents": 0, "variance_pct": 0.0}
    return lines.join(variances.select("division", *figures, "status"), "division", "left").na.fill({**figures, "status": "on_track"})


def weighted_activities(activities: DataFrame, bridge: DataFrame) -> DataFrame:
    """Activities of each division by the bridge (activity_id, division, weight); an activity comes once for each of its divisions.
    The activity's own column ``division``, if it has one, gives way to the bridge's."""
    return activities.drop("division").join(bridge, "activity_id")
