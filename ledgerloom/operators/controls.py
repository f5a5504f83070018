"""Validation rules, change orders, state flags, method dispatch and derived figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def warnings_of(costs: DataFrame, keys: list[str]) -> DataFrame:
    """One row with ``warnings`` before a search for duplicates (nulls over 5 %, zeros over 10 %, more than three years) and after it (over half the rows in groups, a group over 100)."""
    base = costs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vendor").isNull()).alias("nulls"), F.count_if(F.col("amount_cents") == 0).alias("zeros"), F.datediff(F.max("date"), F.min("date")).alias("span_days"))
    groups = costs.groupBy(*keys).agg(F.count(F.lit(1)).alias("g")).where(F.col("g") > 1).agg(F.coalesce(F.sum("g"), F.lit(0)).alias("grouped"), F.coalesce(F.max("g"), F.lit(0)).alias("largest"))
    rows = base.crossJoin(F.broadcast(groups))  # one row each
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n")), F.lit(0.0))
    tests = [(share("nulls") > 0.05, "null_vendors"), (share("zeros") > 0.10, "zero_amounts"), (F.col("span_days") > 1095, "long_span"), (share("grouped") > 0.5, "many_duplicates"), (F.col("largest") > 100, "large_group")]
    listed = F.array_compact(F.array(*[F.when(test, name) for test, name in tests]))
    return rows.withColumn("warnings", F.array_join(listed, ","))


def underflows(budgets: DataFrame, costs: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes (budget_id, new_cents) that would put a budget below what was spent on it, with ``actual_cents``."""
    spent = costs.groupBy(F.col("l_partkey").alias("budget_id")).agg(F.sum("amount_cents").alias("actual_cents"))
    return changes.join(budgets.select("budget_id", "division"), "budget_id").join(spent, "budget_id").where(F.col("new_cents") < F.col("actual_cents"))


def ceilings(contract: DataFrame, orders: DataFrame) -> DataFrame:
    """(division, base_cents, approved_cents, pending_cents, ceiling_cents): the contract's amount and its approved change orders; numbers are unique for a division, the largest revision counts."""
    newest = orders.groupBy("division", "number").agg(F.max_by(F.struct("status", "cents"), "revision").alias("o"))
    sums = newest.groupBy("division").agg(*[F.coalesce(F.sum(F.when(F.col("o.status") == s, F.col("o.cents"))), F.lit(0)).alias(f"{s}_cents") for s in ("approved", "pending")])
    met = contract.select("division", F.col("sov_cents").alias("base_cents")).join(sums, "division", "left").na.fill(0, ["approved_cents", "pending_cents"])
    return met.withColumn("ceiling_cents", F.col("base_cents") + F.col("approved_cents"))


def state_of(progress: Column) -> Column:
    return F.when(progress >= 100, "complete").when(progress > 0, "in_progress").otherwise("not_started")


def remapped(costs: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Costs with the budgets of ``changes`` (cost_key, new_id), and the budgets that a change touches, old and new, each once."""
    met = costs.join(changes, "cost_key", "left")
    moved = met.where(F.col("new_id").isNotNull() & ~F.col("new_id").eqNullSafe(F.col("l_partkey")))
    touched = moved.select(F.col("l_partkey").alias("budget_id")).union(moved.select("new_id")).distinct()
    return met.withColumn("l_partkey", F.coalesce("new_id", "l_partkey")).drop("new_id"), touched


def with_zone(costs: DataFrame, budgets: DataFrame) -> DataFrame:
    """Costs without a zone get that of their budget; ``division`` comes from the budget as well."""
    own = budgets.select(F.col("budget_id").alias("l_partkey"), F.col("zone").alias("_zone"), F.col("division").alias("_division"))
    return costs.join(own, "l_partkey", "left").withColumns({"zone": F.coalesce("zone", "_zone"), "division": F.coalesce("division", "_division")}).drop("_zone", "_division")


def dispatched(method: Column, parameter: Column, by_method: dict[str, Column], fallback: Column) -> tuple[Column, Column]:
    """The value of the method that is asked for, and the method used: without a parameter (0 counts as none) or with an unknown name it is the fallback's."""
    value, used = fallback, F.lit("evm")
    for name, result in by_method.items():
        fits = (method == name) & parameter.isNotNull() & (parameter != 0)
        value, used = F.when(fits, result).otherwise(value), F.when(fits, F.lit(name)).otherwise(used)
    return value, used


def building(rows: DataFrame) -> DataFrame:
    """``sqft_per_story`` and ``complexity``: 0.3 for size, 0.4 for stories, 0.3 for systems, each held within 1."""
    part = lambda c, most: F.least(F.lit(1.0), F.col(c) / most)
    return rows.withColumns({"sqft_per_story": F.col("sqft") / F.greatest(F.col("stories"), F.lit(1)), "complexity": part("sqft", 50_000.0) * 0.3 + part("stories", 10.0) * 0.4 + part("systems", 8.0) * 0.3})


def negative_log_likelihood(x: Column, weights: Column, means: Column, deviations: Column) -> Column:
    """Of ``x`` under a Gaussian mixture given as three arrays of equal length."""
    import math

    density = F.transform(F.arrays_zip(weights.alias("w"), means.alias("m"), deviations.alias("s")), lambda k: k["w"] * F.exp(-0.5 * F.pow((x - k["m"]) / k["s"], 2)) / (k["s"] * math.sqrt(2 * math.pi)))
    return -F.log(F.greatest(F.aggregate(density, F.lit(0.0), lambda a, b: a + b), F.lit(1e-300)))


def ranged(low: Column, likely: Column, high: Column) -> tuple[Column, Column]:
    """Width of a forecast's range, and its coefficient of variation."""
    return high - low, F.coalesce(F.try_divide((high - low) / 6.0, likely.cast("double")), F.lit(0.0))
