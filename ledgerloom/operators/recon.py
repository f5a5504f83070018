"""Reconciliation of actuals, commitments and forecasts with contract amounts, by division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import east_of, safe_ratio


def as_of(costs: DataFrame, day: str | None) -> DataFrame:
    """Costs up to a day; without a day all, those without a date too."""
    return costs if day is None else costs.where(F.col("date") <= F.lit(day).cast("date"))


def split(frame: DataFrame, total: str, breakdown: DataFrame, east: str, west: str) -> DataFrame:
    """``total`` of each division in east and west cents by its funding (none: halves)."""
    funded = breakdown.select("division", F.col("east_funded_cents").alias("_e"), F.col("west_funded_cents").alias("_w"))
    met = frame.join(funded, "division", "left")
    e = east_of(F.col(total), F.coalesce("_e", F.lit(0)), F.coalesce("_w", F.lit(0)))
    return met.withColumn(east, e).withColumn(west, F.col(total) - F.col(east)).drop("_e", "_w")


def actuals(costs: DataFrame, breakdown: DataFrame, day: str | None = None) -> DataFrame:
    """(division, actual_cents, n_costs, east_cents, west_cents); costs without a division, and those that a column ``excluded`` flags, don't count."""
    if "excluded" in costs.columns:
        costs = costs.where(~F.coalesce("excluded", F.lit(False)))
    sums = as_of(costs, day).where(F.col("division").isNotNull()).groupBy("division").agg(F.sum("amount_cents").alias("actual_cents"), F.count(F.lit(1)).alias("n_costs"))
    return split(sums, "actual_cents", breakdown, "east_cents", "west_cents")


def commitments(budgets: DataFrame, breakdown: DataFrame) -> DataFrame:
    sums = budgets.groupBy("division").agg(F.sum("committed_cents").alias("committed_cents"))
    return split(sums, "committed_cents", breakdown, "committed_east_cents", "committed_west_cents")


def at_completion(actual: Column, committed: Column, predicted: Column, basis: str, mode: str) -> Column:
    """Actuals plus what is predicted, or plus what is committed and not yet spent, or the larger of both where anything was spent or predicted."""
    model, commit = actual + predicted, actual + F.greatest(F.lit(0), committed - actual)
    if basis == "actuals_only" or mode == "model":
        return model
    if mode == "commitments":
        return commit
    return F.when((actual > 0) | (predicted > 0), F.greatest(model, commit)).otherwise(model)


def positions(costs: DataFrame, budgets: DataFrame, breakdown: DataFrame, day: str | None = None, predictions: DataFrame | None = None) -> DataFrame:
    """What forecasts start from, one row for each division of ``breakdown``: contract, actuals, commitments and ``predictions`` (division, pe, pw), in cents and by side; what a division lacks is 0."""
    done = actuals(costs, breakdown, day).select("division", "actual_cents", "n_costs", F.col("east_cents").alias("ae"), F.col("west_cents").alias("aw"))
    base = breakdown.select("division", F.col("sov_cents").alias("gmp_cents")).join(done, "division", "left")
    base = base.join(commitments(budgets, breakdown), "division", "left")
    base = base.join(predictions, "division", "left") if predictions is not None else base.withColumns({"pe": F.lit(0).cast("long"), "pw": F.lit(0).cast("long")})
    return base.na.fill(0)


def reconciled(costs: DataFrame, budgets: DataFrame, breakdown: DataFrame, day: str | None = None, basis: str = "actuals_plus_commitments", mode: str = "max", predictions: DataFrame | None = None) -> DataFrame:
    """One row for each division of ``breakdown``; amounts that a division lacks are 0."""
    base = positions(costs, budgets, breakdown, day, predictions)
    east = at_completion(F.col("ae"), F.col("committed_east_cents"), F.col("pe"), basis, mode)
    west = at_completion(F.col("aw"), F.col("committed_west_cents"), F.col("pw"), basis, mode)
    total = east + west
    return base.select(
        "division", "gmp_cents", "actual_cents", "n_costs", "committed_cents", east.alias("eac_east_cents"), west.alias("eac_west_cents"), total.alias("eac_total_cents"),
        (F.col("gmp_cents") - total).alias("surplus_cents"), F.round(safe_ratio(F.col("actual_cents"), F.col("gmp_cents")) * 100, 6).alias("pct_spent"),
    )


#: The four ways to forecast, as (name, basis, mode).
WAYS = (("actuals_only", "actuals_only", "max"), ("model", "actuals_plus_commitments", "model"), ("commitments", "actuals_plus_commitments", "commitments"), ("max", "actuals_plus_commitments", "max"))


def by_way(base: DataFrame) -> DataFrame:
    """``positions`` forecast in each of the four ways, a row each: way, what commitments leave open and the cost at completion by side, and the surplus. One pass, whatever the number of ways."""
    left = {f"left_{s}_cents": F.greatest(F.lit(0), F.col(f"committed_{s}_cents") - F.col(f"a{s[0]}")) for s in ("east", "west")}
    each = [F.struct(F.lit(name).alias("way"), *[at_completion(F.col(f"a{s[0]}"), F.col(f"committed_{s}_cents"), F.col(f"p{s[0]}"), basis, mode).alias(f"eac_{s}_cents") for s in ("east", "west")]) for name, basis, mode in WAYS]
    rows = base.select("division", "gmp_cents", *[c.alias(n) for n, c in left.items()], F.explode(F.array(*each)).alias("_w")).select("division", "gmp_cents", *left, "_w.*")
    total = F.col("eac_east_cents") + F.col("eac_west_cents")
    return rows.withColumns({"eac_total_cents": total, "surplus_cents": F.col("gmp_cents") - total})


def tie_out(costs: DataFrame, by_division: DataFrame, tolerance: int = 1) -> DataFrame:
    """One row: total of all costs, total by division, and whether they agree."""
    one = costs.agg(F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("costs_cents"))
    two = by_division.agg(F.coalesce(F.sum("actual_cents"), F.lit(0)).alias("divisions_cents"))
    return one.crossJoin(F.broadcast(two)).withColumn("ties", F.abs(F.col("costs_cents") - F.col("divisions_cents")) <= tolerance)  # one row each


def row_tie_out(costs: DataFrame, by_division: DataFrame, east: str, west: str) -> DataFrame:
    """One row on two levels: every cost's sides against its amount, a cent each allowed (``rows_off``, ``rows_gap_cents``); and the sides of divisions against their costs, a cent for each cost allowed (``divisions_off``)."""
    gap = F.abs(F.col(east) + F.col(west) - F.col("amount_cents"))
    one = costs.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(gap > 1).alias("rows_off"), F.coalesce(F.sum(gap), F.lit(0)).alias("rows_gap_cents"))
    own = costs.where(F.col("division").isNotNull()).groupBy("division").agg(F.sum(F.col(east) + F.col(west)).alias("_sides"), F.count(F.lit(1)).alias("_n"))
    met = by_division.select("division", "actual_cents").join(own, "division", "full").na.fill(0)
    two = met.agg(F.count_if(F.abs(F.col("_sides") - F.col("actual_cents")) > F.col("_n")).alias("divisions_off"))
    return one.crossJoin(F.broadcast(two)).withColumn("ties", (F.col("rows_off") == 0) & (F.col("divisions_off") == 0))  # one row each


def drilldown(costs: DataFrame, top: int = 10, records: int = 20, key: Column | None = None) -> DataFrame:
    """For each division its ``top`` cost codes by size, with sums, counts and the keys of their largest costs (ties: least ``key``, which is ``cost_key`` unless given).
    Sums combine before their shuffle; then only costs of the listed codes are ranked, by amount, and Spark drops those beyond ``records`` before it shuffles them; keys are built for what is left."""
    pair = ["division", "cost_code"]
    key = F.col("cost_key") if key is None else key
    sums = costs.groupBy(*pair).agg(F.sum("amount_cents").alias("total_cents"), F.count(F.lit(1)).alias("n_costs"))
    place = F.row_number().over(Window.partitionBy("division").orderBy(F.desc(F.abs("total_cents")), "cost_code"))
    codes = sums.withColumn("place", place).where(F.col("place") <= top)
    listed = costs.join(codes.select(*pair), pair, "left_semi").withColumn("_size", F.abs("amount_cents"))
    largest = listed.withColumn("_r", F.rank().over(Window.partitionBy(*pair).orderBy(F.desc("_size")))).where(F.col("_r") <= records)
    largest = largest.select(*pair, "_size", key.alias("_key"))
    row = F.row_number().over(Window.partitionBy(*pair).orderBy(F.desc("_size"), "_key"))
    kept = largest.withColumn("r", row).where(F.col("r") <= records)
    keys = kept.groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct("r", "_key"))).alias("l"))
    return codes.join(keys, pair).withColumn("records", F.array_join(F.transform("l", lambda x: x["_key"]), ",")).drop("l")
