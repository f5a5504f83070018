"""One row of figures for a whole project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dashboard(contract: DataFrame, costs: DataFrame, snapshots: DataFrame, activities: DataFrame) -> DataFrame:
    """The contract with its approved change orders (ceiling_cents), costs (amount_cents), what current snapshots (is_current, etc_cents, ev_cents) leave to spend, and the schedule (planned_finish, finish_date, progress, weight).
    Earned value is that of the snapshots; if they have none, the schedule's weighted progress of the contract. ``cpi`` is null without earned value or costs, ``variance_cents`` without a contract, ``schedule_variance_days``
    (whole days, rounded down, positive ahead) without activities of both dates; ``warnings`` tells which. Every table is summed by itself to one row."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    one = contract.agg(zero(F.sum("ceiling_cents")).alias("budget_cents"))
    two = costs.agg(zero(F.sum("amount_cents")).alias("actual_cents"))
    three = snapshots.where("is_current").agg(F.count(F.lit(1)).alias("_n"), zero(F.sum("etc_cents")).alias("etc_cents"), zero(F.sum("ev_cents")).alias("_ev"))
    early = F.when(F.col("planned_finish").isNotNull() & F.col("finish_date").isNotNull(), F.datediff("planned_finish", "finish_date"))
    weight = F.sum("weight")
    four = activities.agg(F.floor(F.sum(early) / F.count(early)).cast("long").alias("schedule_variance_days"), F.when(weight > 0, F.sum(F.col("weight") * F.col("progress")) / weight).alias("_progress"))
    row = one.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(three)).crossJoin(F.broadcast(four))  # one row each
    eac = F.col("actual_cents") + F.col("etc_cents")
    share = F.when(eac > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("actual_cents") / eac * 100))).otherwise(0.0)
    proxy = F.when(F.col("budget_cents") > 0, (F.col("budget_cents") * F.col("_progress")).cast("long"))
    ev = F.when(F.col("_ev") > 0, F.col("_ev")).when(proxy > 0, proxy)
    row = row.withColumns({"eac_cents": eac, "variance_cents": F.when(F.col("budget_cents") > 0, F.col("budget_cents") - eac), "progress_pct": F.round(share, 1), "cpi": F.when(F.col("actual_cents") > 0, F.round(ev / F.col("actual_cents"), 3))})
    told = [(F.col("budget_cents") == 0, "no contract"), (F.col("_n") == 0, "no forecast"), (F.col("cpi").isNull() & (F.col("actual_cents") > 0), "no earned value"), (F.col("schedule_variance_days").isNull(), "no schedule")]
    warnings = F.array_join(F.array_compact(F.array(*[F.when(test, name) for test, name in told])), ",")
    return row.select("budget_cents", "actual_cents", "etc_cents", "eac_cents", "variance_cents", "progress_pct", "cpi", "schedule_variance_days", warnings.alias("warnings"))
