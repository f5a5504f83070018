"""Changes to kept tables, a batch at a time: budgets under their ceiling, costs, change orders, progress, bridges, and what past mappings teach.
Requests carry a unique ``seq``; those refused come back with a ``problem`` and change nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States that a change order may be set to.
STATUSES = ("draft", "pending", "approved")


def newest(requests: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last request of each key. Combines before its shuffle, so a key with many requests is no burden."""
    values = [c for c in requests.columns if c not in keys]
    return requests.groupBy(*keys).agg(F.max_by(F.struct(*values), seq).alias("_v")).select(*keys, "_v.*")


def _over_ceiling(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The ``seq`` of requests that would lift their division's total over its ceiling, which those taken before may have lifted. Rows come by division and ``seq``; only a total is kept."""
    division, total = None, 0
    for batch in batches:
        refused = []
        for name, seq, delta, start, ceiling in zip(batch["division"], batch["seq"], batch["delta"], batch["total_cents"], batch["ceiling_cents"]):
            if name != division:
                division, total = name, int(start)
            if total + int(delta) <= int(ceiling):
                total += int(delta)
            else:
                refused.append(seq)
        yield pd.DataFrame({"seq": pd.Series(refused, dtype="int64")})


def checked_amounts(contract: DataFrame, budgets: DataFrame, spent: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (seq, budget_id, division, new_cents) for amounts of budgets; an unknown budget is to be created in ``division``. ``contract`` has (division, ceiling_cents), ``spent`` (budget_id, actual_cents).
    Of several requests for one budget the last counts. Returns seq, budget_id, division, old_cents, new_cents, created, headroom_cents (what the ceiling leaves for this budget before the batch) and ``problem``:
    ``no contract``, ``no amount``, ``below actual``, ``over ceiling`` (by the order of ``seq``, with what was taken before), or null.
    Divisions that keep their ceiling even if all their increases are taken need no order and are settled by sums; only the others are walked, each in one task that keeps one total."""
    known = budgets.select("budget_id", F.col("division").alias("_division"), F.col("current_budget_cents").alias("_old"))
    met = newest(requests, ["budget_id"]).join(known, "budget_id", "left").join(spent, "budget_id", "left")
    met = met.select(
        "seq", "budget_id", F.coalesce("_division", "division").alias("division"), F.coalesce("_old", F.lit(0)).cast("long").alias("old_cents"), "new_cents",
        F.col("_division").isNull().alias("created"), F.coalesce("actual_cents", F.lit(0)).alias("_actual"),
    )
    totals = budgets.groupBy("division").agg(F.sum("current_budget_cents").alias("total_cents"))
    limits = contract.select("division", "ceiling_cents").join(totals, "division", "left").na.fill(0, ["total_cents"])
    early = F.when(F.col("ceiling_cents").isNull(), "no contract").when(F.col("new_cents").isNull(), "no amount").when(F.col("new_cents") < F.col("_actual"), "below actual")
    rows = met.join(limits, "division", "left").withColumn("_early", early).withColumn("delta", F.col("new_cents") - F.col("old_cents"))
    fit = rows.where(F.col("_early").isNull())
    rises = fit.groupBy("division").agg(F.sum(F.greatest("delta", F.lit(0))).alias("_rise"), F.any_value("total_cents").alias("_t"), F.any_value("ceiling_cents").alias("_c"))
    tight = rises.where(F.col("_t") + F.col("_rise") > F.col("_c")).select("division")
    walked = fit.join(tight, "division", "left_semi").select("division", "seq", "delta", "total_cents", "ceiling_cents").repartition("division").sortWithinPartitions("division", "seq")
    refused = walked.mapInPandas(_over_ceiling, "seq long").withColumn("_over", F.lit("over ceiling"))
    headroom = F.col("ceiling_cents") - (F.col("total_cents") - F.col("old_cents"))
    return rows.join(refused, "seq", "left").select("seq", "budget_id", "division", "old_cents", "new_cents", "created", headroom.alias("headroom_cents"), F.coalesce("_early", "_over").alias("problem"))


def with_amounts(budgets: DataFrame, checked: DataFrame) -> DataFrame:
    """Budgets after the requests that ``checked_amounts`` lets pass; created ones have nulls in all columns but id, division and amount."""
    passed = checked.where(F.col("problem").isNull()).select("budget_id", "division", "created", F.col("new_cents").alias("_new"))
    old = budgets.join(passed.where(~F.col("created")).select("budget_id", "_new"), "budget_id", "left").withColumn("current_budget_cents", F.coalesce("_new", "current_budget_cents")).drop("_new")
    made = passed.where("created").select("budget_id", "division", F.col("_new").alias("current_budget_cents"))
    return old.select(*budgets.columns).unionByName(made, allowMissingColumns=True)


def without_deleted(budgets: DataFrame, costs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Budgets without those of ``ids`` that no cost (budget_id) is mapped to, and (budget_id, n_costs) of those that stay for their costs."""
    asked = ids.select("budget_id").distinct()
    used = costs.join(asked, "budget_id", "left_semi").groupBy("budget_id").agg(F.count(F.lit(1)).alias("n_costs"))
    kept = budgets.join(asked.join(used, "budget_id", "left_anti"), "budget_id", "left_anti")
    return kept, used.join(budgets.select("budget_id"), "budget_id", "left_semi")


def entered_costs(requests: DataFrame, budgets: DataFrame, today: Column) -> DataFrame:
    """New costs (cost_key, budget_id, vendor, date, amount_cents): the zone is that of the budget, a missing date is ``today``, vendors get their normal form. ``problem`` tells of budgets that don't exist; a cost without a budget may enter, without a zone."""
    own = budgets.select("budget_id", F.col("zone").alias("_zone"), F.lit(True).alias("_known"))
    met = requests.join(own, "budget_id", "left")
    problem = F.when(F.col("budget_id").isNotNull() & F.col("_known").isNull(), "no budget")
    return met.withColumns({"zone": F.col("_zone"), "date": F.coalesce("date", today), "vendor_normalized": F.lower(F.trim("vendor")), "problem": problem}).drop("_zone", "_known")


def moved_costs(costs: DataFrame, requests: DataFrame, budgets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Costs (cost_key, budget_id, zone, ...) moved by requests (seq, cost_key, new_id; null unmaps), the last of each cost counts; a moved cost takes the zone of its new budget, an unmapped one has none.
    Also the budgets touched, old and new, each once, and the refused requests with ``problem``."""
    own = budgets.select(F.col("budget_id").alias("new_id"), F.col("zone").alias("_zone"), F.lit(True).alias("_known"))
    last = newest(requests, ["cost_key"]).join(own, "new_id", "left")
    unknown = F.col("new_id").isNotNull() & F.col("_known").isNull()
    good = last.where(~unknown).select("cost_key", "new_id", "_zone", F.lit(True).alias("_asked"))
    met = costs.join(good, "cost_key", "left")
    asked = F.col("_asked").isNotNull()
    after = met.withColumns({"budget_id": F.when(asked, F.col("new_id")).otherwise(F.col("budget_id")), "zone": F.when(asked, F.col("_zone")).otherwise(F.col("zone"))}).select(*costs.columns)
    touched = met.where(asked).select(F.explode(F.array("budget_id", "new_id")).alias("budget_id")).where(F.col("budget_id").isNotNull()).distinct()
    absent = last.join(costs.select("cost_key"), "cost_key", "left_anti").select("seq", "cost_key", F.lit("no cost").alias("problem"))
    return after, touched, last.where(unknown).join(costs.select("cost_key"), "cost_key", "left_semi").select("seq", "cost_key", F.lit("no budget").alias("problem")).unionByName(absent)


def change_orders(contract: DataFrame, orders: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders (division, number, status, cents) after requests (seq, kind, division, number, status, cents) of kind ``create``, ``update`` or ``approve``, and all requests with ``problem``:
    ``no contract`` and ``exists`` for creations; ``not found``; ``invalid status``; ``already approved`` for approvals; ``unknown kind``. Creations are drafts; nulls of an update leave what is there.
    Every request is judged by what those before it, of the same division and number, left."""
    first = orders.select("division", "number", F.lit(None).cast("long").alias("seq"), F.lit("old").alias("kind"), "status", "cents")
    rows = first.unionByName(requests.select("division", "number", "seq", "kind", "status", "cents"))
    rows = rows.join(contract.select("division").distinct().withColumn("_listed", F.lit(True)), "division", "left")
    kind = F.col("kind")
    bad = F.when((kind == "create") & F.col("_listed").isNull(), "no contract").when((kind == "update") & F.col("status").isNotNull() & ~F.col("status").isin(*STATUSES), "invalid status")
    bad = bad.when(~F.coalesce(kind.isin("old", "create", "update", "approve"), F.lit(False)), "unknown kind")
    rows = rows.withColumn("_bad", bad)
    by = Window.partitionBy("division", "number").orderBy(F.asc_nulls_first("seq"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    makes = F.col("_bad").isNull() & kind.isin("old", "create")
    rows = rows.withColumn("_there", F.coalesce(F.max(makes).over(before), F.lit(False)))
    # a creation counts only as the first, and nothing counts before it
    late = F.when(F.col("_bad").isNotNull(), F.col("_bad")).when((kind == "create") & F.col("_there"), "exists").when(kind.isin("update", "approve") & ~F.col("_there"), "not found")
    sets = F.when(late.isNull(), F.when(kind == "create", "draft").when(kind == "approve", "approved").otherwise(F.col("status")))
    rows = rows.withColumns({"_late": late, "_sets": sets})
    was = F.last("_sets", ignorenulls=True).over(before)
    rows = rows.withColumn("problem", F.when(F.col("_late").isNotNull(), F.col("_late")).when((kind == "approve") & (was == "approved"), "already approved"))
    good = rows.where(F.col("problem").isNull())
    place = F.coalesce("seq", F.lit(-1))
    after = good.groupBy("division", "number").agg(F.max_by("_sets", F.when(F.col("_sets").isNotNull(), place)).alias("status"), F.max_by("cents", F.when(F.col("cents").isNotNull() & (kind != "approve"), place)).alias("cents"))
    return after, rows.where(kind.isNull() | (kind != "old")).select("seq", "division", "number", "kind", "problem")


def progressed(activities: DataFrame, updates: DataFrame) -> DataFrame:
    """Activities (activity_id, pct_complete, ...) after updates (seq, activity_id, pct), held within 0 and 100, with progress_pct, is_complete and is_in_progress; a null update changes nothing."""
    last = newest(updates.where(F.col("pct").isNotNull()), ["activity_id"]).select("activity_id", F.greatest(F.lit(0), F.least(F.lit(100), F.col("pct"))).alias("_pct"))
    met = activities.join(last, "activity_id", "left").withColumn("pct_complete", F.coalesce("_pct", "pct_complete", F.lit(0))).drop("_pct")
    pct = F.col("pct_complete")
    return met.withColumns({"progress_pct": pct / 100.0, "is_complete": pct == 100, "is_in_progress": (pct > 0) & (pct < 100)})


def bridged(bridge: DataFrame, requests: DataFrame) -> DataFrame:
    """The bridge (activity_id, division, weight) after requests (seq, kind, activity_id, division, weight) of kind ``add`` or ``remove``; the last of each pair counts, an added pair has one row, with weight 1 if none is given."""
    last = newest(requests, ["activity_id", "division"])
    added = last.where("kind = 'add'").select("activity_id", "division", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return bridge.select("activity_id", "division", "weight").join(last, ["activity_id", "division"], "left_anti").unionByName(added)


def backfilled(mappings: DataFrame, feedback: DataFrame, now: Column) -> DataFrame:
    """Feedback rows (vendor, prefix, budget_code, confidence, created_at, was_override) of mappings (the same but was_override) whose pattern ``feedback`` lacks: one a pattern, with the confidence of the earliest. Patterns without vendor and prefix are left out; a missing time counts as ``now``."""
    keys = ["vendor", "prefix", "budget_code"]
    text = {c: F.coalesce(c, F.lit("")) for c in keys[:2]}
    rows = mappings.withColumns({**text, "created_at": F.coalesce("created_at", now)}).where((F.col("vendor") != "") | (F.col("prefix") != ""))
    first = rows.groupBy(*keys).agg(F.min(F.struct("created_at", "confidence")).alias("f")).select(*keys, F.col("f.confidence").alias("confidence"), F.col("f.created_at").alias("created_at"), F.lit(False).alias("was_override"))
    seen = feedback.select(*[F.coalesce(c, F.lit("")).alias(f"_{c}") if c in text else F.col(c).alias(f"_{c}") for c in keys])
    return first.join(seen, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], "left_anti")


def match_stats(mappings: DataFrame, stats: DataFrame) -> DataFrame:
    """(budget_code, total_matches, override_count, trust_score): counts anew of every code that mappings name, with a known code's overrides and trust kept and those of a new code 0 and 1; codes that no mapping names stay as they are."""
    counts = mappings.where(F.coalesce("budget_code", F.lit("")) != "").groupBy("budget_code").agg(F.count(F.lit(1)).alias("_n"))
    met = stats.select("budget_code", "total_matches", "override_count", "trust_score").join(counts, "budget_code", "full")
    return met.select("budget_code", F.coalesce("_n", "total_matches").alias("total_matches"), F.coalesce("override_count", F.lit(0)).alias("override_count"), F.coalesce("trust_score", F.lit(1.0)).alias("trust_score"))
