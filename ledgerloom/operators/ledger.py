"""Budgets to divisions, rules with markup, roll-ups of the hierarchy, and checks that its levels agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fuzzy

#: Markup on costs by rule, confidence of a division key, least scores of fuzzy matches of descriptions and of tier names.
MARKUP = {"labor": "1.15", "equipment": "1.05"}
BY_KEY, BY_DESCRIPTION, BY_TIER = 0.95, 60.0, 80.0


def budget_divisions(budgets: DataFrame, saved: DataFrame, keys: DataFrame, divisions: DataFrame) -> DataFrame:
    """(budget_id, division, confidence, method): the saved division of a code; else that of its division key if the contract lists it (names compared
    trimmed and in lower case); else the contract's division most like its description, then most like its tier's name.
    ``divisions`` (division, place) is the contract's list; distinct texts, not rows, are compared with it."""
    norm = lambda c: F.lower(F.trim(c))
    listed = divisions.groupBy(norm(F.col("division")).alias("_norm")).agg(F.max_by("division", "place").alias("_listed"))
    by_key = keys.join(listed, norm(F.col("division")) == F.col("_norm")).select("division_key", F.col("_listed").alias("_key"))
    met = budgets.join(saved.select("budget_code", F.col("division").alias("_saved"), F.col("confidence").alias("_sure")), "budget_code", "left").join(by_key, "division_key", "left")
    tier = F.when(F.col("tier2").contains(" - "), F.regexp_extract("tier2", "^.*? - (.*)$", 1)).otherwise(F.col("tier2"))
    met = met.withColumn("_tier", tier)
    open_ = met.where(F.col("_saved").isNull() & F.col("_key").isNull())
    told = fuzzy.best_match(open_, "description", divisions, "division", fuzzy.token_sort_ratio, BY_DESCRIPTION, "place").select("description", F.col("division").alias("_told"), F.col("score").alias("_told_score"))
    tiers = fuzzy.best_match(open_, "_tier", divisions, "division", fuzzy.token_sort_ratio, BY_TIER, "place").select("_tier", F.col("division").alias("_tiered"), F.col("score").alias("_tier_score"))
    met = met.join(told, "description", "left").join(tiers, "_tier", "left")
    steps = [("_saved", F.col("_sure"), "saved"), ("_key", F.lit(BY_KEY), "division_key"), ("_told", F.col("_told_score") / 100, "fuzzy_description"), ("_tiered", F.col("_tier_score") / 100, "fuzzy_tier")]
    method, sure = F.lit("unmapped"), F.lit(0.0)
    for name, score, label in reversed(steps):
        method, sure = F.when(F.col(name).isNotNull(), label).otherwise(method), F.when(F.col(name).isNotNull(), score).otherwise(sure)
    return met.select("budget_id", F.coalesce(*[n for n, _, _ in steps]).alias("division"), sure.alias("confidence"), method.alias("method"))


def mapping_stats(mapped: DataFrame, column: str) -> DataFrame:
    """One row: rows, mapped rows and their share in percent."""
    return mapped.agg(F.count(F.lit(1)).alias("n"), F.count(column).alias("n_mapped")).withColumn("pct_mapped", F.round(F.coalesce(F.try_divide(F.col("n_mapped") * 100.0, F.col("n")), F.lit(0.0)), 6))


def weighted_share(rows: DataFrame, keys: list[str], amount: str, pct: str) -> DataFrame:
    """Sum of ``amount`` and the mean of ``pct`` that it weighs; null where the sum isn't positive."""
    sums = rows.groupBy(*keys).agg(F.sum(amount).alias(amount), F.sum(F.col(amount) * F.col(pct)).alias("_w"))
    return sums.select(*keys, amount, F.when(F.col(amount) > 0, F.round(F.col("_w") / F.col(amount), 6)).alias(pct))


def row_splits(costs: DataFrame, east: str, west: str) -> DataFrame:
    """(division, actual_cents, east_cents, west_cents) by the rows' own splits where they tie out to a cent a row, else by halves; the larger remainder is rounded up."""
    sums = costs.where(F.col("division").isNotNull()).groupBy("division").agg(F.sum("amount_cents").alias("actual_cents"), F.count(F.lit(1)).alias("n"), F.sum(east).alias("_e"), F.sum(west).alias("_w"))
    close = (F.col("_e") + F.col("_w") > 0) & (F.abs(F.col("_e") + F.col("_w") - F.col("actual_cents")) <= F.col("n"))
    e = F.when(close, F.round(F.col("actual_cents") * F.try_divide(F.col("_e").cast("double"), F.col("_e") + F.col("_w")))).otherwise(F.ceil(F.col("actual_cents") / 2.0)).cast("long")
    return sums.select("division", "actual_cents", e.alias("east_cents"), (F.col("actual_cents") - e).alias("west_cents"), close.alias("from_rows"))


def rule_of(code: Column, rules: list[tuple[str, str]]) -> Column:
    """The name of the first rule, in order of priority, whose pattern matches at the code's start."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(code.rlike(f"^(?:{pattern})"), F.lit(name)).otherwise(out)
    return out


def marked_up(cents: Column, rule: Column) -> Column:
    """Cents times the rule's markup, half up; rules without one cost what they cost."""
    factor = F.lit("1.00")
    for name, value in MARKUP.items():
        factor = F.when(rule == name, F.lit(value)).otherwise(factor)
    return F.round(cents.cast("decimal(20,0)") * factor.cast("decimal(5,2)"), 0).cast("long")


def vertical_check(budgets: DataFrame, contract: DataFrame, tolerance: int = 0) -> DataFrame:
    """(division, contract_cents, budget_cents, gap_cents, agrees) of every division that either level knows."""
    below = budgets.groupBy("division").agg(F.sum("current_budget_cents").alias("budget_cents"))
    met = contract.select("division", F.col("sov_cents").alias("contract_cents")).join(below, "division", "full").na.fill(0)
    gap = F.col("contract_cents") - F.col("budget_cents")
    return met.withColumns({"gap_cents": gap, "agrees": F.abs(gap) <= tolerance})


def hierarchy(budgets: DataFrame, costs: DataFrame) -> DataFrame:
    """(division, budget_code, n_budgets, budget_cents, actual_cents, committed_cents, eac_cents, surplus_cents): codes below divisions; the costs of a budget
    count once, by its id, before levels are joined."""
    spent = costs.groupBy(F.col("l_partkey").alias("budget_id")).agg(F.sum("amount_cents").alias("actual_cents"))
    lines = budgets.join(spent, "budget_id", "left").na.fill(0, ["actual_cents"])
    sums = lines.groupBy("division", "budget_code").agg(F.count(F.lit(1)).alias("n_budgets"), *[F.sum(a).alias(b) for a, b in (("current_budget_cents", "budget_cents"), ("actual_cents", "actual_cents"), ("committed_cents", "committed_cents"))])
    eac = F.greatest("actual_cents", "committed_cents")
    return sums.withColumns({"eac_cents": eac, "surplus_cents": F.col("budget_cents") - eac})


def latest_overrides(log: DataFrame, keys: list[str], order: str, fallback: DataFrame) -> DataFrame:
    """The newest entry of each key in an append-only log; cleared entries (null values) and keys without one fall back."""
    values = [c for c in log.columns if c not in (*keys, order)]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v"))
    met = fallback.join(newest, keys, "left")
    return met.select(*keys, *[F.coalesce(F.col("_v").getField(c), F.col(c)).alias(c) for c in values], F.coalesce(F.col("_v").getField(values[0]).isNotNull(), F.lit(False)).alias("overridden"))


def page(rows: DataFrame, sort: str, offset: int, limit: int, unmapped_first: bool = False) -> DataFrame:
    """One page of items by one of the sorts; ties go by key."""
    orders = {"date_desc": F.desc("date"), "date_asc": F.asc("date"), "amount_desc": F.desc(F.abs("amount_cents")), "amount_asc": F.asc(F.abs("amount_cents")), "vendor": F.asc(F.lower("vendor"))}
    first = [F.col("division").isNotNull()] if unmapped_first else []
    return rows.orderBy(*first, orders[sort], "cost_key").offset(offset).limit(limit)


def entity_rollup(lines: DataFrame) -> DataFrame:
    """Divisions from (division, budget_cents, eac_cents, surplus_cents, committed_cents): sums, and the share of lines over budget as mean risk."""
    return lines.groupBy("division").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("budget_cents").alias("budget_cents"), F.sum("eac_cents").alias("eac_cents"), F.sum("surplus_cents").alias("surplus_cents"),
        F.round(F.avg(F.when(F.col("surplus_cents") < 0, 1.0).otherwise(0.0)), 6).alias("mean_risk"), F.floor(F.sum("budget_cents") * 0.05).cast("long").alias("contingency_cents"), F.floor(F.sum("budget_cents") * 0.03).cast("long").alias("fee_cents"),
    )


def _same(keys: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]


def on_side(costs: DataFrame, mappings: DataFrame, side: str | None, keys: list[str], include_both: bool = True) -> DataFrame:
    """Costs whose ``keys`` are mapped (keys, side) to a side. ``EAST`` and ``WEST`` take what is mapped to ``BOTH`` too, unless ``include_both`` is off; ``BOTH`` takes itself only. All costs stay if no side is asked for,
    or if nothing is mapped to it. Nulls in keys are equal to each other. A cost comes once however many mappings it has."""
    if side is None:
        return costs
    sides = [side, "BOTH"] if include_both and side != "BOTH" else [side]
    mapped = mappings.where(F.col("side").isin(*sides)).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    any_ = mapped.agg((F.count(F.lit(1)) == 0).alias("_none"))
    met = costs.join(mapped.withColumn("_hit", F.lit(True)), _same(keys), "left").crossJoin(F.broadcast(any_))  # one row
    return met.where(F.col("_hit") | F.col("_none")).select(*costs.columns)


def off_side(costs: DataFrame, mappings: DataFrame, keys: list[str]) -> DataFrame:
    """Costs whose ``keys`` have no mapping; nulls are equal to each other."""
    known = mappings.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return costs.join(known, _same(keys), "left_anti")
