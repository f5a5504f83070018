"""Costs to budget codes to divisions: saved mappings first, then rules; suggestions ranked by score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import fuzzy

#: Weights of a match score, its bands, and scores of unlike cost types (alike: 1, others: 0.2).
WEIGHTS = {"code": 0.4, "type": 0.2, "text": 0.3, "history": 0.1}
BANDS, LEAST = ((0.85, "high"), (0.60, "medium")), 0.40
#: Fixed value: least likeness of a name and a description.
LIKE = 60.0
TYPE_SCORES = {("L", "S"): 0.5, ("S", "L"): 0.5, ("M", "S"): 0.4, ("S", "M"): 0.4, ("LB", "L"): 1.0, ("L", "LB"): 1.0, ("SC", "S"): 1.0, ("S", "SC"): 1.0}


def latest(saved: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One saved mapping for each key: the last one."""
    return saved.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_r") == 1).drop("_r")


def by_precedence(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of mapping sources, the first that knows a key wins; ``source`` tells which."""
    every = None
    for k, frame in enumerate(sources):
        ranked = frame.withColumn("source", F.lit(k))
        every = ranked if every is None else every.unionByName(ranked)
    return every.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("source"))).where(F.col("_r") == 1).drop("_r")


def mapped_costs(costs: DataFrame, saved: DataFrame, budgets: DataFrame) -> DataFrame:
    """(cost_key, budget_id, method, confidence): the saved budget of (cost_code, name); else, among the budgets of the code, the only one (0.9),
    the first of the cost's type (0.85), the one whose description is most like the cost's name (by sorted tokens, from ``LIKE`` on; its score), or the first (0.5). Budgets are reduced to one row a code and type before the join, so costs
    don't multiply; only distinct names that are left open are compared with their code's descriptions."""
    first = budgets.groupBy("budget_code").agg(F.count(F.lit(1)).alias("n"), F.min("budget_id").alias("any_id"))
    typed = budgets.groupBy("budget_code", "cost_type").agg(F.min("budget_id").alias("typed_id"))
    met = costs.join(saved.select("cost_code", "name", F.col("budget_id").alias("saved_id")), ["cost_code", "name"], "left")
    met = met.join(first.withColumnRenamed("budget_code", "cost_code"), "cost_code", "left").join(typed.withColumnRenamed("budget_code", "cost_code"), ["cost_code", "cost_type"], "left")
    open_ = met.where(F.col("saved_id").isNull() & (F.col("n") > 1) & F.col("typed_id").isNull())
    told = budgets.select(F.col("budget_code").alias("cost_code"), "description", F.col("budget_id").alias("like_id"))
    like = fuzzy.best_within(open_, ["cost_code"], "name", told, "description", "like_id", LIKE).select("cost_code", "name", "like_id", F.col("score").alias("_like"))
    met = met.join(like, ["cost_code", "name"], "left")
    method = F.when(F.col("saved_id").isNotNull(), "saved").when(F.col("n") == 1, "single").when(F.col("typed_id").isNotNull(), "type").when(F.col("like_id").isNotNull(), "fuzzy").when(F.col("n") > 1, "first")
    chosen = F.coalesce("saved_id", F.when(F.col("n") == 1, F.col("any_id")), "typed_id", "like_id", "any_id")
    score = F.when(method == "saved", 1.0).when(method == "single", 0.9).when(method == "type", 0.85).when(method == "fuzzy", F.col("_like") / 100).when(method == "first", 0.5).otherwise(0.0)
    return met.select("cost_key", chosen.alias("budget_id"), F.coalesce(method, F.lit("none")).alias("method"), score.alias("confidence"))


def type_score(a: Column, b: Column) -> Column:
    out = F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0)
    for (x, y), score in TYPE_SCORES.items():
        out = out.when((a == x) & (b == y), score)
    return out.otherwise(0.2)


def match_score(code: Column, kind: Column, alike: Column, history: Column, trust: Column) -> Column:
    return (code * WEIGHTS["code"] + kind * WEIGHTS["type"] + alike * WEIGHTS["text"] + history * WEIGHTS["history"]) * trust


def band(score: Column) -> Column:
    out = F.lit("low")
    for least, name in reversed(BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def trust(accepted: Column, overridden: Column) -> Column:
    return F.greatest(F.lit(0.3), (accepted + 1) / (accepted + overridden * 1.5 + 2))


#: A cost's class: costs of one class meet the same budget codes with the same scores for code and type.
CLASS = ["base_code", "cost_type"]


def candidates(classes: DataFrame, budgets: DataFrame, fill: int = 0) -> DataFrame:
    """(base_code, cost_type, budget_code) for each class: budget codes with the same base code or the same type, blanks not; classes with fewer than ``fill`` of them get the next codes in order until they have as many.
    Classes are few whatever the number of costs, and only the first ``2 * fill`` codes are broadcast."""
    some = lambda c: F.col(c) != ""
    by_code = classes.join(budgets.where(some("base_code")).select("budget_code", "base_code"), "base_code").select(*CLASS, "budget_code")
    by_type = classes.join(budgets.where(some("cost_type")).select("budget_code", "cost_type"), "cost_type").select(*CLASS, "budget_code")
    met = by_code.unionByName(by_type).distinct()
    if not fill:
        return met
    first = budgets.select("budget_code").orderBy("budget_code").limit(2 * fill)
    first = first.agg(F.sort_array(F.collect_list("budget_code")).alias("_l")).select(F.posexplode("_l").alias("_place", "budget_code"))  # at most 2 * fill codes
    return filled(met, classes, first.withColumn("_place", F.col("_place") + 1), "_place", fill, CLASS)


def filled(met: DataFrame, costs: DataFrame, budgets: DataFrame, order: str, least: int = 50, keys: list[str] | None = None) -> DataFrame:
    """Candidates, and for each cost (or each of ``keys``) with fewer than ``least`` of them the next budgets by their place in ``order``, from 1: of the first twice as many as
    are missing, those it hasn't met, until it has ``least``. The first ``2 * least`` budgets are all that is broadcast."""
    keys = keys or ["cost_key"]
    have = costs.select(*keys).join(met.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, "left").select(*keys, (least - F.coalesce("_n", F.lit(0))).alias("_short"))
    first = budgets.where(F.col(order) <= 2 * least).select("budget_code", order)
    more = have.where("_short > 0").join(F.broadcast(first), F.col(order) <= 2 * F.col("_short")).join(met, [*keys, "budget_code"], "left_anti")
    more = more.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r <= _short")
    return met.unionByName(more.select(*keys, "budget_code"))


def suggested(costs: DataFrame, budgets: DataFrame, past: DataFrame | None = None, k: int = 3, alike=None, flat: float = 0.5, fill: int = 0, kinds: DataFrame | None = None) -> DataFrame:
    """(cost_key, budget_code, score, rank, band): the k best budget codes of every cost of (cost_key, vendor, name, base_code, cost_type), by score (at least ``LEAST``), then history, then code; nulls count as blanks.

    Budgets: (budget_code, base_code, cost_type, description, history_count) and, if there, ``trust``, by which a code's scores are multiplied. ``past`` is what ``history`` gives: a code that was chosen for a cost's vendor
    and name before gets the history score if it is a candidate. ``alike`` compares a name and a description (0 to 1); without it all texts count as ``flat`` alike.

    Costs are not met with codes. Scores of code and type belong to a class, those of texts to a class and a name, so only their k best codes and the one code of a cost's history can be among its k best. With texts, each distinct name
    is compared with the codes of its class that could still reach ``LEAST`` and the class's k-th code, if their texts were equal and the others' had nothing in common. What costs share is ranked once and joined back.

    ``kinds``, if there, holds the (name, base_code, cost_type) of all costs, and maybe more, so that costs are read once, for the join. Histories that may meet a kind are those of its name's prefix. A column ``vendor_key`` of costs is
    taken as their normalised vendor, which is then worked out once for each vendor and not for each cost."""
    blank = lambda *names: {c: F.coalesce(F.col(c), F.lit("")) for c in names}
    budgets = budgets.withColumns(blank("base_code", "cost_type", "description"))
    budgets = budgets if "trust" in budgets.columns else budgets.withColumn("trust", F.lit(1.0))
    costs = _keyed(costs).select("cost_key", *[c.alias(n) for n, c in blank("vendor_key", "name", *CLASS).items()])
    own = [*CLASS, *(["name"] if alike else [])]
    keys = [*own, "_past"]
    kinds = (costs if kinds is None else kinds.withColumns(blank("name", *CLASS))).select("name", *CLASS).distinct()
    variants = kinds.select(*own, F.lit("").alias("_past"))
    if past is None:
        costs = costs.withColumn("_past", F.lit(""))
    else:
        known = past.where((F.col("vendor") != "") | (F.col("prefix") != "")).select(F.col("vendor").alias("vendor_key"), "prefix", F.col("budget_code").alias("_past"))
        prefix = text.name_prefix(F.col("name"))
        costs = costs.withColumn("prefix", prefix).join(known, ["vendor_key", "prefix"], "left").withColumns(blank("_past"))
        seen = known.where(F.col("_past") != "").select("prefix", "_past").distinct()
        variants = variants.unionByName(kinds.withColumn("prefix", prefix).join(seen, "prefix").select(*keys))
    variants = variants.distinct()

    pairs = candidates(kinds.select(*CLASS).distinct(), budgets, fill).join(budgets.withColumnsRenamed({"base_code": "_bb", "cost_type": "_bt"}), "budget_code")
    code = F.when((F.col("base_code") == F.col("_bb")) & (F.col("_bb") != ""), 1.0).otherwise(0.0)
    kind = type_score(F.col("cost_type"), F.col("_bt"))
    pairs = pairs.withColumns({"_code": code, "_kind": kind})
    scored = lambda alike, before: match_score(F.col("_code"), F.col("_kind"), alike, before, F.col("trust"))
    if alike is None:
        met = pairs.withColumn("_alike", F.lit(flat))
    else:
        low, high = scored(F.lit(0.0), F.lit(0.0)), scored(F.lit(1.0), F.lit(1.0))
        placed = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(*CLASS).orderBy(low.desc())))
        floor = F.coalesce(F.min(F.when(F.col("_r") == k, low)).over(Window.partitionBy(*CLASS)), F.lit(0.0))
        open_ = placed.withColumn("_floor", floor).where(high >= F.greatest(F.lit(LEAST), F.col("_floor")) - 1e-9).drop("_r", "_floor")
        met = kinds.join(open_, CLASS).withColumn("_alike", alike(F.col("name"), F.col("description")))
    met = met.withColumn("_place", F.row_number().over(Window.partitionBy(*own).orderBy(scored(F.col("_alike"), F.lit(0.0)).desc(), F.desc("history_count"), "budget_code")))
    more = variants.where(F.col("_past") != "").join(met.where(F.col("_place") > k), own).where(F.col("_past") == F.col("budget_code"))
    met = variants.join(met.where(F.col("_place") <= k), own).unionByName(more)
    before = F.when(F.col("_past") == F.col("budget_code"), 1.0).otherwise(0.0)
    best = top(met.withColumn("score", scored(F.col("_alike"), before)), k, keys)
    listed = best.groupBy(*keys).agg(F.collect_list(F.struct("budget_code", "score", "rank", "band")).alias("_l"))  # at most k of each
    return costs.join(listed, keys).select("cost_key", F.explode("_l").alias("_s")).select("cost_key", "_s.*")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the normalised vendor as ``vendor_key``, which callers may have worked out before."""
    return rows if "vendor_key" in rows.columns else rows.withColumn("vendor_key", text.vendor(F.col("vendor")))


def top(scored: DataFrame, k: int = 3, keys: list[str] | None = None) -> DataFrame:
    """The k best suggestions of each cost (or of ``keys``) of at least ``LEAST``: by score, then history, then code."""
    place = F.row_number().over(Window.partitionBy(*(keys or ["cost_key"])).orderBy(F.desc("score"), F.desc("history_count"), "budget_code"))
    return scored.where(F.col("score") >= LEAST).withColumn("rank", place).where(F.col("rank") <= k).withColumn("band", band(F.col("score")))


def history(feedback: DataFrame) -> DataFrame:
    """(vendor, prefix, budget_code): the newest accepted choice, before any override. A column ``vendor_key`` is taken as the normalised vendor."""
    place = F.row_number().over(Window.partitionBy("vendor", "prefix").orderBy("was_override", F.desc("created_at"), "budget_code"))
    rows = _keyed(feedback).select(F.coalesce("vendor_key", F.lit("")).alias("vendor"), text.name_prefix(F.col("name")).alias("prefix"), "budget_code", "was_override", "created_at")
    return rows.withColumn("_r", place).where(F.col("_r") == 1).select("vendor", "prefix", "budget_code")
