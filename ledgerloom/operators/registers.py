"""Kept tables and their changes: cached suggestions, new contract lines, forecast settings with their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Settings of a division that has none saved.
DEFAULTS = {"method": "evm", "performance_factor": 1.0, "distribution": "linear", "created_by": "system"}


def exists(frame: DataFrame, condition: Column) -> bool:
    return not frame.where(condition).isEmpty()


def cached(old: DataFrame, suggestions: DataFrame, now: Column) -> DataFrame:
    """One fresh row for each suggested cost (cost_key, suggestions as JSON by rank, top_score, computed_at, stale); rows of other costs stay as in ``old``.
    A cost has few suggestions, as they are ranked and cut before."""
    item = F.struct("rank", "budget_code", "score", "band")
    new = suggestions.groupBy("cost_key").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("suggestions"), F.max("score").alias("top_score"))
    new = new.select("*", now.alias("computed_at"), F.lit(False).alias("stale"))
    return old.join(new.select("cost_key"), "cost_key", "left_anti").unionByName(new)


def fresh(cache: DataFrame) -> DataFrame:
    return cache.where(~F.col("stale"))


def outdated(cache: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """All rows stale, or only those of the cost keys in ``touched``."""
    if touched is None:
        return cache.withColumn("stale", F.lit(True))
    hit = touched.select("cost_key", F.lit(True).alias("_hit")).distinct()
    return cache.join(hit, "cost_key", "left").withColumn("stale", F.col("stale") | F.col("_hit").isNotNull()).drop("_hit")


def checked_lines(old: DataFrame, new: DataFrame, keys: list[str], amount: str, order: str) -> DataFrame:
    """New lines with a ``problem``: ``duplicate`` if the key has a line, or an acceptable one earlier among the new by ``order``; ``not positive``;
    null for those to enter. ``order`` is unique."""
    known = old.select(*keys, F.lit(True).alias("_known")).distinct()
    first = new.where(F.col(amount) > 0).groupBy(*keys).agg(F.min(order).alias("_first"))
    met = new.join(known, keys, "left").join(first, keys, "left")
    twice = F.col("_known").isNotNull() | (F.col("_first") < F.col(order))
    problem = F.when(twice, "duplicate").when(~F.coalesce(F.col(amount) > 0, F.lit(False)), "not positive")
    return met.withColumn("problem", problem).drop("_known", "_first")


def settings(divisions: DataFrame, saved: DataFrame) -> DataFrame:
    """The saved settings of every division, or the defaults; a null in a saved row takes its default too."""
    return divisions.select("division").distinct().join(saved, "division", "left").na.fill(DEFAULTS)


def changed_methods(current: DataFrame, changes: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Settings after ``changes`` (division, new_method; one a division), and an audit row of each method that became another one."""
    met = current.join(changes, "division", "left")
    after = met.withColumn("method", F.coalesce("new_method", "method")).drop("new_method")
    audit = met.where(F.col("new_method") != F.col("method"))
    return after, audit.select("division", F.lit("method_change").alias("action"), F.lit("method").alias("field"), F.col("method").alias("old_value"), F.col("new_method").alias("new_value"), F.lit(by).alias("changed_by"))
