"""Lists in a stated order: row ids by position, newest first, largest first, and the budgets of trades whose names differ in punctuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most entries of a history, of snapshots, and of either when asked for more.
HISTORY, SNAPSHOTS, MOST = 50, 20, 200


def numbered(frame: DataFrame, first: str, order: list[str], name: str = "row_id", ranges: int = 200) -> DataFrame:
    """Rows with their position from 0 in the order of ``first`` (numeric, not null) and ``order``, which must tell rows apart; ids stay the same when rows are filtered afterwards.
    No task sees all rows: ``first`` is cut into ranges at approximate quantiles, rows are numbered in their range, and the sizes of the (at most ``ranges`` + 1) ranges before are added.
    Quantiles that are off make ranges uneven, and never an id wrong. All rows of one value of ``first`` share a range."""
    cuts = frame.agg(F.percentile_approx(first, F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), 10_000).alias("_cuts"))
    placed = frame.crossJoin(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(first)))).drop("_cuts")  # one row
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).select("_range", "_before")  # at most `ranges` + 1 rows
    place = F.row_number().over(Window.partitionBy("_range").orderBy(first, *order))
    return placed.withColumn("_place", place).join(before, "_range").withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_range", "_place", "_before")


def newest(rows: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """The ``limit`` (1 to ``MOST``) newest rows of each key with their ``place``; the later columns of ``order`` break ties, largest first. Rows without a first ``order`` come last."""
    limit = max(1, min(limit, MOST))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order]))
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def by_contribution(activities: DataFrame, contribution: Column, keys: list[str]) -> DataFrame:
    """Activities with their ``place`` in each key: largest contribution first, then the earliest start, then the least id."""
    return activities.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(contribution.desc(), F.asc_nulls_last("start_date"), "activity_id")))


def top_trades(activities: DataFrame, trade: str, cost: str, contribution: Column, trades: int = 10, each: int = 5) -> DataFrame:
    """The ``trades`` trades of most cost with their totals, and the ``each`` activities of each that contribute most."""
    totals = activities.groupBy(trade).agg(F.sum(cost).alias("trade_cost"), F.count(F.lit(1)).alias("n_activities"))
    first = totals.orderBy(F.desc("trade_cost"), trade).limit(trades)
    return by_contribution(activities.join(first, trade), contribution, [trade]).where(F.col("place") <= each)


def trade_key(name: Column) -> Column:
    """A trade's name in lower case without punctuation, words parted by one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def trade_budgets(trades: DataFrame, budgets: DataFrame, normalised: bool = False) -> DataFrame:
    """(trade, budget_cents) of every trade; a trade that no budget names has 0 and gets no costs allocated. Names must be equal; ``normalised`` compares them by ``trade_key``, and budgets with one key add up."""
    key = trade_key if normalised else lambda c: c
    sums = budgets.groupBy(key(F.col("division")).alias("_key")).agg(F.sum("current_budget_cents").alias("budget_cents"))
    return trades.join(sums, key(F.col("trade")) == F.col("_key"), "left").drop("_key").na.fill(0, ["budget_cents"])


def reloaded(rows: DataFrame, kind: str, assigned: Column) -> DataFrame:
    """One row on a table that was read anew: rows, those of no zone, and whether someone must act."""
    one = rows.agg(F.lit(kind).alias("file_type"), F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(assigned, F.lit(False))).alias("unassigned_zone_count"))
    return one.withColumn("action_required", F.col("unassigned_zone_count") > 0)
