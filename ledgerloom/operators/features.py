"""Feature tables for forecasting models, and a least-squares line for each group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import week_start
from . import quantiles


def weekly_panel(costs: DataFrame, budgets: DataFrame) -> DataFrame:
    """(division, week) with sums, running sums, what is left of half the budget, and calendar features."""
    weeks = costs.where(F.col("division").isNotNull()).groupBy("division", week_start(F.col("date")).alias("week")).agg(F.sum("amount_cents").alias("cents"), F.count(F.lit(1)).alias("n_costs"))
    run = Window.partitionBy("division").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    total = budgets.groupBy("division").agg(F.sum("current_budget_cents").alias("bac"))
    rows = weeks.withColumn("cumulative_cents", F.sum("cents").over(run)).join(total, "division", "left")
    return rows.withColumns({
        "remaining_half_cents": F.expr("bac div 2") - F.col("cumulative_cents"), "month": F.month("week"), "quarter": F.quarter("week"), "day_of_year": F.dayofyear("week"), "iso_week": F.weekofyear("week"), "year": F.year("week"),
    })


def rolling(daily: DataFrame, key: str, value: str, spans: tuple[int, ...] = (30, 60, 90)) -> DataFrame:
    """Sums over the last n days (the day itself counts), from one row a day."""
    number = F.datediff("date", F.lit("1970-01-01"))
    by = Window.partitionBy(key).orderBy(number)
    return daily.withColumns({f"{value}_{n}d": F.sum(value).over(by.rangeBetween(-(n - 1), 0)) for n in spans})


def temporal(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Lags, centred mean of three (ends padded with 0), trailing population deviation of three, difference, and mean of the last six."""
    by = Window.partitionBy(key).orderBy(order)
    v = F.col(value).cast("double")
    lag = F.coalesce(F.lag(v, 1).over(by), v)
    return rows.withColumns({
        "lag1": F.lag(value, 1).over(by), "lag2": F.lag(value, 2).over(by), "mean3": F.sum(v).over(by.rowsBetween(-1, 1)) / 3,
        "sd3": F.stddev_pop(v).over(by.rowsBetween(-2, 0)), "change": v - lag, "velocity": F.avg(v).over(by.rowsBetween(-5, 0)) / 30,
    })


def sequences(rows: DataFrame, key: str, order: str, value: str, length: int) -> DataFrame:
    """Each row with the ``length`` values before it, where there are so many."""
    by = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("history", F.collect_list(value).over(by.rowsBetween(-length, -1))).where(F.size("history") == length).withColumnRenamed(value, "target")


def time_split(rows: DataFrame, key: str, order: str, share: float = 0.8) -> DataFrame:
    """``part``: train for the earlier rows of each key, test for the rest."""
    place, n = F.row_number().over(Window.partitionBy(key).orderBy(order)), F.count(F.lit(1)).over(Window.partitionBy(key))
    return rows.withColumn("part", F.when(place <= F.floor(n * share), "train").otherwise("test"))


def tier(n: Column) -> Column:
    """Sequence length by months of history."""
    return F.when(n >= 24, 12).when(n >= 12, 6).when(n >= 5, 3).otherwise(0)


def signed_log(value: Column) -> Column:
    return F.signum(value) * F.log1p(F.abs(value))


def robust_scaled(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``scaled``: signed log of an integer, less the key's median, over its quartile range (1 where that is 0), clipped to 5 either way; with ``median``
    and ``spread``, by which ``restored`` undoes it. Quartiles are exact and need no group in memory."""
    stats = quantiles.exact(rows, [key], F.col(value), [0.25, 0.5, 0.75], signed_log).withColumnRenamed(key, "_key")
    q = F.col("quantiles")
    stats = stats.select("_key", q[1].alias("median"), F.when(q[2] > q[0], q[2] - q[0]).otherwise(1.0).alias("spread"))
    joined = rows.join(stats, rows[key].eqNullSafe(stats["_key"])).drop("_key")
    z = (signed_log(F.col(value)) - F.col("median")) / F.col("spread")
    return joined.withColumn("scaled", F.least(F.lit(5.0), F.greatest(F.lit(-5.0), z)))


def restored(scaled: Column, median: Column, spread: Column) -> Column:
    """The value that ``robust_scaled`` scaled; what it clipped comes back as the bound."""
    log = scaled * spread + median
    return F.signum(log) * F.expm1(F.abs(log))


def _products(features: list[str], y: str) -> list[Column]:
    """Upper triangle of the normal equations' matrix, then its right side, for one row."""
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    return [p * q for i, p in enumerate(columns) for q in columns[i:]] + [p * F.col(y).cast("double") for p in columns]


def _solved(size: int):
    """Arrow UDF: coefficients from sums of ``_products``; the least-squares ones of least norm where features depend on each other."""

    def solve(s: pd.Series) -> pd.Series:
        out = []
        for row in s:
            m = np.zeros((size, size))
            m[np.triu_indices(size)] = row[: size * (size + 1) // 2]
            m = m + m.T - np.diag(np.diag(m))
            right = np.asarray(row[-size:])
            out.append(np.linalg.solve(m, right) if np.linalg.matrix_rank(m) == size else np.linalg.lstsq(m, right, rcond=None)[0])
        return pd.Series(out)

    return F.pandas_udf(solve, "array<double>")


def _applied(coefficients: Column, features: list[str]) -> Column:
    total = coefficients[0]
    for i, c in enumerate(features):
        total = total + coefficients[i + 1] * F.col(c).cast("double")
    return total


def split_errors(rows: DataFrame, keys: list[str], order: str, features: list[str], y: str, most: int = 5) -> DataFrame:
    """(keys, n, n_folds, mae): mean absolute error of least squares on ``features`` over min(``most``, n div 3) expanding folds in time; 0 without
    folds, for groups of fewer than 5 rows or 2 folds. A fold's model needs the sums of all rows before it: running sums give
    them for all folds in one pass, and only a fold's coefficients are solved in numpy."""
    by = Window.partitionBy(*keys)
    n, i = F.count(F.lit(1)).over(by), F.row_number().over(by.orderBy(order)) - 1
    own = rows.select(*keys, order, *[c for c in {*features} if c != order], F.col(y).alias("_y")).withColumns({"n": n, "i": i})
    folds = F.when((F.col("n") >= 5) & (F.expr("n div 3") >= 2), F.least(F.lit(most), F.expr("n div 3"))).otherwise(0)
    own = own.withColumn("n_folds", folds).withColumn("size", F.expr("n div (n_folds + 1)"))
    own = own.withColumn("fold", F.expr("CASE WHEN n_folds > 0 AND i >= n - n_folds * size THEN (i - (n - n_folds * size)) div size END"))
    products = _products(features, "_y")
    own = own.withColumns({f"_p{k}": F.sum(p).over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)) for k, p in enumerate(products)})
    first = own.where("fold IS NOT NULL").groupBy(*keys, "fold").agg(F.min_by(F.array(*[f"_p{k}" for k in range(len(products))]), "i").alias("sums"))
    models = first.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("fold").alias("_fold"), _solved(len(features) + 1)("sums").alias("b"))
    test = own["fold"] == models["_fold"]
    for k in keys:
        test = test & own[k].eqNullSafe(models[f"_k_{k}"])
    error = F.abs(F.col("_y").cast("double") - _applied(F.col("b"), features))
    per_fold = own.where("fold IS NOT NULL").join(models, test).groupBy(*keys, "fold").agg(F.avg(error).alias("e"))
    errors = per_fold.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.avg("e").alias("mae"))
    groups = own.groupBy(*keys).agg(F.max("n").alias("n"), F.max("n_folds").alias("n_folds"))
    test = F.lit(True)
    for k in keys:
        test = test & groups[k].eqNullSafe(errors[f"_k_{k}"])
    return groups.join(errors, test, "left").select(*keys, "n", F.col("n_folds").cast("int").alias("n_folds"), F.coalesce("mae", F.lit(0.0)).alias("mae"))


def chosen_models(rows: DataFrame, keys: list[str], order: str, candidates: dict[str, list[str]], y: str, upcoming: DataFrame) -> DataFrame:
    """(keys, model, mae, predicted): of the ``candidates`` (name to features) the one of least time-split error for each group (the first by name on ties), fitted to all
    its rows and applied to its row of ``upcoming``, which holds the features. Nothing below 0 is predicted."""
    every = None
    for name, features in candidates.items():
        sums = rows.groupBy(*keys).agg(F.array(*[F.sum(p) for p in _products(features, y)]).alias("sums"))
        fitted = sums.select(*keys, _solved(len(features) + 1)("sums").alias("b"))
        value = fitted.join(upcoming, keys).select(*keys, _applied(F.col("b"), features).alias("predicted"))
        told = split_errors(rows, keys, order, features, y).join(value, keys).withColumn("model", F.lit(name))
        every = told if every is None else every.unionByName(told)
    best = every.groupBy(*keys).agg(F.min(F.struct("mae", "model", "predicted")).alias("m"))
    return best.select(*keys, "m.model", "m.mae", F.greatest(F.lit(0.0), F.col("m.predicted")).alias("predicted"))


def fitted_lines(panel: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, n, slope, intercept) by least squares, from sums: nothing of a group is gathered."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return panel.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"))


def fitted_planes(panel: DataFrame, key: str, features: list[str], y: str, least: int = 3) -> DataFrame:
    """(key, n, coefficients): several features, by normal equations that are summed in Spark and solved for each key in numpy."""
    sums = panel.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(p) for p in _products(features, y)]).alias("sums")).where(F.col("n") >= least)
    return sums.select(key, "n", _solved(len(features) + 1)("sums").alias("coefficients"))
