"""Queries on scaling, ranges of dates, and models chosen by their errors in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features, ranges
from ..sources import tables
from .base import registered
from .costs import WITH

query, QUERIES, ORACLE_SQL = registered()


@query(f"""{WITH}l AS (SELECT cost_key, division, amount_cents AS a, sign(amount_cents) * ln(1 + abs(amount_cents)::DOUBLE) AS v FROM costs),
s AS (SELECT division AS d, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS spread FROM l GROUP BY division)
SELECT cost_key, round(greatest(-5.0, least(5.0, (v - median) / CASE WHEN spread > 0 THEN spread ELSE 1 END)), 6) AS scaled,
  CASE WHEN abs((v - median) / CASE WHEN spread > 0 THEN spread ELSE 1 END) < 5 THEN a END AS restored FROM l JOIN s ON division IS NOT DISTINCT FROM d""")
def robust_z(spark: SparkSession, sf: str) -> DataFrame:
    """Costs scaled within their division, and scaled back where nothing was clipped."""
    rows = features.robust_scaled(tables.costs(spark, sf), "division", "amount_cents")
    back = F.when(F.abs("scaled") < 5, F.round(features.restored(F.col("scaled"), F.col("median"), F.col("spread"))).cast("long"))
    return rows.select("cost_key", F.round("scaled", 6).alias("scaled"), back.alias("restored"))


@query(f"""{WITH}p AS (SELECT c_custkey AS period_id, DATE '1992-01-01' + CAST(c_custkey * 37 % 2500 AS INTEGER) AS a, CAST(c_custkey * c_custkey % 700 AS INTEGER) AS n FROM customer),
d AS (SELECT date, CAST(sum(amount_cents) AS BIGINT) AS cents, count(*) AS n_costs FROM costs GROUP BY date)
SELECT period_id, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(n_costs) AS BIGINT) AS n_costs, count(*) AS n_days FROM p JOIN d ON date BETWEEN a AND a + n GROUP BY period_id""")
def actuals_by_period(spark: SparkSession, sf: str) -> DataFrame:
    """Actuals of periods that overlap and are of uneven length, one for each customer: days are summed first, then run up, and a period takes the difference of two days."""
    c = F.col("c_custkey")
    periods = tables.read(spark, sf, "customer").select(c.alias("period_id"), F.date_add(F.lit("1992-01-01").cast("date"), (c * 37 % 2500).cast("int")).alias("start"), (c * c % 700).cast("int").alias("n"))
    days = tables.cost_items(spark, sf).groupBy("date").agg(F.sum("amount_cents").alias("cents"), F.count(F.lit(1)).alias("n_costs"))
    met = ranges.sums_in_intervals(days, "date", ["cents", "n_costs"], periods, F.col("start"), F.date_add("start", F.col("n")))
    return met.groupBy("period_id").agg(F.sum("cents").alias("cents"), F.sum("n_costs").alias("n_costs"), F.sum("n_points").alias("n_days"))


PANEL = """m AS (SELECT division, zone, date_trunc('month', date)::DATE AS month, CAST(sum(abs(amount_cents)) // 100 AS BIGINT) AS y FROM costs WHERE division IS NOT NULL AND zone IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS x, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY division, zone) AS n FROM m WINDOW w AS (PARTITION BY division, zone ORDER BY month)),
k AS (SELECT *, CASE WHEN n >= 5 AND n // 3 >= 2 THEN least(5, n // 3) ELSE 0 END AS n_folds FROM r),
f AS (SELECT *, CASE WHEN n_folds > 0 AND i >= n - n_folds * (n // (n_folds + 1)) THEN (i - (n - n_folds * (n // (n_folds + 1)))) // (n // (n_folds + 1)) END AS fold FROM k),
e AS (SELECT t.division, t.zone, t.fold, t.x, any_value(t.y) AS y, regr_slope(p.y, p.x) AS b, regr_intercept(p.y, p.x) AS a, avg(p.y) AS mean
  FROM f t JOIN f p ON p.division = t.division AND p.zone = t.zone AND p.i < t.n - (t.n_folds - t.fold) * (t.n // (t.n_folds + 1)) WHERE t.fold IS NOT NULL GROUP BY ALL),
g AS (SELECT division, zone, avg(trend) AS trend, avg(level) AS level FROM (SELECT division, zone, fold, avg(abs(y - a - b * x)) AS trend, avg(abs(y - mean)) AS level FROM e GROUP BY ALL) GROUP BY ALL),
h AS (SELECT division, zone, n, n_folds, coalesce(trend, 0) AS trend, coalesce(level, 0) AS level FROM (SELECT DISTINCT division, zone, n, n_folds FROM k) LEFT JOIN g USING (division, zone))"""


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    months = tables.costs(spark, sf).where("division IS NOT NULL AND zone IS NOT NULL").groupBy("division", "zone", F.trunc("date", "MM").alias("month")).agg(F.expr("sum(abs(amount_cents)) div 100").alias("y"))
    return months.withColumn("x", F.row_number().over(Window.partitionBy("division", "zone").orderBy("month")))


@query(f"{WITH}{PANEL} SELECT division, zone, n, CAST(n_folds AS INTEGER) AS n_folds, round(trend, 3) AS mae FROM h")
def time_split_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of a line through each division's and region's months, over expanding folds."""
    return features.split_errors(_panel(spark, sf), ["division", "zone"], "month", ["x"], "y").withColumn("mae", F.round("mae", 3))


@query(f"""{WITH}{PANEL}, z AS (SELECT division, zone, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS mean FROM r GROUP BY ALL)
SELECT division, zone, CASE WHEN trend < level THEN 'trend' ELSE 'level' END AS model, round(least(trend, level), 3) AS mae, round(greatest(0, CASE WHEN trend < level THEN a + b * (n + 1) ELSE mean END), 2) AS predicted FROM h JOIN z USING (division, zone)""")
def chosen_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Next month's costs of each division and region by the better of a mean and a line."""
    panel = _panel(spark, sf)
    ahead = panel.groupBy("division", "zone").agg((F.max("x") + 1).alias("x"))
    rows = features.chosen_models(panel, ["division", "zone"], "month", {"level": [], "trend": ["x"]}, "y", ahead)
    return rows.withColumns({"mae": F.round("mae", 3), "predicted": F.round("predicted", 2)})
