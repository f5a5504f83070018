"""Queries on nested results, settings, mixtures, quality and runs of choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import mixtures
from ..operators import trees
from ..sources import scans, tables
from ..streaming import feeds, trust
from .base import registered
from .costs import WITH

query, QUERIES, ORACLE_SQL = registered()
BUDGETS, COSTS = 20, 5


@query(f"""{WITH}c AS (SELECT l_partkey AS id, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS actual, list({{'key': cost_key, 'vendor': vendor, 'date': date, 'cents': amount_cents}} ORDER BY abs(amount_cents) DESC, cost_key)[1:{COSTS}] AS l FROM costs GROUP BY l_partkey),
b AS (SELECT division, count(*) AS n, CAST(sum(current_budget_cents) AS BIGINT) AS budget, list({{'id': budget_id, 'code': budget_code, 'budget_cents': current_budget_cents, 'committed_cents': committed_cents, 'actual_cents': coalesce(actual, 0),
  'remaining_cents': current_budget_cents - coalesce(actual, 0), 'n_costs': coalesce(c.n, 0), 'costs': coalesce(l, [])}} ORDER BY current_budget_cents DESC, budget_id)[1:{BUDGETS}] AS l FROM budgets LEFT JOIN c ON id = budget_id GROUP BY division)
SELECT division, to_json({{'division': division, 'budget_cents': budget, 'n_budgets': n, 'budgets': l}})::VARCHAR AS tree FROM b""")
def budget_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Each division with its first page of budgets, and each of those with its first page of costs, as one JSON text."""
    costs = tables.costs(spark, sf).select("l_partkey", F.col("cost_key").alias("key"), "vendor", "date", F.col("amount_cents").alias("cents"))
    leaves = trees.children(costs, "l_partkey", [F.desc(F.abs("cents")), F.col("key")], ["key", "vendor", "date", "cents"], "costs", COSTS)
    spent = costs.groupBy("l_partkey").agg(F.sum("cents").alias("actual"))
    budgets = tables.budgets(spark, sf)
    rows = budgets.join(leaves, F.col("budget_id") == leaves["l_partkey"], "left").drop("l_partkey").join(spent, F.col("budget_id") == spent["l_partkey"], "left")
    empty = F.array().cast(leaves.schema["costs"].dataType)
    rows = rows.select(
        "division", F.col("budget_id").alias("id"), F.col("budget_code").alias("code"), F.col("current_budget_cents").alias("budget_cents"), "committed_cents", F.coalesce("actual", F.lit(0)).alias("actual_cents"),
        (F.col("current_budget_cents") - F.coalesce("actual", F.lit(0))).alias("remaining_cents"), F.coalesce("n_costs", F.lit(0)).alias("n_costs"), F.coalesce("costs", empty).alias("costs"),
    )
    top = trees.children(rows, "division", [F.desc("budget_cents"), F.col("id")], [c for c in rows.columns if c != "division"], "budgets", BUDGETS)
    sums = budgets.groupBy("division").agg(F.sum("current_budget_cents").alias("budget_cents"))
    tree = F.to_json(F.struct("division", "budget_cents", "n_budgets", "budgets"), {"ignoreNullFields": "false"})
    return top.join(sums, "division").select("division", tree.alias("tree"))


@query("""WITH p AS (SELECT p_partkey AS id, p_size AS s, p_brand AS b FROM part),
f AS (SELECT id, 'limits.size' AS path, s::VARCHAR AS o, (s + (s % 3 = 0)::INTEGER)::VARCHAR AS n FROM p UNION ALL SELECT id, 'limits.zone.east', (s * 2)::VARCHAR, CASE WHEN s % 5 > 0 THEN (s * 2)::VARCHAR END FROM p
  UNION ALL SELECT id, 'name', b, b FROM p UNION ALL SELECT id, 'tags', '[' || s || ',1]', '[' || s || ',' || (1 + (s % 11 = 0)::INTEGER) || ']' FROM p UNION ALL SELECT id, 'extra.deep.er', NULL, CASE WHEN s % 7 = 0 THEN id::VARCHAR END FROM p)
SELECT id, path, o AS old_value, n AS new_value, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' ELSE 'modified' END AS change FROM f WHERE o IS DISTINCT FROM n""")
def settings_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Settings kept as nested JSON, one text for each part, before and after a change."""
    s, part = F.col("p_size").cast("long"), tables.read(spark, sf, "part")
    zone = lambda east: F.struct(east.alias("east"))
    old = F.to_json(F.struct(F.struct(s.alias("size"), zone(s * 2).alias("zone")).alias("limits"), F.col("p_brand").alias("name"), F.array(s, F.lit(1).cast("long")).alias("tags")))
    deep = F.when(s % 7 == 0, F.struct(F.struct(F.col("p_partkey").alias("er")).alias("deep")))
    new = F.to_json(F.struct(
        F.struct((s + (s % 3 == 0).cast("int")).alias("size"), zone(F.when(s % 5 > 0, s * 2)).alias("zone")).alias("limits"), F.col("p_brand").alias("name"), F.array(s, 1 + (s % 11 == 0).cast("long")).alias("tags"), deep.alias("extra"),
    ))
    flat = lambda text: trees.flattened(part.select(F.col("p_partkey").alias("id"), text.alias("j")), "id", "j")
    return trees.changed(flat(old), flat(new), ["id", "path"], "value")


@query("""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b, p_size * 2.0::DOUBLE AS c, 1 + p_size % 4 AS k FROM part),
w AS (SELECT *, k / 10.0::DOUBLE AS x, 0.4::DOUBLE AS y, 0.6::DOUBLE - k / 10.0::DOUBLE AS z FROM p), m AS (SELECT *, x * a + y * b + z * c AS mean FROM w)
SELECT p_partkey, round(mean, 4) AS mean, round(x * (a * a + 1) + y * (b * b + 4) + z * (c * c + 9) - mean * mean, 3) AS variance, round(CASE WHEN x >= y AND x >= z THEN a WHEN y >= z THEN b ELSE c END, 4) AS mode FROM m""")
def mixture_moments(spark: SparkSession, sf: str) -> DataFrame:
    k, size = (1 + F.col("p_size") % 4) / 10.0, F.col("p_size").cast("double")
    weights, means, deviations = F.array(k, F.lit(0.4), 0.6 - k), F.array(size, F.col("p_retailprice"), size * 2), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    return tables.read(spark, sf, "part").select("p_partkey", F.round(mixtures.mean(weights, means), 4).alias("mean"), F.round(mixtures.variance(weights, means, deviations), 3).alias("variance"), F.round(mixtures.mode(weights, means), 4).alias("mode"))


@query(f"""{WITH}m AS (SELECT division, date_trunc('month', date)::DATE AS month, sum(amount_cents)::DOUBLE AS y FROM costs WHERE division IS NOT NULL GROUP BY ALL),
e AS (SELECT division, y - lag(y) OVER (PARTITION BY division ORDER BY month) AS off FROM m)
SELECT division, CAST(round(avg(greatest(0.1 * off, -0.9 * off))) AS BIGINT) AS low, CAST(round(avg(greatest(0.5 * off, -0.5 * off))) AS BIGINT) AS middle, CAST(round(avg(greatest(0.9 * off, -0.1 * off))) AS BIGINT) AS high FROM e WHERE off IS NOT NULL GROUP BY division""")
def pinball_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Losses of the month before as a forecast, at three quantiles."""
    months = tables.costs(spark, sf).where("division IS NOT NULL").groupBy("division", F.trunc("date", "MM").alias("month")).agg(F.sum("amount_cents").cast("double").alias("y"))
    told = months.withColumn("guess", F.lag("y").over(Window.partitionBy("division").orderBy("month"))).where("guess IS NOT NULL")
    return told.groupBy("division").agg(*[F.round(F.avg(mixtures.pinball(F.col("y"), F.col("guess"), q))).cast("long").alias(n) for n, q in (("low", 0.1), ("middle", 0.5), ("high", 0.9))])


@query(f"""{WITH}n AS (SELECT count(*) AS n, count(*) FILTER (coalesce(trim(vendor) = '', true)) AS no_vendor, count(*) FILTER (coalesce(amount_cents = 0, true)) AS zero, count(*) FILTER (date IS NULL) AS no_date,
  count(*) FILTER (NOT coalesce(division IN ('PROMO', 'SMALL', 'LARGE'), false)) AS unmapped FROM costs)
SELECT *, concat_ws(',', CASE WHEN no_vendor > n * 0.05 THEN 'no_vendor' END, CASE WHEN zero > n * 0.1 THEN 'zero' END, CASE WHEN no_date > n * 0.02 THEN 'no_date' END, CASE WHEN unmapped > n * 0.15 THEN 'unmapped' END) AS warnings FROM n""")
def data_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Three of the divisions count as mapped, so that one bound is passed."""
    return scans.quality(tables.costs(spark, sf), F.col("division").isin("PROMO", "SMALL", "LARGE"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""WITH e AS (SELECT epoch_us(ts::TIMESTAMP) // 604800000000 * 604800 - 604800 * k AS s, epoch_us(ts::TIMESTAMP) / 1e6 AS t FROM events, generate_series(0, 4) AS g(k))
SELECT CAST(s AS BIGINT) AS start_s, count(*) AS n FROM e WHERE s + 30 * 86400 > t GROUP BY s""")
def events_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.sliding(_events(spark, sf), "30 days", "7 days").select(F.unix_timestamp("start").alias("start_s"), "n")


@query("""WITH e AS (SELECT user_id, epoch_us(ts::TIMESTAMP) AS us, event_type IN ('purchase', 'click') AS ok FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT *, coalesce(us > lag(us) OVER w + 172800000000, true) AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
g AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT user_id, CAST(min(us) AS BIGINT) AS start_us, CAST(max(us) AS BIGINT) AS last_us, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS overridden, round(count(*) FILTER (ok)::DOUBLE / count(*), 6) AS trust FROM g GROUP BY user_id, run""")
def trust_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases and clicks count as accepted choices; a run ends after two still days."""
    runs = trust.trusted(_events(spark, sf), ["purchase", "click"], days=2)
    return runs.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "accepted", "overridden", "trust")
