"""Queries on batches of changes: budgets, costs, change orders, progress, bridges, feedback from the past."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes
from ..sources import tables
from .base import registered
from .costs import WITH

query, QUERIES, ORACLE_SQL = registered()
TODAY = "1998-12-01"
UNIT = "CAST(sum(sign(amount_cents) * (abs(amount_cents) // quantity)) AS BIGINT)"
REQUESTS = f"""{WITH.replace('WITH', 'WITH RECURSIVE', 1)}spent AS (SELECT l_partkey AS budget_id, {UNIT} AS actual_cents FROM costs GROUP BY 1),
req AS (SELECT 2 * budget_id AS seq, budget_id, CAST(NULL AS VARCHAR) AS division, CASE WHEN budget_id % 7 = 0 THEN current_budget_cents // 4 ELSE current_budget_cents * 11 // 10 END AS new_cents FROM budgets WHERE budget_id % 3 = 0 OR budget_id % 7 = 0
  UNION ALL SELECT 2 * budget_id + 1, -budget_id - 1, CASE WHEN budget_id % 22 = 0 THEN 'NONE' ELSE division END, current_budget_cents // 4 FROM budgets WHERE budget_id % 11 = 0),
lim AS (SELECT division, CASE WHEN division < 'M' THEN 2 * sov_cents ELSE sov_cents * 103 // 100 END AS ceiling_cents, sov_cents AS total_cents FROM breakdown),
met AS (SELECT seq, r.budget_id, coalesce(b.division, r.division) AS div, coalesce(b.current_budget_cents, 0) AS old_cents, new_cents, b.budget_id IS NULL AS created, coalesce(actual_cents, 0) AS actual
  FROM req r LEFT JOIN budgets b ON r.budget_id = b.budget_id LEFT JOIN spent s ON r.budget_id = s.budget_id),
judged AS (SELECT met.*, ceiling_cents, total_cents, CASE WHEN ceiling_cents IS NULL THEN 'no contract' WHEN new_cents < actual THEN 'below actual' END AS early FROM met LEFT JOIN lim ON div = division),
num AS (SELECT *, row_number() OVER (PARTITION BY div ORDER BY seq) AS i FROM judged WHERE early IS NULL),
walk AS (SELECT division AS d, CAST(0 AS BIGINT) AS pos, CAST(total_cents AS HUGEINT) AS t, CAST(-1 AS BIGINT) AS s, true AS ok FROM lim
  UNION ALL SELECT d, n.i, t + CASE WHEN t + new_cents - old_cents <= ceiling_cents THEN new_cents - old_cents ELSE 0 END, n.seq, t + new_cents - old_cents <= ceiling_cents FROM walk JOIN num n ON n.div = d AND n.i = pos + 1),
checked AS (SELECT seq, budget_id, div AS division, old_cents, new_cents, created, CAST(ceiling_cents - (total_cents - old_cents) AS BIGINT) AS headroom_cents, CASE WHEN early IS NOT NULL THEN early WHEN NOT ok THEN 'over ceiling' END AS problem FROM judged LEFT JOIN walk ON seq = s)"""


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    """Every third budget asks for a tenth more, every seventh for a quarter only, and some ids are new. Half the divisions have ceilings that can't be reached."""
    budgets, k, now = tables.budgets(spark, sf), F.col("budget_id"), F.col("current_budget_cents")
    old = budgets.where((k % 3 == 0) | (k % 7 == 0)).select((2 * k).alias("seq"), k, F.lit(None).cast("string").alias("division"), F.when(k % 7 == 0, F.expr("current_budget_cents div 4")).otherwise(F.expr("current_budget_cents * 11 div 10")).alias("new_cents"))
    new = budgets.where(k % 11 == 0).select((2 * k + 1).alias("seq"), (-k - 1).alias("budget_id"), F.when(k % 22 == 0, "NONE").otherwise(F.col("division")).alias("division"), F.expr("current_budget_cents div 4").alias("new_cents"))
    contract = tables.breakdown(spark, sf).select("division", F.when(F.col("division") < "M", 2 * F.col("sov_cents")).otherwise(F.expr("sov_cents * 103 div 100")).alias("ceiling_cents"))
    unit = F.signum("amount_cents").cast("long") * F.expr("abs(amount_cents) div quantity")
    spent = tables.cost_rows(spark, sf, vendors=False).groupBy(F.col("l_partkey").alias("budget_id")).agg(F.sum(unit).alias("actual_cents"))
    return changes.checked_amounts(contract, budgets, spent, old.unionByName(new))


@query(f"{REQUESTS} SELECT * FROM checked")
def budget_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests for amounts against what was spent and the ceilings, in their order; unit prices count as spent."""
    return _checked(spark, sf)


@query(f"""{REQUESTS}, ok AS (SELECT * FROM checked WHERE problem IS NULL), now AS (SELECT division, coalesce(new_cents, current_budget_cents) AS cents FROM budgets LEFT JOIN (SELECT budget_id, new_cents FROM ok) USING (budget_id)
  UNION ALL SELECT division, new_cents FROM ok WHERE created)
SELECT division, count(*) AS n_budgets, CAST(sum(cents) AS BIGINT) AS budget_cents FROM now GROUP BY division""")
def budgets_after_requests(spark: SparkSession, sf: str) -> DataFrame:
    after = changes.with_amounts(tables.budgets(spark, sf), _checked(spark, sf))
    return after.groupBy("division").agg(F.count(F.lit(1)).alias("n_budgets"), F.sum("current_budget_cents").alias("budget_cents"))


USED = "SELECT l_partkey AS budget_id, count(*) AS n FROM costs WHERE date < DATE '1993-01-01' GROUP BY 1"


@query(f"""{WITH}u AS ({USED}), j AS (SELECT budgets.*, n, budget_id % 4 = 0 AND n IS NULL AS gone, budget_id % 4 = 0 AND n IS NOT NULL AS refused FROM budgets LEFT JOIN u USING (budget_id))
SELECT division, count(*) FILTER (NOT gone) AS n_kept, count(*) FILTER (refused) AS n_refused, CAST(coalesce(sum(n) FILTER (refused), 0) AS BIGINT) AS n_costs FROM j GROUP BY division""")
def budget_deletions(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth budget is to go, if no cost before 1993 is mapped to it."""
    budgets = tables.budgets(spark, sf)
    costs = tables.cost_rows(spark, sf, vendors=False).where(F.col("date") < F.lit("1993-01-01").cast("date")).select(F.col("l_partkey").alias("budget_id"))
    kept, refused = changes.without_deleted(budgets, costs, budgets.where(F.col("budget_id") % 4 == 0))
    one = kept.groupBy("division").agg(F.count(F.lit(1)).alias("n_kept"))
    two = refused.join(budgets.select("budget_id", "division"), "budget_id").groupBy("division").agg(F.count(F.lit(1)).alias("n_refused"), F.sum("n_costs").alias("n_costs"))
    return one.join(two, "division", "full").na.fill(0)


@query(f"""{WITH}r AS (SELECT cost_key, CASE WHEN l_orderkey % 10 = 0 THEN NULL WHEN l_orderkey % 10 = 1 THEN -l_partkey - 1 ELSE l_partkey END AS budget_id, '  ' || upper(vendor) || ' ' AS vendor, CASE WHEN l_orderkey % 3 <> 0 THEN date END AS date, amount_cents FROM costs)
SELECT cost_key, r.budget_id, lower(trim(vendor)) AS vendor_normalized, coalesce(date, DATE '{TODAY}') AS date, b.zone, CASE WHEN r.budget_id IS NOT NULL AND b.budget_id IS NULL THEN 'no budget' END AS problem FROM r LEFT JOIN budgets b ON r.budget_id = b.budget_id""")
def cost_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Costs entered anew: some without a budget, some for one that doesn't exist, some without a date."""
    digit = F.col("l_orderkey") % 10
    budget = F.when(digit == 1, -F.col("l_partkey") - 1).when(digit > 1, F.col("l_partkey"))
    asked = tables.costs(spark, sf).select("cost_key", budget.alias("budget_id"), F.concat(F.lit("  "), F.upper("vendor"), F.lit(" ")).alias("vendor"), F.when(F.col("l_orderkey") % 3 != 0, F.col("date")).alias("date"), "amount_cents")
    return changes.entered_costs(asked, tables.budgets(spark, sf), F.lit(TODAY).cast("date")).select("cost_key", "budget_id", "vendor_normalized", "date", "zone", "problem")


MOVES = f"""{WITH}r AS (SELECT cost_key, any_value(l_partkey) AS old, any_value(l_orderkey) AS o FROM costs WHERE l_orderkey % 5 = 0 GROUP BY 1),
t AS (SELECT cost_key, CASE WHEN o % 3 = 0 THEN NULL WHEN o % 3 = 1 THEN -old - 1 ELSE (SELECT max(budget_id) FROM budgets) - old END AS new_id, o % 3 <> 1 AS good FROM r)"""


def _moves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Costs of every fifth order: a third unmapped, a third sent to a budget that doesn't exist, a third to the budget opposite; each asked twice, of which the last counts."""
    budgets = tables.budgets(spark, sf)
    costs = tables.costs(spark, sf).withColumnRenamed("l_partkey", "budget_id").select("cost_key", "budget_id", "zone", "amount_cents", "l_orderkey")
    each = costs.where(F.col("l_orderkey") % 5 == 0).groupBy("cost_key").agg(F.any_value("budget_id").alias("old"), F.any_value("l_orderkey").alias("o"))
    each = each.crossJoin(F.broadcast(budgets.agg(F.max("budget_id").alias("top"))))  # one row
    k = F.col("o") % 3
    asked = each.select((2 * F.xxhash64("cost_key").bitwiseAND(0xFFFFFFFF)).alias("seq"), "cost_key", F.when(k == 1, -F.col("old") - 1).when(k == 2, F.col("top") - F.col("old")).alias("new_id"))
    before = asked.select((F.col("seq") - 1).alias("seq"), "cost_key", F.lit(1).cast("long").alias("new_id"))
    return changes.moved_costs(costs, before.unionByName(asked), budgets)


@query(f"""{MOVES}, a AS (SELECT CASE WHEN good THEN new_id ELSE l_partkey END AS budget_id, CASE WHEN NOT coalesce(good, false) THEN c.zone ELSE b.zone END AS zone, amount_cents FROM costs c LEFT JOIN t USING (cost_key) LEFT JOIN budgets b ON new_id = budget_id)
SELECT zone, budget_id IS NULL AS unmapped, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS cents, count(DISTINCT budget_id) AS n_budgets FROM a GROUP BY ALL""")
def costs_after_moves(spark: SparkSession, sf: str) -> DataFrame:
    return _moves(spark, sf)[0].groupBy("zone", F.col("budget_id").isNull().alias("unmapped")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("cents"), F.countDistinct("budget_id").alias("n_budgets"))


@query(f"{MOVES} SELECT DISTINCT budget_id FROM (SELECT l_partkey AS budget_id FROM costs JOIN t USING (cost_key) WHERE good UNION ALL SELECT new_id FROM t WHERE good) WHERE budget_id IS NOT NULL")
def budgets_touched_by_moves(spark: SparkSession, sf: str) -> DataFrame:
    return _moves(spark, sf)[1]


@query(f"{MOVES} SELECT cost_key, 'no budget' AS problem FROM t WHERE NOT good")
def refused_moves(spark: SparkSession, sf: str) -> DataFrame:
    return _moves(spark, sf)[2].select("cost_key", "problem")


ORDERS = f"""{WITH}old AS (SELECT division, budget_id // 5 AS number, CASE WHEN budget_id % 2 = 0 THEN 'approved' ELSE 'pending' END AS status, committed_cents AS cents FROM budgets WHERE budget_id % 5 = 0),
made AS (SELECT budget_id, division, -budget_id AS number FROM budgets WHERE budget_id % 5 = 1),
req AS (SELECT 4 * budget_id AS seq, 'approve' AS kind, division, budget_id // 5 AS number, NULL AS status, NULL::BIGINT AS cents, CASE WHEN budget_id % 2 = 0 THEN 'already approved' END AS problem FROM budgets WHERE budget_id % 5 = 0
  UNION ALL SELECT 4 * budget_id, 'create', CASE WHEN budget_id % 6 = 0 THEN 'NONE' ELSE division END, number, NULL, budget_id, CASE WHEN budget_id % 6 = 0 THEN 'no contract' END FROM made
  UNION ALL SELECT 4 * budget_id + 1, 'update', CASE WHEN budget_id % 6 = 0 THEN 'NONE' ELSE division END, number, CASE budget_id % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'approved' WHEN 2 THEN 'pending' END, 100 * budget_id, CASE WHEN budget_id % 4 = 0 THEN 'invalid status' WHEN budget_id % 6 = 0 THEN 'not found' END FROM made
  UNION ALL SELECT 4 * budget_id + 2, 'create', CASE WHEN budget_id % 6 = 0 THEN 'NONE' ELSE division END, number, NULL, 7, CASE WHEN budget_id % 6 = 0 THEN 'no contract' ELSE 'exists' END FROM made)"""


def _orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every fifth budget is an order to approve; every budget after such one creates an order, updates it, and creates it once more."""
    b, k = tables.budgets(spark, sf), F.col("budget_id")
    number = F.expr("budget_id div 5").alias("number")
    some, made = b.where(k % 5 == 0), b.where(k % 5 == 1)
    none, cents = F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("cents")
    old = some.select("division", number, F.when(k % 2 == 0, "approved").otherwise("pending").alias("status"), F.col("committed_cents").alias("cents"))
    where = F.when(k % 6 == 0, "NONE").otherwise(F.col("division")).alias("division")
    status = F.when(k % 4 == 0, "rejected").when(k % 4 == 1, "approved").when(k % 4 == 2, "pending").alias("status")
    asked = some.select((4 * k).alias("seq"), F.lit("approve").alias("kind"), "division", number, none, cents)
    for step, kind, state, amount in ((0, "create", none, k), (1, "update", status, 100 * k), (2, "create", none, F.lit(7).cast("long"))):
        asked = asked.unionByName(made.select((4 * k + step).alias("seq"), F.lit(kind).alias("kind"), where, (-k).alias("number"), state, amount.alias("cents")))
    return changes.change_orders(tables.breakdown(spark, sf), old, asked)


@query(f"{ORDERS} SELECT seq, division, number, kind, problem FROM req")
def change_order_requests(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf)[1]


@query(f"""{ORDERS}, now AS (SELECT division, number, 'approved' AS status, cents FROM old
  UNION ALL SELECT division, number, CASE budget_id % 4 WHEN 1 THEN 'approved' WHEN 2 THEN 'pending' ELSE 'draft' END, CASE WHEN budget_id % 4 = 0 THEN budget_id ELSE 100 * budget_id END FROM made WHERE budget_id % 6 <> 0)
SELECT division, status, count(*) AS n_orders, CAST(sum(cents) AS BIGINT) AS cents FROM now GROUP BY ALL""")
def change_orders_after(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by state after all requests; what is approved lifts a ceiling."""
    return _orders(spark, sf)[0].groupBy("division", "status").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("cents").alias("cents"))


@query(f"""{WITH}u AS (SELECT *, CASE WHEN activity_id % 3 = 0 THEN 50 WHEN activity_id % 3 = 1 AND activity_id % 130 <> 0 THEN least(100, greatest(0, activity_id % 130 - 10)) ELSE 20 END AS pct FROM activities)
SELECT division, CAST(pct = 100 AS BOOLEAN) AS is_complete, pct > 0 AND pct < 100 AS is_in_progress, count(*) AS n, CAST(sum(pct) AS BIGINT) AS pct FROM u GROUP BY ALL""")
def activities_after_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Activities stand at 20; a third is set to 50 after another value, a third to values of which some lie outside 0 to 100 or are null."""
    k = F.col("activity_id")
    rows = tables.activities(spark, sf).withColumn("pct_complete", F.lit(20).cast("long"))
    one = rows.where(k % 3 == 1).select(k.alias("seq"), k, F.when(k % 130 != 0, k % 130 - 10).alias("pct"))
    two = rows.where(k % 3 == 0).select(F.explode(F.array(k * 2, k * 2 + 1)).alias("seq"), k).withColumn("pct", F.when(F.col("seq") % 2 == 0, 90).otherwise(50).cast("long"))
    after = changes.progressed(rows, one.unionByName(two))
    return after.groupBy("division", "is_complete", "is_in_progress").agg(F.count(F.lit(1)).alias("n"), F.sum("pct_complete").alias("pct"))


@query(f"""{WITH}b AS (SELECT activity_id, division, CASE WHEN activity_id % 4 = 1 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM activities WHERE activity_id % 4 <> 0 UNION ALL SELECT activity_id, 'ADDED', 1.0::DOUBLE FROM activities WHERE activity_id % 4 = 2)
SELECT division, count(*) AS n, sum(weight) AS weight FROM b GROUP BY division""")
def bridge_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Of four activities one leaves its division, one has its weight changed, one gets a second division, and one removes what it never had."""
    k = F.col("activity_id")
    bridge = tables.activities(spark, sf).select("activity_id", "division", F.lit(0.5).alias("weight"))
    kind = F.when(k % 4 < 1, "remove").when(k % 4 < 3, "add").otherwise("remove")
    where = F.when(k % 4 < 2, F.col("division")).when(k % 4 < 3, "ADDED").otherwise("NEVER")
    asked = bridge.select(k.alias("seq"), kind.alias("kind"), "activity_id", where.alias("division"), F.when(k % 4 == 1, 0.25).alias("weight"))
    return changes.bridged(bridge, asked).groupBy("division").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


PAST = f"""{WITH}m AS (SELECT CASE WHEN l_partkey % 13 <> 0 THEN lower(vendor) ELSE '' END AS vendor, CASE WHEN l_partkey % 26 <> 0 THEN substr(lower(name), 1, 20) ELSE '' END AS prefix, cost_code AS budget_code, quantity / 100.0::DOUBLE AS confidence, coalesce(date, DATE '{TODAY}') AS created_at FROM costs)"""


def _past(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_partkey")
    return tables.costs(spark, sf).select(
        F.when(k % 13 != 0, F.lower("vendor")).alias("vendor"), F.when(k % 26 != 0, F.substring(F.lower("name"), 1, 20)).alias("prefix"), F.col("cost_code").alias("budget_code"), (F.col("quantity") / 100).alias("confidence"), F.col("date").alias("created_at")
    )


@query(f"""{PAST}, p AS (SELECT vendor, prefix, budget_code, min({{'created_at': created_at, 'confidence': confidence}}) AS f, min(created_at) AS first FROM m WHERE vendor <> '' OR prefix <> '' GROUP BY ALL)
SELECT vendor, prefix, budget_code, f.confidence AS confidence, f.created_at AS created_at, false AS was_override FROM p WHERE NOT EXISTS (SELECT 1 FROM m k WHERE k.created_at < DATE '1993-01-01' AND k.vendor = p.vendor AND k.prefix = p.prefix AND k.budget_code = p.budget_code)""")
def feedback_missing(spark: SparkSession, sf: str) -> DataFrame:
    """What the past teaches and feedback, which here knows the mappings before 1993, lacks."""
    past = _past(spark, sf)
    known = past.where(F.col("created_at") < F.lit("1993-01-01").cast("date"))
    return changes.backfilled(past, known, F.lit(TODAY).cast("date"))


@query(f"""{PAST}, c AS (SELECT budget_code, count(*) AS n FROM m GROUP BY 1), s AS (SELECT DISTINCT budget_code, 5 AS total_matches, 2 AS override_count, 0.6::DOUBLE AS trust_score FROM m WHERE budget_code < 'Brand#3' UNION ALL SELECT 'Brand#none', 5, 2, 0.6::DOUBLE)
SELECT budget_code, coalesce(n, total_matches) AS total_matches, coalesce(override_count, 0) AS override_count, coalesce(trust_score, 1.0::DOUBLE) AS trust_score FROM c FULL JOIN s USING (budget_code)""")
def match_stats(spark: SparkSession, sf: str) -> DataFrame:
    past = _past(spark, sf)
    codes = past.where(F.col("budget_code") < "Brand#3").select("budget_code").distinct().unionByName(spark.range(1).select(F.lit("Brand#none").alias("budget_code")))
    return changes.match_stats(past, codes.select("budget_code", F.lit(5).cast("long").alias("total_matches"), F.lit(2).alias("override_count"), F.lit(0.6).alias("trust_score")))
