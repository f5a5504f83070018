"""Queries on the two layers of mapping, rules, roll-ups of the hierarchy and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger, mapping, recon
from ..sources import tables
from .base import registered
from .costs import AS_OF, WITH

query, QUERIES, ORACLE_SQL = registered()

#: The budgets' inputs to mapping, made from the tables: keys 1 to 3 lead to a listed division, 4 to one that the contract lacks; some tiers name a division.
INPUTS = """bud AS (SELECT budget_id, budget_code, description, CAST(budget_id % 7 AS VARCHAR) AS division_key,
    CASE WHEN budget_id % 7 = 5 THEN budget_id || ' - ' || lower(division) WHEN budget_id % 7 = 6 THEN ' ' ELSE 'none' END AS tier2 FROM budgets),
saved AS (SELECT 'Brand#1' AS budget_code, 'LARGE' AS division, 1.0::DOUBLE AS confidence UNION ALL SELECT 'Brand#2', 'SMALL', 0.8::DOUBLE),
keyed AS (SELECT * FROM (VALUES ('1', 'PROMO'), ('2', 'MEDIUM'), ('3', 'ECONOMY')) AS k(division_key, key_division))"""
MAPPED = f"""{INPUTS}, mapped AS (SELECT budget_id, coalesce(s.division, key_division, CASE WHEN bud.division_key = '5' THEN upper(split_part(tier2, ' - ', 2)) END) AS division,
  CASE WHEN s.division IS NOT NULL THEN s.confidence WHEN key_division IS NOT NULL THEN 0.95::DOUBLE WHEN bud.division_key = '5' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN s.division IS NOT NULL THEN 'saved' WHEN key_division IS NOT NULL THEN 'division_key' WHEN bud.division_key = '5' THEN 'fuzzy_tier' ELSE 'unmapped' END AS method
  FROM bud LEFT JOIN saved s USING (budget_code) LEFT JOIN keyed USING (division_key))"""


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("budget_id") % 7
    tier = F.when(key == 5, F.concat(F.col("budget_id").cast("string"), F.lit(" - "), F.upper("division"))).when(key == 6, " ").otherwise("none")
    budgets = tables.budgets(spark, sf).select("budget_id", "budget_code", F.lit(None).cast("string").alias("description"), key.cast("string").alias("division_key"), tier.alias("tier2"))
    saved = spark.createDataFrame([("Brand#1", "LARGE", 1.0), ("Brand#2", "SMALL", 0.8)], "budget_code string, division string, confidence double")
    keys = spark.createDataFrame([("1", " promo"), ("2", "Medium "), ("3", "ECONOMY"), ("4", "no such division")], "division_key string, division string")
    places = tables.breakdown(spark, sf).select("division", F.ascii("division").alias("place"))
    return ledger.budget_divisions(budgets, saved, keys, places)


@query(f"{WITH}{MAPPED} SELECT * FROM mapped")
def budget_divisions(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf)


@query(f"{WITH}{MAPPED} SELECT count(*) AS n, count(division) AS n_mapped, round(count(division) * 100.0::DOUBLE / count(*), 6) AS pct_mapped FROM mapped")
def mapping_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.mapping_stats(_mapped(spark, sf), "division")


@query(f"""{WITH}{MAPPED} SELECT m.division, CAST(sum(amount_cents) AS BIGINT) AS actual_cents, count(*) AS n_costs FROM costs JOIN mapped m ON l_partkey = budget_id
WHERE m.division IS NOT NULL AND date <= DATE '{AS_OF}' GROUP BY 1""")
def recon_actuals_by_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Actuals through both layers: cost to budget, budget to division."""
    division = _mapped(spark, sf).select(F.col("budget_id").alias("l_partkey"), "division")
    costs = tables.costs(spark, sf).drop("division").join(division, "l_partkey", "left")
    return recon.actuals(costs, tables.breakdown(spark, sf), AS_OF).select("division", "actual_cents", "n_costs")


@query(f"{WITH}{MAPPED} SELECT DISTINCT budget_code, m.division FROM budgets JOIN mapped m USING (budget_id) WHERE m.division IS NOT NULL")
def code_divisions(spark: SparkSession, sf: str) -> DataFrame:
    codes = tables.budgets(spark, sf).select("budget_id", "budget_code")
    return codes.join(_mapped(spark, sf).where(F.col("division").isNotNull()), "budget_id").select("budget_code", "division").distinct()


PCT = "CASE WHEN zone = 'EAST' THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END"


@query(f"{WITH}c AS (SELECT division, committed_cents, {PCT} AS pct_east FROM budgets) SELECT division, CAST(sum(committed_cents) AS BIGINT) AS committed_cents, CASE WHEN sum(committed_cents) > 0 THEN round(sum(committed_cents * pct_east) / sum(committed_cents), 6) END AS pct_east FROM c GROUP BY division")
def commitments_weighted(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.budgets(spark, sf).withColumn("pct_east", F.when(F.col("zone") == "EAST", 0.75).otherwise(0.25))
    return ledger.weighted_share(rows, ["division"], "committed_cents", "pct_east")


@query(f"""{WITH[:-2]} SELECT substr(division, 1, 1) AS letter, CAST(sum(sov_cents) AS BIGINT) AS sov_cents, CAST(sum(east_funded_cents) AS BIGINT) AS east_cents, CAST(sum(west_funded_cents) AS BIGINT) AS west_cents,
  round(avg(east_funded_cents::DOUBLE / sov_cents), 6) AS mean_pct_east, round(avg(west_funded_cents::DOUBLE / sov_cents), 6) AS mean_pct_west FROM breakdown GROUP BY 1""")
def breakdown_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of funding, and the unweighted means of the shares."""
    share = lambda c: F.round(F.avg(F.col(c) / F.col("sov_cents")), 6)
    return tables.breakdown(spark, sf).groupBy(F.substring("division", 1, 1).alias("letter")).agg(
        F.sum("sov_cents").alias("sov_cents"), F.sum("east_funded_cents").alias("east_cents"), F.sum("west_funded_cents").alias("west_cents"), share("east_funded_cents").alias("mean_pct_east"), share("west_funded_cents").alias("mean_pct_west")
    )


@query(f"""{WITH}c AS (SELECT division, amount_cents, CASE WHEN zone = 'EAST' THEN amount_cents WHEN zone = 'WEST' THEN 0 WHEN division < 'M' THEN CAST(floor(amount_cents / 2.0::DOUBLE) AS BIGINT) ELSE 0 END AS e,
    CASE WHEN zone = 'WEST' THEN amount_cents WHEN zone = 'EAST' THEN 0 WHEN division < 'M' THEN amount_cents - CAST(floor(amount_cents / 2.0::DOUBLE) AS BIGINT) ELSE 0 END AS w FROM costs),
s AS (SELECT division, sum(amount_cents) AS t, count(*) AS n, sum(e) AS e, sum(w) AS w FROM c GROUP BY division),
r AS (SELECT *, e + w > 0 AND abs(e + w - t) <= n AS from_rows FROM s)
SELECT division, CAST(t AS BIGINT) AS actual_cents, CAST(CASE WHEN from_rows THEN round(t::DOUBLE * (e::DOUBLE / (e + w)::DOUBLE)) ELSE ceil(t::DOUBLE / 2) END AS BIGINT) AS east_cents,
  CAST(t - CASE WHEN from_rows THEN round(t::DOUBLE * (e::DOUBLE / (e + w)::DOUBLE)) ELSE ceil(t::DOUBLE / 2) END AS BIGINT) AS west_cents, from_rows FROM r""")
def recon_row_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Divisions after M have shared costs without a split, so that they don't tie out and fall back to halves."""
    a, known = F.col("amount_cents"), F.col("division") < "M"
    half = F.floor(a / 2).cast("long")
    east = F.when(F.col("zone") == "EAST", a).when(F.col("zone") == "WEST", 0).when(known, half).otherwise(0)
    west = F.when(F.col("zone") == "WEST", a).when(F.col("zone") == "EAST", 0).when(known, a - half).otherwise(0)
    return ledger.row_splits(tables.costs(spark, sf).withColumns({"e": east, "w": west}), "e", "w")


RULES = [("labor", "Brand#1"), ("equipment", "Brand#(2|3)$"), ("material", "Brand#")]
RULED = """ruled AS (SELECT *, CASE WHEN regexp_matches(cost_code, '^Brand#1') THEN 'labor' WHEN regexp_matches(cost_code, '^Brand#(2|3)$') THEN 'equipment' WHEN regexp_matches(cost_code, '^Brand#') THEN 'material' END AS rule FROM costs),
marked AS (SELECT *, CASE rule WHEN 'labor' THEN CAST(sign(amount_cents) * ((abs(amount_cents) * 115 + 50) // 100) AS BIGINT) WHEN 'equipment' THEN CAST(sign(amount_cents) * ((abs(amount_cents) * 105 + 50) // 100) AS BIGINT) ELSE amount_cents END AS marked_cents FROM ruled)"""


@query(f"{WITH}{RULED} SELECT rule, division, count(*) AS n_costs, CAST(sum(amount_cents) AS BIGINT) AS cents, CAST(sum(marked_cents) AS BIGINT) AS marked_cents, grouping(division) AS level FROM marked GROUP BY GROUPING SETS ((rule, division), (rule))")
def rule_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Costs by the first rule that matches, with markup, for each rule and each rule and category."""
    rows = tables.costs(spark, sf).withColumn("rule", ledger.rule_of(F.col("cost_code"), RULES))
    rows = rows.withColumn("marked", ledger.marked_up(F.col("amount_cents"), F.col("rule")))
    return rows.groupingSets([["rule", "division"], ["rule"]], "rule", "division").agg(F.count(F.lit(1)).alias("n_costs"), F.sum("amount_cents").alias("cents"), F.sum("marked").alias("marked_cents"), F.grouping("division").cast("long").alias("level"))


TREE = """spent AS (SELECT l_partkey AS budget_id, sum(amount_cents) AS actual FROM costs GROUP BY 1),
tree AS (SELECT division, budget_code, count(*) AS n_budgets, CAST(sum(current_budget_cents) AS BIGINT) AS budget_cents, CAST(sum(coalesce(actual, 0)) AS BIGINT) AS actual_cents, CAST(sum(committed_cents) AS BIGINT) AS committed_cents
  FROM budgets LEFT JOIN spent USING (budget_id) GROUP BY ALL)"""


@query(f"{WITH}{TREE} SELECT *, greatest(actual_cents, committed_cents) AS eac_cents, budget_cents - greatest(actual_cents, committed_cents) AS surplus_cents FROM tree")
def budget_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.hierarchy(tables.budgets(spark, sf), tables.costs(spark, sf))


@query(f"""{WITH}{TREE}, e AS (SELECT *, greatest(actual_cents, committed_cents) AS eac FROM tree) SELECT division, count(*) AS n_lines, CAST(sum(budget_cents) AS BIGINT) AS budget_cents, CAST(sum(eac) AS BIGINT) AS eac_cents, CAST(sum(budget_cents - eac) AS BIGINT) AS surplus_cents,
  round(avg(CASE WHEN eac > budget_cents THEN 1.0 ELSE 0.0 END), 6) AS mean_risk, CAST(floor(sum(budget_cents)::DOUBLE * 0.05::DOUBLE) AS BIGINT) AS contingency_cents, CAST(floor(sum(budget_cents)::DOUBLE * 0.03::DOUBLE) AS BIGINT) AS fee_cents FROM e GROUP BY division""")
def entity_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.entity_rollup(ledger.hierarchy(tables.budgets(spark, sf), tables.costs(spark, sf)))


@query(f"""{WITH}b AS (SELECT division, CAST(sum(CASE WHEN budget_id % 50 <> 0 THEN current_budget_cents ELSE 0 END) AS BIGINT) AS budget_cents FROM budgets GROUP BY 1)
SELECT division, coalesce(sov_cents, 0) AS contract_cents, coalesce(budget_cents, 0) AS budget_cents, coalesce(sov_cents, 0) - coalesce(budget_cents, 0) AS gap_cents, coalesce(sov_cents, 0) = coalesce(budget_cents, 0) AS agrees FROM breakdown FULL JOIN b USING (division)""")
def vertical_check(spark: SparkSession, sf: str) -> DataFrame:
    """Every fiftieth budget has no amount yet, so that levels differ."""
    budgets = tables.budgets(spark, sf).withColumn("current_budget_cents", F.when(F.col("budget_id") % 50 != 0, F.col("current_budget_cents")).otherwise(0))
    return ledger.vertical_check(budgets, tables.breakdown(spark, sf))


@query(f"""{WITH}log AS (SELECT division, budget_id AS seq, CASE WHEN budget_id % 2 = 0 THEN round(budget_id % 100 / 100.0::DOUBLE, 2) END AS pct FROM budgets WHERE division < 'P'), n AS (SELECT division, arg_max({{'p': pct}}, seq) AS v FROM log GROUP BY 1)
SELECT division, coalesce(v.p, 0.5::DOUBLE) AS pct, coalesce(v.p IS NOT NULL, false) AS overridden FROM breakdown LEFT JOIN n USING (division)""")
def allocation_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """A log of overrides and clearings; the newest of each division counts, others have the default."""
    pct = F.when(F.col("budget_id") % 2 == 0, F.round(F.col("budget_id") % 100 / 100.0, 2))
    log = tables.budgets(spark, sf).where(F.col("division") < "P").select("division", F.col("budget_id").alias("at"), pct.alias("pct"))
    return ledger.latest_overrides(log, ["division"], "at", tables.breakdown(spark, sf).select("division", F.lit(0.5).alias("pct")))


def _paged(sort: str, order: str):
    @query(f"{WITH[:-2]} SELECT cost_key, vendor, date, amount_cents, substr(name, 1, 30) AS shown FROM costs ORDER BY {order}, cost_key LIMIT 40 OFFSET 20")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return ledger.page(tables.costs(spark, sf), sort, 20, 40).select("cost_key", "vendor", "date", "amount_cents", F.substring("name", 1, 30).alias("shown"))

    QUERIES[f"cost_page_{sort}"], ORACLE_SQL[f"cost_page_{sort}"] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


for _sort, _order in (("date_desc", "date DESC"), ("date_asc", "date"), ("amount_desc", "abs(amount_cents) DESC"), ("amount_asc", "abs(amount_cents)"), ("vendor", "lower(vendor)")):
    _paged(_sort, _order)


@query(f"""{WITH}c AS (SELECT cost_key, amount_cents, CASE WHEN l_partkey % 9 <> 0 THEN division END AS division FROM costs)
SELECT cost_key, division, amount_cents FROM c ORDER BY division IS NOT NULL, abs(amount_cents) DESC, cost_key LIMIT 60""")
def unmapped_first_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.costs(spark, sf).withColumn("division", F.when(F.col("l_partkey") % 9 != 0, F.col("division")))
    return ledger.page(rows, "amount_desc", 0, 60, unmapped_first=True).select("cost_key", "division", "amount_cents")


@query(f"""{WITH}{MAPPED} SELECT budget_id, budget_code, mapped.division, confidence FROM budgets JOIN mapped USING (budget_id) ORDER BY confidence, budget_code, budget_id LIMIT 50""")
def budget_page(spark: SparkSession, sf: str) -> DataFrame:
    """The least sure mappings first."""
    return tables.budgets(spark, sf).select("budget_id", "budget_code").join(_mapped(spark, sf), "budget_id").orderBy("confidence", "budget_code", "budget_id").limit(50).select("budget_id", "budget_code", "division", "confidence")


@query(f"""{WITH}{TREE} SELECT division, budget_code, budget_cents - greatest(actual_cents, committed_cents) AS variance_cents FROM tree ORDER BY variance_cents, division, budget_code LIMIT 10""")
def worst_variances(spark: SparkSession, sf: str) -> DataFrame:
    rows = ledger.hierarchy(tables.budgets(spark, sf), tables.costs(spark, sf))
    return rows.orderBy("surplus_cents", "division", "budget_code").limit(10).select("division", "budget_code", F.col("surplus_cents").alias("variance_cents"))


@query(f"""{WITH[:-2]} SELECT zone, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct, array_to_string(list_sort(list(DISTINCT budget_code))[1:10], ',') AS first_codes FROM budgets GROUP BY zone""")
def side_summary(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    sides = tables.budgets(spark, sf).groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("budget_code")), 1, 10), ",").alias("first_codes"))
    return sides.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))  # a handful of sides


@query(f"""{WITH}f AS (SELECT lower(vendor) AS vendor, substr(lower(name), 1, 20) AS prefix, cost_code, date, cost_key FROM costs)
SELECT vendor, prefix, cost_code, min(date) AS first_seen, count(*) AS n FROM f GROUP BY ALL""")
def feedback_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """The first use and the number of uses of each vendor, name prefix and code, from the mappings of the past."""
    rows = tables.costs(spark, sf).select(F.lower("vendor").alias("vendor"), F.substring(F.lower("name"), 1, 20).alias("prefix"), "cost_code", "date")
    return rows.groupBy("vendor", "prefix", "cost_code").agg(F.min("date").alias("first_seen"), F.count(F.lit(1)).alias("n"))


@query(f"""{WITH}f AS (SELECT cost_code, count(*) FILTER (zone = 'EAST') AS ok, count(*) FILTER (zone = 'WEST') AS bad FROM costs GROUP BY 1) SELECT cost_code, ok AS accepted, bad AS overridden, round(greatest(0.3::DOUBLE, (ok + 1) / (ok + bad * 1.5::DOUBLE + 2)), 6) AS trust FROM f""")
def code_trust(spark: SparkSession, sf: str) -> DataFrame:
    """Trust in each budget code from accepted and overridden choices (here: costs east and west)."""
    sums = tables.costs(spark, sf).groupBy("cost_code").agg(F.count_if(F.col("zone") == "EAST").alias("accepted"), F.count_if(F.col("zone") == "WEST").alias("overridden"))
    return sums.withColumn("trust", F.round(mapping.trust(F.col("accepted"), F.col("overridden")), 6))


SIDES = f"""{WITH}c AS (SELECT cost_code, CASE WHEN l_partkey % 17 <> 0 THEN name END AS name, amount_cents FROM costs),
m AS (SELECT budget_code AS cost_code, CASE WHEN budget_id % 17 <> 0 THEN description END AS name, CASE budget_id % 5 WHEN 0 THEN 'EAST' WHEN 1 THEN 'WEST' WHEN 2 THEN 'BOTH' END AS side FROM budgets WHERE budget_id % 5 < 3)"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Costs and mappings by code and name, some names null in both; two budgets of five have no mapping."""
    costs = tables.cost_rows(spark, sf, vendors=False).select("cost_code", F.when(F.col("l_partkey") % 17 != 0, F.col("name")).alias("name"), "amount_cents")
    k = F.col("budget_id")
    side = F.when(k % 5 == 0, "EAST").when(k % 5 == 1, "WEST").when(k % 5 == 2, "BOTH").alias("side")
    return costs, tables.budgets(spark, sf).where(k % 5 < 3).select(F.col("budget_code").alias("cost_code"), F.when(k % 17 != 0, F.col("description")).alias("name"), side)


def _on_sql(asked: str, sides: str) -> str:
    return f"SELECT '{asked}' AS asked, count(*) AS n_costs, CAST(sum(amount_cents) AS BIGINT) AS cents FROM c WHERE EXISTS (SELECT 1 FROM m WHERE m.cost_code IS NOT DISTINCT FROM c.cost_code AND m.name IS NOT DISTINCT FROM c.name AND side IN ({sides}))"


@query(f"""{SIDES} {_on_sql('EAST', "'EAST', 'BOTH'")} UNION ALL {_on_sql('WEST alone', "'WEST'")} UNION ALL {_on_sql('BOTH', "'BOTH'")}
UNION ALL SELECT unnest(['NORTH', 'all']), count(*), CAST(sum(amount_cents) AS BIGINT) FROM c""")
def costs_on_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Costs by side: east with both, west without, both alone, a side that nothing is mapped to, and no side."""
    costs, mappings = _sides(spark, sf)
    out = None
    for name, side, both in (("EAST", "EAST", True), ("WEST alone", "WEST", False), ("BOTH", "BOTH", True), ("NORTH", "NORTH", False), ("all", None, True)):
        one = ledger.on_side(costs, mappings, side, ["cost_code", "name"], both).agg(F.lit(name).alias("asked"), F.count(F.lit(1)).alias("n_costs"), F.sum("amount_cents").alias("cents"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{SIDES} SELECT cost_code, count(*) AS n_costs, CAST(sum(amount_cents) AS BIGINT) AS cents FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.cost_code IS NOT DISTINCT FROM c.cost_code AND m.name IS NOT DISTINCT FROM c.name) GROUP BY 1")
def costs_unmapped_by_tuple(spark: SparkSession, sf: str) -> DataFrame:
    costs, mappings = _sides(spark, sf)
    return ledger.off_side(costs, mappings, ["cost_code", "name"]).groupBy("cost_code").agg(F.count(F.lit(1)).alias("n_costs"), F.sum("amount_cents").alias("cents"))
