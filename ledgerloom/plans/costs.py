"""Queries on costs: reconciliation, duplicates, roll-ups, panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.money import safe_ratio
from ..operators import dedupe, features, quantiles, recon
from ..sources import tables
from ..sources.tables import SQL, east_sql
from .base import registered

AS_OF = "2000-01-01"
WITH = f"WITH {SQL.strip()},\n"
query, QUERIES, ORACLE_SQL = registered()


ACTUALS = f"""acts AS (SELECT division, CAST(sum(amount_cents) AS BIGINT) AS actual_cents, count(*) AS n_costs FROM costs WHERE date <= DATE '{AS_OF}' GROUP BY division),
actuals AS (SELECT acts.*, {east_sql('actual_cents', 'coalesce(east_funded_cents, 0)', 'coalesce(west_funded_cents, 0)')} AS east_cents FROM acts LEFT JOIN breakdown USING (division)),
coms AS (SELECT division, CAST(sum(committed_cents) AS BIGINT) AS committed_cents FROM budgets GROUP BY division),
commitments AS (SELECT coms.*, {east_sql('committed_cents', 'coalesce(east_funded_cents, 0)', 'coalesce(west_funded_cents, 0)')} AS committed_east_cents FROM coms LEFT JOIN breakdown USING (division))
"""


@query(f"{WITH}{ACTUALS} SELECT division, actual_cents, n_costs, east_cents, actual_cents - east_cents AS west_cents FROM actuals")
def recon_actuals_by_division(spark: SparkSession, sf: str) -> DataFrame:
    return recon.actuals(tables.cost_rows(spark, sf, vendors=False), tables.breakdown(spark, sf), AS_OF)


@query(f"{WITH}{ACTUALS} SELECT division, committed_cents, committed_east_cents, committed_cents - committed_east_cents AS committed_west_cents FROM commitments")
def recon_commitments(spark: SparkSession, sf: str) -> DataFrame:
    return recon.commitments(tables.budgets(spark, sf), tables.breakdown(spark, sf))


@query(f"""{WITH}{ACTUALS}, base AS (
  SELECT division, sov_cents AS gmp_cents, coalesce(actual_cents, 0) AS actual_cents, coalesce(n_costs, 0) AS n_costs, coalesce(committed_cents, 0) AS committed_cents,
    coalesce(east_cents, 0) AS ae, coalesce(actual_cents - east_cents, 0) AS aw, coalesce(committed_east_cents, 0) AS ce, coalesce(committed_cents - committed_east_cents, 0) AS cw
  FROM breakdown LEFT JOIN actuals USING (division) LEFT JOIN commitments USING (division)),
eac AS (SELECT *, CASE WHEN ae > 0 THEN greatest(ae, ae + greatest(0, ce - ae)) ELSE ae END AS e, CASE WHEN aw > 0 THEN greatest(aw, aw + greatest(0, cw - aw)) ELSE aw END AS w FROM base)
SELECT division, gmp_cents, actual_cents, n_costs, committed_cents, e AS eac_east_cents, w AS eac_west_cents, e + w AS eac_total_cents, gmp_cents - (e + w) AS surplus_cents,
  round(CASE WHEN gmp_cents = 0 THEN 0 ELSE actual_cents::DOUBLE / gmp_cents END * 100, 6) AS pct_spent FROM eac""")
def recon_full(spark: SparkSession, sf: str) -> DataFrame:
    return recon.reconciled(tables.cost_rows(spark, sf, vendors=False), tables.budgets(spark, sf), tables.breakdown(spark, sf), AS_OF)


@query(f"{WITH}{ACTUALS} SELECT CAST((SELECT sum(amount_cents) FROM costs) AS BIGINT) AS costs_cents, CAST((SELECT sum(actual_cents) FROM actuals) AS BIGINT) AS divisions_cents, abs((SELECT sum(amount_cents) FROM costs) - (SELECT sum(actual_cents) FROM actuals)) <= 1 AS ties")
def recon_tie_out(spark: SparkSession, sf: str) -> DataFrame:
    c = tables.costs(spark, sf)
    return recon.tie_out(c, recon.actuals(c, tables.breakdown(spark, sf), AS_OF))


@query(f"""{WITH[:-2]} SELECT CAST(sum(amount_cents) AS BIGINT) AS total_cents, CAST(coalesce(sum(amount_cents) FILTER (amount_cents < 0), 0) AS BIGINT) AS credit_cents, count(*) AS n_costs,
  count(*) FILTER (amount_cents < 0) AS n_credits, count(*) FILTER (division IS NULL) AS n_unmapped, count(DISTINCT vendor) AS n_vendors, min(date) AS first_date, max(date) AS last_date,
  CAST(floor(sum(amount_cents)::DOUBLE / count(*)) AS BIGINT) AS average_cents FROM costs""")
def recon_summary(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("amount_cents")
    return tables.costs(spark, sf).agg(
        F.sum(a).alias("total_cents"), F.coalesce(F.sum(F.when(a < 0, a)), F.lit(0)).alias("credit_cents"), F.count(F.lit(1)).alias("n_costs"), F.count_if(a < 0).alias("n_credits"),
        F.count_if(F.col("division").isNull()).alias("n_unmapped"), F.countDistinct("vendor").alias("n_vendors"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.floor(F.sum(a) / F.count(F.lit(1))).cast("long").alias("average_cents"),
    )


@query(f"""{WITH}s AS (SELECT division, cost_code, CAST(sum(amount_cents) AS BIGINT) AS total_cents, count(*) AS n_costs FROM costs GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY division ORDER BY abs(total_cents) DESC, cost_code) AS place FROM s QUALIFY place <= 10),
r AS (SELECT division, cost_code, cost_key, row_number() OVER (PARTITION BY division, cost_code ORDER BY abs(amount_cents) DESC, cost_key) AS r FROM costs QUALIFY r <= 20),
l AS (SELECT division, cost_code, string_agg(cost_key, ',' ORDER BY r) AS records FROM r GROUP BY ALL)
SELECT division, cost_code, total_cents, n_costs, CAST(place AS INTEGER) AS place, records FROM t JOIN l USING (division, cost_code)""")
def recon_drilldown(spark: SparkSession, sf: str) -> DataFrame:
    return recon.drilldown(tables.cost_rows(spark, sf, vendors=False), key=tables.cost_key())


@query(f"""{WITH[:-2]} SELECT division, zone, CAST(sum(amount_cents) AS BIGINT) AS cents, count(*) AS n_costs, grouping(division) * 2 + grouping(zone) AS level FROM costs GROUP BY ROLLUP (division, zone)""")
def rollup_division_zone(spark: SparkSession, sf: str) -> DataFrame:
    return tables.costs(spark, sf).rollup("division", "zone").agg(F.sum("amount_cents").alias("cents"), F.count(F.lit(1)).alias("n_costs"), F.grouping_id().alias("level"))


@query(f"""{WITH[:-2]} SELECT cost_code, zone, CAST(sum(amount_cents) AS BIGINT) AS cents, count(*) AS n_costs FROM costs GROUP BY GROUPING SETS ((cost_code), (zone), ())""")
def batch_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = tables.costs(spark, sf)
    return c.groupingSets([["cost_code"], ["zone"], []], "cost_code", "zone").agg(F.sum("amount_cents").alias("cents"), F.count(F.lit(1)).alias("n_costs"))


def _kept(side: str, include_both: bool = True):
    return F.col("zone").isin(side, "SHARED") if include_both else F.col("zone") == side


@query(f"{WITH[:-2]} SELECT division, CAST(sum(amount_cents) AS BIGINT) AS cents, count(*) AS n_costs FROM costs WHERE vendor IN (SELECT vendor FROM costs WHERE zone IN ('EAST', 'SHARED')) GROUP BY division")
def side_filter_east(spark: SparkSession, sf: str) -> DataFrame:
    c = tables.costs(spark, sf)
    keys = c.where(_kept("EAST")).select("vendor").distinct()
    return c.join(keys, "vendor", "left_semi").groupBy("division").agg(F.sum("amount_cents").alias("cents"), F.count(F.lit(1)).alias("n_costs"))


@query(f"{WITH[:-2]} SELECT budget_id, budget_code, division FROM budgets WHERE budget_id NOT IN (SELECT l_partkey FROM costs WHERE date <= DATE '1996-06-30')")
def unmapped_budgets(spark: SparkSession, sf: str) -> DataFrame:
    used = recon.as_of(tables.costs(spark, sf), "1996-06-30").select(F.col("l_partkey").alias("budget_id"))
    return tables.budgets(spark, sf).join(used, "budget_id", "left_anti").select("budget_id", "budget_code", "division")


@query(f"""{WITH[:-2]} SELECT cost_code, vendor, name, date, amount_cents FROM costs WHERE contains(lower(name), 'steel') OR contains(lower(vendor), '7') ORDER BY abs(amount_cents) DESC, cost_key LIMIT 50 OFFSET 25""")
def search_page(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.lower("name").contains("steel") | F.lower("vendor").contains("7")
    rows = tables.costs(spark, sf).where(hit).orderBy(F.desc(F.abs("amount_cents")), "cost_key").offset(25).limit(50)
    return rows.select("cost_code", "vendor", "name", "date", "amount_cents")


@query(f"""{WITH[:-2]} SELECT count(*) AS n, count(*) FILTER (vendor IS NULL OR trim(vendor) = '') AS no_vendor, count(*) FILTER (date IS NULL) AS no_date, count(*) FILTER (amount_cents = 0) AS zero,
  CAST(date_diff('day', min(date), max(date)) AS INTEGER) AS span_days, date_diff('day', min(date), max(date)) > 1095 AS long_span FROM costs""")
def data_health(spark: SparkSession, sf: str) -> DataFrame:
    span = F.datediff(F.max("date"), F.min("date"))
    return tables.costs(spark, sf).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("vendor").isNull() | (F.trim("vendor") == "")).alias("no_vendor"), F.count_if(F.col("date").isNull()).alias("no_date"), F.count_if(F.col("amount_cents") == 0).alias("zero"), span.alias("span_days"), (span > 1095).alias("long_span")
    )


KEYS, SAME = ["l_suppkey", "quantity", "date"], ["l_suppkey", "l_partkey", "quantity"]


@query(f"""{WITH}g AS (SELECT l_suppkey, quantity, date, count(*) AS group_size, min(cost_key) AS group_id FROM costs GROUP BY ALL HAVING count(*) > 1)
SELECT cost_key, group_size, group_id FROM costs JOIN g USING (l_suppkey, quantity, date)""")
def duplicates_exact(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.exact(tables.cost_items(spark, sf), KEYS, named=tables.cost_key()).select("cost_key", "group_size", "group_id")


EXACT = "ex AS (SELECT min(cost_key) OVER (PARTITION BY l_suppkey, quantity, date) AS group_id, cost_key AS row_id, 1.0::DOUBLE AS score, count(*) OVER (PARTITION BY l_suppkey, quantity, date) AS n FROM costs)"
NEAR = """nr AS (SELECT CAST(min(cost_key) OVER w AS VARCHAR) AS group_id, cost_key AS row_id, count(*) OVER w AS n, min(date) OVER w AS lo, max(date) OVER w AS hi FROM costs WINDOW w AS (PARTITION BY l_suppkey, l_partkey, quantity))"""
MEMBERS = f"""{EXACT}, {NEAR}, members AS (SELECT 'exact:' || group_id AS group_id, row_id, score, 'exact' AS method FROM ex WHERE n > 1
  UNION ALL SELECT 'near:' || group_id, row_id, CAST(0.95 AS DOUBLE) - CASE WHEN hi - lo <= 7 THEN 0.0::DOUBLE WHEN hi - lo <= 30 THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END, 'near' FROM nr WHERE n > 1 AND hi > lo)"""


def _duplicates(spark: SparkSession, sf: str) -> DataFrame:
    items = tables.cost_items(spark, sf)
    one = dedupe.exact(items, KEYS, named=tables.cost_key()).select("group_id", F.col("cost_key").alias("row_id"), F.lit(1.0).alias("score"))
    two = dedupe.near_members(items, SAME, named=tables.cost_key()).select(F.col("first_id").alias("group_id"), F.col("cost_key").alias("row_id"), "score")
    return dedupe.united([("exact", one), ("near", two)])


@query(f"{WITH}{MEMBERS} SELECT *, max(score) OVER (PARTITION BY group_id) AS top_score FROM members")
def duplicates_united(spark: SparkSession, sf: str) -> DataFrame:
    return _duplicates(spark, sf)


@query(f"""{WITH}{MEMBERS}, g AS (SELECT group_id, method, max(score) AS score, count(*) AS n FROM members GROUP BY ALL)
SELECT method, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_groups, count(*) FILTER (score >= 0.98) AS n_auto, count(*) FILTER (score < 0.98) AS n_pending, max(n) AS largest_group FROM g GROUP BY method""")
def duplicates_summary(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.summarised(_duplicates(spark, sf))


@query(f"""{WITH}{ACTUALS}, k AS (SELECT division, amount_cents FROM costs WHERE date <= DATE '{AS_OF}' QUALIFY cost_key = min(cost_key) OVER (PARTITION BY l_suppkey, quantity, date))
SELECT division, CAST(sum(amount_cents) AS BIGINT) AS actual_cents, count(*) AS n_costs FROM k GROUP BY division""")
def recon_actuals_without_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of exact duplicates score 1.0 and collapse by themselves: all but their first rows leave the actuals."""
    flagged = dedupe.keep_first(recon.as_of(tables.costs(spark, sf), AS_OF), KEYS)
    return recon.actuals(flagged, tables.breakdown(spark, sf), AS_OF).select("division", "actual_cents", "n_costs")


@query(f"""{WITH}g AS (SELECT l_suppkey, l_partkey, quantity, count(*) AS n, count(DISTINCT date) AS n_dates, CAST(max(date) - min(date) AS INTEGER) AS span_days, min(cost_key) AS first_id FROM costs GROUP BY ALL)
SELECT *, CAST(0.95 AS DOUBLE) - CASE WHEN span_days <= 7 THEN 0.0::DOUBLE WHEN span_days <= 30 THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END AS score FROM g WHERE n > 1 AND n_dates > 1""")
def duplicates_near(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.near(tables.cost_items(spark, sf), SAME, named=tables.cost_key())


@query(f"""{WITH}k AS (SELECT *, cost_key <> min(cost_key) OVER (PARTITION BY l_suppkey, quantity, date) AS excluded FROM costs)
SELECT division, count(*) FILTER (excluded) AS n_excluded, CAST(coalesce(sum(amount_cents) FILTER (NOT excluded), 0) AS BIGINT) AS kept_cents FROM k GROUP BY division""")
def duplicates_excluded(spark: SparkSession, sf: str) -> DataFrame:
    rows = dedupe.keep_first(tables.costs(spark, sf), KEYS)
    return rows.groupBy("division").agg(F.count_if("excluded").alias("n_excluded"), F.coalesce(F.sum(F.when(~F.col("excluded"), F.col("amount_cents"))), F.lit(0)).alias("kept_cents"))


@query(f"""{WITH.replace("WITH", "WITH RECURSIVE", 1)}r AS (SELECT l_suppkey, abs(amount_cents) // 100000 AS size, amount_cents < 0 AS credit, date, cost_key,
  row_number() OVER (PARTITION BY l_suppkey, abs(amount_cents) // 100000, amount_cents < 0 ORDER BY date, cost_key) AS k FROM costs WHERE amount_cents <> 0 AND date IS NOT NULL AND l_suppkey IS NOT NULL),
s AS (SELECT l_suppkey, size, 1::BIGINT AS i, 1::BIGINT AS j, NULL::VARCHAR AS charge_id, NULL::DATE AS charge_date, NULL::VARCHAR AS credit_id, NULL::DATE AS credit_date FROM r GROUP BY l_suppkey, size
  UNION ALL SELECT s.l_suppkey, s.size, s.i + CASE WHEN c.date - p.date < -30 THEN 0 ELSE 1 END, s.j + CASE WHEN c.date - p.date > 30 THEN 0 ELSE 1 END, CASE WHEN abs(c.date - p.date) <= 30 THEN p.cost_key END, p.date, c.cost_key, c.date
  FROM s JOIN r p ON p.l_suppkey = s.l_suppkey AND p.size = s.size AND p.k = s.i AND NOT p.credit JOIN r c ON c.l_suppkey = s.l_suppkey AND c.size = s.size AND c.k = s.j AND c.credit)
SELECT l_suppkey, size, charge_id, charge_date, credit_id, credit_date, CAST(abs(charge_date - credit_date) AS INTEGER) AS gap_days FROM s WHERE charge_id IS NOT NULL""")
def reversals(spark: SparkSession, sf: str) -> DataFrame:
    """Charges and credits of a supplier in the same thousand, within 30 days."""
    return dedupe.reversals(tables.costs(spark, sf), ["l_suppkey"], days=30, step=100_000)


@query()
def duplicates_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.fuzzy_pairs(tables.costs(spark, sf), known=dedupe.exact(tables.cost_items(spark, sf), KEYS, named=tables.cost_key()))


@query(f"""{WITH[:-2]} SELECT date_trunc('week', date)::DATE AS week, CAST(isoyear(date_trunc('week', date)) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(date_trunc('week', date)) AS VARCHAR), 2, '0') AS label,
  CAST(sum(amount_cents) AS BIGINT) AS cents, count(*) AS n_costs, CASE WHEN date_trunc('week', date) < DATE '1999-12-27' THEN 'actual' WHEN date_trunc('week', date) = DATE '1999-12-27' THEN 'blended' ELSE 'forecast' END AS kind FROM costs GROUP BY ALL""")
def weekly_totals(spark: SparkSession, sf: str) -> DataFrame:
    weeks = tables.costs(spark, sf).groupBy(dates.week_start(F.col("date")).alias("week")).agg(F.sum("amount_cents").alias("cents"), F.count(F.lit(1)).alias("n_costs"))
    now = dates.week_start(F.lit(AS_OF).cast("date"))
    return weeks.select("week", dates.iso_label(F.col("week")).alias("label"), "cents", "n_costs", F.when(F.col("week") < now, "actual").when(F.col("week") == now, "blended").otherwise("forecast").alias("kind"))


@query(f"""{WITH}m AS (SELECT division, strftime(date, '%Y-%m') AS month, CAST(sum(amount_cents) AS BIGINT) AS cents FROM costs GROUP BY ALL)
SELECT *, CAST(sum(cents) OVER (PARTITION BY division ORDER BY month) AS BIGINT) AS cumulative_cents FROM m""")
def monthly_trend(spark: SparkSession, sf: str) -> DataFrame:
    months = tables.costs(spark, sf).groupBy("division", F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum("amount_cents").alias("cents"))
    run = Window.partitionBy("division").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return months.withColumn("cumulative_cents", F.sum("cents").over(run))


@query(f"""{WITH}w AS (SELECT division, date_trunc('week', date)::DATE AS week, CAST(sum(amount_cents) AS BIGINT) AS cents, count(*) AS n_costs FROM costs GROUP BY ALL),
b AS (SELECT division, CAST(sum(current_budget_cents) AS BIGINT) AS bac FROM budgets GROUP BY division),
c AS (SELECT *, CAST(sum(cents) OVER (PARTITION BY division ORDER BY week) AS BIGINT) AS cumulative_cents FROM w)
SELECT c.*, bac, bac // 2 - cumulative_cents AS remaining_half_cents, CAST(month(week) AS INTEGER) AS month, CAST(quarter(week) AS INTEGER) AS quarter, CAST(dayofyear(week) AS INTEGER) AS day_of_year,
  CAST(weekofyear(week) AS INTEGER) AS iso_week, CAST(year(week) AS INTEGER) AS year FROM c JOIN b USING (division)""")
def weekly_panel(spark: SparkSession, sf: str) -> DataFrame:
    return features.weekly_panel(tables.costs(spark, sf), tables.budgets(spark, sf))


@query(f"""{WITH}d AS (SELECT division, date, CAST(sum(amount_cents) AS BIGINT) AS cents FROM costs GROUP BY ALL)
SELECT *, CAST(sum(cents) OVER (PARTITION BY division ORDER BY date RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS cents_30d,
  CAST(sum(cents) OVER (PARTITION BY division ORDER BY date RANGE BETWEEN INTERVAL 59 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS cents_60d,
  CAST(sum(cents) OVER (PARTITION BY division ORDER BY date RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS cents_90d FROM d""")
def rolling_costs(spark: SparkSession, sf: str) -> DataFrame:
    daily = tables.costs(spark, sf).groupBy("division", "date").agg(F.sum("amount_cents").alias("cents"))
    return features.rolling(daily, "division", "cents")


MONTHS = "m AS (SELECT division, strftime(date, '%Y-%m') AS month, CAST(sum(amount_cents) AS BIGINT) AS cents FROM costs GROUP BY ALL)"


def _months(spark: SparkSession, sf: str) -> DataFrame:
    return tables.costs(spark, sf).groupBy("division", F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum("amount_cents").alias("cents"))


@query(f"""{WITH}{MONTHS} SELECT division, month, cents, lag(cents, 1) OVER w AS lag1, lag(cents, 2) OVER w AS lag2,
  CAST(round(sum(cents::DOUBLE) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3) AS BIGINT) AS mean3, CAST(round(stddev_pop(cents::DOUBLE) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS BIGINT) AS sd3,
  CAST(cents - coalesce(lag(cents) OVER w, cents) AS BIGINT) AS change, CAST(round(avg(cents::DOUBLE) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) / 30) AS BIGINT) AS velocity
FROM m WINDOW w AS (PARTITION BY division ORDER BY month)""")
def temporal_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.temporal(_months(spark, sf), "division", "month", "cents")
    return rows.withColumns({c: F.round(c).cast("long") for c in ("mean3", "sd3", "change", "velocity")})


@query(f"""{WITH}{MONTHS}, h AS (SELECT division, month, cents AS target, list(cents) OVER (PARTITION BY division ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS l FROM m)
SELECT division, month, target, array_to_string(l, ',') AS history FROM h WHERE len(l) = 6""")
def sequence_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.sequences(_months(spark, sf), "division", "month", "cents", 6)
    return rows.select("division", "month", "target", F.array_join(F.col("history").cast("array<string>"), ",").alias("history"))


@query(f"""{WITH}{MONTHS}, p AS (SELECT division, CASE WHEN row_number() OVER (PARTITION BY division ORDER BY month) <= floor(count(*) OVER (PARTITION BY division) * 0.8) THEN 'train' ELSE 'test' END AS part, cents FROM m)
SELECT division, part, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM p GROUP BY ALL""")
def training_split(spark: SparkSession, sf: str) -> DataFrame:
    return features.time_split(_months(spark, sf), "division", "month").groupBy("division", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query(f"""{WITH[:-2]} SELECT division, CAST(round(quantile_cont(abs(amount_cents)::DOUBLE, 0.25)) AS BIGINT) AS q1, CAST(round(quantile_cont(abs(amount_cents)::DOUBLE, 0.5)) AS BIGINT) AS median,
  CAST(round(quantile_cont(abs(amount_cents)::DOUBLE, 0.75)) AS BIGINT) AS q3, min(amount_cents) AS least, max(amount_cents) AS most, CAST(round(stddev_samp(amount_cents)) AS BIGINT) AS sd FROM costs GROUP BY division""")
def scaling_stats(spark: SparkSession, sf: str) -> DataFrame:
    costs = tables.costs(spark, sf)
    rest = costs.groupBy("division").agg(F.min("amount_cents").alias("least"), F.max("amount_cents").alias("most"), F.round(F.stddev_samp("amount_cents")).cast("long").alias("sd"))
    found = quantiles.exact(costs, ["division"], F.abs("amount_cents"), [0.25, 0.5, 0.75]).withColumnRenamed("division", "_division")
    rows = rest.join(found, rest["division"].eqNullSafe(found["_division"]))
    return rows.select("division", *[F.round(F.col("quantiles")[k]).cast("long").alias(n) for k, n in enumerate(("q1", "median", "q3"))], "least", "most", "sd")


@query(f"""{WITH}{MONTHS}, i AS (SELECT division, row_number() OVER (PARTITION BY division ORDER BY month) AS x, cents FROM m)
SELECT division, count(*) AS n, CAST(round(regr_slope(cents, x)) AS BIGINT) AS slope, CAST(round(regr_intercept(cents, x)) AS BIGINT) AS intercept FROM i GROUP BY division""")
def trend_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = _months(spark, sf).withColumn("x", F.row_number().over(Window.partitionBy("division").orderBy("month")))
    return features.fitted_lines(rows, "division", "x", "cents").withColumns({c: F.round(c).cast("long") for c in ("slope", "intercept")})


@query()
def regression_planes(spark: SparkSession, sf: str) -> DataFrame:
    panel = features.weekly_panel(tables.costs(spark, sf), tables.budgets(spark, sf))
    return features.fitted_planes(panel, "division", ["month", "iso_week", "n_costs"], "cents")


@query(f"""{WITH}b AS (SELECT budget_id, division, current_budget_cents AS budget, coalesce(a, 0) AS actual FROM budgets LEFT JOIN (SELECT l_partkey AS budget_id, CAST(sum(amount_cents) AS BIGINT) AS a FROM costs GROUP BY 1) USING (budget_id))
SELECT division, count(*) AS n_lines, count(*) FILTER (actual > budget) AS n_over, count(*) FILTER (actual <= budget AND actual * 10 > budget * 9) AS n_near, CAST(sum(budget) AS BIGINT) AS budget_cents, CAST(sum(actual) AS BIGINT) AS actual_cents,
  CAST(sum(budget) - sum(actual) AS BIGINT) AS headroom_cents, round(CASE WHEN sum(budget) = 0 THEN 0 ELSE sum(actual)::DOUBLE / sum(budget)::DOUBLE END * 100, 6) AS spent_pct FROM b GROUP BY division""")
def budget_validation(spark: SparkSession, sf: str) -> DataFrame:
    spent = tables.costs(spark, sf).groupBy(F.col("l_partkey").alias("budget_id")).agg(F.sum("amount_cents").alias("actual"))
    rows = tables.budgets(spark, sf).select("budget_id", "division", F.col("current_budget_cents").alias("budget")).join(spent, "budget_id", "left").na.fill(0, ["actual"])
    over, near = F.col("actual") > F.col("budget"), (F.col("actual") <= F.col("budget")) & (F.col("actual") * 10 > F.col("budget") * 9)
    sums = rows.groupBy("division").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(over).alias("n_over"), F.count_if(near).alias("n_near"), F.sum("budget").alias("budget_cents"), F.sum("actual").alias("actual_cents"))
    return sums.withColumns({"headroom_cents": F.col("budget_cents") - F.col("actual_cents"), "spent_pct": F.round(safe_ratio(F.col("actual_cents"), F.col("budget_cents")) * 100, 6)})


@query(f"""{WITH[:-2]} SELECT division, CAST(sum(amount_cents) FILTER (date <= DATE '{AS_OF}') AS BIGINT) AS cumulative_cents, CAST(coalesce(sum(amount_cents) FILTER (date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'), 0) AS BIGINT) AS period_cents,
  max(date) AS last_date FROM costs GROUP BY division""")
def cumulative_and_period(spark: SparkSession, sf: str) -> DataFrame:
    a, d = F.col("amount_cents"), F.col("date")
    return tables.costs(spark, sf).groupBy("division").agg(F.sum(F.when(d <= F.lit(AS_OF).cast("date"), a)).alias("cumulative_cents"), F.coalesce(F.sum(F.when(d.between(F.lit("1999-01-01").cast("date"), F.lit("1999-12-31").cast("date")), a)), F.lit(0)).alias("period_cents"), F.max("date").alias("last_date"))
