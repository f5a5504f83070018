"""Queries on lists in order: row ids, duplicates for display, histories, contributions, trades, curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, money
from ..operators import listings
from ..sources import tables
from .base import registered
from .costs import MEMBERS, WITH, _duplicates
from .schedules import ALLOCATED, _allocated

query, QUERIES, ORACLE_SQL = registered()
WEIGHT = "(duration_days * CASE WHEN is_critical THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END)"
WEEKS = """wk AS (SELECT {key}, CAST(date_trunc('week', date) AS DATE) AS week, CAST(sum(amount_cents) AS BIGINT) AS cents FROM costs WHERE date IS NOT NULL GROUP BY ALL),
cum AS (SELECT {key}, week, cents, CAST(sum(cents) OVER (PARTITION BY {key} ORDER BY week) AS BIGINT) AS eac_cents FROM wk)"""


def _weight():
    return F.col("duration_days") * F.when(F.col("is_critical"), 1.5).otherwise(1.0)


@query(f"{WITH[:-2]} SELECT cost_key, amount_cents, row_number() OVER (ORDER BY l_orderkey, cost_key) - 1 AS row_id FROM costs QUALIFY amount_cents < 0")
def cost_row_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids are positions before credits are picked."""
    rows = listings.numbered(tables.costs(spark, sf).select("l_orderkey", "cost_key", "amount_cents"), "l_orderkey", ["cost_key"])
    return rows.where("amount_cents < 0").select("cost_key", "amount_cents", "row_id")


@query(f"""{WITH}{MEMBERS} SELECT group_id, row_id, method, format('{{:.2f}}%', score * 100) AS score, vendor, invoice, CASE WHEN amount_cents < 0 THEN '-$' ELSE '$' END || format('{{:,.2f}}', abs(amount_cents) / 100.0) AS amount, date
FROM members JOIN costs ON row_id = cost_key ORDER BY group_id, row_id""")
def duplicates_listed(spark: SparkSession, sf: str) -> DataFrame:
    """Members of groups with their rows for display, ordered by group and row."""
    rows = tables.cost_items(spark, sf).withColumn("_h", F.xxhash64(tables.cost_key()))  # keys, long texts, meet by their hashes first
    shown = _duplicates(spark, sf).select("group_id", "row_id", "method", F.format_string("%.2f%%", F.col("score") * 100).alias("score"))
    met = shown.withColumn("_h", F.xxhash64("row_id")).join(rows, "_h").where(tables.cost_key() == F.col("row_id"))
    met = met.join(tables.vendors(spark, sf), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return met.select("group_id", "row_id", "method", "score", "vendor", F.col("l_orderkey").cast("string").alias("invoice"), money.display(F.col("amount_cents")).alias("amount"), "date").orderBy("group_id", "row_id")


@query(f"""{ALLOCATED} SELECT division, activity_id, start_date, CAST(round(expected_cost / 1000) AS BIGINT) AS expected_cost, CAST(row_number() OVER (PARTITION BY division ORDER BY {WEIGHT} DESC, start_date, activity_id) AS INTEGER) AS place FROM al""")
def activities_by_contribution(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings.by_contribution(_allocated(spark, sf), _weight(), ["division"])
    return rows.select("division", "activity_id", "start_date", F.round(F.col("expected_cost") / 1000).cast("long").alias("expected_cost"), "place")


@query(f"""{ALLOCATED}, tot AS (SELECT division, budget, count(*) AS n_activities FROM al GROUP BY ALL ORDER BY budget DESC, division LIMIT 10)
SELECT division, n_activities, activity_id, CAST(round(expected_cost / 1000) AS BIGINT) AS expected_cost, CAST(row_number() OVER (PARTITION BY division ORDER BY {WEIGHT} DESC, start_date, activity_id) AS INTEGER) AS place FROM al JOIN tot USING (division) QUALIFY place <= 5""")
def top_trades(spark: SparkSession, sf: str) -> DataFrame:
    """The ten trades of most expected cost and their five largest activities."""
    rows = listings.top_trades(_allocated(spark, sf), "division", "expected_cost", _weight())
    return rows.select("division", "n_activities", "activity_id", F.round(F.col("expected_cost") / 1000).cast("long").alias("expected_cost"), "place")


@query(f"{WITH[:-2]} SELECT division, count(*) AS n_activities, CAST(sum(duration_days) AS BIGINT) AS total_days FROM activities GROUP BY division ORDER BY n_activities DESC, division LIMIT 15")
def trade_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The fifteen trades of most activities."""
    sums = tables.activities(spark, sf).groupBy("division").agg(F.count(F.lit(1)).alias("n_activities"), F.sum("duration_days").cast("long").alias("total_days"))
    return sums.orderBy(F.desc("n_activities"), "division").limit(15)


def _cumulated(spark: SparkSession, sf: str, key: str) -> DataFrame:
    """(key, week, cents, eac_cents): what each week cost, and all weeks up to it."""
    from pyspark.sql import Window

    weeks = tables.cost_rows(spark, sf, vendors=key == "zone").where(F.col("date").isNotNull()).groupBy(key, dates.week_start(F.col("date")).alias("week")).agg(F.sum("amount_cents").alias("cents"))
    return weeks.withColumn("eac_cents", F.sum("cents").over(Window.partitionBy(key).orderBy("week")))


@query(f"{WITH}{WEEKS.format(key='division')} SELECT *, CAST(row_number() OVER (PARTITION BY division ORDER BY week DESC) AS INTEGER) AS place FROM cum QUALIFY place <= 20")
def snapshot_history(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot a week; each division's newest ones."""
    return listings.newest(_cumulated(spark, sf, "division"), ["division"], ["week"], listings.SNAPSHOTS)


@query("""WITH e AS (SELECT user_id, event_id, event_type, ts FROM events) SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM e QUALIFY place <= 50""")
def change_history(spark: SparkSession, sf: str) -> DataFrame:
    """Events as entries of a change log; each user's newest ones."""
    rows = listings.newest(tables.read(spark, sf, "events"), ["user_id"], ["ts", "event_id"], listings.HISTORY)
    return rows.select("user_id", "event_id", "event_type", "place")


@query(f"{WITH}{WEEKS.format(key='zone')} SELECT zone, week AS period_date, eac_cents AS actual_cumulative_cents, sum(cents) OVER (PARTITION BY zone ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)::BIGINT AS last_four_cents FROM cum WHERE zone = 'EAST' ORDER BY zone, week")
def curve_of_zone(spark: SparkSession, sf: str) -> DataFrame:
    """The curve of one zone, ordered by zone and date, with the four weeks before each."""
    from pyspark.sql import Window

    rows = _cumulated(spark, sf, "zone").where("zone = upper('east')")
    four = F.sum("cents").over(Window.partitionBy("zone").orderBy("week").rowsBetween(-4, -1))
    return rows.select("zone", F.col("week").alias("period_date"), F.col("eac_cents").alias("actual_cumulative_cents"), four.alias("last_four_cents")).orderBy("zone", "period_date")


@query(f"""{WITH}t AS (SELECT DISTINCT division, replace(division, ' ', ', ') || CASE WHEN length(division) % 2 = 0 THEN ',' ELSE '' END AS trade FROM activities), s AS (SELECT division, CAST(sum(current_budget_cents) AS BIGINT) AS cents FROM budgets GROUP BY 1)
SELECT trade, CASE WHEN trade = division THEN cents ELSE 0 END AS equal_cents, cents AS normalised_cents FROM t JOIN s USING (division)""")
def trade_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """Trades whose names have commas that the budgets' divisions lack: they have no budget unless names are normalised."""
    name = F.concat(F.replace("division", F.lit(" "), F.lit(", ")), F.when(F.length("division") % 2 == 0, ",").otherwise(""))
    trades, budgets = tables.activities(spark, sf).select(name.alias("trade")).distinct(), tables.budgets(spark, sf)
    plain = listings.trade_budgets(trades, budgets).withColumnRenamed("budget_cents", "equal_cents")
    return plain.join(listings.trade_budgets(trades, budgets, normalised=True).withColumnRenamed("budget_cents", "normalised_cents"), "trade")


@query(f"{WITH[:-2]} SELECT 'direct_costs' AS file_type, count(*) AS n, count(*) FILTER (zone = 'SHARED') AS unassigned_zone_count, count(*) FILTER (zone = 'SHARED') > 0 AS action_required FROM costs")
def reload_report(spark: SparkSession, sf: str) -> DataFrame:
    return listings.reloaded(tables.cost_rows(spark, sf), "direct_costs", F.col("zone") != "SHARED")
