"""The engine's tables over the star-schema Parquet tables: costs, budgets, breakdown, activities. All are lazy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import to_cents


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cost_key() -> Column:
    """The name of a cost row, from columns of ``cost_rows``."""
    return F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents", "date")])


def cost_rows(spark: SparkSession, sf_dir: str, vendors: bool = True, spread: bool = False) -> DataFrame:
    """One row for each line item; returned items are credits. Items whose part or supplier is unknown stay, with a null code, division or vendor. Dimensions are joined by key; Spark broadcasts those whose size it knows to be
    small and shuffles the others. Without ``vendors`` the columns vendor and zone are left out, and suppliers aren't read. ``cost_key`` names a row; who keeps few rows builds it for those only.
    With ``spread`` parts are dealt over tasks and not broadcast: their names repeat, so that files small enough for a broadcast may hold millions of them, too many for the driver where a query meets them more than once."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("cost_code"), F.col("p_name").alias("name"), F.col("p_type").alias("division"))
    rows = read(spark, sf_dir, "lineitem").join(part.hint("shuffle_hash") if spread else part, F.col("l_partkey") == F.col("p_partkey"), "left")
    if vendors:
        region = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
        vendor = read(spark, sf_dir, "supplier").join(region, F.col("s_nationkey") == F.col("n_nationkey"))
        zone = F.when(F.col("n_regionkey").isin(0, 1), "EAST").when(F.col("n_regionkey").isin(2, 3), "WEST").otherwise("SHARED")
        rows = rows.join(vendor.select("s_suppkey", F.col("s_name").alias("vendor"), zone.alias("zone")), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    cents = to_cents(F.col("l_extendedprice"))
    return rows.select(
        "cost_code", "name", "division", *(["vendor", "zone"] if vendors else []), F.col("l_shipdate").cast("date").alias("date"), (F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * cents).alias("amount_cents"),
        cents.alias("cents"), "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("quantity"),
    )


def cost_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``cost_rows`` that line items hold themselves, for searches that need no other: neither parts nor suppliers, whose keys are unique, are read."""
    cents = to_cents(F.col("l_extendedprice"))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"), (F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * cents).alias("amount_cents"), cents.alias("cents"), "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber",
        F.col("l_quantity").cast("long").alias("quantity"),
    )


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, vendor) of suppliers of a known nation, as ``cost_rows`` has them. A semi join, of whose size Spark knows that it is no more than the suppliers'."""
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"))
    return read(spark, sf_dir, "supplier").join(nations, "s_nationkey", "left_semi").select("s_suppkey", F.col("s_name").alias("vendor"))


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cost_rows`` with their names as ``cost_key`` and their invoices."""
    return cost_rows(spark, sf_dir).select(
        cost_key().alias("cost_key"), "cost_code", "name", "division", "vendor", F.col("l_orderkey").cast("string").alias("invoice"), "date", "amount_cents", "zone", "l_partkey", "l_suppkey", "quantity", "l_orderkey",
    )


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One budget line for each part."""
    cents = to_cents(F.col("p_retailprice"))
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("budget_id"), F.col("p_brand").alias("budget_code"), F.col("p_type").alias("division"), F.col("p_name").alias("description"), F.substring("p_type", 1, 1).alias("cost_type"),
        (cents * 30).alias("current_budget_cents"), F.when(F.col("p_size") > 10, cents * 20).otherwise(0).cast("long").alias("committed_cents"), F.when(F.col("p_size") <= 25, "EAST").otherwise("WEST").alias("zone"),
    )


def breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funding of each division by zone."""
    east = F.sum(F.when(F.col("zone") == "EAST", F.col("current_budget_cents")).otherwise(0))
    total = F.sum("current_budget_cents")
    return budgets(spark, sf_dir).groupBy("division").agg(total.alias("sov_cents"), east.alias("east_funded_cents"), (total - east).alias("west_funded_cents"))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One activity for each order: from the order date to its last shipment; its division is that of its least part."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("division"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.col("l_shipdate").cast("date")).alias("last"), F.min("l_partkey").alias("p_partkey"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("start_date"), (F.col("o_orderpriority") == "1-URGENT").alias("is_critical"))
    rows = orders.join(lines, "l_orderkey").join(part, "p_partkey")
    finish = F.greatest("start_date", "last")
    return rows.select(F.col("l_orderkey").alias("activity_id"), "division", "start_date", finish.alias("finish_date"), F.datediff(finish, "start_date").alias("duration_days"), "is_critical")


#: The same tables as DuckDB common table expressions, for the oracle.
SQL = """
costs AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_shipdate AS DATE)) AS cost_key,
    p_brand AS cost_code, p_name AS name, p_type AS division, s_name AS vendor, CAST(l_orderkey AS VARCHAR) AS invoice, CAST(l_shipdate AS DATE) AS date,
    CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents,
    CASE WHEN n_regionkey IN (0, 1) THEN 'EAST' WHEN n_regionkey IN (2, 3) THEN 'WEST' ELSE 'SHARED' END AS zone,
    l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS quantity, l_orderkey
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN (supplier JOIN nation ON s_nationkey = n_nationkey) ON l_suppkey = s_suppkey),
budgets AS (
  SELECT p_partkey AS budget_id, p_brand AS budget_code, p_type AS division, p_name AS description, substr(p_type, 1, 1) AS cost_type,
    CAST(round(p_retailprice * 100) AS BIGINT) * 30 AS current_budget_cents, CASE WHEN p_size > 10 THEN CAST(round(p_retailprice * 100) AS BIGINT) * 20 ELSE 0 END AS committed_cents,
    CASE WHEN p_size <= 25 THEN 'EAST' ELSE 'WEST' END AS zone FROM part),
breakdown AS (
  SELECT division, CAST(sum(current_budget_cents) AS BIGINT) AS sov_cents, CAST(coalesce(sum(current_budget_cents) FILTER (zone = 'EAST'), 0) AS BIGINT) AS east_funded_cents,
    CAST(coalesce(sum(current_budget_cents) FILTER (zone = 'WEST'), 0) AS BIGINT) AS west_funded_cents FROM budgets GROUP BY division),
activities AS (
  SELECT activity_id, p_type AS division, start_date, greatest(start_date, last) AS finish_date, greatest(start_date, last) - start_date AS duration_days, is_critical
  FROM (SELECT o_orderkey AS activity_id, CAST(o_orderdate AS DATE) AS start_date, o_orderpriority = '1-URGENT' AS is_critical FROM orders)
  JOIN (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS last, min(l_partkey) AS p_partkey FROM lineitem GROUP BY l_orderkey) ON activity_id = l_orderkey
  JOIN part USING (p_partkey))
"""


def east_sql(t: str, e: str, w: str) -> str:
    """DuckDB SQL of ``functions.money.east_of``."""
    wide, both = f"CAST({t} AS HUGEINT) * ({e})", f"(({e}) + ({w}))"
    rest = f"((({wide}) % {both} + {both}) % {both})"
    return f"CAST(CASE WHEN {both} = 0 THEN ({t} + ({t} % 2 + 2) % 2) // 2 ELSE (({wide}) - {rest}) // {both} + CASE WHEN {rest} * 2 >= {both} AND {rest} > 0 THEN 1 ELSE 0 END END AS BIGINT)"
