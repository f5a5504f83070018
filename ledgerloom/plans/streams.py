"""Queries on the event feed; the batch form of the streaming operators (tests hold the streams against it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from ..streaming import feeds
from .base import registered

query, QUERIES, ORACLE_SQL = registered()


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def events_weekly(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.weekly(_events(spark, sf))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.sessions(_events(spark, sf)).select("user_id", F.unix_timestamp("start").alias("start_s"), "n")


@query("SELECT event_type, count(DISTINCT user_id) AS n_users, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS d FROM events) GROUP BY event_type")
def events_distinct(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds.without_duplicates(_events(spark, sf).withColumn("d", F.to_date("ts")), ["user_id", "event_type", "d"])
    return rows.groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"), F.count(F.lit(1)).alias("n"))
