"""Queries that apply the scalar functions to whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, dates, money, text
from ..sources import tables
from .base import registered

query, QUERIES, ORACLE_SQL = registered()


@query("""WITH b AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -c ELSE c END AS cents, CASE WHEN o_orderkey % 2 = 0 THEN '-$' ELSE '$' END || format('{:,}', c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS shown FROM b""")
def money_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Totals as text (credits in parentheses) and back."""
    cents = money.to_cents(F.col("o_totalprice"))
    plain = F.format_number((cents / 100).cast("decimal(26,2)"), 2)
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("($"), plain, F.lit(")"))).otherwise(F.concat(F.lit(" $"), plain))
    rows = tables.read(spark, sf, "orders").select("o_orderkey", money.parse_money(shown).alias("cents"))
    return rows.withColumn("shown", money.display(F.col("cents")))


@query("""SELECT p_partkey, regexp_extract(p_brand || '', '^([0-9]+(-[0-9]+)?)', 1) AS base, lower(trim(p_name)) AS clean, trim(substr(lower(p_name), 1, 20)) AS prefix, upper(substr(trim(p_type), 1, 1)) AS letter,
  trim(regexp_replace(regexp_replace(lower(p_name || ' (#' || p_brand || ')'), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS words, CASE WHEN trim(p_name) = '' THEN '<EMPTY>' ELSE lower(trim(p_name)) END || '|' || lower(trim(p_brand)) AS composite FROM part""")
def text_normalisers(spark: SparkSession, sf: str) -> DataFrame:
    name, brand = F.col("p_name"), F.col("p_brand")
    return tables.read(spark, sf, "part").select(
        "p_partkey", text.base_code(brand).alias("base"), text.vendor_clean(name).alias("clean"), text.name_prefix(name).alias("prefix"), F.upper(F.substring(F.trim("p_type"), 1, 1)).alias("letter"),
        text.words(F.concat(name, F.lit(" (#"), brand, F.lit(")"))).alias("words"), text.composite_key(name, brand).alias("composite"),
    )


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed, o_orderkey % 2 = 0 AS is_actual, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
  CAST(isoyear(o_orderdate) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS label FROM orders""")
def schedule_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates as schedule text and back."""
    shown = F.concat(F.date_format("o_orderdate", "dd-MMM-yyyy"), F.when(F.col("o_orderkey") % 2 == 0, " A").otherwise(""))
    day = dates.parse(F.col("shown"))
    rows = tables.read(spark, sf, "orders").select("o_orderkey", shown.alias("shown"))
    return rows.select("o_orderkey", day.alias("parsed"), dates.is_actual(F.col("shown")).alias("is_actual"), dates.week_start(day).alias("week"), dates.month_start(day).alias("month"), dates.iso_label(day).alias("label"))


def _case(column: str) -> str:
    rows = "".join(f" WHEN regexp_matches({column}, '{p}') THEN '{t}'" for p, t, *_ in classify.TRADES)
    return f"CASE{rows} ELSE '{classify.GENERAL}' END"


@query(f"""WITH t AS (SELECT doc_id, upper(replace(coalesce(text, ''), 'ß', 'ss')) AS u FROM documents)
SELECT doc_id, {_case('u')} AS trade, CASE WHEN regexp_matches(u, '{"|".join(classify.EAST)}') THEN 'EAST' WHEN regexp_matches(u, '{"|".join(classify.WEST)}') THEN 'WEST' ELSE 'SHARED' END AS zone FROM t""")
def classified_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Trade and zone rules over long texts."""
    plain = F.replace("text", F.lit("ß"), F.lit("ss"))  # whose capital differs between engines
    docs = tables.read(spark, sf, "documents").select("doc_id", plain.alias("text"))
    return docs.select("doc_id", classify.trade(F.col("text"))["trade"].alias("trade"), classify.zone(F.col("text")).alias("zone"))


@query("""SELECT event_id, CAST(json_extract_string(to_json({'id': event_id, 'kind': event_type}), '$.kind') AS VARCHAR) AS kind, md5(event_type) AS md5, sha256(event_type) AS sha FROM events""")
def json_and_hashes(spark: SparkSession, sf: str) -> DataFrame:
    packed = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")), {"ignoreNullFields": "false"})
    back = F.from_json(packed, "id bigint, kind string")
    return tables.read(spark, sf, "events").select("event_id", back["kind"].alias("kind"), F.md5("event_type").alias("md5"), F.sha2("event_type", 256).alias("sha"))


@query("""SELECT p_partkey, CAST(round(CASE WHEN g >= 0 THEN pow(g, 0.88::DOUBLE) ELSE -2.25::DOUBLE * pow(-g, 0.88::DOUBLE) END * 10000) AS BIGINT) AS risk, CAST(round(sum_w * 1000) AS BIGINT) AS mixture_mean
FROM (SELECT p_partkey, (p_size - 25) / 25.0::DOUBLE AS g, 0.25::DOUBLE * p_size + 0.75::DOUBLE * p_retailprice AS sum_w FROM part)""")
def risk_and_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Prospect-theory value of a relative gain, and the mean of a two-part mixture."""
    g = (F.col("p_size") - 25) / 25.0
    value = F.when(g >= 0, F.pow(F.abs(g), F.lit(0.88))).otherwise(-2.25 * F.pow(F.abs(g), F.lit(0.88)))
    mean = F.aggregate(F.zip_with(F.array(F.lit(0.25), F.lit(0.75)), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")), lambda w, m: w * m), F.lit(0.0), lambda s, x: s + x)
    return tables.read(spark, sf, "part").select("p_partkey", F.round(value * 10000).cast("long").alias("risk"), F.round(mean * 1000).cast("long").alias("mixture_mean"))
