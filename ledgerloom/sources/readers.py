"""CSV exports as typed tables: header aliases, missing columns, money, dates, and a quality report."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, money, text

#: Header names that each column may have.
ALIASES = {
    "breakdown": {"division": ("Cost Code - Description", "cost_code_description", "Division"), "gmp_sov": ("GMP SOV", "gmp_sov", "SOV"), "east": ("East Addition Funded on GMP", "East Funded", "east_funded"), "west": ("West Addition Funded on GMP", "West Funded", "west_funded")},
    "schedule": {"activity_id": ("Activity ID", "activity_id", "ID"), "name": ("Activity Name", "Task Name", "name"), "duration": ("Duration", "Original Duration"), "start": ("Start", "start"), "finish": ("Finish", "finish"), "total_float": ("Total Float", "Float"), "percent": ("% Complete", "Percent Complete"), "wbs": ("WBS", "wbs")},
}


def csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; a byte-order mark in the first header goes. Types are never guessed."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])


def first_found(spark: SparkSession, folder: str, names: list[str]) -> DataFrame | None:
    """The first of the files that exists, as ``csv``; none if none does."""
    for name in names:
        try:
            return csv(spark, f"{folder}/{name}")
        except AnalysisException as absent:
            if absent.getCondition() != "PATH_NOT_FOUND":
                raise
    return None


def _sheet(content: bytes) -> list[list[str | None]]:
    """The first sheet's rows as texts; empty cells are null."""
    parts = zipfile.ZipFile(io.BytesIO(content))
    name = lambda e: e.tag.rpartition("}")[2]
    text = lambda e: "".join(t.text or "" for t in e.iter() if name(t) == "t")
    shared = [text(e) for e in ElementTree.fromstring(parts.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in parts.namelist() else []
    rows = []
    for line in ElementTree.fromstring(parts.read("xl/worksheets/sheet1.xml")).iter():
        if name(line) != "row":
            continue
        row: list[str | None] = []
        for cell in line:
            place = 0
            for letter in re.match("[A-Z]*", cell.get("r", "")).group():
                place = place * 26 + ord(letter) - 64
            row += [None] * (max(place, len(row) + 1) - len(row))
            value = next((e.text for e in cell if name(e) == "v"), None)
            row[-1] = text(cell) if cell.get("t") == "inlineStr" else shared[int(value)] if cell.get("t") == "s" and value else value
        rows.append(row)
    return rows


def contract_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(gmp_id, division, amount_total_cents) of a workbook's first sheet, whose first row must name ``GMP`` and ``Amount Total``; ids count the rows
    from 0. A workbook is one small file and is read by one task."""

    def rows(content: bytes):
        head, *body = _sheet(bytes(content)) or [[]]
        if not {"GMP", "Amount Total"} <= set(head):
            raise ValueError(f"the sheet must have the columns GMP and Amount Total, it has {head}")
        at = [head.index(c) for c in ("GMP", "Amount Total")]
        return [(k, *[row[i] if i < len(row) else None for i in at]) for k, row in enumerate(body)]

    found = spark.read.format("binaryFile").load(path).select(F.explode(F.udf(rows, "array<struct<gmp_id bigint, division string, amount string>>")("content")).alias("r"))
    return found.select("r.gmp_id", "r.division", money.parse_money(F.col("r.amount")).alias("amount_total_cents"))


def aliased(raw: DataFrame, kind: str) -> DataFrame:
    """The known columns under their own names; absent ones are null."""
    have = set(raw.columns)
    names = ALIASES[kind]
    return raw.select(*[next((F.col(f"`{h}`") for h in heads if h in have), F.lit(None).cast("string")).alias(name) for name, heads in names.items()])


def column(raw: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in raw.columns else F.lit(None).cast("string")


def budget(spark: SparkSession, path: str) -> DataFrame:
    raw = csv(spark, path)
    code = column(raw, "Budget Code")
    cents = {f"{n}_cents": money.parse_money(column(raw, h)) for n, h in (("current_budget", "Current Budget"), ("committed_costs", "Committed Costs"), ("direct_cost_tool", "Direct Cost Tool"))}
    rows = raw.where(code.isNotNull() & (F.trim(code) != ""))
    return rows.select(F.trim(code).alias("budget_code"), column(raw, "Budget Code Description").alias("description"), column(raw, "Cost Type").alias("cost_type"), text.base_code(code).alias("base_code"), text.division_key(code).alias("division_key"), *[v.alias(k) for k, v in cents.items()])


def direct_costs(spark: SparkSession, path: str) -> DataFrame:
    raw = csv(spark, path)
    pick = lambda *names: next((column(raw, n) for n in names if n in raw.columns), F.lit(None).cast("string"))
    code, vendor = pick("Cost Code", "cost_code"), pick("Vendor", "vendor")
    day = F.coalesce(dates.parse(pick("Date", "date")), F.try_to_timestamp(pick("Date", "date")).cast("date"))
    return raw.select(
        code.alias("cost_code"), pick("Name", "name").alias("name"), pick("Type", "type").alias("type"), vendor.alias("vendor"), text.vendor_clean(vendor).alias("vendor_clean"), text.base_code(code).alias("base_code"),
        text.invoice(pick("Invoice #", "invoice")).alias("normalized_invoice"), pick("Description", "description").alias("description"), day.alias("date"), money.parse_money(pick("Amount", "amount")).alias("amount_cents"), F.lit(False).alias("excluded_from_actuals"),
    )


def breakdown(spark: SparkSession, path: str) -> DataFrame:
    """Funding by division; east defaults to half, west to the rest; rows without an amount go."""
    rows = aliased(csv(spark, path), "breakdown").withColumn("sov_cents", money.parse_money(F.col("gmp_sov"))).where(F.col("sov_cents") > 0)
    east = F.when(F.col("east").isNull(), F.expr("sov_cents div 2")).otherwise(money.parse_money(F.col("east")))
    rows = rows.withColumn("east_funded_cents", east)
    west = F.when(F.col("west").isNull(), F.col("sov_cents") - F.col("east_funded_cents")).otherwise(money.parse_money(F.col("west")))
    rows = rows.withColumn("west_funded_cents", west)
    share = lambda c: F.col(c) / F.col("sov_cents")
    return rows.select(F.trim("division").alias("division"), "sov_cents", "east_funded_cents", "west_funded_cents", share("east_funded_cents").alias("pct_east"), share("west_funded_cents").alias("pct_west"))


def schedule(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    rows = aliased(csv(spark, path), "schedule").where(F.col("name").isNotNull() & (F.trim("name") != ""))
    start, finish = dates.parse(F.col("start")), dates.parse(F.col("finish"))
    rows = rows.withColumns({"start_date": start, "finish_date": finish, "start_is_actual": dates.is_actual(F.col("start")), "finish_is_actual": dates.is_actual(F.col("finish")), "duration_days": dates.days(F.col("duration")), "float_days": dates.days(F.col("total_float"))})
    done = F.when(F.col("finish_is_actual"), 1.0).when(F.col("start_is_actual"), dates.elapsed(F.col("start_date"), F.col("finish_date"), F.lit(as_of).cast("date"))).otherwise(0.0)
    given = F.when(F.col("percent").isNotNull(), dates.percent(F.col("percent")) / 100).otherwise(done)
    return rows.select("activity_id", "name", "wbs", "start_date", "finish_date", "start_is_actual", "finish_is_actual", "duration_days", "float_days", F.coalesce(F.col("float_days") == 0, F.lit(False)).alias("is_critical"), given.alias("progress"))


def allocations(spark: SparkSession, path: str | None) -> DataFrame:
    """Shares by code; no file gives an empty table."""
    if path is None:
        return spark.createDataFrame([], "code string, region string, pct_west double, pct_east double, confirmed boolean")
    raw = csv(spark, path)
    share = lambda name: F.coalesce(column(raw, name).try_cast("double"), F.lit(0.5))
    return raw.select(column(raw, "code").alias("code"), F.coalesce(column(raw, "region"), F.lit("Both")).alias("region"), share("pct_west").alias("pct_west"), share("pct_east").alias("pct_east"), F.coalesce(column(raw, "confirmed").try_cast("boolean"), F.lit(False)).alias("confirmed"))
