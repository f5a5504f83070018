"""Loads that never fail on a bad row: counts of what was read, skipped and broken come from the scan's own pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.money import parse_money

CORRUPT = "_corrupt"
#: Shares of rows above which a report warns.
WARN = {"no_vendor": 0.05, "zero": 0.10, "no_date": 0.02, "unmapped": 0.15}


def _unparsed(text: Column, cents: Column) -> Column:
    """Money text that says something other than zero and still gave 0."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    return (cents == 0) & ~plain.isin("", "-") & ~plain.rlike(r"^[-($\s]*0*(\.0*)?[)\s-]*$")


def scanned(spark: SparkSession, path: str, columns: list[str], required: str, money: list[str]) -> tuple[DataFrame, Observation]:
    """The rows of a CSV file that have ``required``, all as text, with cents for ``money`` columns as ``<name>_cents``; and what the scan saw, to be had
    (``Observation.get``) once the rows were used by an action: total, corrupt (the wrong number of fields), blank (no ``required``), bad_money, valid. Columns that the file lacks are null.
    Reading is permissive: a broken line is counted and left out."""
    head = spark.read.option("header", True).csv(path).columns
    clean = [h.lstrip("﻿").strip() for h in head]
    schema = ", ".join(f"`{h.replace('`', '``')}` string" for h in [*clean, CORRUPT])
    raw = spark.read.schema(schema).option("header", True).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", True).csv(path)
    named = lambda c: F.col(f"`{c}`") if c in clean else F.lit(None).cast("string")
    rows = raw.select(*[named(c).alias(c) for c in columns], F.col(CORRUPT).isNotNull().alias("_bad"))
    rows = rows.withColumns({f"{c}_cents": parse_money(F.col(f"`{c}`")) for c in money})
    blank = F.coalesce(F.trim(F.col(f"`{required}`")) == "", F.lit(True)) & ~F.col("_bad")
    bad_money = F.lit(0)
    for c in money:
        bad_money = bad_money + (_unparsed(F.col(f"`{c}`"), F.col(f"`{c}_cents`")) & ~F.col("_bad")).cast("int")
    seen = Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if("_bad").alias("corrupt"), F.count_if(blank).alias("blank"), F.coalesce(F.sum(bad_money), F.lit(0)).alias("bad_money"), F.count_if(~blank & ~F.col("_bad")).alias("valid"))
    return rows.where(~blank & ~F.col("_bad")).drop("_bad"), seen


def missing(spark: SparkSession, path: str, columns: list[str]) -> list[str]:
    head = {h.lstrip("﻿").strip() for h in spark.read.option("header", True).csv(path).columns}
    return [c for c in columns if c not in head]


def warnings_of(seen: dict[str, int], absent: list[str] = ()) -> list[str]:
    """What a person should look at."""
    out = [f"column {c} is missing" for c in absent]
    out += [f"{seen[k]} {what}" for k, what in (("corrupt", "broken rows left out"), ("blank", "blank rows skipped"), ("bad_money", "amounts not understood")) if seen[k]]
    return out


def quality(costs: DataFrame, mapped: Column) -> DataFrame:
    """One row about a table of costs: its size, the share of rows without vendor, amount, date or ``mapped``, and the names of those over their bound (``WARN``)."""
    tests = {"no_vendor": F.coalesce(F.trim("vendor") == "", F.lit(True)), "zero": F.coalesce(F.col("amount_cents") == 0, F.lit(True)), "no_date": F.col("date").isNull(), "unmapped": ~F.coalesce(mapped, F.lit(False))}
    one = costs.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(t).alias(k) for k, t in tests.items()])
    return one.withColumn("warnings", F.array_join(F.array_compact(F.array(*[F.when(F.col(k) > F.col("n") * WARN[k], F.lit(k)) for k in tests])), ","))
