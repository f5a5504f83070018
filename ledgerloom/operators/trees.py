"""Nested JSON: trees of budgets and costs built from the leaves up, and settings flattened and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def children(rows: DataFrame, parent: str, order: list[Column], fields: list[str], name: str, page: int, first: int = 0) -> DataFrame:
    """(parent, name, n_<name>): each parent's children as an array of structs in order, ``page`` of them from number ``first`` on, and how many it has; so a
    parent with any number of children is one bounded row."""
    place = F.row_number().over(Window.partitionBy(parent).orderBy(*order))
    kept = rows.withColumn("_place", place).where((F.col("_place") > first) & (F.col("_place") <= first + page))
    listed = kept.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct("_place", F.struct(*fields).alias("child")))).alias("l"))
    counts = rows.groupBy(parent).agg(F.count(F.lit(1)).alias(f"n_{name}"))
    return counts.join(listed, parent, "left").select(parent, F.coalesce(F.transform("l", lambda x: x["child"]), F.array()).alias(name), f"n_{name}")


def _opened(level: DataFrame, key: str) -> DataFrame:
    """The members of each object, with their paths."""
    each = level.sparkSession.sql("SELECT {level}.*, e.key AS _name, e.value AS _value FROM {level}, LATERAL variant_explode(v) AS e", level=level)
    return each.where("_name IS NOT NULL").select(key, F.concat_ws(".", F.nullif(F.col("path"), F.lit("")), F.col("_name")).alias("path"), F.col("_value").alias("v"))


def flattened(settings: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value): the leaves of each row's JSON object by dotted paths, as text; objects are opened level by level, arrays are leaves, and an empty object has none.
    Texts that aren't JSON give no rows."""
    level = settings.select(key, F.lit("").alias("path"), F.try_parse_json(text).alias("v"))
    out = None
    while True:
        each = _opened(level, key)
        is_object = F.expr("schema_of_variant(v) LIKE 'OBJECT<%'")
        leaves = each.where(~is_object).select(key, "path", F.expr("CASE WHEN is_variant_null(v) THEN NULL ELSE CAST(v AS STRING) END").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        level = each.where(is_object)
        if level.isEmpty():
            return out


def changed(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, old_value, new_value, change): what was added, removed or modified between two tables of one value a key; a null value counts as absent."""
    a = old.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("old_value"))
    b = new.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("new_value"))
    kind = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").when(F.col("old_value") != F.col("new_value"), "modified")
    return a.join(b, keys, "full").withColumn("change", kind).where("change IS NOT NULL")
