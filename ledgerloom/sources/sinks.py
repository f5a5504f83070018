"""Exports and table writes: CSV, JSON, upsert with audit, predicate updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_csv(frame: DataFrame, path: str, dollars: list[str] | None = None) -> None:
    """With a header; ``dollars`` columns turn from cents to dollars."""
    shown = frame.withColumns({c: (F.col(c) / 100).cast("decimal(20,2)") for c in dollars or []})
    shown.write.mode("overwrite").option("header", True).csv(path)


def as_json(frame: DataFrame) -> DataFrame:
    """One JSON text for each row; nulls stay as fields, NaN turns to null."""
    clean = frame.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in frame.dtypes if t in ("double", "float")})
    return clean.select(F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias("json"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The merged table, and an audit of changed rows (keys, old_value, new_value as JSON). Of several new rows of a key the last by ``order``, a column of ``new`` alone, counts; without it the one with the largest values, in the order of the columns.
    Rows of one ``order`` are told apart by their values, largest last."""
    packed_values = F.struct(*[c for c in old.columns if c not in keys])
    newest = F.max(packed_values) if order is None else F.max(F.struct(F.col(order).alias("_o"), packed_values.alias("_v")))["_v"]
    new = new.groupBy(*keys).agg(newest.alias("_v")).select(*keys, "_v.*")
    values = [c for c in old.columns if c not in keys]
    packed = lambda f, name: f.select(*keys, F.to_json(F.struct(*values)).alias(name))
    merged = old.join(new.select(*keys), keys, "left_anti").unionByName(new)
    audit = packed(new, "new_value").join(packed(old, "old_value"), keys, "left").where(~F.col("new_value").eqNullSafe(F.col("old_value")))
    return merged, audit.select(*keys, "old_value", "new_value")


def updated(frame: DataFrame, where: Column, **values: Column) -> DataFrame:
    return frame.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})
