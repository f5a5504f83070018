"""Helpers that several operators share: tables in the cluster's shared folder, packed rows, numbered copies, and bounded Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a new local one in local mode (tests), and an error on a cluster,
    whose executors would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(spark, "_ledgerloom_dir", None)
    if made is None:
        made = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark._ledgerloom_dir = made
    return made


def table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, and lost executors cost nothing done before."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._ledgerloom_path = path
    return back


def release(df: DataFrame) -> None:
    """Delete a table that ``table`` wrote and that nothing reads any more."""
    path = getattr(df, "_ledgerloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def named(column: str) -> Column:
    """A column by its exact name, whatever characters are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """``docs`` as one struct column ``row``, with the columns ``more`` beside it: no name in ``docs`` can clash with an operator's own."""
    return docs.select(F.struct(*map(named, docs.columns)).alias("row"), *[c.alias(name) for name, c in more.items()])


def unpacked(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, out of ``row``."""
    return [F.col("row").getField(c).alias(c) for c in docs.columns]


def numbered(rows: DataFrame, keys: list[str], name: str, label: str) -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... within each of ``keys``, in no set order. Rows are dealt to salts first and each salt is
    numbered by itself from the count of those before, so that a key with a third of all rows isn't one task's work."""
    salts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = table(rows.withColumn("_salt", F.floor(F.rand(7) * salts).cast("int")), label)
    counts = dealt.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_salt")) - F.col("_n")
    starts = table(counts.select(*keys, "_salt", before.alias("_before")), f"{label}-counts")
    place = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(F.lit(0)))
    return dealt.withColumn("_place", place).join(starts, [*keys, "_salt"]).withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_salt", "_place", "_before")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most`` bytes in each piece; a longer value stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (xor-shift and multiply rounds) on uint64 arrays."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
