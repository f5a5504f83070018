"""Sharding by extendible hashing: buckets split on one more hash bit until each fits its byte limit.

A row's hash is 60 bits of the MD5 of its id and text. The directory is indexed by
hash-prefix bits; a bucket of local depth d holds all rows that share its first d bits.
Only buckets over the limit split, so sparse ranges keep short prefixes. The splits
are found from byte sums of prefixes, not by moving rows: one aggregation to cells of
``bits`` bits, the sums of all their prefixes, and a second, finer pass over the few
cells that are still too large.

A row larger than the limit gets a shard of its own (nothing can split it). Rows equal
in id and text share all bits; if such a group is too large, its copies are numbered and
packed into shards ``<prefix>.<k>`` of whole copies. Null ids and texts count as empty
strings; a null or empty text has no bytes. An empty table gives no shards; a table
that fits as a whole gives the one shard ''. Extra columns stay in ``assign``, whatever their
names are; columns named as its results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, numbered, packed, table, unpacked

#: Bytes of text in a shard at most; bits of a hash; cells for each expected shard; most bits of the first pass.
LIMIT, BITS, CELLS, MOST = 4 << 20, 60, 64, 30


def hash_of(doc_id: Column, text: Column) -> Column:
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def sums_by_prefix(cells: DataFrame, low: int, high: int) -> DataFrame:
    """(depth, prefix, bytes, n) of every prefix of low to high bits, from cells of high bits."""
    depths = F.sequence(F.lit(low), F.lit(high))
    each = cells.select(F.explode(depths).alias("depth"), "cell", "bytes", "n")
    prefix = F.expr(f"shiftright(cell, {high} - depth)")
    return each.groupBy("depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))


def leaves(sums: DataFrame, limit: int, low: int, high: int) -> tuple[DataFrame, DataFrame]:
    """Buckets (depth, prefix, bytes, n) that need no split and whose parent does; and what is still too large at ``high`` bits."""
    large = (F.col("bytes") > limit) & (F.col("n") > 1)
    split = sums.where(large)
    children = split.where(F.col("depth") < high).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    top = sums.where(F.col("depth") == low).select("depth", "prefix")
    fit = sums.where(~large).join(children.unionByName(top), ["depth", "prefix"], "left_semi")
    return fit, split.where(F.col("depth") == high)


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """From (h, bytes): (depth, prefix, bytes, n) of every bucket, as a table in the shared folder."""
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    bits = min(MOST, max(1, math.ceil(math.log2(max(1, total / limit) * CELLS))))
    cells = rows.groupBy(F.shiftright("h", BITS - bits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    sums = table(sums_by_prefix(cells, 0, bits), "prefix-sums")
    fit, rest = leaves(sums, limit, 0, bits)
    rest = table(rest, "oversized")
    if not rest.isEmpty():
        inside = rows.withColumn("prefix", F.shiftright("h", BITS - bits)).join(rest.select("prefix"), "prefix", "left_semi")
        fine = inside.groupBy(F.col("h").alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        deeper = table(sums_by_prefix(fine, bits + 1, BITS), "prefix-sums")
        more, same = leaves(deeper, limit, bits + 1, BITS)
        fit = fit.unionByName(more).unionByName(same)  # what is left at all bits is one hash: its copies are numbered later
    return table(fit, "directory")


def keyed(found: DataFrame, limit: int, low: int) -> DataFrame:
    """The directory with ``coarse``, a prefix of exactly ``low`` bits: deeper buckets have it as their own first bits, shallower ones once for each of its values."""
    deep = F.array(F.expr(f"shiftright(prefix, greatest(0, depth - {low}))"))
    first = F.expr(f"shiftleft(prefix, greatest(0, {low} - depth))")
    wide = F.sequence(first, first + F.expr(f"shiftleft(1L, greatest(0, {low} - depth))") - 1)
    return found.select("depth", "prefix", F.explode(F.when(F.col("depth") >= low, deep).otherwise(wide)).alias("coarse"), ((F.col("bytes") > limit) & (F.col("n") > 1)).alias("copies"))


def assign(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``shard`` (prefix bits), ``depth``, ``n_bytes``. ``docs`` is read several times."""
    new = ["shard", "depth", "n_bytes"]
    kept = docs.select(*[named(c) for c in docs.columns if c not in new])
    h, size = hash_of(named(id_col), named(text_col)), F.coalesce(F.octet_length(named(text_col).cast("string")), F.lit(0)).cast("long")
    found = directory(docs.select(h.alias("h"), size.alias("bytes")), limit)
    # rows meet buckets by a prefix of about as many bits as there are buckets: shallower ones multiply to no more than that, deeper ones share one
    low = max(0, found.count().bit_length() - 1)
    met = packed(kept, h=h, n_bytes=size).withColumn("coarse", F.shiftright("h", BITS - low)).join(table(keyed(found, limit, low), "keyed"), "coarse").where(F.expr(f"shiftright(h, {BITS} - depth)") == F.col("prefix"))
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    met = met.withColumn("shard", name)
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1))))
    copies = numbered(met.where("copies"), ["h"], "copy", "copies")
    copies = copies.withColumn("shard", F.concat_ws(".", "shard", F.floor(F.col("copy") / per).cast("string")))
    result = [*unpacked(kept), *new]
    return met.where("not copies").select(*result).unionByName(copies.select(*result))


def write(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write the shards as one folder each below ``path``."""
    assigned = assign(docs, limit)
    assigned.repartition("shard").write.partitionBy("shard").parquet(path)


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, shard, depth, n_bytes) of every document."""
    return assign(docs.select("doc_id", "text"), limit).select("doc_id", "shard", F.col("depth").cast("int").alias("depth"), "n_bytes")


#: DuckDB SQL for ``shards`` over ``documents`` (rows equal in id and text are taken not to exceed the limit).
ORACLE_SQL = f"""
WITH rows_ AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
sums AS (SELECT d AS depth, h >> ({BITS} - d) AS prefix, sum(n_bytes) AS b, count(*) AS n
  FROM (SELECT *, unnest(generate_series(0, {BITS})) AS d FROM rows_) GROUP BY ALL),
split AS (SELECT depth, prefix FROM sums WHERE b > {LIMIT} AND n > 1),
depths AS (SELECT r.h, coalesce(max(s.depth), -1) + 1 AS depth
  FROM (SELECT h, unnest(generate_series(0, {BITS})) AS d FROM (SELECT DISTINCT h FROM rows_)) r LEFT JOIN split s ON s.depth = r.d AND s.prefix = r.h >> ({BITS} - r.d) GROUP BY r.h)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> ({BITS} - depth)), depth::INTEGER, '0') END AS shard, depth::INTEGER AS depth, n_bytes::BIGINT AS n_bytes
FROM rows_ JOIN depths USING (h)
"""
