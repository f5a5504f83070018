"""Importance resampling towards a target distribution by hashed n-grams, in DataFrame functions only.

A document's features are its runs of 1 to ``RUN`` consecutive words; each falls into one
of ``BUCKETS`` buckets. Higher-order functions turn a text into its array of buckets within
its own row, so no feature is exploded for scoring: a document's weight is an aggregate over
that array of ``element_at`` a literal array that holds each bucket's gain. Bucket totals
of the raw documents and of the target texts are the one thing that is shuffled before
scores exist (``BUCKETS`` partial sums for each task), and their gains the one thing that comes
to the driver, ``BUCKETS`` numbers at every size.

Gumbel noise seeded by the document's id is added to its weight, and the highest scores of the
eligible documents are drawn: that is sampling without replacement in proportion to the weights.
The cut is found by a histogram of scores that narrows to the score at the wanted place; only
documents at or above it are range-partitioned and numbered, range by range.

A null text has no words; a text without words has no features and weight 0. A null id hashes
as an empty one and comes last among ties; rows equal in id and score are drawn in no set order,
which their equal rows can't show. Repeated rows count each. Without any target text gains
only follow the raw counts; empty tables give empty results. Extra columns pass through ``resample``
whatever their names are; columns named as its results are replaced.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, table

#: Buckets, longest run of words, words that a drawable document has, share drawn in percent, seed.
BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: What lies between words, once A-Z are lower-cased (fixed values).
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bins of a histogram of scores; a narrowing pass cuts its range by so much.
BINS = 4096
RESULTS = ("n_words", "n_features", "weight", "score", "rank")


def pieces_of(text: Column) -> Column:
    """The words of a text; a gap at either end leaves an empty piece there."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.split(lower, GAPS, -1)


def trimmed(pieces: str) -> Column:
    """Without empty pieces, which are at the ends only."""
    first = (F.get(pieces, F.lit(0)) == "").cast("int")
    last = ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")
    return F.slice(pieces, first + 1, F.size(pieces) - first - last)


def bucketed(rows: DataFrame, text: Column, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with ``n_words`` and ``buckets``, the bucket of every run of 1 to ``run`` words of ``text``, repeats included. Runs of n words extend
    those of n - 1 by the word that follows; each step is a projection of its own, so that none is computed twice."""
    kept = rows.columns
    rows = rows.withColumn("pieces", pieces_of(text)).withColumn("runs1", trimmed("pieces"))
    for n in range(2, run + 1):
        longer = F.greatest(F.size("runs1") - n + 1, F.lit(0))
        rows = rows.withColumn(f"runs{n}", F.zip_with(F.slice(f"runs{n - 1}", F.lit(1), longer), F.slice("runs1", F.lit(n), longer), lambda a, b: F.concat(a, F.lit(" "), b)))
    each = [F.transform(f"runs{n}", lambda x: (F.crc32(x.cast("binary")) % buckets).cast("int")) for n in range(1, run + 1)]
    return rows.select(*kept, F.size("runs1").cast("long").alias("n_words"), F.concat(*each).alias("buckets"))


def totals(texts: DataFrame, text_col: str, name: str) -> DataFrame:
    """(bucket, name): how often features fall into each bucket; partial sums per task, so at most ``BUCKETS`` rows of each are shuffled."""
    rows = bucketed(texts.select(named(text_col).alias("text")), F.col("text"))
    each = rows.select(F.explode_outer("buckets").alias("bucket"))  # a plain explode is filtered by size first, which would compute all arrays twice
    return each.groupBy("bucket").agg(F.count(F.lit(1)).alias(name)).where(F.col("bucket").isNotNull())


def gains(raw: DataFrame, target: DataFrame, text_col: str = "text") -> list[int]:
    """The gain of each bucket: 1000 times the log-ratio of its smoothed share in ``target`` to that in ``raw``, rounded down."""
    every = raw.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(totals(raw, text_col, "s"), "bucket", "left").join(totals(target, text_col, "t"), "bucket", "left").na.fill(0)
    found = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()  # BUCKETS rows at every size
    s, t = {r["bucket"]: r["s"] for r in found}, {r["bucket"]: r["t"] for r in found}
    all_s, all_t = sum(s.values()), sum(t.values())
    ratio = lambda b: float(t[b] + 1) * float(all_s + BUCKETS) / (float(s[b] + 1) * float(all_t + BUCKETS))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(BUCKETS)]


def literal(values: list[int]) -> Column:
    """An array literal: one constant that the optimiser folds once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Seeded Gumbel noise in thousandths, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``docs`` with n_words, n_features, weight and score. ``docs`` is read twice, and no text is shuffled."""
    gain = literal(gains(docs.select(named(text_col)), target.select(named(text_col)), text_col))
    kept = [c for c in docs.columns if c not in RESULTS]
    parts = docs.select(F.struct(*map(named, kept)).alias("row"), named(id_col).alias("id"), named(text_col).alias("text"))
    parts = bucketed(parts, F.col("text"))
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(gain, b + 1))
    parts = parts.select("row", "id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    return parts.select(*[F.col("row").getField(c).alias(c) for c in kept], "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score"))


def cut(scores: DataFrame, wanted: int) -> int | None:
    """The score at place ``wanted`` from the top of the column ``score``; None if nothing is wanted. A histogram of ``BINS`` bins narrows to it."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    if wanted < 1 or low is None:
        return None
    above = 0
    while low < high:
        width = -(-(high - low + 1) // BINS)
        inside = scores.where(F.col("score").between(low, high))
        bins = inside.groupBy(F.floor((F.col("score") - low) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()  # BINS rows at most
        for r in sorted(bins, key=lambda r: -r["bin"]):
            if above + r["n"] >= wanted:
                low, high = low + r["bin"] * width, min(high, low + (r["bin"] + 1) * width - 1)
                break
            above += r["n"]
        else:
            return low  # fewer rows than wanted
    return low


def ranked(rows: DataFrame, id_col: str, wanted: int, label: str = "ranked") -> DataFrame:
    """``rows`` with ``rank`` by falling score, then rising id: ranges of the order are written as a table, counted, and numbered each by itself."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("score"), F.asc_nulls_last(named(id_col))]
    dealt = table(rows.repartitionByRange(parts, *order).withColumn("rank", F.spark_partition_id()), label)  # rank: the range, for now
    sizes = {r["rank"]: r["n"] for r in dealt.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each range
    before, starts = 0, {}
    for k in sorted(sizes):
        starts[k], before = before, before + sizes[k]
    if not starts:
        return dealt.withColumn("rank", F.lit(None).cast("long"))
    start = F.create_map(*[F.lit(x) for k, n in starts.items() for x in (k, n)])[F.col("rank")]
    place = F.row_number().over(Window.partitionBy("rank").orderBy(*order)) + start
    return dealt.withColumn("rank", F.when(place <= wanted, place).cast("long"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` with n_words, n_features, weight, score and ``rank`` (null: not drawn). floor(percent * N / 100) rows are drawn
    of the N that have at least ``LEAST_WORDS`` words."""
    rows = table(scored(docs, target, id_col, text_col, seed), "scored")
    able = F.col("n_words") >= LEAST_WORDS
    wanted = percent * rows.where(able).count() // 100
    least = cut(rows.where(able).select("score"), wanted)
    if least is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    high = able & (F.col("score") >= least)
    return ranked(rows.where(high), id_col, wanted).unionByName(rows.where(~high).withColumn("rank", F.lit(None).cast("long")))


def draws(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document, drawn towards the ``benchmark`` texts."""
    return resample(docs.select("doc_id", "text"), benchmark.select("text")).select("doc_id", "n_features", "weight", "score", "rank")


#: The CRC-32 of each half byte (fixed values of the reflected polynomial), for SQL, which has no such function.
HALVES = [0]
for _i in range(1, 16):
    _c = _i
    for _ in range(4):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    HALVES.append(_c)

#: DuckDB SQL for ``draws`` over ``documents`` and ``benchmark``: half bytes of every distinct feature go through the CRC in a list_reduce.
ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, text, row_number() OVER () AS row_, 0 AS target FROM documents UNION ALL SELECT NULL, text, -row_number() OVER (), 1 FROM benchmark),
words AS (SELECT doc_id, row_, target, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{GAPS}'), lambda x: x <> '') AS w FROM texts),
runs AS (SELECT row_, target, unnest(list_transform(generate_series(1, len(w) - n + 1), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS f FROM words, generate_series(1, 3) AS g(n) WHERE len(w) >= n),
counted AS MATERIALIZED (SELECT row_, target, f, count(*) AS c FROM runs GROUP BY ALL),
halves AS (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM counted)),
hashed AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(generate_series(0, len(h) - 1), lambda i: (strpos('0123456789ABCDEF', h[xor(i, 1) + 1]) - 1)::BIGINT)),
    lambda c, x: xor(c >> 4, ({HALVES}::BIGINT[])[(xor(c, x) & 15) + 1])), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM halves),
per_bucket AS (SELECT row_, target, bucket, sum(c) AS c FROM counted JOIN hashed USING (f) GROUP BY ALL),
sums AS (SELECT bucket, sum(c) FILTER (target = 0) AS s, sum(c) FILTER (target = 1) AS t FROM per_bucket GROUP BY bucket),
alls AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM sums),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(sums.t, 0)::DOUBLE + 1) * (alls.s + {BUCKETS}) / ((coalesce(sums.s, 0)::DOUBLE + 1) * (alls.t + {BUCKETS}))))::BIGINT AS gain FROM sums, alls),
weights AS (SELECT row_, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM per_bucket JOIN gains USING (bucket) WHERE target = 0 GROUP BY row_),
scored AS (SELECT doc_id, row_, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM words LEFT JOIN weights USING (row_) WHERE target = 0),
drawn AS (SELECT row_, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn USING (row_)
"""
