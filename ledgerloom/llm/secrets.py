"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a text is content-addressed (SHA-256 of its bytes). A ledger in the
shared folder holds, for each (blob, rule, rule version) pair that was ever scanned,
the spans found. ``update`` scans each blob once, and only for pairs that the ledger
lacks; ``locate`` joins findings back to every path that holds the blob. So copies,
renames and earlier versions cost one scan, and a changed rule rescans for that rule alone.
The query starts with an empty ledger, as its table is one version of every path; callers
with a history keep the ledger's path and update it with each new version.

A rule is a regular expression whose matches are leftmost and do not overlap, with
the least length that one of its groups must have; shorter matches fail but still
consume their text. A text splits into the pieces between matches; the running lengths of
pieces and matches give every span, in code points and in bytes. These sums are a window
over rows of (blob, rule, place), so the work grows in proportion to a text's length and
findings. A text is masked by cutting its bytes at the spans and joining the pieces once.

Null texts count as empty ones; empty texts have no spans. Repeated rows get equal
findings each. Spans are ordered by start and then by the rules' order, so ties are
settled. Empty tables give empty results. Extra columns pass through ``locate`` and
``redact`` whatever their names are (a column ``secret_spans`` is replaced by ``locate`` only).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, packed, shared_dir, table, unpacked


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order that settles ties.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # a run of hex digits is maximal either way, so the bound can stand in the pattern: short runs are then no matches
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: A finding: code points from start to stop (exclusive), and the same in bytes.
SPAN = "struct<start:int,place:int,kind:string,stop:int,byte_start:int,byte_stop:int>"


def matches_of(text: Column, pieces: Column, rule: Rule) -> Column:
    """array<struct<gap,n,byte_gap,byte_n,size>> of one rule's matches in order: lengths of the piece before, of the match and of its group.
    ``pieces`` is the text split by the rule; a text without matches is gone over once."""
    whole = F.when(F.size(pieces) > 1, F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    size = (lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group))) if rule.group else F.length
    return F.zip_with(
        F.slice(pieces, 1, F.size(pieces) - 1), whole,
        lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("n"), F.octet_length(p).alias("byte_gap"), F.octet_length(m).alias("byte_n"), size(m).alias("size")),
    )


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


class Ledger:
    """What was scanned, as Parquet in one folder: (blob, rule, spans), one row for each pair, added to by every update."""

    def __init__(self, spark, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"

    def read(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        schema = f"blob string, rule string, spans array<{SPAN}>"
        if not where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def update(self, versions: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> Ledger:
        """Scan the unseen (blob, rule) pairs of ``versions`` and append them. Pairs without a finding are kept as well: they were seen."""
        text = F.coalesce(named(text_col).cast("string"), F.lit(""))
        blobs = versions.select(blob_of(named(text_col)).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
        seen = self.read().where(F.col("rule").isin([r.name for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
        todo = todo.withColumns({f"pieces{k}": F.when(~F.array_contains("seen", r.name), F.split("text", r.pattern, -1)) for k, r in enumerate(rules)})
        scanned = F.array(*[F.when(F.col(p := f"pieces{k}").isNotNull(), F.struct(F.lit(k).alias("k"), matches_of(F.col("text"), F.col(p), r).alias("m"))) for k, r in enumerate(rules)])
        each = todo.select("blob", F.explode(F.filter(scanned, lambda x: x.isNotNull())).alias("x"))
        each = each.select("blob", F.col("x.k").alias("k"), F.posexplode_outer("x.m").alias("i", "m"))
        upto = Window.partitionBy("blob", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        stop, byte_stop = F.sum(F.col("m.gap") + F.col("m.n")).over(upto), F.sum(F.col("m.byte_gap") + F.col("m.byte_n")).over(upto)
        placed = each.withColumns({"stop": stop.cast("int"), "byte_stop": byte_stop.cast("int")})
        of_rule = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("k") + 1)
        span = F.struct(
            (F.col("stop") - F.col("m.n")).alias("start"), F.col("k").alias("place"), of_rule([r.kind for r in rules]).alias("kind"), F.col("stop"),
            (F.col("byte_stop") - F.col("m.byte_n")).alias("byte_start"), F.col("byte_stop"),
        )
        long_enough = F.col("m.size") >= of_rule([r.least for r in rules])
        rows = placed.groupBy("blob", "k").agg(F.array_sort(F.collect_list(F.when(long_enough, span))).alias("spans"))
        rows.select("blob", of_rule([r.name for r in rules]).alias("rule"), F.col("spans").cast(f"array<{SPAN}>").alias("spans")).write.mode("append").parquet(self.path)
        return self

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, spans): all spans of the current rule versions, in order; only blobs that have some."""
        order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)])
        rows = self.read().where(F.col("rule").isin([r.name for r in rules]) & (F.size("spans") > 0))
        once = F.transform(F.collect_set(F.struct("rule", "spans")), lambda x: x["spans"])  # two updates at once may have scanned a pair twice, with equal spans
        keyed = F.transform(F.flatten(once), lambda s: s.withField("place", order[s["kind"]]))
        return rows.groupBy("blob").agg(F.array_sort(keyed).alias("spans"))

    def holes(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, holes array<struct<from,upto>>): the byte ranges that findings cover, those that overlap as one, in order."""
        each = self.findings(rules).select("blob", F.explode("spans").alias("s")).select("blob", F.col("s.byte_start").alias("a"), F.col("s.byte_stop").alias("b"))
        order = Window.partitionBy("blob").orderBy("a", "b")
        apart = F.col("a") >= F.coalesce(F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        islands = each.withColumn("apart", apart.cast("int")).withColumn("island", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        ranges = islands.groupBy("blob", "island").agg(F.min("a").alias("from"), F.max("b").alias("upto"))
        return ranges.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("from", "upto"))).alias("holes"))


def located(paths: DataFrame, ledger: Ledger, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, spans): every row of ``paths`` as a struct, with its findings."""
    return packed(paths, blob=blob_of(named(text_col))).join(ledger.findings(rules), "blob", "left").select("row", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def locate(paths: DataFrame, ledger: Ledger, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``paths`` with ``secret_spans`` (array of start, place, kind, stop and the byte offsets; empty without findings)."""
    return located(paths, ledger, text_col, rules).select(*[c for c, name in zip(unpacked(paths), paths.columns, strict=True) if name != "secret_spans"], F.col("spans").alias("secret_spans"))


def scan(docs: DataFrame, text_col: str = "text", ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Update a ledger (a new one if none is given) with the texts of ``docs`` and locate its findings in them."""
    ledger = (ledger or Ledger(docs.sparkSession)).update(docs, text_col, rules)
    return locate(docs, ledger, text_col, rules)


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    ledger = Ledger(docs.sparkSession).update(docs.select("text"), "text", rules)
    found = table(ledger.findings(rules).select("blob", F.col("spans").alias("s")), "findings")  # a table, so that AQE can split a hot blob
    hits = docs.select("doc_id", blob_of(F.col("text")).alias("blob")).join(found, "blob", "left").withColumn("s", F.coalesce("s", F.array().cast(f"array<{SPAN}>")))
    listed = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")
    return hits.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in rules], F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]", ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by ``mask`` (overlapping spans by one); columns and rows stay as they are."""
    ledger = (ledger or Ledger(docs.sparkSession)).update(docs, text_col, rules)
    holes = table(ledger.holes(rules), "holes")
    met = packed(docs, blob=blob_of(named(text_col))).join(holes.hint("merge"), "blob", "left").select("row", "holes")  # holes grow with the texts: the same plan at every size
    text = F.col("row").getField(text_col).cast("string")
    starts = F.concat(F.array(F.lit(0)), F.col("holes")["upto"])
    stops = F.concat(F.col("holes")["from"], F.array(F.octet_length(text)))
    pieces = F.zip_with(starts, stops, lambda a, b: F.substring(text.cast("binary"), a + 1, b - a).cast("string"))
    cut = F.when(F.col("holes").isNotNull(), F.array_join(pieces, mask)).otherwise(text)
    return met.select(*[cut.alias(name) if name == text_col else c for c, name in zip(unpacked(docs), docs.columns, strict=True)])


#: DuckDB SQL for ``digests`` over ``documents``.
ORACLE_SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT doc_id, kind, place, least, regexp_extract_all(t, pat) AS m, regexp_split_to_array(t, pat) AS p, regexp_extract_all(t, pat, grp) AS g
  FROM texts, (VALUES
    ('assign', 0, 8, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2),
    ('access', 1, 16, 'AKIA[A-Z0-9]+', 0),
    ('hex', 2, 32, '[0-9a-f]{32,}', 0)) AS rules(kind, place, least, pat, grp)
  WHERE regexp_matches(t, pat)
),
spans AS (
  SELECT doc_id, kind, place, least, length(g[i]) AS size,
    CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start,
    length(m[i]) AS n
  FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM parts)
),
rows_ AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS h,
    string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, place) AS s
  FROM spans WHERE size >= least GROUP BY doc_id
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(s, '')) AS base_sha256, coalesce(s, '') AS spans
FROM texts LEFT JOIN rows_ USING (doc_id)
"""
