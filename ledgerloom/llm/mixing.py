"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only.

A tree of levels (production: domain, language, source) carries weights. The token
budget runs down from the root: each node shares its budget among its children in
proportion to their weights, but no child gets more than its capacity (its tokens
times ``max_epochs``); what a child can't use goes to its siblings first, and only
what a whole subtree can't use goes to the parent's siblings, because a parent never
asks for more than its subtree's capacity. All amounts are whole tokens: shares round
down and single tokens left over go to the first unfilled children by name.

A leaf whose budget is q times its tokens and a rest takes q whole epochs, and from
epoch q the prefix whose tokens reach the rest. Rows of an epoch are ordered by
MD5(seed, epoch, document id, MD5 of the text). The prefix is found from token sums of hash
ranges and an ordering of one range, so no leaf is ever sorted as a whole. Rows that share the
hash at a prefix's end are copies of one id and text: they are numbered, and the prefix takes as
many as it needs.

Tokens of a text are its UTF-8 bytes over four, rounded up. Null and empty texts have
no tokens and are never taken. Nulls in level columns count as the name ''; null ids as an
empty id, told apart by their texts. Weights that aren't given are 1. An empty table, or a budget of 0,
takes nothing. A leaf never takes more tokens than its budget, but for the rest of the last whole document
in ``select_documents``. Extra columns are kept by ``select_documents`` whatever their names are, and not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, packed, table, unpacked

#: Weights by level and name (others: 1), tokens asked for as a share of all, most epochs, seed.
WEIGHTS = {"domain": {"news": 5, "web": 3, "reference": 2}, "lang": {"en": 5, "fr": 2, "de": 2, "es": 1}, "source": {}}
LEVELS = ("domain", "lang", "source")
SHARE, MAX_EPOCHS, SEED = (3, 5), 3, 17
#: Documents that a hash range has on average.
RANGE_ROWS = 128
WIDE = "decimal(38,0)"


def tokens_of(text: Column) -> Column:
    return F.floor((F.octet_length(F.coalesce(text.cast("string"), F.lit(""))) + 3) / 4).cast("long")


def domain_of(source: Column) -> Column:
    """Production rule: sources with numbers ending in 0 to 4 are web, 5 to 7 news, others (and sources without a number) reference."""
    last = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9])$", 1)
    return F.when(last.isin("0", "1", "2", "3", "4"), "web").when(last.isin("5", "6", "7"), "news").otherwise("reference")


def weight_of(level: str, name: Column, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for key, value in weights.get(level, {}).items():
        out = F.when(name == key, F.lit(value)).otherwise(out)
    return out.cast(WIDE)


def budgets(leaves: DataFrame, levels: tuple[str, ...], weights: dict[str, dict[str, int]], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens, n) with ``budget`` long. Its rows are the leaves, far fewer than the documents."""
    root = leaves.agg(F.coalesce(F.sum(F.col("tokens").cast(WIDE)), F.lit(0)).cast(WIDE).alias("all")).select(
        F.floor(F.col("all") * share[0] / share[1]).cast(WIDE).alias("ask"), (F.col("all") * max_epochs).cast(WIDE).alias("capacity")
    )
    level = root.select(F.least("ask", "capacity").alias("budget"))
    above: list[str] = []
    for depth, name in enumerate(levels):
        keys = [*above, name]
        nodes = leaves.groupBy(*keys).agg((F.sum(F.col("tokens").cast(WIDE)) * max_epochs).cast(WIDE).alias("capacity")).withColumn("weight", weight_of(name, F.col(name), weights))
        nodes = nodes.join(level, above) if above else nodes.crossJoin(F.broadcast(level))  # the root is one row
        nodes = nodes.where(F.col("capacity") > 0)
        # children that fill up come first: least capacity for their weight
        by = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        ratio = (F.col("capacity").cast("double") / F.col("weight").cast("double"))
        order = by.orderBy(ratio, name)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        nodes = nodes.withColumn("used", F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast(WIDE)).withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast(WIDE))
        rest = F.col("budget") - F.col("used")
        # filled if an even share among itself and all later ones would exceed its capacity; those that fill are the first ones
        nodes = nodes.withColumn("full", (F.col("capacity") * F.col("open")).cast(WIDE) <= (rest * F.col("weight")).cast(WIDE))
        nodes = nodes.withColumn("stopped", F.coalesce(F.max(F.when(~F.col("full"), 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
        filled = F.col("stopped") == 0
        left = (F.max("budget").over(by) - F.coalesce(F.sum(F.when(filled, F.col("capacity"))).over(by), F.lit(0))).cast(WIDE)
        among = F.coalesce(F.sum(F.when(~filled, F.col("weight"))).over(by), F.lit(1)).cast(WIDE)
        nodes = nodes.withColumn("left", left).withColumn("among", among)
        nodes = nodes.withColumn("part", F.when(filled, F.col("capacity")).otherwise(F.floor(F.expr("left * weight div among")).cast(WIDE)).cast(WIDE))
        odd = (F.col("left") - F.coalesce(F.sum(F.when(F.col("stopped") == 1, F.col("part"))).over(by), F.lit(0))).cast(WIDE)
        place = F.row_number().over(by.orderBy(F.col("stopped").desc(), name))
        nodes = nodes.withColumn("odd", odd).withColumn("place", place)
        level = nodes.select(*keys, (F.col("part") + F.when((F.col("stopped") == 1) & (F.col("place") <= F.col("odd")), 1).otherwise(0)).cast(WIDE).alias("budget"))
        above = keys
    return leaves.join(level.select(*levels, F.col("budget").cast("long").alias("budget")), list(levels)).where(F.col("tokens") > 0)


def place_of(seed: int, epoch: Column, doc_id: Column, content: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")), content))


def content_of(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def plan(rows: DataFrame, levels: tuple[str, ...] = LEVELS, weights: dict[str, dict[str, int]] = WEIGHTS, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """From (doc_id, content, levels, tokens): one row for each leaf with levels, ``budget``, ``epochs`` (whole ones), ``rest`` (tokens of the
    last), ``bits`` and the prefix's end: rows up to hash ``edge`` (excluded if null) lie in it, and ``taken`` tokens come before ``edge``."""
    keys = list(levels)
    taken = rows.where(F.col("tokens") > 0)
    leaves = taken.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    given = budgets(leaves, levels, weights, share, max_epochs)
    given = given.withColumn("epochs", F.expr("budget div tokens")).withColumn("rest", F.expr("budget % tokens"))
    given = given.withColumn("bits", F.greatest(F.lit(0), F.least(F.lit(40), F.ceil(F.log2(F.col("n") / RANGE_ROWS)))).cast("int"))
    given = table(given, "budgets")  # a row for each leaf: Spark sees its size and broadcasts it if small
    ordered = taken.join(given.select(*keys, "epochs", "rest", "bits"), keys).where(F.col("rest") > 0)
    ordered = ordered.withColumn("hash", place_of(seed, F.col("epochs"), F.col("doc_id"), F.col("content")))
    ordered = ordered.withColumn("range", F.expr("shiftright(cast(conv(substr(hash, 1, 15), 16, 10) as bigint), 60 - bits)"))
    sums = ordered.groupBy(*keys, "range", "rest").agg(F.sum("tokens").alias("sum"))
    upto = F.sum("sum").over(Window.partitionBy(*keys).orderBy("range"))
    edges = sums.withColumn("upto", upto).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("sum") < F.col("rest"))).select(*keys, "range", (F.col("upto") - F.col("sum")).alias("before"))
    inside = ordered.join(edges, [*keys, "range"]).groupBy(*keys, "hash", "rest", "before").agg(F.sum("tokens").alias("sum"))
    upto = F.col("before") + F.sum("sum").over(Window.partitionBy(*keys).orderBy("hash"))
    edge = inside.withColumn("upto", upto).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("sum") < F.col("rest")))
    ends = given.select(*keys, "budget", "epochs", "rest").join(edge.select(*keys, F.col("hash").alias("edge"), (F.col("upto") - F.col("sum")).alias("taken")), keys, "left")
    return table(ends, "prefixes")


def in_last_epoch(rows: DataFrame, ends: DataFrame, seed: int) -> DataFrame:
    """``rows`` (doc_id, content, levels, tokens and more) of leaves with a budget, with ``epochs`` and ``last``: how many of their tokens
    the prefix of the last, partial epoch takes (0: none)."""
    each = rows.where(F.col("tokens") > 0).join(ends, list(LEVELS)).withColumn("hash", place_of(seed, F.col("epochs"), F.col("doc_id"), F.col("content")))
    at_edge = F.coalesce(F.col("hash") == F.col("edge"), F.lit(False))
    before = F.coalesce(F.col("hash") < F.col("edge"), F.lit(False))
    plain = each.where(~at_edge).withColumn("last", F.when(before, F.col("tokens")).otherwise(F.lit(0)).cast("long"))
    copies = numbered(each.where(at_edge), list(LEVELS), "copy", "edges")
    left = F.col("rest") - F.col("taken") - F.col("copy") * F.col("tokens")
    copies = copies.withColumn("last", F.greatest(F.lit(0), F.least(F.col("tokens"), left)).cast("long")).drop("copy")
    return plain.unionByName(copies)


def mixture(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, tokens, used): every document once for each epoch that takes it. ``used`` is less than
    ``tokens`` only where the budget ends inside a document: at the last place of a leaf's prefix."""
    rows = leaf_rows(docs)
    each = in_last_epoch(rows, plan(rows, seed=seed), seed)
    spread = each.withColumn("epoch", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("epochs")), lambda e: (e < F.col("epochs")) | (F.col("last") > 0))))
    used = F.when(F.col("epoch") == F.col("epochs"), F.col("last")).otherwise(F.col("tokens"))
    return spread.select("doc_id", *LEVELS, "epoch", "tokens", used.alias("used"))


def leaf_columns() -> dict[str, Column]:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return {"doc_id": F.col("doc_id"), "content": content_of(F.col("text")), "domain": domain_of(F.col("source").cast("string")), "lang": name("lang"), "source": name("source"), "tokens": tokens_of(F.col("text"))}


def leaf_rows(docs: DataFrame) -> DataFrame:
    return docs.select(*[c.alias(name) for name, c in leaf_columns().items()])


def select_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The whole documents that the mixture takes, once for each epoch that takes them, with the columns of ``docs``."""
    each = in_last_epoch(packed(docs, **leaf_columns()), plan(leaf_rows(docs), seed=seed), seed)
    times = F.col("epochs") + (F.col("last") > 0).cast("long")
    return each.where(times > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*unpacked(docs))


#: DuckDB SQL for ``mixture`` over ``documents``.
def _oracle() -> str:
    def weight(level: str) -> str:
        cases = "".join(f" WHEN {level} = '{k}' THEN {v}" for k, v in WEIGHTS.get(level, {}).items())
        return f"CASE{cases} ELSE 1 END" if cases else "1"

    steps, above = [f"l0 AS (SELECT least(sum(tokens) * {SHARE[0]} // {SHARE[1]}, sum(tokens) * {MAX_EPOCHS}) AS budget FROM leaves)"], []
    for depth, name in enumerate(LEVELS, 1):
        keys = [*above, name]
        part = f"PARTITION BY {', '.join(above)}" if above else ""
        join = f"JOIN l{depth - 1} USING ({', '.join(above)})" if above else f", l{depth - 1}"
        steps.append(f"""n{depth} AS (
  SELECT *, capacity::DOUBLE / weight AS ratio FROM (SELECT {', '.join(keys)}, sum(tokens) * {MAX_EPOCHS} AS capacity, {weight(name)} AS weight FROM leaves GROUP BY {', '.join(keys)}) {join}),
f{depth} AS (SELECT *, capacity * sum(weight) OVER ({part} ORDER BY ratio, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= (budget - coalesce(sum(capacity) OVER ({part} ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS filled FROM n{depth}),
s{depth} AS (SELECT *, bool_or(NOT filled) OVER ({part} ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped FROM f{depth}),
p{depth} AS (SELECT *, budget - coalesce(sum(capacity) FILTER (NOT stopped) OVER ({part}), 0) AS rest, coalesce(sum(weight) FILTER (stopped) OVER ({part}), 1) AS among FROM s{depth}),
q{depth} AS (SELECT *, CASE WHEN stopped THEN rest * weight // among ELSE capacity END AS share FROM p{depth}),
l{depth} AS (SELECT {', '.join(keys)}, share + CASE WHEN stopped AND row_number() OVER ({part} ORDER BY stopped DESC, {name})
    <= rest - coalesce(sum(share) FILTER (stopped) OVER ({part}), 0) THEN 1 ELSE 0 END AS budget FROM q{depth})""")
        above = keys
    k = ", ".join(LEVELS)
    return f"""
WITH rows_ AS (
  SELECT * FROM (SELECT doc_id, md5(coalesce(text, '')) AS content, coalesce(source, '') AS source, coalesce(lang, '') AS lang, (strlen(coalesce(text, '')) + 3) // 4 AS tokens,
    CASE WHEN regexp_matches(coalesce(source, ''), '[0-4]$') THEN 'web' WHEN regexp_matches(coalesce(source, ''), '[5-7]$') THEN 'news' ELSE 'reference' END AS domain
  FROM documents) WHERE tokens > 0),
leaves AS (SELECT {k}, sum(tokens) AS tokens FROM rows_ GROUP BY {k}),
{', '.join(steps)},
ends AS (SELECT {k}, l.budget // tokens AS epochs, l.budget % tokens AS rest FROM leaves JOIN l{len(LEVELS)} l USING ({k})),
placed AS (SELECT r.*, epochs, rest, md5('{SEED}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '') || ':' || content) AS hash FROM rows_ r JOIN ends USING ({k})),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY {k} ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tokens AS before FROM placed),
spread AS (SELECT *, unnest(generate_series(0, epochs::BIGINT)) AS epoch FROM summed)
SELECT doc_id, {k}, epoch::BIGINT AS epoch, tokens::BIGINT AS tokens,
  (CASE WHEN epoch = epochs THEN least(tokens, rest - before) ELSE tokens END)::BIGINT AS used
FROM spread WHERE epoch < epochs OR before < rest
"""


ORACLE_SQL = _oracle()
