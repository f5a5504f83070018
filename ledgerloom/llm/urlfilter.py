"""URL filters by a path-template tree for each host.

Rules (host and path prefix, allow or block) judge the urls they fit; the longest wins.
Their verdicts are the labels from which the tree learns to judge all other urls. The tree is
built from distinct (host, path) pairs, each counted once. Level by level, under each host and
template so far (a slot), the values of the next segment are sorted out:

* a slot is variable if its rare values, those that occur up to ``RARE`` times, make up half of its urls or more;
  values of a variable slot, and rare values of any slot, become ``*``;
* but a value with labels stays a branch of its own unless ``ALIKE`` or more other values of the
  slot have labels and its blocked rate doesn't differ from theirs by a two-proportion test. So ``*``
  takes its labels from many values that agree, and the labels of one or a few named segments never judge others;
* labelled branches of one slot whose rates don't differ by the test merge into one, named ``a|b``
  by its first ``NAMES`` values. Branches without labels stay single.

The tree goes on until no slot has an open segment. A slot that holds a single url needs no level of its own: what follows is
``*`` throughout, or the url's own segments if it has a label; so there are as many levels as two urls share segments, and one more. ``%``, ``|`` and ``*`` within
segments are percent-encoded in templates, so no segment can pass for a merged branch or a wildcard. A template's purity is its share of blocked
labels, smoothed by ``STRENGTH`` labels at ``PRIOR``; templates with a purity of ``REJECT`` or more are
blocked, so templates without labels are allowed.

Null urls and urls without ``://`` have an empty host and path, which are judged as the
host '' at its root. Repeated urls count once and are judged alike.
Ties in rates are ordered by name. Empty tables give empty results; extra
columns are kept by ``judge`` unless they bear the names of its results. Copies of one url are
one row of the tree; branches, rates and purities come from aggregations that combine before
their shuffle, and the windows run over a slot's distinct label counts and a merged branch's first names,
so a host with a third of all pages is no one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, packed, table, unpacked

#: The production rules.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
RARE, ALIKE, NAMES, Z, STRENGTH, PRIOR, REJECT = 3, 5, 3, 1.96, 2.0, 0.25, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def escaped(segment: Column) -> Column:
    """A segment as templates show it: the marks of merged branches and wildcards are encoded."""
    for mark, code in (("%", "%25"), ("|", "%7C"), ("*", "%2A")):
        segment = F.replace(segment, F.lit(mark), F.lit(code))
    return segment


def differ(b: str, n: str, c: str, m: str) -> str:
    """SQL: the rates b of n and c of m differ by more than Z standard errors (those of the common rate, smoothed by a label of each kind)."""
    common = f"(({b} + {c} + 1) / ({n} + {m} + 2.0))"
    return f"(abs({b} / greatest({n}, 1) - {c} / greatest({m}, 1)) > {Z} * sqrt({common} * (1 - {common}) * (1.0 / greatest({n}, 1) + 1.0 / greatest({m}, 1))))"


def branches(rows: DataFrame) -> DataFrame:
    """From (host, t, v, label): (host, t, v, branch) of the segments that aren't variable."""
    seen = rows.where(F.col("v").isNotNull()).groupBy("host", "t", "v").agg(F.count(F.lit(1)).alias("n"), F.count("label").cast("double").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).cast("double").alias("blocked"))
    seen = table(seen, "segments")
    slots = table(
        seen.groupBy("host", "t").agg(
            F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("n") <= RARE, F.col("n"))), F.lit(0)).alias("rare"), F.sum("labelled").alias("labels"), F.sum("blocked").alias("blocks"), F.count_if(F.col("labelled") > 0).alias("values"),
        ),
        "slots",
    )
    met = seen.join(slots, ["host", "t"])
    known = F.col("labelled") > 0
    variable = (F.col("rare") * 2 >= F.col("all")) | (F.col("n") <= RARE)
    apart = F.expr(differ("blocked", "labelled", "(blocks - blocked)", "(labels - labelled)"))
    fixed = table(met.where(~variable | (known & ((F.col("values") <= ALIKE) | apart))).select("host", "t", "v", "labelled", "blocked"), "branches")
    # labelled branches in order of their rates; one row for each pair of counts, however many segments have it
    rates = fixed.where(known).select("host", "t", "labelled", "blocked").distinct()
    order = Window.partitionBy("host", "t").orderBy(F.col("blocked") / F.col("labelled"), "labelled")
    rates = rates.withColumns({"b0": F.lag("blocked").over(order), "n0": F.lag("labelled").over(order)})
    apart = F.col("n0").isNull() | F.expr(differ("blocked", "labelled", "b0", "n0"))
    rates = rates.withColumn("group", F.sum(apart.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).select("host", "t", "labelled", "blocked", "group")
    grouped = fixed.where(known).join(table(rates, "rates"), ["host", "t", "labelled", "blocked"]).select("host", "t", "v", "group")
    grouped = table(grouped, "grouped")
    place = F.row_number().over(Window.partitionBy("host", "t", "group").orderBy("v"))
    first = grouped.withColumn("place", place).where(F.col("place") <= NAMES)
    names = table(first.groupBy("host", "t", "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list("v")), escaped), "|").alias("branch")), "names")
    merged = grouped.join(names, ["host", "t", "group"]).select("host", "t", "v", "branch")
    return merged.unionByName(fixed.where(~known).select("host", "t", "v", escaped(F.col("v")).alias("branch")))


def templates(urls: DataFrame) -> DataFrame:
    """``urls`` (host, segments, label and more) with ``template``."""
    done, rows, depth = [], urls.withColumn("t", F.lit("")), 0
    while True:
        rows = table(rows.withColumn("v", F.get("segments", F.lit(depth))), f"templates-{depth}")
        done.append(rows.where(F.col("v").isNull()).drop("v"))
        rows = rows.where(F.col("v").isNotNull())
        if rows.isEmpty():
            break
        single = rows.groupBy("host", "t").agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("path")).where(F.col("_n") == 1)
        met = table(rows.join(single, ["host", "t", "path"], "left"), f"slots-{depth}")  # by path too, so that a large slot is dealt over many tasks
        own = F.array_join(F.transform(F.slice("segments", depth + 1, F.size("segments")), lambda s: F.concat(F.lit("/"), F.when(F.col("label").isNull(), "*").otherwise(escaped(s)))), "")
        done.append(met.where(F.col("_n") == 1).withColumn("t", F.concat("t", own)).drop("v", "_n"))
        rows = met.where(F.col("_n").isNull()).drop("_n")
        rows = rows.join(table(branches(rows), f"branches-{depth}"), ["host", "t", "v"], "left")
        rows = rows.withColumn("t", F.concat("t", F.lit("/"), F.coalesce("branch", F.lit("*")))).drop("v", "branch")
        depth += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("t", "template")


def judge(pages: DataFrame, url_col: str = "url", rules: dict[str, str] = RULES) -> DataFrame:
    """All columns of ``pages`` with host, path, rule, verdict, template and purity."""
    new = ["host", "path", "rule", "verdict", "template", "purity"]
    kept = pages.select(*[named(c) for c in pages.columns if c not in new])
    host, path = host_and_path(named(url_col).cast("string"))
    urls = pages.select(host.alias("host"), path.alias("path")).distinct().withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    said = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])[F.col("rule")]
    urls = urls.withColumn("label", (said == "block").cast("int")).withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != ""))
    rows = table(templates(urls), "templates")
    nodes = rows.groupBy("host", "template").agg(F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"))
    purity = (F.col("blocked") + F.lit(STRENGTH * PRIOR)) / (F.col("labelled") + F.lit(STRENGTH))
    judged = rows.join(table(nodes.select("host", "template", purity.alias("purity")), "purities"), ["host", "template"])
    verdict = F.when(F.col("label") == 1, "block").when(F.col("label") == 0, "allow").when(F.col("purity") >= REJECT, "block").otherwise("allow")
    judged = table(judged.select(F.col("host").alias("h"), F.col("path").alias("p"), "rule", verdict.alias("verdict"), "template", "purity"), "verdicts")
    met = packed(kept, host=host, path=path).join(judged, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")))
    return met.select(*unpacked(kept), *new)


def verdicts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) of every page."""
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "template")


#: Levels that the SQL spells out; no path of ``pages`` has more segments.
LEVELS = 8


def _oracle() -> str:
    """DuckDB SQL for ``verdicts`` over ``pages``."""
    shown = lambda v: f"replace(replace(replace({v}, '%', '%25'), '|', '%7C'), '*', '%2A')"
    ordered = sorted(RULES, key=lambda r: (len(r), r), reverse=True)
    fits = []
    for rule in ordered:
        name, slash, rest = rule.partition("/")
        fits.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}') THEN '{rule}'")
    said = " ".join(f"WHEN '{r}' THEN {int(v == 'block')}" for r, v in RULES.items())
    steps = []
    for d in range(1, LEVELS + 1):
        steps.append(f"""
seen{d} AS (SELECT host, t, segments[{d}] AS v, count(*)::DOUBLE AS n, count(label)::DOUBLE AS labelled, coalesce(sum(label), 0)::DOUBLE AS blocked
  FROM rows{d - 1} WHERE len(segments) >= {d} GROUP BY ALL),
rated{d} AS (SELECT *, sum(n) OVER w AS total, coalesce(sum(n) FILTER (n <= {RARE}) OVER w, 0) AS rare, sum(labelled) OVER w AS labels, sum(blocked) OVER w AS blocks,
    count(*) FILTER (labelled > 0) OVER w AS vals FROM seen{d} WINDOW w AS (PARTITION BY host, t)),
fixed{d} AS (SELECT * FROM rated{d} WHERE NOT (rare * 2 >= total OR n <= {RARE}) OR (labelled > 0 AND (vals <= {ALIKE} OR {differ('blocked', 'labelled', '(blocks - blocked)', '(labels - labelled)')}))),
lagged{d} AS (SELECT *, lag(blocked) OVER w AS b0, lag(labelled) OVER w AS n0 FROM fixed{d} WHERE labelled > 0 WINDOW w AS (PARTITION BY host, t ORDER BY blocked / labelled, labelled, v)),
grouped{d} AS (SELECT *, sum(CASE WHEN n0 IS NULL OR {differ('blocked', 'labelled', 'b0', 'n0')} THEN 1 ELSE 0 END) OVER (PARTITION BY host, t ORDER BY blocked / labelled, labelled, v) AS grp FROM lagged{d}),
named{d} AS (SELECT host, t, v, list(v) OVER (PARTITION BY host, t, grp ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS all_ FROM grouped{d}),
branch{d} AS (SELECT host, t, v, array_to_string(list_transform(all_[1:{NAMES}], lambda x: {shown('x')}), '|') AS branch FROM named{d} UNION ALL SELECT host, t, v, {shown('v')} FROM fixed{d} WHERE labelled = 0),
rows{d} AS (SELECT r.host, path, rule, label, segments, CASE WHEN len(segments) < {d} THEN r.t ELSE r.t || '/' || coalesce(branch, '*') END AS t
  FROM rows{d - 1} r LEFT JOIN branch{d} b ON r.host = b.host AND r.t = b.t AND r.segments[{d}] = b.v)""")
    return f"""
WITH parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages)),
urls AS (SELECT *, CASE {' '.join(fits)} END AS rule FROM (SELECT DISTINCT host, path FROM parsed)),
rows0 AS (SELECT *, CASE rule {said} END AS label, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments, '' AS t FROM urls),
{','.join(steps).strip()},
judged AS (SELECT host, path, rule, t AS template, CASE WHEN label = 1 THEN 'block' WHEN label = 0 THEN 'allow'
    WHEN (coalesce(sum(label) OVER w, 0) + {STRENGTH * PRIOR}) / (count(label) OVER w + {STRENGTH}) >= {REJECT} THEN 'block' ELSE 'allow' END AS verdict
  FROM rows{LEVELS} WINDOW w AS (PARTITION BY host, t))
SELECT page_id, host, path, rule, verdict, template FROM parsed JOIN judged USING (host, path)
"""


ORACLE_SQL = _oracle()
