"""Deep and odd url paths against a plain tree, long texts in pieces, columns that can't be hashed, pairs scanned twice."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import minhash, quality, secrets, toxicity, urlfilter


def differ(b, n, c, m):
    common = (b + c + 1) / (n + m + 2)
    return abs(b / max(n, 1) - c / max(m, 1)) > 1.96 * (common * (1 - common) * (1 / max(n, 1) + 1 / max(m, 1))) ** 0.5


def tree_by_force(urls, rules):
    """(host, path) -> (template, verdict), slot by slot."""
    told, rows = {}, []
    for host, path in sorted(set(urls)):
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        label = None if not fits else int(rules[max(fits, key=len)] == "block")
        rows.append((host, path, [s for s in path.split("/") if s], label))
    show = lambda v: v.replace("%", "%25").replace("|", "%7C").replace("*", "%2A")

    def grow(slot, depth, name):
        values = {}
        for row in slot:
            if len(row[2]) <= depth:
                told[row[:2]] = (name, row[3])
            else:
                values.setdefault(row[2][depth], []).append(row)
        n = {v: len(r) for v, r in values.items()}
        known = {v: (sum(x[3] for x in r if x[3] is not None), sum(x[3] is not None for x in r)) for v, r in values.items()}
        labels, blocks = sum(k[1] for k in known.values()), sum(k[0] for k in known.values())
        rare = sum(x for x in n.values() if x <= 3)
        named = sum(k[1] > 0 for k in known.values())
        branch = {}
        for v in values:
            b, m = known[v]
            if m and (named <= 5 or differ(b, m, blocks - b, labels - m) or not (rare * 2 >= sum(n.values()) or n[v] <= 3)):
                branch[v] = None
            elif not m and not (rare * 2 >= sum(n.values()) or n[v] <= 3):
                branch[v] = show(v)
        order, groups, last = sorted((v for v in branch if branch[v] is None), key=lambda v: (known[v][0] / known[v][1], known[v][1])), [], None
        for v in order:
            if last is None or (known[v] != known[last] and differ(*known[v], *known[last])):
                groups.append([])
            groups[-1].append(v)
            last = v
        for g in groups:
            for v in g:
                branch[v] = "|".join(map(show, sorted(g)[:3]))
        below = {}
        for v, r in values.items():
            below.setdefault(branch.get(v, "*"), []).extend(r)
        for b, r in below.items():
            grow(r, depth + 1, f"{name}/{b}")

    for host in {r[0] for r in rows}:
        grow([r for r in rows if r[0] == host], 0, "")
    sums = {}
    for (host, _), (t, label) in told.items():
        if label is not None:
            s = sums.setdefault((host, t), [0, 0])
            s[0], s[1] = s[0] + label, s[1] + 1
    out = {}
    for (host, path), (t, label) in told.items():
        b, n = sums.get((host, t), (0, 0))
        out[host, path] = (t, {1: "block", 0: "allow"}.get(label, "block" if (b + 0.5) / (n + 2) >= 0.5 else "allow"))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_url_tree_of_any_depth(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["a", "b", "bad", "good", "bad|worse", "*", "**", "%2A", "x y", "ü", *[f"n{i}" for i in range(40)]]
    weights = np.array([12, 8, 9, 9, 4, 3, 2, 2, 2, 2] + [1] * 40, float)
    rules = {"h0.com/a/": "block", "h0.com/a/good/": "allow", "h1.com/b/a/a/b/bad/": "block", "h1.com/b/a/a/b/good/": "allow", "h1.com/bad/": "block"}
    urls = []
    for _ in range(400):
        host, depth = f"h{rng.integers(0, 2)}.com", int(rng.integers(0, 8))
        head = ["b", "a", "a", "b"] if host == "h1.com" and rng.random() < 0.6 else []
        urls.append((host, "/" + "/".join([*head, *rng.choice(names, depth, p=weights / weights.sum())])))
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(urls)], "page_id int, url string")
    want = tree_by_force(urls, rules)
    got = urlfilter.judge(pages, rules=rules).collect()
    assert len(got) == 400 and {(r.host, r.path): (r.template, r.verdict) for r in got} == want


def test_urls_that_were_judged_wrongly(spark):
    deep = [f"http://h.com/a/b/c/d/bad/{i}" for i in range(40)] + [f"http://h.com/a/b/c/d/good/{i}" for i in range(40)]
    odd = [f"http://o.com/{s}/{i}" for s in ("bad", "worse", "bad|worse", "*", "**") for i in range(40)]
    rules = {**{f"h.com/a/b/c/d/bad/{i}": "block" for i in range(10, 40)}, "o.com/bad/": "block", "o.com/worse/": "block"}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(deep + odd)], "page_id int, url string")
    blocked = {r.path.rsplit("/", 1)[0] for r in urlfilter.judge(pages, rules=rules).where("verdict = 'block'").collect()}
    assert blocked == {"/a/b/c/d/bad", "/bad", "/worse"}


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_long_texts_are_scored_in_pieces(spark, operator):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["good", "fine", "bad", "awful", "Ünder"], 30)) for _ in range(60)]
    rows = spark.createDataFrame([(i, t, int("bad" in t.split()[:6])) for i, t in enumerate(texts)], "doc_id int, text string, y int")
    model = operator.fit(rows)
    docs = spark.createDataFrame([(0, " ".join(f"w{i % 9000} good" for i in range(20_000))), (1, texts[0]), (2, None), (3, " " * 3000)], "doc_id int, text string").coalesce(1)
    shown = lambda: {r.doc_id: r.score for r in operator.score(docs, model).collect()}
    whole = shown()
    long = docs.withColumn("text", F.when(F.col("doc_id") == 0, F.concat("text", F.lit(" " * (1 << 20)))).otherwise(F.col("text")))  # spaces make it long and change no word
    got = {r.doc_id: r.score for r in operator.score(long, model).collect()}
    assert got == pytest.approx(whole, abs=1e-9)


def test_deduplication_with_a_map_column(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = spark.createDataFrame([(1, text, {"a": 1}), (1, text, {"a": 2}), (2, text, {"b": 1}), (3, "other words " * 5, {})], "doc_id int, text string, m map<string,int>")
    assert sorted(r.doc_id for r in minhash.deduplicated(rows).collect()) == [1, 3]


def test_pairs_scanned_twice_count_once(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh12 password=secretword99"), (2, "none")], "doc_id int, text string")
    ledger = secrets.Ledger(spark).update(docs)
    before = sorted(map(str, secrets.locate(docs, ledger).collect()))
    ledger.read().write.mode("append").parquet(ledger.path + "-copy")
    spark.read.parquet(ledger.path + "-copy").write.mode("append").parquet(ledger.path)  # as a second update at once would
    assert ledger.read().count() == 12 and sorted(map(str, secrets.locate(docs, ledger).collect())) == before and re.search("secretword99", before[0])
