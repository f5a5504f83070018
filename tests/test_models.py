"""Exact quantiles, bins of intervals and errors over time folds against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import features, fuzzy, mapping, quantiles, ranges


@pytest.mark.parametrize("spread", [1, 50, 10**7, 2**61])
def test_exact_quantiles(spark, spread):
    rng = np.random.default_rng(spread % 97)
    groups = {"a": rng.integers(-spread, spread, 501), "b": np.array([5]), None: rng.integers(0, spread, 40), "c": np.array([3, 3, 3, 4])}
    rows = spark.createDataFrame([(k, int(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("z", None)], "k string, v bigint").repartition(3)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: (r.n, list(r["quantiles"])) for r in quantiles.exact(rows, ["k"], F.col("v"), shares).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k][0] == len(values) and np.allclose(got[k][1], np.quantile(values.astype(float), shares), rtol=1e-12)
    assert quantiles.exact(rows.limit(0), ["k"], F.col("v"), shares).count() == 0


def test_robust_scaling_goes_back(spark):
    rows = spark.createDataFrame([("a", v) for v in (-500, 0, 3, 10, 40, 10**9)] + [("b", 7), (None, 1), (None, 90)], "k string, v bigint")
    out = features.robust_scaled(rows, "k", "v").withColumn("back", F.round(features.restored(F.col("scaled"), F.col("median"), F.col("spread")))).collect()
    assert len(out) == 9 and all(abs(r.scaled) <= 5 for r in out) and all(r.back == r.v for r in out if abs(r.scaled) < 5)


def test_points_meet_intervals_by_bins(spark):
    rng = np.random.default_rng(8)
    points = [(i, int(x), "ab"[i % 2]) for i, x in enumerate(rng.integers(-3000, 3000, 300))] + [(300, None, "a")]
    spans = [(i, int(s), int(s + rng.choice([0, 1, 5, 700, 5000])), "ab"[i % 2]) for i, s in enumerate(rng.integers(-3500, 3000, 120))] + [(120, 5, None, "a"), (121, 9, 3, "a"), (122, -(10**12), 10**12, "a")]
    p, s = spark.createDataFrame(points, "p int, x bigint, k string"), spark.createDataFrame(spans, "s int, lo bigint, hi bigint, k string")
    met = ranges.in_intervals(p, F.col("x"), s, F.col("lo"), F.col("hi"), ["k"])
    want = sorted((a[0], b[0]) for a in points for b in spans if a[2] == b[3] and None not in (a[1], b[2]) and b[1] <= a[1] <= b[2])
    assert sorted((r.p, r.s) for r in met.collect()) == want and len(want) > 1000
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert ranges.in_intervals(p, F.col("x"), s.limit(0), F.col("lo"), F.col("hi")).count() == 0


def test_split_errors_of_several_features(spark):
    rng = np.random.default_rng(6)
    data = [(k, i, float(rng.normal()), float(rng.normal()), float(3 * i + rng.normal() * 20)) for k, n in (("a", 47), ("b", 7), ("c", 4), (None, 20)) for i in range(n)]
    rows = spark.createDataFrame(data, "k string, i int, u double, v double, y double").repartition(3)
    got = {r.k: (r.n, r.n_folds, r.mae) for r in features.split_errors(rows, ["k"], "i", ["i", "u", "v"], "y").collect()}
    for k in ("a", "b", "c", None):
        own = np.array([r[1:] for r in data if r[0] == k])
        n, folds = len(own), min(5, len(own) // 3) if len(own) >= 5 and len(own) // 3 >= 2 else 0
        size, errors = n // (folds + 1), []
        for f in range(folds):
            start = n - (folds - f) * size
            x = np.c_[np.ones(n), own[:, :3]]
            b = np.linalg.lstsq(x[:start], own[:start, 3], rcond=None)[0]
            errors.append(np.abs(own[start : start + size, 3] - x[start : start + size] @ b).mean())
        assert got[k][:2] == (n, folds)
        if k != "b":  # two rows can't settle four coefficients: the least norm depends on rounding
            assert got[k][2] == pytest.approx(np.mean(errors) if folds else 0.0, rel=1e-6)


def test_suggestions_are_what_scoring_every_pair_would_give(spark):
    """Nulls, blanks, repeated and tied rows, histories within and beyond a class's best, codes that are not trusted, with and without texts."""
    rng = random.Random(5)
    words = ["steel", "deck", "pipe", "wall", "paint", ""]
    pick = lambda *xs: rng.choice(xs)
    costs = [(f"c{i}", pick("Acme Inc", "acme", "Bolt", None), pick(None, " ".join(rng.choices(words, k=2))), pick("1", "2", "", None), pick("L", "S", "M", "", None)) for i in range(150)]
    budgets = [(f"b{i:02}", pick("1", "2", "3", ""), pick("L", "S", "M", ""), pick(None, " ".join(rng.choices(words, k=3))), pick(1, 2), pick(1.0, 0.9, 0.4)) for i in range(24)]
    past = [(v, p, f"b{rng.randrange(24):02}") for v in ("acme", "bolt", "") for p in ("steel deck", "pipe wall", "paint", "")]
    c = spark.createDataFrame(costs, "cost_key string, vendor string, name string, base_code string, cost_type string")
    b = spark.createDataFrame(budgets, "budget_code string, base_code string, cost_type string, description string, history_count int, trust double")
    h = spark.createDataFrame(past, "vendor string, prefix string, budget_code string")
    known = {(v, p): code for v, p, code in past if v or p}
    vendors = {"Acme Inc": "acme", "acme": "acme", "Bolt": "bolt", None: ""}

    def kinds(x, y):
        return 0.0 if not x or not y else 1.0 if x == y else mapping.TYPE_SCORES.get((x, y), 0.2)

    def best(fill, alike):
        out = set()
        for key, vendor, name, base, kind in costs:
            met = [r for r in budgets if (base and r[1] == base) or (kind and r[2] == kind)]
            if len(met) < fill:
                short = fill - len(met)
                met += [r for r in budgets[: 2 * short] if r not in met][:short]
            scored = []
            for code, bb, bt, told, n, trust in met:
                before = known.get((vendors[vendor], (name or "")[:20].strip()))
                score = ((0.4 if base and base == bb else 0.0) + kinds(kind, bt) * 0.2 + alike(name or "", told or "") * 0.3 + (0.1 if before == code else 0.0)) * trust
                scored += [(-score, -n, code)] if score >= mapping.LEAST else []
            out |= {(key, code, rank, round(-score, 9)) for rank, (score, _, code) in enumerate(sorted(scored)[:3], 1)}
        return out

    run = lambda **kw: {(r.cost_key, r.budget_code, r.rank, round(r.score, 9)) for r in mapping.suggested(c, b, h, **kw).collect()}
    assert run() == best(0, lambda x, y: 0.5)
    told = lambda x, y: fuzzy.token_set(x, y) / 100
    texts = run(alike=lambda x, y: fuzzy.token_set_ratio(x, y) / 100, fill=12)
    assert texts == best(12, told) and texts != run(fill=12)
    assert mapping.suggested(c.limit(0), b, h, fill=3).count() == 0 and mapping.suggested(c, b.limit(0), h, fill=3).count() == 0


def test_sums_of_intervals_from_running_sums(spark):
    import datetime as dt

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    points = {3: 5, 4: None, 9: -2, 12: 7}
    frame = spark.createDataFrame([*[(day(n), v) for n, v in points.items()], (None, 99)], "d date, v bigint")
    spans = [(i, a, b) for i, (a, b) in enumerate([(a, b) for a in range(0, 16) for b in range(a - 1, 18)])]
    got = ranges.sums_in_intervals(frame, "d", ["v"], spark.createDataFrame([*[(i, day(a), day(b)) for i, a, b in spans], (-1, None, day(3))], "i int, a date, b date"), F.col("a"), F.col("b"))
    inner = {i: [v for n, v in points.items() if a <= n <= b] for i, a, b in spans}
    assert {(r.i, r.v, r.n_points) for r in got.collect()} == {(i, sum(x for x in v if x is not None) if any(x is not None for x in v) else None, len(v)) for i, v in inner.items() if v}
    assert ranges.sums_in_intervals(frame.limit(0), "d", ["v"], spark.createDataFrame([(1, day(1), day(2))], "i int, a date, b date"), F.col("a"), F.col("b")).count() == 0


def test_lines_of_finished_activities_leave_their_whole_cost(spark):
    """Large costs and odd lengths: in doubles what starts add isn't what ends take away."""
    import datetime as dt

    from ledgerloom.operators import sweep

    rows = [("d", dt.date(2020, 1, 1 + i % 28), dt.date(2021, 1, 1) + dt.timedelta(days=i * 7 % 300), i % 2 == 0, i % 5, 10.0**11 + i / 4) for i in range(300)]
    frame = spark.createDataFrame(rows, "division string, start_date date, finish_date date, is_critical boolean, float_days int, expected_cost double")
    got = sweep.events(frame, F.lit("2019-06-01").cast("date")).agg(F.sum("a").cast("string").alias("a"), F.sum("b").cast("string").alias("b")).first()
    assert (float(got.a), float(got.b)) == (300 * 10**11 + sum(range(300)) / 4, 0.0)
