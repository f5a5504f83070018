"""Batches of changes against plain Python, request by request, and the project's figures where tables are empty."""

import datetime
import random

from ledgerloom.operators import changes, kpis, ledger, recon
from ledgerloom.sources import sinks
from pyspark.sql import functions as F


def rows(frame, *keys):
    return sorted((tuple(r) for r in frame.select(*keys).collect()), key=lambda t: tuple((v is None, str(v)) for v in t))


def test_amounts_one_by_one(spark):
    draw = random.Random(7)
    budgets = [(i, f"d{i % 3}", draw.randint(1, 100)) for i in range(60)]
    contract = [(f"d{k}", sum(b[2] for b in budgets if b[1] == f"d{k}") + add) for k, add in ((0, 40), (1, 10**6), (2, -5))]
    spent = [(i, draw.randint(0, 60)) for i in range(0, 60, 2)]
    requests = [(s, draw.choice([draw.randrange(60), 100 + s]), draw.choice(["d0", "d1", "d2", "none", None]), draw.choice([None, *range(1, 130, 9)])) for s in range(120)]
    requests += [(200 + s, 5, None, v) for s, v in enumerate((30, None, 70))]
    draw.shuffle(requests)
    got = changes.checked_amounts(
        spark.createDataFrame(contract, "division string, ceiling_cents long"), spark.createDataFrame([(*b, "x") for b in budgets], "budget_id long, division string, current_budget_cents long, delta string"),
        spark.createDataFrame(spent, "budget_id long, actual_cents long"), spark.createDataFrame(requests, "seq long, budget_id long, division string, new_cents long"),
    )
    last = {b: max((r for r in requests if r[1] == b), key=lambda r: r[0]) for b in {r[1] for r in requests}}
    amounts, place, ceilings, paid = {b: v for b, _, v in budgets}, {b: d for b, d, _ in budgets}, dict(contract), dict(spent)
    want = []
    for seq, b, division, new in sorted(last.values()):
        division = place.get(b, division)
        if division not in ceilings:
            problem = "no contract"
        elif new is None:
            problem = "no amount"
        elif new < paid.get(b, 0):
            problem = "below actual"
        elif sum(v for k, v in amounts.items() if place[k] == division and k != b) + new > ceilings[division]:
            problem = "over ceiling"
        else:
            problem, amounts[b], place[b] = None, new, division
        want.append((seq, b, problem))
    assert rows(got, "seq", "budget_id", "problem") == sorted(want, key=lambda t: tuple((v is None, str(v)) for v in t))
    assert {w[2] for w in want} == {None, "no contract", "no amount", "below actual", "over ceiling"}
    after = changes.with_amounts(spark.createDataFrame([(*b, "x") for b in budgets], "budget_id long, division string, current_budget_cents long, delta string"), got)
    assert {(r[0], r[1]): r[2] for r in after.select("budget_id", "division", "current_budget_cents").collect()} == {(b, place[b]): v for b, v in amounts.items()}


def test_amounts_of_empty_tables(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    got = changes.checked_amounts(empty("division string, ceiling_cents long"), empty("budget_id long, division string, current_budget_cents long"), empty("budget_id long, actual_cents long"), empty("seq long, budget_id long, division string, new_cents long"))
    assert got.count() == 0 and got.columns[-1] == "problem"


def test_orders_one_by_one(spark):
    draw = random.Random(3)
    orders = [("a", n, draw.choice(["draft", "approved", "pending"]), n) for n in range(4)]
    requests = [(s, draw.choice(["create", "update", "update", "approve", "other", None]), draw.choice(["a", "b", "gone"]), draw.randint(0, 7), draw.choice(["draft", "pending", "approved", "rejected", None]), draw.choice([None, s])) for s in range(300)]
    after, judged = changes.change_orders(spark.createDataFrame([("a",), ("b",), ("b",)], "division string"), spark.createDataFrame(orders, "division string, number int, status string, cents int"), spark.createDataFrame(requests, "seq long, kind string, division string, number int, status string, cents int"))
    book, problems = {(d, n): [s, c] for d, n, s, c in orders}, []
    for seq, kind, division, number, status, cents in requests:
        key, problem = (division, number), None
        if kind == "create":
            problem = "no contract" if division == "gone" else "exists" if key in book else None
            if not problem:
                book[key] = ["draft", cents]
        elif kind == "update":
            problem = "invalid status" if status == "rejected" else None if key in book else "not found"
            if not problem:
                book[key] = [status or book[key][0], book[key][1] if cents is None else cents]
        elif kind == "approve":
            problem = "not found" if key not in book else "already approved" if book[key][0] == "approved" else None
            if not problem:
                book[key][0] = "approved"
        else:
            problem = "unknown kind"
        problems.append((seq, problem))
    assert sorted(((r[0], r[1]) for r in judged.select("seq", "problem").collect())) == problems
    assert {(r[0], r[1]): [r[2], r[3]] for r in after.select("division", "number", "status", "cents").collect()} == book
    assert {p for _, p in problems} == {None, "no contract", "exists", "invalid status", "not found", "already approved", "unknown kind"}


def test_moves_and_deletions(spark):
    budgets = spark.createDataFrame([(1, "EAST"), (2, None), (3, "WEST")], "budget_id long, zone string")
    costs = spark.createDataFrame([("a", 1, "EAST"), ("b", None, None), ("b", None, None), ("c", 3, "WEST"), (None, 2, None)], "cost_key string, budget_id long, zone string")
    asked = spark.createDataFrame([(1, "a", 3), (2, "a", None), (3, "b", 1), (4, "c", 9), (5, "z", 1)], "seq long, cost_key string, new_id long")
    after, touched, refused = changes.moved_costs(costs, asked, budgets)
    assert rows(after, "cost_key", "budget_id", "zone") == [("a", None, None), ("b", 1, "EAST"), ("b", 1, "EAST"), ("c", 3, "WEST"), (None, 2, None)]
    assert rows(touched, "budget_id") == [(1,)]
    assert rows(refused, "seq", "cost_key", "problem") == [(4, "c", "no budget"), (5, "z", "no cost")]
    kept, held = changes.without_deleted(budgets, costs, spark.createDataFrame([(2,), (3,), (3,), (9,), (1,)], "budget_id long"))
    assert rows(kept, "budget_id") == [(1,), (2,), (3,)] and rows(held, "budget_id", "n_costs") == [(1, 1), (2, 1), (3, 1)]
    kept, held = changes.without_deleted(budgets, after, spark.createDataFrame([(2,), (3,)], "budget_id long"))
    assert rows(kept, "budget_id") == [(1,), (2,), (3,)]
    kept, held = changes.without_deleted(budgets, after.where("cost_key = 'b'"), spark.createDataFrame([(2,), (1,)], "budget_id long"))
    assert rows(kept, "budget_id") == [(1,), (3,)] and rows(held, "budget_id", "n_costs") == [(1, 2)]


def test_feedback_of_the_past(spark):
    day = datetime.date
    past = spark.createDataFrame([("v", "p", "x", 0.4, day(2024, 1, 2)), ("v", "p", "x", 0.9, day(2024, 1, 1)), ("v", None, "x", 0.1, None), ("", None, "x", 0.2, None), ("v", "p", None, 0.3, None), ("w", "p", "y", None, None)], "vendor string, prefix string, budget_code string, confidence double, created_at date")
    known = spark.createDataFrame([("v", None, "x")], "vendor string, prefix string, budget_code string")
    got = changes.backfilled(past, known, F.lit("2024-06-01").cast("date"))
    assert rows(got, "vendor", "prefix", "budget_code", "confidence", "created_at") == [("v", "p", "x", 0.9, day(2024, 1, 1)), ("v", "p", None, 0.3, day(2024, 6, 1)), ("w", "p", "y", None, day(2024, 6, 1))]
    stats = changes.match_stats(past, spark.createDataFrame([("x", 1, 3, 0.5), ("old", 4, 1, 0.7)], "budget_code string, total_matches long, override_count int, trust_score double"))
    assert rows(stats, *stats.columns) == [("old", 4, 1, 0.7), ("x", 4, 3, 0.5), ("y", 1, 0, 1.0)]


def test_progress_and_bridge(spark):
    after = changes.progressed(spark.createDataFrame([(1, 20), (2, None), (3, 5)], "activity_id long, pct_complete int"), spark.createDataFrame([(1, 1, 130), (2, 1, None), (3, 3, -4), (4, 9, 5)], "seq long, activity_id long, pct int"))
    assert rows(after, "activity_id", "pct_complete", "progress_pct", "is_complete", "is_in_progress") == [(1, 100, 1.0, True, False), (2, 0, 0.0, False, False), (3, 0, 0.0, False, False)]
    bridge = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5)], "activity_id long, division string, weight double")
    asked = spark.createDataFrame([(1, "add", 1, "a", 0.3), (2, "remove", 1, "a", None), (3, "add", 2, "a", None), (4, "remove", 2, "b", None)], "seq long, kind string, activity_id long, division string, weight double")
    assert rows(changes.bridged(bridge, asked), "activity_id", "division", "weight") == [(1, "b", 0.5), (2, "a", 1.0)]


def test_figures_without_tables(spark):
    contract = lambda r: spark.createDataFrame(r, "ceiling_cents long")
    costs = lambda r: spark.createDataFrame(r, "amount_cents long")
    shots = lambda r: spark.createDataFrame(r, "is_current boolean, etc_cents long, ev_cents long")
    plan = lambda r: spark.createDataFrame(r, "planned_finish date, finish_date date, progress double, weight double")
    one = kpis.dashboard(contract([]), costs([]), shots([]), plan([])).collect()
    assert [tuple(r) for r in one] == [(0, 0, 0, 0, None, 0.0, None, None, "no contract,no forecast,no schedule")]
    day = datetime.date
    dates = [(day(2024, 1, 10), day(2024, 1, 11), 0.5, 1.0), (day(2024, 1, 10), day(2024, 1, 12), 0.25, 3.0), (None, day(2024, 1, 1), 0.0, 0.0)]
    one = kpis.dashboard(contract([(1000,)]), costs([(200,), (None,)]), shots([(False, 9, 900), (True, 50, None)]), plan(dates)).collect()[0]
    assert tuple(one) == (1000, 200, 50, 250, 750, 80.0, round(int(1000 * 0.3125) / 200, 3), -2, "")


def test_sides_that_do_not_tie(spark):
    costs = spark.createDataFrame([("a", 10, 5, 5), ("a", 11, 5, 5), ("b", 10, 9, 9), (None, 4, None, 4)], "division string, amount_cents long, e long, w long")
    got = recon.row_tie_out(costs, costs.groupBy("division").agg(F.sum("amount_cents").alias("actual_cents")).where("division is not null"), "e", "w")
    assert [tuple(r) for r in got.collect()] == [(4, 1, 9, 1, False)]


def test_last_row_wins(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, w string")
    new = spark.createDataFrame([("a", 9, "z", 1), ("a", 3, None, 2), ("b", 2, "y", 1), ("c", None, "n", 1)], "k string, v int, w string, at int")
    merged, audit = sinks.upserted(old, new, ["k"], "at")
    assert rows(merged, "k", "v", "w") == [("a", 3, None), ("b", 2, "y"), ("c", None, "n")]
    assert rows(audit, "k", "old_value", "new_value") == [("a", '{"v":1,"w":"x"}', '{"v":3}'), ("c", None, '{"w":"n"}')]


def test_sides_by_tuple(spark):
    costs = spark.createDataFrame([("a", "x", 1), ("a", None, 2), (None, None, 3), ("b", "x", 4), ("b", "x", 4)], "cost_code string, name string, n int")
    maps = spark.createDataFrame([("a", "x", "EAST"), ("a", "x", "BOTH"), ("a", None, "BOTH"), ("b", "x", "WEST")], "cost_code string, name string, side string")
    keys = ["cost_code", "name"]
    kept = lambda side, **more: sorted(r["n"] for r in ledger.on_side(costs, maps, side, keys, **more).collect())
    assert [kept("EAST"), kept("EAST", include_both=False), kept("WEST"), kept("BOTH"), kept(None), kept("NORTH", include_both=False)] == [[1, 2], [1], [1, 2, 4, 4], [1, 2], [1, 2, 3, 4, 4], [1, 2, 3, 4, 4]]
    assert [r["n"] for r in ledger.off_side(costs, maps, keys).collect()] == [3]
    assert ledger.on_side(costs.limit(0), maps.limit(0), "EAST", keys).count() == 0
