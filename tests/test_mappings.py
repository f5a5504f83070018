"""Fuzzy steps of the mappings and numbered rows against plain Python, with rows in every branch."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import fuzzy, ledger, listings, mapping, phases

WORDS = ["steel", "deck", "pipe", "wall", "paint", "roofing", "glass", "concrete"]


def test_costs_take_the_most_alike_budget_of_their_code(spark):
    rng = random.Random(11)
    some = lambda n: " ".join(rng.choices(WORDS, k=n))
    costs = [(f"k{i}", rng.choice(["1", "2", "3", "9"]), rng.choice([None, "", some(2), some(3), some(4)]), rng.choice(["L", "M", "X", None])) for i in range(200)] + [("both", "2", "wall  steel", "X")]
    budgets = [(i, rng.choice(["1", "2"]), rng.choice(["L", "S"]), rng.choice([None, some(2), some(3)])) for i in range(30)] + [(77, "3", "S", "one only"), (78, "2", "S", "steel wall"), (79, "2", "S", "wall steel")]
    saved = [("1", next(name for _, code, name, _ in costs if code == "1" and name), 5)]
    got = mapping.mapped_costs(
        spark.createDataFrame(costs, "cost_key string, cost_code string, name string, cost_type string"), spark.createDataFrame(saved, "cost_code string, name string, budget_id bigint"),
        spark.createDataFrame(budgets, "budget_id bigint, budget_code string, cost_type string, description string"),
    )
    want = set()
    for key, code, name, kind in costs:
        mine = [b for b in budgets if b[1] == code]
        typed = [b[0] for b in mine if kind is not None and b[2] == kind]
        like = max(((fuzzy.token_sort(name, d), -b) for b, _, _, d in mine if name and d), default=(0.0, 0))
        if name is not None and (code, name) == saved[0][:2]:
            want.add((key, 5, "saved", 1.0))
        elif len(mine) == 1:
            want.add((key, mine[0][0], "single", 0.9))
        elif typed:
            want.add((key, min(typed), "type", 0.85))
        elif mine and like[0] >= 60:
            want.add((key, -like[1], "fuzzy", round(like[0] / 100, 9)))
        else:
            want.add((key, min(b[0] for b in mine), "first", 0.5) if mine else (key, None, "none", 0.0))
    assert {(r.cost_key, r.budget_id, r.method, round(r.confidence, 9)) for r in got.collect()} == want
    assert {w[2] for w in want} == {"saved", "single", "type", "fuzzy", "first", "none"} and any(0.6 <= w[3] < 1 for w in want if w[2] == "fuzzy")
    assert got.where("cost_key = 'both'").first().budget_id == 78  # of equal ones the first


def test_budgets_take_divisions_by_sorted_tokens(spark):
    divisions = [("Structural Steel", 0), ("Metal Deck", 1), ("Deck Metal", 2)]
    budgets = [(1, "a", "steel structure", None), (2, "b", "metal deck", "9 - Structural Steel"), (3, "c", "Metal Decks", None), (4, "d", "Structural Steel and much else of every kind", None), (5, "e", "nothing", "05 - Structural Steels"), (6, "f", None, "Structural"), (7, "g", "Deck Metal", None)]
    empty = lambda schema: spark.createDataFrame([], schema)
    frame = spark.createDataFrame([(i, c, d, t, "x") for i, c, d, t in budgets], "budget_id int, budget_code string, description string, tier2 string, division_key string")
    got = ledger.budget_divisions(frame, empty("budget_code string, division string, confidence double"), empty("division_key string, division string"), spark.createDataFrame(divisions, "division string, place int"))
    want = set()
    for i, _, told, tier in budgets:
        steps = [("fuzzy_description", told, 60), ("fuzzy_tier", tier.split(" - ", 1)[-1] if tier else None, 80)]
        found = (i, None, 0.0, "unmapped")
        for method, asked, least in steps:
            best = max(((fuzzy.token_sort(asked, d), -p, d) for d, p in divisions), default=None) if asked is not None else None
            if best and best[0] >= least:
                found = (i, best[2], round(best[0] / 100, 9), method)
                break
        want.add(found)
    assert {(r.budget_id, r.division, round(r.confidence, 9), r.method) for r in got.collect()} == want
    assert any(0.6 <= c < 0.99 for _, _, c, m in want if m == "fuzzy_description") and {m for *_, m in want} == {"fuzzy_description", "fuzzy_tier", "unmapped"}
    assert next(d for i, d, *_ in want if i == 7) == "Metal Deck"  # both hold the same tokens: the first


def test_activities_take_divisions_by_rules_then_likeness(spark):
    divisions = spark.createDataFrame([("Structural Steel", 0), ("Concrete Division", 1), ("Masonry & Stone", 2), ("Plumbing work", 3)], "division string, place int")
    prefixes, keywords = {"ST": "structural steel", "CO": "Concrete", "XX": "not listed"}, {"brick": "masonry", "pour": "concrete", "tile": "not listed", "beam": "Structural Steel"}
    rows = [("st-1", "Pour"), ("CO-7", None), ("XX1", "Brick wall"), ("A1", "Pour slab"), ("A2", "tile and beam"), ("A3", "plumbing rough"), ("A4", "tile"), (None, "Plumbing"), (None, None), ("A4", "tile"), ("", "masonry stone")]
    got = {(r.activity_id, r.name): (r.division, r.source, r.confidence) for r in phases.activity_matches(spark.createDataFrame(rows, "activity_id string, name string"), divisions, prefixes, keywords).collect()}
    assert len(got) == 10
    like = lambda a, b: round(fuzzy.token_set(a, b) / 100, 6)
    assert got == {
        ("st-1", "Pour"): ("Structural Steel", "prefix_match", 0.95), ("CO-7", None): ("Concrete Division", "prefix_match", 0.9), ("XX1", "Brick wall"): ("Masonry & Stone", "keyword_match", 0.75),
        ("A1", "Pour slab"): ("Concrete Division", "keyword_match", 0.75), ("A2", "tile and beam"): ("Structural Steel", "keyword_match", 0.8), ("A3", "plumbing rough"): ("Plumbing work", "fuzzy_match", like("a3 plumbing rough", "plumbing")),
        ("A4", "tile"): (None, "none", 0.0), (None, "Plumbing"): ("Plumbing work", "fuzzy_match", 1.0), (None, None): (None, "none", 0.0), ("", "masonry stone"): ("Masonry & Stone", "fuzzy_match", 1.0),
    }


def test_too_many_choices_are_an_error(spark):
    rows = spark.range(5).select(F.col("id").cast("string").alias("t"), "id")
    assert fuzzy.listed(rows, ["t", "id"], 5).select(F.size("_l")).first()[0] == 5
    with pytest.raises(Exception, match="more than 4 choices"):
        fuzzy.listed(rows, ["t", "id"], 4).collect()


def test_rows_are_numbered_by_position(spark):
    rng = random.Random(3)
    rows = [(rng.choice([7, 7, 7, rng.randrange(-50, 50), rng.randrange(10**12)]), f"r{i:04}") for i in range(900)]
    frame = spark.createDataFrame(rows, "k bigint, key string").repartition(5)
    got = {r.key: r.row_id for r in listings.numbered(frame, "k", ["key"], ranges=16).collect()}
    assert got == {key: i for i, (_, key) in enumerate(sorted(rows))}
    assert listings.numbered(frame.limit(0), "k", ["key"]).count() == 0
    assert [r.row_id for r in listings.numbered(frame.limit(1), "k", ["key"]).collect()] == [0]


def test_newest_entries_and_trades_of_one_key(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 5, 3), ("b", 1, 4)], "k string, t int, id int")
    assert [(r.k, r.id) for r in listings.newest(rows, ["k"], ["t", "id"], 2).orderBy("k", "place").collect()] == [("a", 3), ("a", 2), ("b", 4)]
    assert listings.newest(rows, ["k"], ["t", "id"], 0).count() == 2  # at least one of each
    trades = spark.createDataFrame([("Carpentry, Drywall",), ("Roof",), (None,)], "trade string")
    budgets = spark.createDataFrame([("carpentry drywall", 5), ("Carpentry Drywall", 6), ("Roof", 7)], "division string, current_budget_cents bigint")
    got = lambda n: {r.trade: r.budget_cents for r in listings.trade_budgets(trades, budgets, n).collect()}
    assert got(False) == {"Carpentry, Drywall": 0, "Roof": 7, None: 0} and got(True) == {"Carpentry, Drywall": 11, "Roof": 7, None: 0}


def test_likeness_of_long_and_odd_texts(spark):
    """Texts beyond one word of bits, with repeated tokens, blanks of all kinds and characters outside the first plane."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcé😀") for _ in range(draw.randint(1, 9)))
    text = lambda: draw.choice([" ", "  ", "\t", "\u2003", "\n"]).join(word() for _ in range(draw.choice([1, 2, 9, 40])))
    texts, choices = [text() for _ in range(40)] + [" ", "", None, "a" * 62, "a" * 63, "b" * 124], [text() for _ in range(40)] + [" ", None, "a" * 62, "ab" * 62]
    got = fuzzy.best_within(spark.createDataFrame([("k", t) for t in texts], "k string, t string"), ["k"], "t", spark.createDataFrame([("k", c, i) for i, c in enumerate(choices)], "k string, c string, i long"), "c", "i", 0.0)
    want = {t: max((fuzzy.token_sort(t, c), -i) for i, c in enumerate(choices) if c) for t in texts if t}
    assert {r["t"]: (r["score"], -r["i"]) for r in got.collect()} == want
