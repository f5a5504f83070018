import itertools

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import classify, dates, money, text
from ledgerloom.operators import forecast, fuzzy, mapping


def values(spark, inputs, expression, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(expression(F.col("v")).alias("x")).collect()]


def test_money(spark):
    """Amounts written in every accepted form read back as the cents they were made from."""
    cents = [0, 7, 45, 999, 8_120, 32_050, 4_444_401, 987_650_013]
    written = {}
    for c in cents:
        plain = f"{c // 100}.{c % 100:02}"
        grouped = f"{c // 100:,}.{c % 100:02}"
        written |= {plain: c, f"${grouped}": c, f"  {grouped} ": c}
        if c:
            written |= {f"-{plain}": -c, f"-${grouped}": -c, f"(${grouped})": -c}
    written |= {None: 0, "": 0, "-": 0, " - ": 0, "12.345": 1235, "12.344": 1234, "n/a": 0}
    assert values(spark, written, money.parse_money) == list(written.values())
    assert values(spark, [3.015, 2.5], money.parse_money, "double") == [302, 250]
    assert values(spark, [250, 8_765_432, -99, 0], money.display, "bigint") == ["$2.50", "$87,654.32", "-$0.99", "$0.00"]


def test_two_way_split(spark):
    cases = [(t, e, w) for t, e, w in itertools.product([0, 1, 99, 101, 10000, 5000, -101, -7], [0, 1, 3, 7], [0, 1, 2, 5])]
    rows = spark.createDataFrame(cases, "t bigint, e bigint, w bigint").select("t", "e", "w", money.east_of(F.col("t"), F.col("e"), F.col("w")).alias("x")).collect()
    for r in rows:
        exact = r.t / 2 if r.e + r.w == 0 else r.t * r.e / (r.e + r.w)
        assert abs(r.x - exact) < 1 or r.x == exact
    odd = {(r.t, r.e, r.w): r.x for r in rows}
    assert (odd[101, 1, 1], odd[10000, 1, 1], odd[5000, 1, 0], odd[5000, 0, 1], odd[101, 0, 0]) == (51, 5000, 5000, 0, 51)


def test_largest_remainder_sums(spark):
    rows = spark.createDataFrame([(g, t, w, str(i)) for g, t in (("a", 100), ("b", -101), ("c", 7)) for i, w in enumerate([3, 3, 1] if g != "c" else [0, 0])], "g string, t bigint, w bigint, o string")
    got = money.largest_remainder(rows, ["g"], "t", "w", "o").groupBy("g", "t").agg(F.sum("part").alias("s")).collect()
    assert all(r.t == r.s for r in got) and len(got) == 3


def test_text(spark):
    assert values(spark, ["7-300-015", "7-300", "9", "31-002-777", "", None], text.base_code) == ["7-300", "7-300", "9", "31-002", "", ""]
    vendors = {f"{name} {suffix}": name.lower() for name, suffix in zip(["Quarry", "Fjord", "Larch"], ["Corp", "LLC", "Inc"], strict=True)} | {"  Wide   Gap  Inc ": "wide gap", None: ""}
    assert values(spark, vendors, text.vendor) == list(vendors.values())
    assert values(spark, ["Gravel and sand for the north yard", "Tiny"], text.name_prefix) == ["gravel and sand for ", "tiny"] or values(spark, ["Gravel and sand for the north yard"], text.name_prefix) == ["gravel and sand for"]
    kinds = {"L - Crew": "L", "M - Gravel": "M", "": ""}
    assert values(spark, kinds, text.cost_type) == list(kinds.values())
    assert values(spark, [" Wet;  Paint? ", "Beam [W12 X 26]"], text.words) == ["wet paint", "beam w12 x 26"]
    assert values(spark, [None, " ", "Q "], lambda c: text.composite_key(c, c)) == ["<NULL>|<NULL>", "<EMPTY>|<EMPTY>", "q|q"]


def test_dates(spark):
    assert [str(d) for d in values(spark, ["01-May-24 A", "2024-05-01", "05/01/2024", "bad", None], dates.parse)] == ["2024-05-01"] * 3 + ["None"] * 2
    assert values(spark, ["01-May-24 A", "01-May-24", None], dates.is_actual) == [True, False, False]
    assert values(spark, ["2024-12-30"], lambda c: dates.iso_label(c.cast("date"))) == ["2025-W01"]
    assert values(spark, ["0.5", "45%", "1", "250", None, "x"], dates.percent) == [50, 45, 100, 100, 0, 0]
    assert values(spark, ["5d", "5 days", "", None, "-3"], dates.days) == [5, 5, None, None, -3]


def test_classification(spark):
    trades = {"Excavation": "Low Voltage", "FTG pour": "Concrete", "Erect steel": "Structural Steel", "Roof drain": "Plumbing & H.V.A.C", "Something": "General Requirements", None: "General Requirements"}
    assert values(spark, trades, lambda c: classify.trade(c)["trade"]) == list(trades.values())
    assert values(spark, ["FTG Layout N", "North wall", "2nd fl slab", None], classify.zone) == ["SHARED", "EAST", "WEST", "SHARED"]
    assert values(spark, ["Tree removal", "Main roof", "Paint"], lambda c: classify.phase(c, F.lit(""))) == ["SITE_PREP", "ENVELOPE", "FINISHES"]
    assert values(spark, [0.0, 0.5, 1.0], lambda c: classify.curve_value(F.lit("concentrated"), c), "double") == [0.0, 1.5, 0.0]


def test_similarity():
    assert fuzzy.similarity("abcd", "abce") == 75 and fuzzy.similarity("a", "a") == 100 and fuzzy.similarity("", "a") == 0
    assert fuzzy.token_sort("b a", "a b") == 100 and fuzzy.token_set("a b", "a b c") == 100 and fuzzy.token_set("", "a") == 0


def test_type_scores(spark):
    pairs = {("L", "L"): 1.0, ("M", "M"): 1.0, ("L", "S"): 0.5, ("S", "L"): 0.5, ("M", "S"): 0.4, ("L", "M"): 0.2, ("", "L"): 0.0}
    rows = spark.createDataFrame([(*k, v) for k, v in pairs.items()], "a string, b string, v double").withColumn("x", mapping.type_score(F.col("a"), F.col("b"))).collect()
    assert all(r.x == r.v for r in rows)


@pytest.mark.parametrize("method", ["linear", "front_loaded", "back_loaded", "s_curve"])
@pytest.mark.parametrize("etc", [0, 7, 100003])
def test_spread_keeps_the_sum(spark, method, etc):
    plans = spark.createDataFrame([("a", etc)], "d string, etc_cents bigint")
    costs = spark.createDataFrame([("a", "2024-01-03", 50)], "d string, date string, amount_cents bigint").withColumn("date", F.col("date").cast("date"))
    rows = forecast.period_forecast(costs, plans, "d", "2024-01-01", "2024-04-30", "2024-01-17", "week", method)
    r = rows.agg(F.sum("forecast_cents").alias("f"), F.sum("actual_cents").alias("a"), F.max("cumulative_cents").alias("c"), F.min("forecast_cents").alias("m")).first()
    assert (r.f, r.a, r.c) == (etc, 50, etc + 50) and r.m >= 0


def test_methods(spark):
    row = spark.range(1).select(
        forecast.earned_value(F.lit(1000), F.lit(0), F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(1.0)).alias("a"),
        forecast.earned_value(F.lit(1000), F.lit(500), F.lit(600), F.lit(None).cast("double"), F.lit(1.0)).alias("b"),
        forecast.three_point(F.lit(300), F.lit(100), F.lit(200), F.lit(50)).alias("c"), forecast.parametric(F.lit(10.0), F.lit(100), F.lit(1.15), F.lit(50), F.lit(2000)).alias("d"),
    ).first()
    assert (row.a.eac, row.a.etc, row.a.score) == (1000, 1000, 0.5)
    assert (row.b.eac, row.b.cpi, row.b.band) == (833, 1.2, "medium")
    assert (row.c.eac, row.c.sd) == (200, 33) and (row.d.eac, row.d.label) == (1150, "High")
