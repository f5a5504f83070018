"""Streams with late rows, restarts and replays; safe loads; mixtures; settings; the SQL surface."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import mixtures
from ledgerloom.operators import trees
from ledgerloom.plans import surface
from ledgerloom.plans.registry import queries
from ledgerloom.sources import scans
from ledgerloom.streaming import feeds, recalc, trust

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def feed(spark, folder, name, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def at(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_trust_over_a_stream_equals_the_batch(spark, rocks, tmp_path):
    """Three runs of the query from one checkpoint: rows out of order within the delay join their runs, one of them two runs; a row that is too late is dropped;
    the state holds nothing of users who stay away."""
    source, rng = str(tmp_path / "in"), np.random.default_rng(1)
    one = [(i, at(int(rng.integers(0, 12)), int(rng.integers(0, 24))), int(rng.integers(1, 6)), ["click", "view"][i % 2], 0.0) for i in range(80)] + [(80, at(11), 9, "click", 0.0)]
    two = [(100, at(10, 12), 9, "view", 0.0), (101, at(14), 9, "click", 0.0), (102, at(12, 12), 9, "click", 0.0), (103, at(20), 1, "view", 0.0), (104, None, 1, "view", 0.0), (105, at(20), None, "view", 0.0)]
    late = [(200, at(2), 1, "click", 0.0)]
    three = [(201, at(19), 2, "click", 0.0), (202, at(60), 7, "click", 0.0)]
    last = [(300, at(61), 7, "click", 0.0)]

    def run():
        stream = feeds.stream(spark, source, files_per_trigger=1)
        feeds.collected(trust.trusted(stream, ["click"], days=2), str(tmp_path / "c"), str(tmp_path / "o")).awaitTermination()

    for name, rows in (("a.parquet", one), ("b.parquet", two), ("c.parquet", late + three), ("d.parquet", last)):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "made" / name))
        part = next((tmp_path / "made" / name).glob("part-*"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / name)
        run()
    batch = spark.createDataFrame(one + two + three + last, EVENTS)
    want = sorted(map(tuple, trust.trusted(batch, ["click"], days=2).where(F.col("last") < F.lit(at(55))).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "o")).collect())) == want and len(want) > 8


def test_replayed_batches_write_once(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    amounts = {1: 100, 2: 300, 3: 900}

    def snapshot(keys):
        return keys.withColumn("eac", F.create_map(*[F.lit(x) for kv in amounts.items() for x in kv])[F.col("user_id").cast("int")])

    spread = lambda s: s.select("user_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("month"), F.expr("eac div 3").alias("cents"))
    run = recalc.on_batch("user_id", snapshot, spread, folder)
    for k, users in enumerate([(1, 2), (2, 3), (None,)]):
        spark.createDataFrame([(k * 10 + i, at(k), u, "click", 0.0) for i, u in enumerate(users)], EVENTS).coalesce(1).write.parquet(str(tmp_path / "made" / str(k)))
        next((tmp_path / "made" / str(k)).glob("part-*")).rename(tmp_path / "in" / f"{k}.parquet")
        recalc.follow(feeds.stream(spark, source), str(tmp_path / "c"), run).awaitTermination()
        amounts[2] += 30
    seen = lambda: (sorted(map(tuple, recalc.snapshots(spark, folder + "/snapshots", "user_id").collect())), sorted(map(tuple, recalc.periods(spark, folder + "/periods", "user_id").collect())))
    want = [(1, 100, 0, True), (2, 300, 0, False), (2, 330, 1, True), (3, 900, 1, True)]
    assert seen()[0] == want and [r for r in seen()[1] if r[0] == 2] == [(2, m, 110, 1) for m in (1, 2, 3)]
    before, amounts[2] = seen(), 330
    for _ in range(2):  # the same batch again, as after a failure between the write and the commit
        run(spark.createDataFrame([(1, at(1), 2, "x", 0.0), (2, at(1), 3, "x", 0.0)], EVENTS), 1)
    assert seen() == before


def test_late_rows_leave_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    query = lambda: feeds.collected(feeds.weekly(feeds.stream(spark, str(tmp_path / "in"), files_per_trigger=1)), str(tmp_path / "c"), str(tmp_path / "o"))
    for name, rows in (("a", [(1, at(0), 1, "x", 1.0), (2, at(10), 1, "x", 1.0)]), ("b", [(3, at(9), 1, "x", 5.0), (4, at(1), 1, "x", 7.0)]), ("c", [(5, at(40), 1, "x", 1.0)]), ("d", [(6, at(41), 1, "x", 1.0)])):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "made" / name))
        next((tmp_path / "made" / name).glob("part-*")).rename(tmp_path / "in" / f"{name}.parquet")
        query().awaitTermination()
    got = {str(r.week): (r.n, r.cents) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {"2024-01-01": (1, 100), "2024-01-08": (2, 600)}  # the row of day 9 is within the delay, that of day 1 isn't


def test_safe_scan(spark, tmp_path):
    text = '﻿Code,Vendor,Amount\n1-100,"Amber, Ltd","$1,200.50"\n,nobody,5\n1-200,North,abc\n1-300,South,(3.00),extra\n1-400,West,-\n1-500,East,$0.00\n1-600\n'
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    columns = ["Code", "Vendor", "Amount", "Zone"]
    rows, seen = scans.scanned(spark, str(tmp_path / "a.csv"), columns, "Code", ["Amount"])
    got = {r.Code: (r.Vendor, r.Amount_cents, r.Zone) for r in rows.collect()}
    assert got == {"1-100": ("Amber, Ltd", 120050, None), "1-200": ("North", 0, None), "1-400": ("West", 0, None), "1-500": ("East", 0, None)}
    assert seen.get == {"total": 7, "corrupt": 2, "blank": 1, "bad_money": 1, "valid": 4}
    told = scans.warnings_of(seen.get, scans.missing(spark, str(tmp_path / "a.csv"), columns))
    assert told == ["column Zone is missing", "2 broken rows left out", "1 blank rows skipped", "1 amounts not understood"]


def test_mixture_draws(spark):
    parts = ([0.3, 0.5, 0.2], [-5.0, 0.0, 40.0], [1.0, 0.5, 3.0])
    w, m, s = (F.array(*map(F.lit, p)) for p in parts)
    rows = spark.range(4).withColumn("d", mixtures.draws(F.col("id"), w, m, s, 4000))
    one = rows.select("id", "d", *[mixtures.percentile(F.col("d"), q).alias(f"q{k}") for k, q in enumerate((0.1, 0.5, 0.9))], mixtures.variance(w, m, s).alias("v"), mixtures.mode(w, m).alias("mode"))
    got = {r.id: r for r in one.repartition(1).collect()}
    again = {r.id: r for r in one.repartition(4).collect()}
    assert all(list(got[k].d) == list(again[k].d) for k in got) and list(got[0].d) != list(got[1].d)
    values = np.array([r.d for r in got.values()])
    p, mu, sd = map(np.array, parts)
    assert abs(values.mean() - (p * mu).sum()) < 0.5 and got[0].v == pytest.approx((p * (sd**2 + mu**2)).sum() - (p * mu).sum() ** 2) and values.var() == pytest.approx(got[0].v, rel=0.05) and got[0].mode == 0.0
    assert [[got[k].q0, got[k].q1, got[k].q2] for k in got] == [pytest.approx(np.quantile(got[k].d, (0.1, 0.5, 0.9)).tolist()) for k in got]
    loss = spark.createDataFrame([(3.0, 1.0), (1.0, 3.0)], "y double, f double").select(mixtures.pinball(F.col("y"), F.col("f"), 0.9).alias("l")).collect()
    assert [r.l for r in loss] == pytest.approx([1.8, 0.2])


def test_settings_flatten(spark):
    def flat(d, at=""):
        return {k: v for key, x in d.items() for k, v in (flat(x, f"{at}{key}.") if isinstance(x, dict) else {at + key: x}).items()}

    texts = [{"a": {"b": {"c": 1}, "d": [1, {"e": 2}]}, "f": "x", "g": None, "h": {}, "i": True}, {}, {"z": {"y": 0.5}}]
    rows = spark.createDataFrame([(k, json.dumps(t)) for k, t in enumerate(texts)] + [(9, None), (10, "no json"), (11, "[1]")], "k int, t string")
    shown = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"))
    want = sorted((k, p, shown(v)) for k, t in enumerate(texts) for p, v in flat(t).items())
    assert sorted(map(tuple, trees.flattened(rows, "k", "t").collect())) == want


def test_sql_surface(spark, sf):
    names = surface.register(spark, sf)
    assert {"costs", "division_actuals"} <= set(names)
    rows = lambda f: sorted(map(str, map(tuple, f.collect())))
    direct = queries()["recon_actuals_by_division"](spark, sf).select("division", "actual_cents", "n_costs")
    assert rows(spark.sql("SELECT * FROM division_actuals(DATE '2000-01-01')")) == rows(direct)
    costs = spark.table("costs")
    assert rows(spark.sql("SELECT * FROM actuals_between(DATE '1996-01-01', DATE '1996-12-31')")) == rows(costs.where("year(date) = 1996").groupBy("division").agg(F.sum("amount_cents")))
    assert rows(spark.sql("SELECT vendor FROM vendor_totals('EAST')")) == rows(costs.where("zone IN ('EAST', 'SHARED')").select("vendor").distinct())
    assert rows(spark.sql("SELECT cost_key FROM budget_costs(7)")) == rows(costs.where("l_partkey = 7").select("cost_key"))
    assert rows(spark.sql("SELECT division, n FROM active_activities(DATE '1996-06-15')")) == rows(spark.table("activities").where("DATE '1996-06-15' BETWEEN start_date AND finish_date").groupBy("division").count())
    assert spark.sql("SELECT * FROM code_search('7') LIMIT 3").count() == 3
    plan = spark.sql("SELECT * FROM actuals_between(DATE '1996-01-01', DATE '1996-12-31')")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual" in plan or "l_shipdate" in plan
