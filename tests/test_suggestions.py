"""Suggestions on large tables: what reaches the driver, how often costs are read, and what callers may have worked out before."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import fuzzy, mapping
from ledgerloom.plans import registry
from ledgerloom.sources import tables


@pytest.mark.parametrize("name", ["suggestions_with_text", "suggestions_with_history"])
def test_parts_are_not_broadcast(spark, sf, name):
    """Parts repeat their names, so that a small file holds many of them: 1.2 million of them, broadcast five times at once, were too many for the driver."""
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [l_partkey" in line]
    assert joins and all("ShuffledHashJoin" in line for line in joins), joins


@pytest.mark.parametrize("name", ["suggestions_with_text", "suggestions_with_history"])
def test_costs_do_not_bring_what_suppliers_can(spark, sf, name):
    """Line items meet parts for the choices known and for the result only; vendors are normalised before they are joined."""
    query = registry.queries()[name](spark, sf)._jdf.queryExecution()
    joins = [line for line in query.optimizedPlan().toString().splitlines() if "Join LeftOuter, (l_partkey" in line]
    assert len(joins) <= 4, joins  # the choices known stand in the plan three times and run once
    normal = [line for line in query.optimizedPlan().toString().splitlines() if "incorporated" in line]
    assert normal and all("s_name" in line and "l_orderkey" not in line for line in normal)


def test_kinds_and_vendor_keys_change_nothing(spark):
    """Kinds beyond those of the costs, vendors normalised by the caller, nulls and blanks, histories of other vendors with the same name."""
    rng = random.Random(8)
    pick = lambda *xs: rng.choice(xs)
    costs = spark.createDataFrame(
        [(f"c{i}", pick("Acme Inc", "acme", "Bolt", None), pick("steel deck", "pipe", "", None), pick("1", "2", "", None), pick("L", "S", "", None)) for i in range(120)],
        "cost_key string, vendor string, name string, base_code string, cost_type string",
    )
    budgets = spark.createDataFrame([(f"b{i:02}", pick("1", "2", "3"), pick("L", "S", "M"), pick("deck of steel", "pipes", None), pick(1, 2)) for i in range(20)], "budget_code string, base_code string, cost_type string, description string, history_count int")
    told = [(v, p, f"b{rng.randrange(20):02}", pick(True, False), rng.randrange(9)) for v in ("Acme Inc", "Bolt", "other", None) for p in ("steel deck", "pipe", "", None) for _ in range(3)]
    told = spark.createDataFrame(told, "vendor string, name string, budget_code string, was_override boolean, created_at int")
    keyed = lambda f: f.withColumn("vendor_key", F.when(F.col("vendor").isNotNull(), text.vendor(F.col("vendor")))).drop("vendor")
    kinds = costs.select("name", "base_code", "cost_type").distinct().unionByName(spark.createDataFrame([("pipe", "3", "M"), ("unseen", "1", "L")], "name string, base_code string, cost_type string"))
    rows = lambda f: sorted(map(tuple, f.collect()))
    assert rows(mapping.history(keyed(told))) == rows(mapping.history(told))
    for more in ({}, {"alike": lambda x, y: fuzzy.token_set_ratio(x, y) / 100, "fill": 8}):
        want = rows(mapping.suggested(costs, budgets, mapping.history(told), **more))
        assert want and rows(mapping.suggested(keyed(costs), budgets, mapping.history(keyed(told)), kinds=kinds, **more)) == want


def test_vendors_are_no_larger_than_suppliers(spark, sf):
    """Spark takes a join to be as large as the product of its sides, and so shuffled all costs by supplier."""
    plan = tables.vendors(spark, sf)._jdf.queryExecution().optimizedPlan()
    assert "LeftSemi" in plan.toString() and int(str(plan.stats().sizeInBytes())) < 10_000
