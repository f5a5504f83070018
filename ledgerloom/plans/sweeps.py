"""The schedule-driven feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import phases, schedule, sweep
from ..sources import tables
from .base import registered
from .costs import WITH
from .phases import NAMES

query, QUERIES, ORACLE_SQL = registered()
ROUNDED = ("project_pct_complete", "phase_pct_complete", "avg_float", "trade_expected_pct_complete", "trade_actual_pct_spent")
CENTS = ("trade_expected_cost", "trade_schedule_variance", "trade_cost_velocity", "trade_forecast_at_completion", "trade_budget_variance")


@query(f"""{WITH}g AS (SELECT division, CAST(sum(current_budget_cents) AS BIGINT) AS budget FROM budgets GROUP BY division),
t AS (SELECT a.*, {NAMES}[CAST(1 + activity_id % 9 AS INTEGER)] AS phase, CAST(1 + activity_id % 9 AS INTEGER) AS place, activity_id % 21 AS f, budget * (duration_days / nullif(sum(duration_days) OVER (PARTITION BY division), 0)::DOUBLE) AS e
  FROM activities a JOIN g USING (division)),
m AS (SELECT division, date_trunc('month', date)::DATE AS month, CAST(sum(amount_cents) AS BIGINT) AS cents FROM costs WHERE division IS NOT NULL GROUP BY ALL),
x AS (SELECT *, month + 15 AS seen, CAST(sum(cents) OVER (PARTITION BY division ORDER BY month) AS BIGINT) AS spent, avg(cents) OVER (PARTITION BY division ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS mean FROM m),
ats AS (SELECT DISTINCT seen FROM x),
o AS (SELECT min(start_date) AS o, max(finish_date) AS z, count(*) AS n FROM t),
pr AS (SELECT seen, count(*) FILTER (seen BETWEEN start_date AND finish_date) AS act, count(*) FILTER (seen BETWEEN start_date AND finish_date AND is_critical) AS crit, count(*) FILTER (seen > finish_date) AS done,
  avg(f) FILTER (seen BETWEEN start_date AND finish_date) AS af, min(f) FILTER (seen BETWEEN start_date AND finish_date) AS mf FROM ats, t GROUP BY seen),
ph AS (SELECT phase, place, min(start_date) AS a, max(finish_date) AS b FROM t GROUP BY ALL),
cp AS (SELECT seen, count(*) AS n, arg_min({{'p': phase, 'a': a, 'b': b}}, place) AS c FROM ats JOIN ph ON seen BETWEEN a AND b GROUP BY seen),
tr AS (SELECT seen, division, count(*) FILTER (seen BETWEEN start_date AND finish_date) AS act, count(*) FILTER (seen > finish_date) AS done, count(*) AS n, min(start_date) AS first, max(finish_date) AS last, list(DISTINCT phase) AS ps, sum(e) AS whole,
  sum(CASE WHEN seen > finish_date THEN e WHEN seen >= start_date THEN e * (seen - start_date) / greatest(1, finish_date - start_date) ELSE 0 END) AS ex FROM ats, t GROUP BY ALL),
r AS (SELECT x.*, o.o, o.z, o.n AS n_all, pr.act AS pact, pr.crit, pr.done AS pdone, pr.af, pr.mf, cp.n AS np, cp.c, tr.act, tr.done, tr.n, tr.first, tr.last, tr.ps, tr.whole, tr.ex, g.budget,
  spent + CASE WHEN ex > 0 THEN (whole - ex) / greatest(0.5::DOUBLE, least(2.0::DOUBLE, CASE WHEN spent > 0 THEN ex / spent ELSE 1 END)) ELSE whole - ex END AS fc
  FROM x JOIN tr USING (division, seen) JOIN pr USING (seen) LEFT JOIN cp USING (seen) JOIN g USING (division), o)
SELECT division, month, seen AS as_of_date, round(greatest(0, least(1, (seen - o) / greatest(1, z - o)::DOUBLE)), 6) AS project_pct_complete, CAST(seen - o AS INTEGER) AS project_days_elapsed, CAST(greatest(0, z - seen) AS INTEGER) AS project_days_remaining, CAST(z - o AS INTEGER) AS project_total_days,
  coalesce(c.p, 'NONE') AS current_phase, round(coalesce((seen - c.a) / greatest(1, c.b - c.a)::DOUBLE, 0), 6) AS phase_pct_complete, CAST(coalesce(c.b - seen, 0) AS INTEGER) AS phase_days_remaining, coalesce(np, 0) AS phases_active_count,
  pact AS total_active_activities, crit AS critical_path_activities, pdone AS activities_completed_to_date, n_all - pdone AS activities_remaining, round(coalesce(af, 0), 6) AS avg_float, coalesce(mf, 0) AS min_float,
  act AS trade_activities_active, done AS trade_activities_complete, n - done AS trade_activities_remaining, coalesce(list_contains(ps, coalesce(c.p, 'NONE')), false) AS trade_phase_active, round(CASE WHEN budget > 0 THEN ex / budget ELSE 0 END, 6) AS trade_expected_pct_complete,
  CAST(floor((last - first) / 2) + (first - seen) AS INTEGER) AS trade_days_to_peak, CAST(greatest(0, seen - first) AS INTEGER) AS trade_days_since_start, spent AS trade_actual_cost, cents AS trade_cost_this_period, CAST(round(ex) AS BIGINT) AS trade_expected_cost,
  CAST(round(spent - ex) AS BIGINT) AS trade_schedule_variance, round(CASE WHEN ex > 0.0001 THEN (spent - ex) / ex ELSE 0 END, 2) AS trade_variance_pct, CAST(round(mean / 30) AS BIGINT) AS trade_cost_velocity, budget AS trade_gmp_budget, budget - spent AS trade_budget_remaining,
  round(CASE WHEN budget > 0 THEN spent::DOUBLE / budget ELSE 0 END, 6) AS trade_actual_pct_spent, CAST(round(fc) AS BIGINT) AS trade_forecast_at_completion, CAST(round(fc - budget) AS BIGINT) AS trade_budget_variance FROM r""")
def schedule_feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """All features of all divisions and months. The tables have neither floats nor phases of activities: both follow from the activity's number by a fixed rule."""
    number = F.col("activity_id")
    budget = tables.budgets(spark, sf).groupBy("division").agg(F.sum("current_budget_cents").alias("budget"))
    rows = tables.activities(spark, sf).withColumns({"float_days": number % 21, "phase": F.element_at(F.array(*map(F.lit, phases.ORDER)), (1 + number % 9).cast("int")), "place": (1 + number % 9).cast("int"), "cost_weight": F.lit(1), "intensity": F.lit(1)})
    rows = schedule.allocated(rows, budget)
    rolled = rows.groupBy("phase", "place").agg(F.min("start_date").alias("first_start"), F.max("finish_date").alias("last_finish"))
    monthly = tables.costs(spark, sf).where("division IS NOT NULL").groupBy("division", F.trunc("date", "MM").alias("month")).agg(F.sum("amount_cents").alias("cents"))
    out = sweep.schedule_features(rows, monthly, budget, rolled)
    return out.withColumns({c: F.round(c, 6) for c in ROUNDED} | {c: F.round(c).cast("long") for c in CENTS} | {"trade_variance_pct": F.round("trade_variance_pct", 2)})
