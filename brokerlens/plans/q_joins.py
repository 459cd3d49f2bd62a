"""Queries of join-shaped operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from brokerlens.functions.rules import alignment_verdict
from brokerlens.operators import joins, series, sequence
from brokerlens.plans import views
from brokerlens.plans.registry import ANALYSED_SQL, PROGRESS_SQL, query, rounded, us
from brokerlens.plans.q_series import DAY, _PAIR_SQL, _pair

WIDTH = DAY


def _side(spark, sf, kind, *columns):
    rows = views.events(spark, sf).filter(F.col("event_type") == kind)
    return rows.select("ts", views.broker().alias("broker"), *columns)


_SIDES = """l AS (SELECT event_id, epoch_us(ts) AS us, user_id % 3 AS b FROM events WHERE event_type = 'click'),
    r AS (SELECT event_id, epoch_us(ts) AS us, user_id % 3 AS b, value FROM events WHERE event_type = 'error')"""


@query("j1_nearest", f"""WITH {_SIDES}, p AS (SELECT l.event_id AS id, l.us, r.event_id AS rid, r.us AS rus, r.value, abs(l.us - r.us) AS gap FROM l JOIN r ON l.b = r.b),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, rus) AS i FROM p)
    SELECT id AS event_id, rid AS right_event_id, value AS right_value, round(gap / 1e6, 6) AS gap_seconds FROM k WHERE i = 1""")
def j1(spark, sf):
    left, right = _side(spark, sf, "click", "event_id"), _side(spark, sf, "error", "event_id", "value")
    out = joins.asof_nearest(left, right, "ts", ["broker"], width=WIDTH)
    return rounded(out.select("event_id", "right_event_id", "right_value", "gap_seconds"), ["gap_seconds"], 6)


@query("j1_nearest_no_key", """WITH l AS (SELECT event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'signup'), r AS (SELECT event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view'),
    k AS (SELECT l.event_id AS id, r.event_id AS rid, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.us - r.us), r.us) AS i FROM l CROSS JOIN r)
    SELECT id AS event_id, rid AS right_event_id FROM k WHERE i = 1""")
def j1_no_key(spark, sf):
    left, right = _side(spark, sf, "signup", "event_id").drop("broker"), _side(spark, sf, "view", "event_id").drop("broker")
    return joins.asof_nearest(left, right, "ts", [], width=WIDTH).select("event_id", "right_event_id")


@query("j2_equal_labels", f"{_PAIR_SQL} SELECT a.ts, a.broker, round(a.value, 4) AS left_value, round(b.value, 4) AS right_value FROM a JOIN b ON a.ts = b.ts AND a.broker = b.broker")
def j2(spark, sf):
    a, b = _pair(spark, sf)
    rows = joins.join_series(a, b).select(us("ts").alias("ts"), series.label("broker").alias("broker"), "left_value", "right_value")
    return rounded(rows, ["left_value", "right_value"])


@query("j3_strategy_config", """SELECT event_id, strategy, CASE strategy WHEN 'QUICK_REBALANCE' THEN '4' ELSE '2' END AS fetchers,
    CASE strategy WHEN 'QUICK_REBALANCE' THEN 'speed' WHEN 'RESOURCE_OPTIMIZED' THEN 'resource' ELSE 'controlled' END AS priority FROM (
    SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'QUICK_REBALANCE' WHEN 1 THEN 'RESOURCE_OPTIMIZED' ELSE 'CONTROLLED_GRADUAL' END AS strategy FROM events)""")
def j3(spark, sf):
    names = F.array(*[F.lit(n) for n in joins.STRATEGY_CONFIGS])
    rows = views.events(spark, sf).select("event_id", F.get(names, (F.col("user_id") % 3).cast("int")).alias("strategy"))
    out = joins.with_strategy_config(rows, joins.strategy_dimension(spark))
    return out.select("event_id", "strategy", F.col("config")["num.replica.fetchers"].alias("fetchers"), F.col("config")["rebalance.priority"].alias("priority"))


@query("j4_in_force", f"""WITH {_SIDES} SELECT l.event_id, r.event_id AS right_event_id, r.value AS right_value FROM l ASOF LEFT JOIN r ON l.b = r.b AND l.us >= r.us""")
def j4(spark, sf):
    left, right = _side(spark, sf, "click", "event_id"), _side(spark, sf, "error", "event_id", "value")
    out = joins.asof_backward(left, right, "ts", ["broker"], width=WIDTH)
    return out.select("event_id", "right_event_id", "right_value")


@query("j5_actual_labels", f"""WITH {_SIDES}, j AS (SELECT l.event_id, l.event_id % 2 AS prediction, CAST(floor(r.value) AS INTEGER) % 2 AS actual FROM l ASOF LEFT JOIN r ON l.b = r.b AND l.us >= r.us)
    SELECT event_id, prediction, actual, CASE WHEN actual IS NULL THEN 'unknown' WHEN actual = prediction THEN 'match' ELSE 'mismatch' END AS verdict FROM j""")
def j5(spark, sf):
    predictions = _side(spark, sf, "click", "event_id", (F.col("event_id") % 2).alias("prediction"))
    actuals = _side(spark, sf, "error", (F.floor("value") % 2).cast("int").alias("actual"))
    out = joins.align_labels(predictions, actuals, "ts", ["broker"], width=WIDTH)
    return alignment_verdict(out).select("event_id", "prediction", "actual", "verdict")


@query("j6_around", """WITH e AS (SELECT event_id, epoch_us(ts) AS s, epoch_us(ts) + 60000000 + CAST(floor(value) AS BIGINT) * 1000000 AS f, user_id % 3 AS b FROM events WHERE event_type = 'error'),
    m AS (SELECT epoch_us(ts) AS us, user_id % 3 AS b, value FROM events WHERE event_type IN ('click', 'view'))
    SELECT event_id,
      (SELECT arg_max(m.value, m.us) FROM m WHERE m.b = e.b AND m.us BETWEEN s - 3600000000 AND s) AS value_before,
      (SELECT arg_min(m.value, m.us) FROM m WHERE m.b = e.b AND m.us BETWEEN s + 10000000 AND s + 10000000 + 1800000000) AS value_during,
      (SELECT arg_min(m.value, m.us) FROM m WHERE m.b = e.b AND m.us BETWEEN f AND f + 1800000000) AS value_after FROM e""")
def j6(spark, sf):
    ending = F.timestamp_micros(us("ts") + 60_000_000 + F.floor("value") * 1_000_000)
    events = _side(spark, sf, "error", "event_id", ending.alias("end_ts"))
    samples = views.events(spark, sf).filter(F.col("event_type").isin("click", "view")).select("ts", views.broker().alias("broker"), "value")
    out = joins.around_events(events, samples, 3600, 10, 1800, ["broker"], width=WIDTH)
    return out.select("event_id", "value_before", "value_during", "value_after")


@query("j7_within_period", f"""WITH {PROGRESS_SQL}, g AS (SELECT us, lead(us) OVER (ORDER BY us) AS nxt FROM (SELECT DISTINCT us FROM prg)),
    p AS (SELECT min(us) AS s FROM g WHERE nxt - us > 1200000000) SELECT prg.us AS ts, workload_type, cpu_usage FROM prg, p WHERE us BETWEEN s AND s + 86400000000""")
def j7(spark, sf):
    rows = views.progress(spark, sf)
    period = sequence.recovery_period(rows, seconds=1200, minutes=1440, width=WIDTH)
    return joins.within_period(rows, period).select(us("timestamp").alias("ts"), "workload_type", "cpu_usage")


@query("j8_compare", f"""WITH {ANALYSED_SQL} SELECT workload_strategy, round(avg(recovery_time_seconds) FILTER (configuration = 'baseline'), 4) AS baseline,
    round(avg(recovery_time_seconds) FILTER (configuration = 'ARMS'), 4) AS adaptive,
    round(avg(recovery_time_seconds) FILTER (configuration = 'ARMS') - avg(recovery_time_seconds) FILTER (configuration = 'baseline'), 4) AS difference FROM ana GROUP BY 1""")
def j8(spark, sf):
    from brokerlens.plans.q_summary import analysed

    out = joins.compare_configs(analysed(spark, sf), "recovery_time_seconds", ["workload_strategy"])
    return rounded(out, ["baseline", "adaptive", "difference"])
