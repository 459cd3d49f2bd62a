"""Queries of the metric time-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from brokerlens.operators import series
from brokerlens.plans import views
from brokerlens.plans.registry import COUNTERS_SQL, RECOVERY_SQL, SAMPLES_SQL, query, rounded, us

DAY, QUARTER = 86400.0, 21600.0
_W, _S = 86400000000, 21600000000


def seen(view: str, window: int = _W, step: int = _S, name: str = "seen") -> str:
    """Every sample once per grid time that sees it, with the sample before it in the same window."""
    return f"""{name} AS (
      SELECT *, lag(value) OVER w AS prev, row_number() OVER w AS i FROM (
        SELECT metric, broker, us, value, unnest(range((us + {step} - 1) // {step}, (us + {window} - 1) // {step} + 1)) * {step} AS ts FROM {view})
      WINDOW w AS (PARTITION BY metric, broker, ts ORDER BY us))"""


_DELTA = "sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END)"


def flat(df, digits=4):
    return rounded(df.select(us("ts").alias("ts"), "metric", series.label("broker").alias("broker"), "value"), ["value"], digits)


_RATE = f"SELECT ts, metric, broker, {_DELTA} / ((max(us) - min(us)) / 1e6) AS value FROM seen GROUP BY ALL HAVING count(*) >= 2"
_EXTRAPOLATED = f"""SELECT ts, metric, broker, inc * (span + CASE WHEN s >= 1.1 * gap THEN least(gap / 2, zero) ELSE least(s, zero) END
      + CASE WHEN e >= 1.1 * gap THEN gap / 2 ELSE e END) / span AS value
    FROM (SELECT x.*, CASE WHEN inc > 0 AND first >= 0 THEN span * (first / inc) END AS zero FROM (
      SELECT ts, metric, broker, {_DELTA} AS inc, arg_min(value, us) AS first, CAST(max(us) - min(us) AS DOUBLE) AS span,
        CAST(max(us) - min(us) AS DOUBLE) / (count(*) - 1) AS gap, CAST(min(us) - (ts - {_W}) AS DOUBLE) AS s, CAST(ts - max(us) AS DOUBLE) AS e
      FROM seen GROUP BY ts, metric, broker HAVING count(*) >= 2) x)"""


@query("t1_rate", f"WITH {COUNTERS_SQL}, {seen('cnt')} SELECT ts, metric, broker, round(value, 4) AS value FROM ({_RATE})")
def t1(spark, sf):
    return flat(series.rate(views.counters(spark, sf), DAY, QUARTER, False, DAY))


@query("t1_rate_extrapolated", f"WITH {COUNTERS_SQL}, {seen('cnt')} SELECT ts, metric, broker, round(value / 86400, 4) AS value FROM ({_EXTRAPOLATED})")
def t1_extrapolated(spark, sf):
    return flat(series.rate(views.counters(spark, sf), DAY, QUARTER, True, DAY))


@query("t2_increase", f"WITH {COUNTERS_SQL}, {seen('cnt')} SELECT ts, metric, broker, round({_DELTA}, 4) AS value FROM seen GROUP BY ALL HAVING count(*) >= 2")
def t2(spark, sf):
    return flat(series.increase(views.counters(spark, sf), DAY, QUARTER, False, DAY))


@query("t2_increase_extrapolated", f"WITH {COUNTERS_SQL}, {seen('cnt')} SELECT ts, metric, broker, round(value, 2) AS value FROM ({_EXTRAPOLATED})")
def t2_extrapolated(spark, sf):
    return flat(series.increase(views.counters(spark, sf), DAY, QUARTER, True, DAY), 2)


@query("t3_changes", f"""WITH smp AS (SELECT us, metric, broker, floor(value / 50) AS value FROM (
      SELECT epoch_us(ts) AS us, event_type AS metric, CAST(user_id % 3 + 1 AS VARCHAR) AS broker, value FROM events)), {seen('smp')}
    SELECT ts, metric, broker, CAST(count(*) FILTER (value <> prev) AS DOUBLE) AS value FROM seen GROUP BY ALL HAVING count(*) FILTER (value <> prev) > 0""")
def t3(spark, sf):
    rows = views.samples(spark, sf).withColumn("value", F.floor(F.col("value") / 50).cast("double"))
    return flat(series.filter_series(series.changes(rows, DAY, QUARTER, DAY), F.col("value") > 0))


# Whole cents, so that sums do not depend on the order of adding.
_CENTS_SQL = "smp AS (SELECT epoch_us(ts) AS us, event_type AS metric, CAST(user_id % 3 + 1 AS VARCHAR) AS broker, round(value * 100) AS value FROM events)"


def _cents(df):
    return df.withColumn("value", F.round(F.col("value") * 100))


def _over(fn: str, sql: str):
    text = f"WITH {_CENTS_SQL}, {seen('smp')} SELECT ts, metric, broker, round({sql}, 4) AS value FROM seen GROUP BY ALL"

    @query(f"{'t4_avg' if fn == 'avg' else 't5_max' if fn == 'max' else 't4_' + fn}_over_time", text)
    def run(spark, sf):
        return flat(series.over_time(_cents(views.samples(spark, sf)), fn, DAY, QUARTER, DAY))


for _fn, _sql in {"avg": "avg(value)", "max": "max(value)", "min": "min(value)", "sum": "sum(value)",
                  "count": "CAST(count(*) AS DOUBLE)", "last": "arg_max(value, us)", "stddev": "stddev_pop(value)"}.items():
    _over(_fn, _sql)


_HOUR = 3600000000


@query("t6_stddev_of_rate", f"""WITH {COUNTERS_SQL}, {seen('cnt', 21600000000, 3600000000)},
    inr AS (SELECT ts AS us, metric, '' AS broker, sum(value) AS value FROM ({_RATE}) GROUP BY ts, metric), {seen('inr', 86400000000, 21600000000, 'outr')}
    SELECT ts, metric, round(stddev_pop(value), 4) AS value FROM outr GROUP BY ts, metric""")
def t6(spark, sf):
    inner = series.agg_series(series.rate(views.counters(spark, sf), QUARTER, 3600.0, False, DAY), "sum")
    outer = series.subquery_over_time(inner, "stddev", DAY, QUARTER, DAY)
    return rounded(outer.select(us("ts").alias("ts"), "metric", "value"), ["value"])


@query("t7_latest", f"""WITH {SAMPLES_SQL} SELECT max(us) AS ts, metric, broker, arg_max(value, us) AS value FROM smp
    WHERE us <= epoch_us(TIMESTAMP '2024-01-15 12:00:00') AND us > epoch_us(TIMESTAMP '2024-01-15 06:00:00') GROUP BY metric, broker""")
def t7(spark, sf):
    return flat(series.latest(views.samples(spark, sf), "2024-01-15 12:00:00", QUARTER))


@query("t7_first_result", f"""WITH {SAMPLES_SQL} SELECT metric, arg_min(value, broker) AS value FROM (
    SELECT metric, broker, arg_max(value, us) AS value FROM smp GROUP BY metric, broker) GROUP BY metric""")
def t7_first(spark, sf):
    return series.first_result(series.latest(views.samples(spark, sf)), ["metric"])


def _agg(fn: str, sql: str, by: list[str]):
    keys = ", ".join(["ts", "metric", *by])
    text = f"WITH {SAMPLES_SQL}, {seen('smp')}, l AS (SELECT ts, metric, broker, max(value) AS value FROM seen GROUP BY ALL) SELECT {keys}, round({sql}, 4) AS value FROM l GROUP BY {keys}"

    @query(f"t8_{fn}{'_by_' + by[0] if by else ''}", text)
    def run(spark, sf):
        rows = series.agg_series(series.over_time(views.samples(spark, sf), "max", DAY, QUARTER, DAY), fn, by)
        return rounded(rows.select(us("ts").alias("ts"), "metric", *[series.label(b).alias(b) for b in by], "value"), ["value"])


for _fn, _sql, _by in (("sum", "sum(value)", []), ("avg", "avg(value)", ["broker"]), ("stddev", "stddev_pop(value)", []), ("sum", "sum(value)", ["broker"])):
    _agg(_fn, _sql, _by)


BOUNDS = [1.0, 5.0, 10.0, 30.0, 60.0, 120.0]
_LE = ", ".join(f"({b}::DOUBLE)" for b in BOUNDS)


def _buckets(spark, sf):
    """Cumulative bucket counts of event values per day and broker, as bucket samples."""
    rows = views.events(spark, sf).groupBy(F.date_trunc("day", "ts").alias("ts"), views.broker().alias("broker")).agg(
        *[F.count_if(F.col("value") <= b).cast("double").alias(str(b)) for b in BOUNDS], F.count("*").cast("double").alias("+Inf")
    )
    long = rows.unpivot(["ts", "broker"], [F.col(f"`{b}`") for b in [*map(str, BOUNDS), "+Inf"]], "le", "value")
    labels = F.create_map(F.lit("broker"), F.col("broker"), F.lit("le"), F.col("le"))
    return long.select("ts", F.lit("value_bucket").alias("metric"), labels.alias("labels"), "value")


def _quantile(q: float, by: list[str]):
    keys = ", ".join(["day", *by])
    on = " AND ".join(f"{k} = t.{k}" for k in ["day", *by])
    text = f"""WITH ev AS (SELECT epoch_us(date_trunc('day', ts)) AS day, CAST(user_id % 3 + 1 AS VARCHAR) AS broker, value FROM events),
      le(le) AS (VALUES {_LE}, ('inf'::DOUBLE)),
      b AS (SELECT {keys}, le, CAST(count(*) FILTER (value <= le) AS DOUBLE) AS c FROM ev CROSS JOIN le GROUP BY {keys}, le),
      r AS (SELECT *, {q} * max(c) OVER (PARTITION BY {keys}) AS rank, lag(c, 1, 0) OVER w AS below, lag(le, 1, 0) OVER w AS low
            FROM b WINDOW w AS (PARTITION BY {keys} ORDER BY le)),
      t AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY le) AS i FROM r WHERE c >= rank)
      SELECT day AS ts, {''.join(k + ', ' for k in by)} round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - below) / (c - below) END, 4) AS value FROM t WHERE i = 1"""

    @query(f"t9_quantile_{int(q * 100)}{'_by_broker' if by else ''}", text)
    def run(spark, sf):
        rows = series.histogram_quantile(_buckets(spark, sf), q, by)
        return rounded(rows.withColumn("ts", us("ts")), ["value"])


for _q, _by in ((0.95, []), (0.5, ["broker"]), (0.99, ["broker"])):
    _quantile(_q, _by)


@query("t9_quantile_of_rates", f"""WITH le(le) AS (VALUES {_LE}, ('inf'::DOUBLE)),
      h AS (SELECT DISTINCT epoch_us(ts) AS us, event_type, le, count(*) FILTER (value <= le) OVER (PARTITION BY event_type, le ORDER BY ts) AS v FROM events CROSS JOIN le),
      s AS (SELECT event_type, le, us, v, unnest(range((us + {_S} - 1) // {_S}, (us + {_W} - 1) // {_S} + 1)) * {_S} AS ts FROM h),
      x AS (SELECT ts, event_type, le, (max(v) - min(v)) / ((max(us) - min(us)) / 1e6) AS rate FROM s GROUP BY ALL HAVING count(*) >= 2),
      b AS (SELECT ts, le, sum(rate) AS c FROM x GROUP BY ALL),
      r AS (SELECT *, 0.95 * max(c) OVER (PARTITION BY ts) AS rank, lag(c, 1, 0) OVER w AS below, lag(le, 1, 0) OVER w AS low
            FROM b WINDOW w AS (PARTITION BY ts ORDER BY le)),
      t AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY le) AS i FROM r WHERE c >= rank)
      SELECT ts, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - below) / (c - below) END, 4) AS value FROM t WHERE i = 1""")
def t9_of_rates(spark, sf):
    """histogram_quantile(0.95, sum(rate(bucket[1d])) by (le)) every six hours."""
    buckets = series.to_histogram(views.events(spark, sf), "latency", ["event_type"], F.col("value"), BOUNDS)
    rates = series.agg_series(series.rate(buckets, DAY, QUARTER, False, DAY), "sum", ["le"])
    return rounded(series.histogram_quantile(rates, 0.95).withColumn("ts", us("ts")), ["value"])


def _pair(spark, sf):
    grid = series.over_time(views.samples(spark, sf).filter(F.col("metric").isin("click", "error")), "sum", DAY, QUARTER, DAY)
    return grid.filter(F.col("metric") == "error"), grid.filter(F.col("metric") == "click")


_PAIR_SQL = f"WITH {SAMPLES_SQL}, {seen('smp')}, g AS (SELECT ts, metric, broker, sum(value) AS value FROM seen GROUP BY ALL), a AS (SELECT * FROM g WHERE metric = 'error'), b AS (SELECT * FROM g WHERE metric = 'click')"


@query("t10_ratio", f"{_PAIR_SQL} SELECT a.ts, a.metric, a.broker, round(a.value / b.value * 100, 4) AS value FROM a JOIN b ON a.ts = b.ts AND a.broker = b.broker")
def t10(spark, sf):
    a, b = _pair(spark, sf)
    return flat(series.scalar(series.binary(a, b, "/"), "*", 100))


@query("t11_or", f"{_PAIR_SQL}, a2 AS (SELECT * FROM a WHERE broker <> '2') SELECT ts, metric, broker, round(value, 4) AS value FROM a2 UNION ALL SELECT ts, metric, broker, round(value, 4) FROM b WHERE (ts, broker) NOT IN (SELECT ts, broker FROM a2)")
def t11(spark, sf):
    a, b = _pair(spark, sf)
    return flat(series.or_series(a.filter(series.label("broker") != "2"), b))


@query("t12_above", f"WITH {SAMPLES_SQL} SELECT us AS ts, metric, broker, value FROM smp WHERE value > 100")
def t12(spark, sf):
    rows = views.samples(spark, sf).select("ts", "metric", "labels", "value")
    return flat(series.filter_series(rows, F.col("value") > 100))


FEATURES = [
    series.Feature("clicks", "click", "rate_5m", "sum"),
    series.Feature("views", "view", "rate_5m", "avg", 100.0),
    series.Feature("click_spread", "click", "rate_1m", "stddev"),
    series.Feature("level", "signup", "instant", "avg"),
    series.Feature("level_spread", "signup", "instant", "stddev", divide_by=series.Feature("", "signup", "instant", "avg")),
    series.Feature("click_size", "purchase", "rate_5m", "sum", divide_by=series.Feature("", "click", "rate_5m", "sum")),
    series.Feature("first_error", "error"),
    series.Feature("broker_two", "error", "rate_5m", "avg", match={"broker": "2"}),
    series.Feature("rate_variance", "view", "rate_1m", "sum", stddev_minutes=4),
]
# Events are minutes apart, so the windows are stretched: 5 minutes to a day, 1 minute to six hours.
STRETCHED = {"instant": DAY, "rate_5m": DAY, "rate_1m": QUARTER}

_MATRIX = f"""WITH {COUNTERS_SQL}, {seen('cnt')}, {seen('cnt', 21600000000, 21600000000, 'shrt')},
    r5 AS (SELECT ts, metric, broker, {_DELTA} / ((max(us) - min(us)) / 1e6) AS v FROM seen GROUP BY ALL HAVING count(*) >= 2),
    r1 AS (SELECT ts, metric, broker, {_DELTA} / ((max(us) - min(us)) / 1e6) AS v FROM shrt GROUP BY ALL HAVING count(*) >= 2),
    l AS (SELECT ts, metric, broker, arg_max(value, us) AS v FROM seen GROUP BY ALL),
    s5 AS (SELECT ts, sum(v) FILTER (metric = 'click') AS clicks, avg(v) FILTER (metric = 'view') * 100 AS views, sum(v) FILTER (metric = 'purchase') AS buys,
      avg(v) FILTER (metric = 'error' AND broker = '2') AS broker_two FROM r5 GROUP BY ts),
    s1 AS (SELECT ts, stddev_pop(v) FILTER (metric = 'click') AS click_spread, sum(v) FILTER (metric = 'view') AS inner_rate FROM r1 GROUP BY ts),
    sl AS (SELECT ts, avg(v) FILTER (metric = 'signup') AS level, stddev_pop(v) FILTER (metric = 'signup') AS spread, arg_min(v, broker) FILTER (metric = 'error') AS first_error FROM l GROUP BY ts),
    rv AS (SELECT t.ts, stddev_pop(s.inner_rate) AS rate_variance FROM sl t JOIN s1 s ON s.ts <= t.ts AND s.ts > t.ts - {_W} GROUP BY t.ts)
    SELECT sl.ts, round(clicks, 4) AS clicks, round(views, 4) AS views, round(click_spread, 4) AS click_spread, round(level, 4) AS level, round(spread / level, 4) AS level_spread,
      round(buys / clicks, 4) AS click_size, round(first_error, 4) AS first_error, round(broker_two, 4) AS broker_two, round(rate_variance, 4) AS rate_variance
    FROM sl LEFT JOIN s5 ON sl.ts = s5.ts LEFT JOIN s1 ON sl.ts = s1.ts LEFT JOIN rv ON sl.ts = rv.ts"""


@query("t13_feature_matrix", _MATRIX)
def t13(spark, sf):
    rows = series.feature_matrix(views.counters(spark, sf), FEATURES, QUARTER, STRETCHED, QUARTER, False, DAY)
    return rounded(rows.withColumn("ts", us("ts")), [f.name for f in FEATURES])


@query("t14_summary_mean", """SELECT epoch_us(ts) AS ts, CAST(broker AS VARCHAR) AS broker, round(s / n, 4) AS value FROM (
    SELECT ts, user_id % 3 + 1 AS broker, sum(round(value * 100)) OVER w AS s, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id % 3 ORDER BY ts))""")
def t14(spark, sf):
    events = _cents(views.events(spark, sf)).withColumn("broker", views.broker())
    rows = series.summary_mean(series.to_summary(events, "value", ["broker"], F.col("value")), "value")
    return rounded(rows.select(us("ts").alias("ts"), series.label("broker").alias("broker"), "value"), ["value"])


@query("t14_summary_mean_total", """SELECT day AS ts, round(s / n, 4) AS value FROM (SELECT epoch_us(date_trunc('day', ts)) AS day, sum(round(value * 100)) AS s, count(*) AS n FROM events GROUP BY 1)""")
def t14_total(spark, sf):
    rows = _cents(views.events(spark, sf)).groupBy(F.date_trunc("day", "ts").alias("ts"), views.broker().alias("broker")).agg(
        F.sum("value").alias("latency_sum"), F.count("*").cast("double").alias("latency_count")
    )
    long = rows.unpivot(["ts", "broker"], ["latency_sum", "latency_count"], "metric", "value")
    long = long.withColumn("labels", F.create_map(F.lit("broker"), "broker"))
    return rounded(series.summary_mean(long, "latency", []).select(us("ts").alias("ts"), "value"), ["value"])


@query("t15_counter", """SELECT epoch_us(ts) AS ts, event_type, CAST(count(*) OVER (PARTITION BY event_type ORDER BY ts) AS DOUBLE) AS value FROM events""")
def t15(spark, sf):
    rows = series.to_counter(views.events(spark, sf), "recoveries", ["event_type"])
    return rows.select(us("ts").alias("ts"), series.label("event_type").alias("event_type"), "value")


@query("t15_histogram", f"""WITH le(le) AS (VALUES {_LE}, ('inf'::DOUBLE))
    SELECT epoch_us(ts) AS ts, event_type, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(le AS VARCHAR) END AS le,
      CAST(count(*) FILTER (value <= le) OVER (PARTITION BY event_type, le ORDER BY ts) AS DOUBLE) AS value FROM events CROSS JOIN le""")
def t15_histogram(spark, sf):
    rows = series.to_histogram(views.events(spark, sf), "latency", ["event_type"], F.col("value"), BOUNDS)
    return rows.select(us("ts").alias("ts"), series.label("event_type").alias("event_type"), series.label("le").alias("le"), "value")


@query("t15_one_hot", """SELECT epoch_us(ts) AS ts, n AS event_type, CAST(event_type = n AS INTEGER)::DOUBLE AS value FROM events CROSS JOIN (VALUES ('click'), ('view'), ('error')) t(n)""")
def t15_one_hot(spark, sf):
    rows = series.to_one_hot(views.events(spark, sf), "current_strategy", "event_type", ["click", "view", "error"])
    return rows.select(us("ts").alias("ts"), series.label("event_type").alias("event_type"), "value")


@query("t16_label_values", "SELECT DISTINCT CAST(user_id % 3 + 1 AS VARCHAR) AS broker FROM events WHERE event_type = 'click'")
def t16(spark, sf):
    return series.label_values(views.samples(spark, sf), "click", "broker")


@query("t17_success_ratio", f"""WITH {RECOVERY_SQL} SELECT config_source, workload_type, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (result = 'SUCCESS') AS BIGINT) AS successes,
    round(count(*) FILTER (result = 'SUCCESS') / count(*) * 100, 4) AS success_percent FROM rec GROUP BY ALL""")
def t17(spark, sf):
    rows = series.success_ratio(views.recovery(spark, sf), ["config_source", "workload_type"], F.lower("result") == "success")
    return rounded(rows, ["success_percent"])


@query("t17_used_percent", """SELECT o_orderkey AS id, round((o_totalprice - o_custkey) / o_totalprice * 100, 4) AS used FROM orders""")
def t17_used(spark, sf):
    rows = views.table(spark, sf, "orders")
    used = series.used_percent(rows, F.col("o_totalprice"), F.col("o_custkey"))
    return rows.select(F.col("o_orderkey").alias("id"), F.round(used, 4).alias("used"))
