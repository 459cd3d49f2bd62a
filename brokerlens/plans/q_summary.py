"""Queries of aggregations, sorting, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from brokerlens.functions import scalars
from brokerlens.operators import sequence, summary
from brokerlens.plans import views
from brokerlens.plans.registry import ANALYSED_SQL, PROGRESS_SQL, RECOVERY_SQL, query, rounded, us

METRICS = ["recovery_time_seconds", "cpu", "memory_usage_percent"]


def analysed(spark, sf):
    """Recovery rows recoded for analysis: display names, CPU in percent, two workloads."""
    rows = scalars.recode(views.recovery(spark, sf), "config_source", scalars.CONFIGURATION_NAMES, "configuration")
    return rows.withColumns(
        {"workload_strategy": scalars.batch_or_real_time("workload_type"), "cpu": F.col("cpu_usage_percent") * 100}
    )


def _stats_sql(keys: str, view: str = "rec", digits: int = 2) -> str:
    cols = ", ".join(
        f"round_even({fn}(recovery_time_seconds), {digits}) AS recovery_time_seconds_{name}"
        for name, fn in (("mean", "avg"), ("min", "min"), ("max", "max"), ("std", "stddev_samp"))
    )
    return f"WITH {RECOVERY_SQL} SELECT {keys}, CAST(count(recovery_time_seconds) AS BIGINT) AS recovery_time_seconds_count, {cols} FROM {view} GROUP BY {keys}"


@query("a1_by_strategy", _stats_sql("strategy"))
def a1(spark, sf):
    return summary.summarize(views.recovery(spark, sf), ["strategy"], ["recovery_time_seconds"], digits=2)


@query("a2_resources", f"WITH {RECOVERY_SQL} SELECT strategy, round(avg(cpu_usage_percent), 4) AS cpu_usage_percent_mean, round(avg(memory_usage_percent), 4) AS memory_usage_percent_mean FROM rec GROUP BY strategy")
def a2(spark, sf):
    rows = summary.summarize(views.recovery(spark, sf), ["strategy"], ["cpu_usage_percent", "memory_usage_percent"], ["mean"])
    return rounded(rows, ["cpu_usage_percent_mean", "memory_usage_percent_mean"])


@query("a3_by_workload", _stats_sql("workload_type"))
def a3(spark, sf):
    return summary.summarize(views.recovery(spark, sf), ["workload_type"], ["recovery_time_seconds"], digits=2)


@query("a4_success_rate", f"WITH {RECOVERY_SQL} SELECT strategy, round(avg(CASE WHEN result = 'SUCCESS' THEN 100 ELSE 0 END), 4) AS success_rate FROM rec GROUP BY strategy")
def a4(spark, sf):
    return rounded(summary.success_rate(views.recovery(spark, sf), ["strategy"]), ["success_rate"])


@query("a5_overview", f"""WITH {RECOVERY_SQL} SELECT CAST(count(*) AS BIGINT) AS total, min(ts) AS first_seen, max(ts) AS last_seen,
    CAST(count(*) FILTER (result = 'SUCCESS') AS BIGINT) AS successes, round(count(*) FILTER (result = 'SUCCESS') * 100.0 / count(*), 4) AS success_percent FROM rec""")
def a5(spark, sf):
    rows = summary.overview(views.recovery(spark, sf))
    return rounded(rows.withColumns({c: us(c) for c in ("first_seen", "last_seen")}), ["success_percent"])


_FNS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


@query("a6_config_workload", f"WITH {ANALYSED_SQL} SELECT configuration, workload_strategy, " + ", ".join(
    f"round({fn}({m}), 4) AS {m}_{name}" for m in METRICS for name, fn in _FNS.items()) + " FROM ana GROUP BY configuration, workload_strategy")
def a6(spark, sf):
    rows = summary.summarize(analysed(spark, sf), ["configuration", "workload_strategy"], METRICS, list(_FNS))
    return rounded(rows, [f"{m}_{fn}" for m in METRICS for fn in _FNS])


@query("a7_percent_diff", f"WITH {ANALYSED_SQL}, m AS (SELECT workload_strategy, metric, avg(v) FILTER (configuration = 'baseline') AS baseline, avg(v) FILTER (configuration = 'ARMS') AS adaptive FROM (" + " UNION ALL ".join(
    f"SELECT workload_strategy, configuration, '{m}' AS metric, {m} AS v FROM ana" for m in METRICS) + """) GROUP BY ALL)
    SELECT workload_strategy, metric, round(baseline, 4) AS baseline, round(adaptive, 4) AS adaptive, round(adaptive - baseline, 4) AS change, round((adaptive - baseline) / baseline * 100, 4) AS percent FROM m""")
def a7(spark, sf):
    rows = summary.percent_diff(analysed(spark, sf), ["workload_strategy"], METRICS)
    return rounded(rows, ["baseline", "adaptive", "change", "percent"])


@query("a8_standard_error", f"WITH {ANALYSED_SQL} SELECT configuration, workload_strategy, round(avg(cpu), 4) AS mean, round(stddev_samp(cpu) / sqrt(count(cpu)), 6) AS sem FROM ana GROUP BY ALL")
def a8(spark, sf):
    rows = summary.mean_sem(analysed(spark, sf), ["configuration", "workload_strategy"], "cpu")
    return rounded(rounded(rows, ["mean"]), ["sem"], 6)


_READINGS = {
    "cpu_usage_percent": "l_discount", "memory_usage_percent": "l_tax", "message_rate_before": "l_extendedprice",
    "message_rate_during": "l_extendedprice * (1 - l_discount)", "message_rate_after": "l_extendedprice * (1 + l_tax)",
    "under_replicated_before": "CAST(l_linenumber AS DOUBLE)", "under_replicated_after": "CAST(l_linenumber % 2 AS DOUBLE)",
}


@query("a9_scenarios", "SELECT scenario, " + ", ".join(f"round({fn}(recovery_time_seconds), 4) AS recovery_time_{n}" for n, fn in _FNS.items()) + ", " + ", ".join(
    f"round(avg({c}), 2) AS {c}" for c in _READINGS) + ", round((1 - avg(message_rate_during) / avg(message_rate_before)) * 100, 4) AS impact FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'batch' ELSE 'real_time' END || CASE WHEN l_linestatus = 'O' THEN '_with_arms' ELSE '_without_arms' END AS scenario, l_quantity AS recovery_time_seconds, " + ", ".join(
    f"{e} AS {c}" for c, e in _READINGS.items()) + " FROM lineitem) GROUP BY scenario")
def a9(spark, sf):
    workload = F.when(F.col("l_returnflag") == "R", "batch").otherwise("real_time")
    rows = views.table(spark, sf, "lineitem").select(
        scalars.scenario_name(workload, F.col("l_linestatus") == "O").alias("scenario"), F.col("l_quantity").alias("recovery_time_seconds"),
        *[F.expr(e).alias(c) for c, e in _READINGS.items()],
    )
    out = rounded(summary.scenario_report(rows), list(_READINGS), 2)
    return rounded(out, [f"recovery_time_{n}" for n in _FNS] + ["impact"])


@query("a10_recovery_time", f"""WITH {PROGRESS_SQL} SELECT workload_type, round((coalesce(min(us) FILTER (cpu_usage < 0.02), max(us)) - min(us)) / 1e6, 4) AS recovery_seconds FROM prg GROUP BY 1""")
def a10(spark, sf):
    return rounded(summary.recovery_time(views.progress(spark, sf), 0.02), ["recovery_seconds"])


@query("a11_nested_usage", f"WITH {PROGRESS_SQL} SELECT workload_type, round(avg(cpu_usage), 4) AS cpu_mean, max(cpu_usage) AS cpu_max, min(cpu_usage) AS cpu_min, round(avg(memory_usage), 4) AS memory_mean, max(memory_usage) AS memory_max, min(memory_usage) AS memory_min FROM prg GROUP BY 1")
def a11(spark, sf):
    rows = summary.summarize(views.progress(spark, sf), ["workload_type"], ["cpu_usage", "memory_usage"], ["mean", "max", "min"], nested=True)
    flat = [F.col(f"{m}_usage.{fn}").alias(f"{m}_{fn}") for m in ("cpu", "memory") for fn in ("mean", "max", "min")]
    return rounded(rows.select("workload_type", *flat), ["cpu_mean", "memory_mean"])


@query("a12_value_share", f"WITH {RECOVERY_SQL} SELECT strategy, workload_type, CAST(count(*) AS BIGINT) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percent FROM rec GROUP BY ALL")
def a12(spark, sf):
    return rounded(summary.value_share(views.recovery(spark, sf), "strategy", "workload_type"), ["percent"])


@query("a13_outages", """WITH e AS (SELECT user_id % 3 AS broker, epoch_us(ts) AS us, CAST(event_type <> 'error' AS INTEGER) AS up FROM events),
    t AS (SELECT * FROM (SELECT *, coalesce(lag(up) OVER (PARTITION BY broker ORDER BY us), 1) AS was FROM e) WHERE up <> was),
    o AS (SELECT *, lead(us) OVER (PARTITION BY broker ORDER BY us) - us AS d FROM t), f AS (SELECT d / 1e6 AS d FROM o WHERE up = 0)
    SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (d <= 900) AS BIGINT) AS completed, round(avg(d) FILTER (d <= 900), 4) AS avg_recovery_seconds FROM f""")
def a13(spark, sf):
    readings = views.events(spark, sf).select(views.broker().alias("broker"), "ts", (F.col("event_type") != "error").alias("up"))
    return rounded(summary.outage_summary(sequence.outages(readings, 900, width=86400)), ["avg_recovery_seconds"])


@query("a14_distinct", f"WITH {RECOVERY_SQL} SELECT DISTINCT broker_url FROM rec")
def a14(spark, sf):
    return summary.distinct_values(views.recovery(spark, sf), "broker_url")


def _box_sql(keys: list[str], metric: str) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"r.{x} = q.{x}" for x in keys)
    return f"""WITH {ANALYSED_SQL}, q AS (SELECT {k}, count({metric}) AS n, quantile_cont({metric}, 0.25) AS q1, quantile_cont({metric}, 0.5) AS median, quantile_cont({metric}, 0.75) AS q3 FROM ana GROUP BY {k})
    SELECT {', '.join('q.' + x for x in keys)}, CAST(n AS BIGINT) AS n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
      min({metric}) FILTER ({metric} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
      max({metric}) FILTER ({metric} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
      CAST(count(*) FILTER (NOT {metric} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers
    FROM ana r JOIN q ON {on} GROUP BY ALL"""


def _box(name: str, keys: list[str], metric: str):
    @query(name, _box_sql(keys, metric))
    def run(spark, sf):
        return rounded(summary.box_stats(analysed(spark, sf), keys, metric), ["q1", "median", "q3"])


_box("a15_box_config_workload", ["configuration", "workload_strategy"], "recovery_time_seconds")
_box("a15_box_strategy_result", ["strategy", "result"], "price")
_box("a15_box_workload_result", ["workload_type", "result"], "price")
_box("a15_box_strategy_workload", ["strategy", "workload_type"], "total")


@query("a15_outliers", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
    SELECT e.event_type, event_id, value FROM events e JOIN q ON e.event_type = q.event_type WHERE NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def a15_outliers(spark, sf):
    return summary.box_outliers(views.events(spark, sf), ["event_type"], "value").select("event_type", "event_id", "value")


@query("a16_resource_means", f"WITH {RECOVERY_SQL} SELECT strategy, resource, round(avg(v), 4) AS mean FROM (UNPIVOT (SELECT strategy, cpu_usage_percent, memory_usage_percent FROM rec) ON cpu_usage_percent, memory_usage_percent INTO NAME resource VALUE v) GROUP BY ALL")
def a16(spark, sf):
    rows = summary.resource_long(views.recovery(spark, sf), ["strategy"], ["cpu_usage_percent", "memory_usage_percent"], ["mean"])
    return rounded(rows, ["mean"])


@query("a17_throughput", """SELECT event_type, CAST(count(*) AS BIGINT) AS messages, CAST(sum(strlen(props)) AS BIGINT) AS bytes, round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 2) AS elapsed,
    round_even(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 2) AS messages_per_second,
    round_even(sum(strlen(props)) / 1048576 / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 2) AS mb_per_second FROM events GROUP BY 1""")
def a17(spark, sf):
    return summary.throughput(views.events(spark, sf), ["event_type"], size=F.octet_length("props"))


@query("a18_resource_table", f"WITH {PROGRESS_SQL} SELECT workload_type, resource, round(avg(v), 4) AS mean, max(v) AS max FROM (UNPIVOT (SELECT workload_type, cpu_usage, memory_usage FROM prg) ON cpu_usage, memory_usage INTO NAME resource VALUE v) GROUP BY ALL")
def a18(spark, sf):
    return rounded(summary.resource_long(views.progress(spark, sf), ["workload_type"], ["cpu_usage", "memory_usage"]), ["mean"])


# ---------------------------------------------------------------- sorting, limits, sets


def _part_scores(spark, sf):
    """A score per part: its average sales price, NaN for every seventh part."""
    rows = views.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("feature")).agg(F.max("l_extendedprice").alias("score"))
    return rows.withColumn("score", F.when(F.col("feature") % 7 == 0, float("nan")).otherwise(F.col("score")))


_SCORES = "s AS (SELECT l_partkey AS feature, CASE WHEN l_partkey % 7 <> 0 THEN max(l_extendedprice) END AS score FROM lineitem GROUP BY l_partkey)"


@query("o1_sort_scores", f"WITH {_SCORES} SELECT feature, score FROM s")
def o1(spark, sf):
    return summary.sort_scores(_part_scores(spark, sf), "score")


@query("o2_top_k", f"WITH {_SCORES} SELECT feature, score FROM s ORDER BY score DESC NULLS LAST, feature LIMIT 5")
def o2(spark, sf):
    return summary.top_k(_part_scores(spark, sf), "score", 5, ["feature"])


@query("o3_first_last", """SELECT user_id, epoch_us(min(ts)) AS first_ts, arg_min(event_type, ts) AS first_event_type, arg_min(value, ts) AS first_value,
    epoch_us(max(ts)) AS last_ts, arg_max(event_type, ts) AS last_event_type, arg_max(value, ts) AS last_value FROM events GROUP BY user_id""")
def o3(spark, sf):
    rows = summary.first_last(views.events(spark, sf), "ts", ["user_id"], ["event_type", "value"])
    return rows.withColumns({c: us(c) for c in ("first_ts", "last_ts")})


@query("o4_sort_coefficients", "SELECT c_nationkey AS feature, round(avg(c_acctbal), 4) AS coefficient FROM customer GROUP BY 1")
def o4(spark, sf):
    rows = views.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("feature")).agg(F.avg("c_acctbal").alias("coefficient"))
    return rounded(summary.sort_scores(rows, "coefficient"), ["coefficient"])


@query("o5_stack", f"""WITH {RECOVERY_SQL} SELECT 'strategy' AS kind, strategy AS name, CAST(count(*) AS BIGINT) AS n, NULL AS share FROM rec GROUP BY strategy
    UNION ALL SELECT 'workload', workload_type, CAST(count(*) AS BIGINT), round(count(*) * 100.0 / sum(count(*)) OVER (), 4) FROM rec GROUP BY workload_type""")
def o5(spark, sf):
    rows = views.recovery(spark, sf)
    a = rows.groupBy(F.col("strategy").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("strategy"))
    b = summary.value_share(rows, "workload_type").select(
        F.col("workload_type").alias("name"), F.col("count").alias("n"), F.round("percent", 4).alias("share"), F.lit("workload").alias("kind")
    )
    return summary.stack_rows([a, b])
