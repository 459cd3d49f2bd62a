"""Aggregations, sorting, limits and set operations over recovery and workload tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brokerlens.operators.joins import PAIR
from brokerlens.operators.ranks import bucket_count, counted, exact_quantiles, lookup

METRICS = ["recovery_time_seconds", "cpu_usage_percent", "memory_usage_percent"]
FUNCTIONS = {
    "count": lambda c: F.count(c),
    "mean": lambda c: F.avg(c),
    "std": lambda c: F.stddev_samp(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
}


def summarize(
    df: DataFrame, keys: list[str], metrics: list[str], fns: list[str] = ("count", "mean", "min", "max", "std"),
    digits: int | None = None, nested: bool = False,
) -> DataFrame:
    """Statistics of metrics per key: flat columns ``<metric>_<fn>``, or one struct per metric."""

    def stat(metric: str, fn: str) -> Column:
        value = FUNCTIONS[fn](F.col(metric))
        return value if digits is None or fn == "count" else F.bround(value, digits)

    if nested:
        out = [F.struct(*[stat(m, fn).alias(fn) for fn in fns]).alias(m) for m in metrics]
    else:
        out = [stat(m, fn).alias(f"{m}_{fn}") for m in metrics for fn in fns]
    return df.groupBy(*keys).agg(*out)


def is_success(result: str = "result") -> Column:
    return F.lower(F.col(result)) == "success"


def success_rate(df: DataFrame, keys: list[str]) -> DataFrame:
    share = F.avg(F.when(is_success(), 100.0).otherwise(0.0))
    return df.groupBy(*keys).agg(share.alias("success_rate"))


def overview(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.agg(
        F.count("*").alias("total"),
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
        F.count_if(is_success()).alias("successes"),
        F.try_divide(F.count_if(is_success()) * 100.0, F.count("*")).alias("success_percent"),
    )


def percent_diff(df: DataFrame, keys: list[str], metrics: list[str] = METRICS, config: str = "configuration"):
    """Per key and metric: both means, absolute change and change in percent of the baseline."""
    means = [
        F.avg(F.when(F.col(config) == name, F.col(m))).alias(f"{m}__{side}")
        for m in metrics
        for side, name in PAIR.items()
    ]
    wide = df.groupBy(*keys).agg(*means)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(m).alias("metric"),
                    F.col(f"{m}__baseline").alias("baseline"),
                    F.col(f"{m}__adaptive").alias("adaptive"),
                )
                for m in metrics
            ]
        )
    ).alias("_r")
    change = F.col("adaptive") - F.col("baseline")
    return (
        wide.select(*keys, rows)
        .select(*keys, "_r.*")
        .withColumn("change", change)
        .withColumn("percent", F.try_divide(change, F.col("baseline")) * 100)
    )


def mean_sem(df: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Mean and standard error of the mean."""
    error = F.stddev_samp(metric) / F.sqrt(F.count(metric))
    return df.groupBy(*keys).agg(F.avg(metric).alias("mean"), error.alias("sem"))


def scenario_report(df: DataFrame) -> DataFrame:
    """Per scenario: recovery statistics, means of the readings, and the drop of the message rate in percent."""
    readings = [
        "cpu_usage_percent", "memory_usage_percent", "message_rate_before", "message_rate_during",
        "message_rate_after", "under_replicated_before", "under_replicated_after",
    ]
    out = df.groupBy("scenario").agg(
        *[FUNCTIONS[fn]("recovery_time_seconds").alias(f"recovery_time_{fn}") for fn in ("mean", "min", "max", "std")],
        *[F.avg(c).alias(c) for c in readings],
    )
    impact = (1 - F.try_divide("message_rate_during", "message_rate_before")) * 100
    return out.withColumn("impact", impact)


def recovery_time(
    df: DataFrame, threshold: float = 0.7, by: str = "workload_type", ts: str = "timestamp", cpu: str = "cpu_usage"
) -> DataFrame:
    """Seconds from a workload's first row to its first row with CPU below the threshold, else to its last."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    calm = F.min(F.when(F.col(cpu) < threshold, at))
    seconds = (F.coalesce(calm, F.max(at)) - F.min(at)) / F.lit(1e6)
    return df.groupBy(by).agg(seconds.alias("recovery_seconds"))


def value_share(df: DataFrame, *columns: str) -> DataFrame:
    """Counts and percentages per value (or combination of values)."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("count"))
    total = df.agg(F.count("*")).scalar()
    return counts.withColumn("percent", F.col("count") * 100.0 / total)


def outage_summary(df: DataFrame) -> DataFrame:
    done = F.col("recovered")
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(done).alias("completed"),
        F.avg(F.when(done, F.col("duration_seconds"))).alias("avg_recovery_seconds"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def box_stats(df: DataFrame, keys: list[str], metric: str, exact: bool = True) -> DataFrame:
    """Quartiles, and whiskers at the outermost values within 1.5 interquartile ranges.

    Exact quartiles come from distributed ranks; ``exact=False`` uses a sketch.
    Fences are met per (group, value bucket), so a large group stays spread out.
    """
    counts = counted(df, metric, keys)
    if exact:
        quartiles = exact_quantiles(counts, metric, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    else:
        sketch = F.percentile_approx(metric, [0.25, 0.5, 0.75]).alias("_q")
        quartiles = df.groupBy(*keys).agg(F.count(metric).alias("total"), sketch)
        quartiles = quartiles.select(*keys, "total", *[F.col("_q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    spread = F.col("q3") - F.col("q1")
    fences = quartiles.withColumn("_low", F.col("q1") - 1.5 * spread).withColumn("_high", F.col("q3") + 1.5 * spread)
    buckets = F.sequence(F.lit(0), F.lit(bucket_count(df) - 1))
    fences = fences.withColumn("_bucket", F.explode(buckets)).withColumnRenamed("total", "_total")
    inside = F.col(metric).between(F.col("_low"), F.col("_high"))
    names = {"_total": "n", "q1": "q1", "median": "median", "q3": "q3"}
    return (
        counts.join(fences, [*keys, "_bucket"])
        .groupBy(*keys)
        .agg(
            *[F.first(source).alias(name) for source, name in names.items()],
            F.min(F.when(inside, F.col(metric))).alias("whisker_low"),
            F.max(F.when(inside, F.col(metric))).alias("whisker_high"),
            F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("outliers"),
        )
    )


def box_outliers(df: DataFrame, keys: list[str], metric: str, exact: bool = True) -> DataFrame:
    """The rows outside the whiskers of their group."""
    ends = [F.col("whisker_low").alias("_low"), F.col("whisker_high").alias("_high")]
    stats = box_stats(df, keys, metric, exact).select(*keys, *ends)
    outside = (no_nan(metric) < F.col("_low")) | (no_nan(metric) > F.col("_high"))
    return lookup(df, stats, keys).filter(outside).select(*df.columns)


def resource_long(df: DataFrame, keys: list[str], columns: list[str], fns: list[str] = ("mean", "max")) -> DataFrame:
    """Statistics per key and resource in long form; aggregates first, then unpivots the few results."""
    wide = df.groupBy(*keys).agg(*[FUNCTIONS[fn](c).alias(f"{c}__{fn}") for c in columns for fn in fns])
    rows = F.array(
        *[F.struct(F.lit(c).alias("resource"), *[F.col(f"{c}__{fn}").alias(fn) for fn in fns]) for c in columns]
    )
    return wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def throughput(df: DataFrame, by: list[str], ts: str = "ts", size: Column | str = "bytes", digits: int = 2):
    """Messages and megabytes per second over the covered time of each group."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    size = F.col(size) if isinstance(size, str) else size
    out = df.groupBy(*by).agg(
        F.count("*").alias("messages"),
        F.sum(size).alias("bytes"),
        ((F.max(at) - F.min(at)) / F.lit(1e6)).alias("elapsed"),
    )

    def per_second(column: Column) -> Column:
        return F.bround(F.when(F.col("elapsed") > 0, column / F.col("elapsed")).otherwise(0.0), digits)

    return (
        out.withColumn("messages_per_second", per_second(F.col("messages")))
        .withColumn("mb_per_second", per_second(F.col("bytes") / F.lit(1024.0 * 1024.0)))
        .withColumn("elapsed", F.bround("elapsed", digits))
    )


# ---------------------------------------------------------------- sorting, limits, sets


def no_nan(column: str) -> Column:
    """NaN as NULL, since NaN would otherwise sort above every number."""
    return F.when(~F.isnan(F.col(column).cast("double")), F.col(column))


def sort_scores(df: DataFrame, column: str) -> DataFrame:
    """Highest score first; missing and NaN scores last, as NULL."""
    return df.withColumn(column, no_nan(column)).orderBy(F.col(column).desc_nulls_last())


def top_k(df: DataFrame, column: str, k: int = 5, ties: list[str] = ()) -> DataFrame:
    ordered = df.withColumn(column, no_nan(column))
    return ordered.orderBy(F.col(column).desc_nulls_last(), *ties).limit(k)


def first_last(df: DataFrame, ts: str, by: list[str], columns: list[str]) -> DataFrame:
    """Values of the first and the last row in time per group; equal times fall back to the values' order."""
    row = F.struct(ts, *columns)
    ends = df.filter(F.col(ts).isNotNull()).groupBy(*by).agg(F.min(row).alias("_f"), F.max(row).alias("_l"))
    names = [ts, *columns]
    return ends.select(
        *by, *[F.col(f"_f.{c}").alias(f"first_{c}") for c in names], *[F.col(f"_l.{c}").alias(f"last_{c}") for c in names]
    )


def stack_rows(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
