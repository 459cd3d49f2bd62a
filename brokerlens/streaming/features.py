"""The feature rows of the classifier inside a stream: four windowed aggregations in a chain, all in the JVM."""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brokerlens.operators.ordered import micros
from brokerlens.operators.series import (
    FEATURES, READS, Feature, feature_columns, feature_metrics, series_key,
)

_KEPT = ("n", "first", "last", "first_us", "last_us", "increase")


def _rise(before: Column, after: Column) -> Column:
    """What a counter gained between two samples; one that fell began anew at 0."""
    return F.when(after < before, after).otherwise(after - before)


def _struct(**parts: Column) -> Column:
    return F.struct(*[parts[name].alias(name) for name in _KEPT])


def _summary(points: Column) -> Column:
    """What a bucket keeps of its samples, an array of (us, value); of several of an instant the highest counts.

    One pass over the sorted samples: ``before`` and ``gained`` are the value and the increase up to the instant before
    the last, from which a further, higher sample of the last instant counts anew.
    """

    def follow(state: Column, p: Column) -> Column:
        again = F.coalesce(state["last_us"] == p["us"], F.lit(False))
        before = F.when(again, state["before"]).otherwise(state["last"])
        gained = F.when(again, state["gained"]).otherwise(state["increase"])
        return F.struct(
            F.when(again, state["n"]).otherwise(state["n"] + 1).alias("n"),
            F.when(before.isNull(), p["value"]).otherwise(state["first"]).alias("first"),
            p["value"].alias("last"),
            F.coalesce(state["first_us"], p["us"]).alias("first_us"),
            p["us"].alias("last_us"),
            F.when(before.isNull(), F.lit(0.0)).otherwise(gained + _rise(before, p["value"])).alias("increase"),
            before.alias("before"),
            gained.alias("gained"),
        )

    kinds = {"n": "0L", "increase": "0D", "gained": "0D", "first_us": "CAST(NULL AS BIGINT)", "last_us": "CAST(NULL AS BIGINT)"}
    begin = F.struct(*[F.expr(kinds.get(n, "CAST(NULL AS DOUBLE)")).alias(n) for n in (*_KEPT, "before", "gained")])
    # Sorted by (us, value): the last of each instant is the highest.
    return F.aggregate(F.sort_array(points), begin, follow, lambda state: _struct(**{n: state[n] for n in _KEPT}))


def _merged(buckets: Column) -> Column:
    """Buckets of a series in order of time as one; NULL for none."""

    def join(a: Column, b: Column) -> Column:
        return _struct(
            n=a["n"] + b["n"], first=a["first"], first_us=a["first_us"], last=b["last"], last_us=b["last_us"],
            increase=a["increase"] + _rise(a["last"], b["first"]) + b["increase"],
        )

    rest = F.slice(buckets, 2, F.greatest(F.size(buckets) - 1, F.lit(0)))
    return F.when(F.size(buckets) > 0, F.aggregate(rest, F.get(buckets, F.lit(0)), join))


def feature_matrix_stream(
    samples: DataFrame,
    features: list[Feature] = FEATURES,
    step: float = 15.0,
    windows: dict[str, float] | None = None,
    subquery_step: float = 60.0,
    extrapolate: bool = True,
    delay: str = "10 minutes",
) -> DataFrame:
    """``series.feature_matrix`` of a stream of samples, in append mode: the same rows, however the samples arrive.

    Samples may come late by the delay; a row is sent once the watermark has passed the windows that end at its time.
    Each aggregation works on what the one before sends: samples to buckets (per series), buckets to windows (per
    series, where resets between buckets are found), windows to one row per step (over all series), and rows to
    deviations over the last minutes. State is held until the watermark passes: the samples of open buckets, one
    summary per bucket and window, one row per step. Samples without a value or time do not count; every sample,
    also of other metrics, moves the watermark.
    """
    windows = windows or READS
    if subquery_step % step:
        raise ValueError("subquery_step must be a multiple of step")
    hop, longest = micros(step), max(map(micros, windows.values()))
    bucket = reduce(gcd, map(micros, windows.values()), hop)

    def window(of: str, length: int, name: str, slide: int | None = None) -> Column:
        return F.window(of, f"{length} microseconds", slide and f"{slide} microseconds").alias(name)

    # Spark's windows hold their start and not their end, these their end: samples move by a microsecond.
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) - 1)
    rows = samples.withColumn("at", at).withWatermark("at", delay)
    wanted = F.col("metric").isin(feature_metrics(features)) & F.col("value").isNotNull()
    # One condition with the time in it stays above the watermark, which other samples thus move as well.
    rows = rows.filter(F.when(F.col("at").isNotNull(), wanted))
    point = F.struct((F.unix_micros("at") + 1).alias("us"), F.col("value").cast("double").alias("value"))
    buckets = rows.groupBy(window("at", bucket, "bucket"), "metric", series_key().alias("series")).agg(F.collect_list(point).alias("points"))
    buckets = buckets.select("bucket", "metric", "series", _summary(F.col("points")).alias("kept"))

    seen = buckets.groupBy(window("bucket", longest, "span", hop), "metric", "series").agg(
        F.array_sort(F.collect_list(F.struct(F.col("kept.last_us").alias("us"), "kept"))).alias("seen")
    )
    end = F.unix_micros("span.end")

    def within(length: int) -> Column:
        # Windows are whole buckets, so a bucket is inside if its last sample is.
        return F.transform(F.filter("seen", lambda b: b["us"] > end - length), lambda b: b["kept"])

    stats = seen.select(
        "span", F.col("span.end").alias("ts"), "metric", F.map_from_entries("series").alias("labels"),
        *[_merged(within(micros(length))).alias(name) for name, length in windows.items()],
    )
    # The aggregates read the time of the row as ``ts``, which is the end of every window of the group.
    wide = stats.groupBy(window("span", hop, "tick")).agg(*feature_columns(features, windows, extrapolate))
    names = [f.name for f in features]
    spreads = {f.name: f.stddev_minutes for f in features if f.stddev_minutes}
    if not spreads:
        return wide.select(F.col("tick.end").alias("ts"), *names)

    inner = micros(subquery_step)
    reach = {name: inner * minutes for name, minutes in spreads.items()}
    # A window stands for the row at its end, the newest in it.
    rows = wide.select("tick", F.unix_micros("tick.end").alias("us"), *names)
    around = rows.groupBy(window("tick", max(max(reach.values()), hop), "around", hop)).agg(
        F.collect_list(F.struct("us", *names)).alias("rows")
    )
    end = F.unix_micros("around.end")

    def deviation(name: str) -> Column:
        near = F.filter("rows", lambda r: (r["us"] > end - reach[name]) & (r["us"] % inner == 0) & r[name].isNotNull())
        values = F.transform(near, lambda r: r[name])
        mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
        squares = F.aggregate(F.transform(values, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v)
        return F.when(F.size(values) > 0, F.sqrt(squares / F.size(values)))

    now = F.get(F.filter("rows", lambda r: r["us"] == end), F.lit(0))
    found = around.select("around", "rows", now.alias("now")).filter("now IS NOT NULL")
    return found.select(F.col("around.end").alias("ts"), *[(deviation(n) if n in spreads else F.col("now")[n]).alias(n) for n in names])
