"""Metric time-series operators on samples ``(ts, metric, labels, value)``.

An evaluation at grid time ``t`` sees samples in ``(t - window, t]``; grid times
are whole multiples of the step since the epoch. A counter delta counts only
when both of its samples are inside the window.

Plan shape: copies of a sample collapse map-side; each series is cut into time
slices that overlap by one window (a sample near the end of a slice is repeated
in the next), so deltas, per-bucket partials and sliding merges all run inside
one shuffle on (metric, series, slice). No task ever holds a whole series.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brokerlens.operators.ordered import micros, running_totals

LOOKBACK = 300.0
SLICE = 3600.0


def label(name: str) -> Column:
    return F.col("labels")[name]


def series_key(labels: str = "labels") -> Column:
    """A label map as a sorted array, which can be grouped and joined on."""
    return F.array_sort(F.map_entries(labels))


def points(samples: DataFrame) -> DataFrame:
    """One value per (series, instant); copies keep the larger value, missing values are dropped."""
    return (
        samples.filter(F.col("value").isNotNull() & F.col("ts").isNotNull())
        .groupBy("metric", series_key().alias("series"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
        .agg(F.max("value").alias("value"))
    )


class _Grid:
    """Integer arithmetic of windows, steps, buckets and slices, all in microseconds."""

    def __init__(self, window: float, step: float, slice_seconds: float):
        self.window, self.step = micros(window), micros(step)
        if self.window <= 0 or self.step <= 0:
            raise ValueError("window and step must be positive")
        self.bucket = gcd(self.window, self.step)
        per_slice = -(-max(self.window, micros(slice_seconds)) // self.step)
        self.steps_per_slice = per_slice
        self.slice = per_slice * self.step

    def cut(self, pts: DataFrame) -> DataFrame:
        """Assign slices, repeating samples the next slice's windows still see."""
        home = F.ceil(F.col("us") / F.lit(self.slice))
        seen_next = F.col("us") > home * self.slice + self.step - self.window
        return pts.withColumn("slice", F.explode(F.when(seen_next, F.array(home, home + 1)).otherwise(F.array(home))))

    def to_grid(self, rows: DataFrame, bucket: Column) -> DataFrame:
        """Repeat a row for every grid index of its slice whose window holds its bucket."""
        first = F.ceil(bucket * self.bucket / F.lit(self.step))
        last = F.floor((bucket * self.bucket + (self.window - self.bucket)) / F.lit(self.step))
        low = F.greatest(first, (F.col("slice") - 1) * self.steps_per_slice + 1)
        high = F.least(last, F.col("slice") * self.steps_per_slice)
        return (
            rows.withColumn("_low", low)
            .withColumn("_high", high)
            .filter("_low <= _high")
            .withColumn("grid", F.explode(F.sequence("_low", "_high")))
            .drop("_low", "_high")
        )

    def time(self) -> Column:
        return F.timestamp_micros(F.col("grid") * self.step)


SERIES = ["metric", "series"]


COUNTER_FIELDS = ("n", "first", "first_us", "last_us", "increase")


def window_stats(
    samples: DataFrame,
    windows: dict[str, float],
    step: float,
    slice_seconds: float = SLICE,
    fields: tuple[str, ...] | None = None,
) -> DataFrame:
    """Statistics of every series in every window at every grid time, in one pass.

    ``windows`` names window lengths; each adds a struct column of that name with
    n, sum, min, max, last, first_us, last_us, first, increase, changes (or those
    in ``fields``). A grid time where every window is empty has no row.
    """
    grid = _Grid(max(windows.values()), step, slice_seconds)
    for seconds in windows.values():
        grid.bucket = gcd(grid.bucket, micros(seconds))
    order = W.partitionBy(*SERIES, "slice").orderBy("us")
    prev, value = F.col("prev"), F.col("value")
    rows = (
        grid.cut(points(samples))
        .withColumn("prev", F.lag("value").over(order))
        .withColumn("delta", F.when(prev.isNotNull(), F.when(value < prev, value).otherwise(value - prev)))
        .withColumn("changed", F.when(prev.isNotNull(), (value != prev).cast("bigint")))
    )
    partial = rows.groupBy(*SERIES, "slice", F.ceil(F.col("us") / F.lit(grid.bucket)).alias("bucket")).agg(
        F.count("*").alias("n"),
        F.sum("value").alias("total"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.min_by("value", "us").alias("first"),
        F.max_by("value", "us").alias("last"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.sum("delta").alias("delta"),
        F.min_by("delta", "us").alias("entering"),
        F.sum("changed").alias("changed"),
        F.min_by("changed", "us").alias("entering_change"),
    )
    spread = grid.to_grid(partial, F.col("bucket"))
    aggregates = []
    for name, seconds in windows.items():
        inside = F.col("bucket") * grid.bucket > F.col("grid") * grid.step - micros(seconds)

        def only(column, inside=inside):
            return F.when(inside, F.col(column))

        # The first delta of a window starts outside it, so it is taken off again.
        in_bucket = only("bucket")
        stats = {
            "n": F.sum(only("n")),
            "sum": F.sum(only("total")),
            "min": F.min(only("low")),
            "max": F.max(only("high")),
            "last": F.max_by("last", in_bucket),
            "first": F.min_by("first", in_bucket),
            "first_us": F.min(only("first_us")),
            "last_us": F.max(only("last_us")),
            "increase": F.coalesce(F.sum(only("delta")), F.lit(0.0))
            - F.coalesce(F.min_by("entering", in_bucket), F.lit(0.0)),
            "changes": F.coalesce(F.sum(only("changed")), F.lit(0))
            - F.coalesce(F.min_by("entering_change", in_bucket), F.lit(0)),
        }
        aggregates.append(F.struct(*[stats[f].alias(f) for f in fields or stats]).alias(name))
    merged = spread.groupBy(*SERIES, "slice", "grid").agg(*aggregates)
    return merged.select(
        grid.time().alias("ts"), "metric", F.map_from_entries("series").alias("labels"), *list(windows)
    )


def _extrapolated(stats: Column, end_us: Column, window: int) -> Column:
    """Increase scaled to the window edges, as the public metric query language defines it."""
    sampled = (stats["last_us"] - stats["first_us"]).cast("double")
    gap = sampled / (stats["n"] - 1)
    limit = gap * 1.1
    to_start = (stats["first_us"] - (end_us - window)).cast("double")
    to_end = (end_us - stats["last_us"]).cast("double")
    to_start = F.when(to_start >= limit, gap / 2).otherwise(to_start)
    to_zero = F.when(
        (stats["increase"] > 0) & (stats["first"] >= 0), sampled * (stats["first"] / stats["increase"])
    )
    to_start = F.least(to_start, to_zero)
    to_end = F.when(to_end >= limit, gap / 2).otherwise(to_end)
    return stats["increase"] * (sampled + to_start + to_end) / sampled


def counter_value(stats: Column, ts: Column, window: float, per_second: bool, extrapolate: bool) -> Column:
    """Increase or rate out of window statistics; NULL with fewer than two samples."""
    covered = (stats["last_us"] - stats["first_us"]) / F.lit(1e6)
    if extrapolate:
        value = _extrapolated(stats, F.unix_micros(ts), micros(window))
        value = value / F.lit(float(window)) if per_second else value
    else:
        value = stats["increase"] / covered if per_second else stats["increase"]
    return F.when(stats["n"] >= 2, value)


def _finish(df: DataFrame, value: Column) -> DataFrame:
    return df.select("ts", "metric", "labels", value.cast("double").alias("value")).filter(F.col("value").isNotNull())


def rate(samples: DataFrame, window: float, step: float, extrapolate: bool = True, slice_seconds: float = SLICE):
    """Reset-corrected increase per second; without extrapolation, over the covered span."""
    stats = window_stats(samples, {"w": window}, step, slice_seconds, COUNTER_FIELDS)
    return _finish(stats, counter_value(F.col("w"), F.col("ts"), window, True, extrapolate))


def increase(samples: DataFrame, window: float, step: float, extrapolate: bool = True, slice_seconds: float = SLICE):
    stats = window_stats(samples, {"w": window}, step, slice_seconds, COUNTER_FIELDS)
    return _finish(stats, counter_value(F.col("w"), F.col("ts"), window, False, extrapolate))


def changes(samples: DataFrame, window: float, step: float, slice_seconds: float = SLICE) -> DataFrame:
    """How often the value changed inside each window."""
    stats = window_stats(samples, {"w": window}, step, slice_seconds, ("n", "changes"))
    return _finish(stats, F.when(F.col("w.n") > 0, F.col("w.changes")))


def over_time(samples: DataFrame, fn: str, window: float, step: float, slice_seconds: float = SLICE) -> DataFrame:
    """avg, min, max, sum, count, last or (population) stddev of the samples in each window."""
    if fn == "stddev":
        return _deviation_over_time(samples, window, step, slice_seconds)
    fields = {"avg": ("sum", "n"), "count": ("n",)}.get(fn, (fn,))
    stats, w = window_stats(samples, {"w": window}, step, slice_seconds, fields), F.col("w")
    value = w["sum"] / w["n"] if fn == "avg" else w["n"] if fn == "count" else w[fn]
    return _finish(stats, value)


def _deviation_over_time(samples: DataFrame, window: float, step: float, slice_seconds: float) -> DataFrame:
    """Population deviation in each window out of one row of moments per bucket: no sample is repeated.

    A bucket keeps its count, mean and squared deviation from it. A window adds up its buckets' squared deviations and
    those of their means from its own mean; both are sums of squares, so large values lose no digits.
    """
    grid = _Grid(window, step, slice_seconds)
    grid.bucket = gcd(grid.bucket, micros(window))
    rows = grid.cut(points(samples)).withColumn("bucket", F.ceil(F.col("us") / F.lit(grid.bucket)))
    buckets = rows.groupBy(*SERIES, "slice", "bucket").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("inner")
    )
    spread = grid.to_grid(buckets, F.col("bucket"))
    cell = [*SERIES, "slice", "grid"]
    whole = W.partitionBy(*cell)
    centre = F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    between = F.col("n") * (F.col("mean") - F.col("centre")) * (F.col("mean") - F.col("centre"))
    merged = spread.withColumn("centre", centre).groupBy(*cell).agg(
        F.sqrt((F.sum("inner") + F.sum(between)) / F.sum("n")).alias("value")
    )
    return merged.select(grid.time().alias("ts"), "metric", F.map_from_entries("series").alias("labels"), "value")


def subquery_over_time(inner: DataFrame, fn: str, window: float, step: float, slice_seconds: float = SLICE):
    """``fn`` over the last ``window`` of an inner result that is already on its own grid."""
    return over_time(inner, fn, window, step, slice_seconds)


def latest(samples: DataFrame, at=None, lookback: float = LOOKBACK) -> DataFrame:
    """Newest value of each series not older than ``lookback`` at time ``at`` (default: all samples)."""
    rows = samples.filter(F.col("value").isNotNull())
    if at is not None:
        end = F.to_timestamp(F.lit(at))
        start = F.timestamp_micros(F.unix_micros(end) - micros(lookback))
        rows = rows.filter((F.col("ts") <= end) & (F.col("ts") > start))
    newest = F.max(F.struct("ts", "value"))
    return (
        rows.groupBy("metric", series_key().alias("series"))
        .agg(newest.alias("new"))
        .select("new.ts", "metric", F.map_from_entries("series").alias("labels"), "new.value")
    )


def first_result(samples: DataFrame, by: list[str]) -> DataFrame:
    """One value per group: the one whose labels sort first."""
    return samples.groupBy(*by).agg(F.min(F.struct(series_key().alias("k"), "value"))["value"].alias("value"))


AGGREGATES = {
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "stddev": F.stddev_pop,
    "count": lambda c: F.count(c).cast("double"),
}


def agg_series(df: DataFrame, fn: str, by: list[str] = ()) -> DataFrame:
    """Aggregate across series at each time, keeping only the labels in ``by``."""
    kept = [F.coalesce(label(name), F.lit("")).alias(name) for name in by]
    grouped = df.select("ts", "metric", *kept, "value").groupBy("ts", "metric", *by)
    out = grouped.agg(AGGREGATES[fn]("value").alias("value"))
    pairs = [part for name in by for part in (F.lit(name), F.col(name))]
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return out.select("ts", "metric", (F.create_map(*pairs) if pairs else empty).alias("labels"), "value")


def histogram_quantile(buckets: DataFrame, q: float, by: list[str] = ()) -> DataFrame:
    """Quantile from cumulative bucket rates, linear inside the bucket that holds the rank.

    Input labels carry ``le``. Buckets of a group are summed first, so the array
    built per group has one entry per distinct bound, not per row.
    """
    kept = [F.coalesce(label(name), F.lit("")).alias(name) for name in by]
    bound = F.when(F.lower(label("le")).isin("+inf", "inf"), F.lit(float("inf"))).otherwise(
        label("le").try_cast("double")
    )
    sums = (
        buckets.select("ts", *kept, bound.alias("le"), "value")
        .filter(F.col("le").isNotNull())
        .groupBy("ts", *by, "le")
        .agg(F.sum("value").alias("c"))
    )
    sorted_buckets = F.array_sort(F.collect_list(F.struct("le", "c")))
    grouped = sums.groupBy("ts", *by).agg(sorted_buckets.alias("b"))
    # Counts must not fall from one bound to the next; keep the running maximum.
    running = F.transform(
        "b", lambda x, i: F.struct(x["le"].alias("le"), F.array_max(F.slice("b", 1, i + 1)["c"]).alias("c"))
    )
    total = F.element_at("b", -1)["c"]
    rank = F.lit(float(q)) * total
    at = F.array_position(F.transform("b", lambda x: x["c"] >= rank), True).cast("int")
    low = F.when(at > 1, F.get("b", at - 2)["le"]).otherwise(0.0)
    below = F.when(at > 1, F.get("b", at - 2)["c"]).otherwise(0.0)
    here = F.get("b", at - 1)
    nan = F.lit(float("nan"))
    inside = low + (here["le"] - low) * F.coalesce(F.try_divide(rank - below, here["c"] - below), nan)
    value = (
        F.when(F.lit(q < 0), F.lit(float("-inf")))
        .when(F.lit(q > 1), F.lit(float("inf")))
        .when((F.size("b") < 2) | (F.element_at("b", -1)["le"] != float("inf")) | (total == 0), nan)
        .when(at == F.size("b"), F.get("b", F.size("b") - 2)["le"])
        .when((at == 1) & (here["le"] <= 0), here["le"])
        .otherwise(inside)
    )
    return grouped.withColumn("b", running).select("ts", *by, value.alias("value"))


OPERATORS = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.when(b != 0, a / b),
}


def binary(a: DataFrame, b: DataFrame, op: str, on: list[str] | None = None) -> DataFrame:
    """Arithmetic between series with equal time and labels (all labels, or those in ``on``)."""
    key = series_key() if on is None else F.array(*[F.coalesce(label(n), F.lit("")) for n in on])
    left = a.select("ts", key.alias("k"), "metric", "labels", F.col("value").alias("x"))
    right = b.select("ts", key.alias("k"), F.col("value").alias("y"))
    joined = left.join(right, ["ts", "k"])
    return joined.select("ts", "metric", "labels", OPERATORS[op](F.col("x"), F.col("y")).alias("value"))


def scalar(df: DataFrame, op: str, number: float) -> DataFrame:
    return df.withColumn("value", OPERATORS[op](F.col("value"), F.lit(float(number))))


def or_series(a: DataFrame, b: DataFrame) -> DataFrame:
    """All of ``a`` plus those of ``b`` whose time and labels ``a`` lacks."""
    keys = a.select("ts", series_key().alias("k")).distinct()
    extra = b.withColumn("k", series_key()).join(keys, ["ts", "k"], "left_anti").drop("k")
    return a.unionByName(extra.select(*a.columns))


def filter_series(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def summary_mean(samples: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Mean of a summary: its sum series divided by its count series, per label set or summed first."""
    parts = []
    for suffix in ("sum", "count"):
        part = samples.filter(F.col("metric") == f"{name}_{suffix}").withColumn("metric", F.lit(name))
        parts.append(part if by is None else agg_series(part, "sum", by))
    return binary(parts[0], parts[1], "/")


def label_values(samples: DataFrame, metric: str, name: str) -> DataFrame:
    rows = samples.filter(F.col("metric") == metric).select(label(name).alias(name))
    return rows.filter(F.col(name).isNotNull()).distinct()


def success_ratio(df: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """Percentage of rows where ``ok`` holds, per key, in one conditional aggregate."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("successes"),
        (F.count_if(ok) / F.count("*") * 100).alias("success_percent"),
    )


def used_percent(df: DataFrame, total: Column, available: Column) -> Column:
    """Used share in percent, NULL for a total of zero."""
    return F.when(total != 0, (total - available) / total * 100)


# ---------------------------------------------------------------- event rows to series


def to_counter(events: DataFrame, metric: str, labels: list[str], ts: str = "ts", value: Column | None = None):
    """Running count of events (or running sum of ``value``) per label set, one sample per instant."""
    amount = F.lit(1.0) if value is None else value.cast("double")
    steps = events.groupBy(*labels, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us")).agg(
        F.sum(amount).alias("value")
    )
    return _as_samples(running_totals(steps, labels, ["value"]), metric, labels, "COUNTER")


def to_summary(events: DataFrame, metric: str, labels: list[str], value: Column, ts: str = "ts") -> DataFrame:
    """The sum and count series of a summary."""
    steps = events.groupBy(*labels, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us")).agg(
        F.sum(value.cast("double")).alias("sum"), F.count(value).cast("double").alias("count")
    )
    totals = running_totals(steps, labels, ["sum", "count"])
    long = totals.unpivot([*labels, "_us"], ["sum", "count"], "part", "value")
    named = _as_samples(long.withColumn("part", F.concat(F.lit(f"{metric}_"), "part")), None, labels, "SUMMARY")
    return named


def to_histogram(events: DataFrame, metric: str, labels: list[str], value: Column, bounds: list[float], ts="ts"):
    """Cumulative bucket series, one per bound and +Inf."""
    names = [str(b) for b in bounds] + ["+Inf"]
    counts = [F.count_if(value <= b).cast("double").alias(n) for b, n in zip(bounds, names)]
    counts.append(F.count(value).cast("double").alias("+Inf"))
    renamed = [f"b{i}" for i in range(len(names))]
    steps = events.groupBy(*labels, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us")).agg(
        *[c.alias(r) for c, r in zip(counts, renamed)]
    )
    totals = running_totals(steps, labels, renamed)
    long = totals.unpivot([*labels, "_us"], renamed, "le", "value")
    text = F.create_map(*[x for r, n in zip(renamed, names) for x in (F.lit(r), F.lit(n))])
    return _as_samples(long.withColumn("le", text[F.col("le")]), f"{metric}_bucket", [*labels, "le"], "HISTOGRAM")


def to_one_hot(events: DataFrame, metric: str, column: str, names: list[str], ts: str = "ts") -> DataFrame:
    """A gauge per known name: 1 for the current one, 0 for the others."""
    state = F.explode(F.array(*[F.lit(n) for n in names])).alias("name")
    rows = events.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), F.col(column).alias("_now"), state)
    rows = rows.withColumn("value", (F.col("_now") == F.col("name")).cast("double")).withColumnRenamed("name", column)
    return _as_samples(rows, metric, [column], "GAUGE")


@dataclass(frozen=True)
class SeriesSpec:
    """One metric made out of event rows; ``kind`` is COUNTER, SUMMARY, HISTOGRAM or GAUGE (one-hot)."""

    metric: str
    kind: str
    labels: tuple[str, ...] = ()
    value: str | None = None
    bounds: tuple[float, ...] = ()
    names: tuple[str, ...] = ()


# Latency bounds in seconds of the classification histogram.
LATENCY_BOUNDS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0)


def to_series(events: DataFrame, specs: list[SeriesSpec], ts: str = "ts") -> DataFrame:
    """All the series the specs describe, as one sample table."""

    def one(spec: SeriesSpec) -> DataFrame:
        labels, value = list(spec.labels), None if spec.value is None else F.col(spec.value)
        if spec.kind == "COUNTER":
            return to_counter(events, spec.metric, labels, ts, value)
        if spec.kind == "SUMMARY":
            return to_summary(events, spec.metric, labels, value, ts)
        if spec.kind == "HISTOGRAM":
            return to_histogram(events, spec.metric, labels, value, list(spec.bounds or LATENCY_BOUNDS), ts)
        return to_one_hot(events, spec.metric, labels[0], list(spec.names), ts)

    return reduce(DataFrame.unionByName, map(one, specs))


def _as_samples(df: DataFrame, metric: str | None, labels: list[str], kind: str) -> DataFrame:
    pairs = [part for n in labels for part in (F.lit(n), F.col(n).cast("string"))]
    return df.select(
        F.timestamp_micros("_us").alias("ts"),
        (F.col("part") if metric is None else F.lit(metric)).alias("metric"),
        F.create_map(*pairs).alias("labels"),
        F.col("value").cast("double").alias("value"),
        F.lit(kind).alias("kind"),
    )


# ---------------------------------------------------------------- feature rows


@dataclass(frozen=True)
class Feature:
    """One feature column: how one or two metrics become one number per grid time.

    ``read`` is instant, rate_5m or rate_1m; ``agg`` combines series at a time.
    """

    name: str
    metric: str
    read: str = "instant"
    agg: str = "first"
    scale: float = 1.0
    match: dict = field(default_factory=dict, hash=False)
    divide_by: "Feature | None" = None
    stddev_minutes: int = 0


# The metric behind each feature, its window, aggregate and factor.
_MESSAGES = "kafka_server_brokertopicmetrics_messagesin_total"
_BYTES = "kafka_server_brokertopicmetrics_bytesin_total"
_HEAP = "java_lang_memory_heapmemoryusage_used"
_REQUESTS = "kafka_server_brokertopicmetrics_totalproducerequests_total"
_LATENCY = "kafka_network_requestmetrics_totaltimems"
FEATURES = [
    Feature("workload_type", "workload_type"),
    Feature("message_rate", "message_rate"),
    Feature("payload_size", "payload_size"),
    Feature("batch_size", "batch_size"),
    Feature(_MESSAGES, _MESSAGES, "rate_5m", "sum"),
    Feature(_BYTES, _BYTES, "rate_5m", "sum"),
    Feature("message_size_bytes", _BYTES, "rate_5m", "sum", divide_by=Feature("", _MESSAGES, "rate_5m", "sum")),
    Feature("message_rate_variance", _MESSAGES, "rate_1m", "stddev"),
    Feature("process_cpu_seconds_total", "process_cpu_seconds_total", "rate_5m", "avg", 100.0),
    Feature(_HEAP, _HEAP, "instant", "avg"),
    Feature("node_disk_io_time_seconds_total", "node_disk_io_time_seconds_total", "rate_5m", "sum", 100.0),
    Feature("memory_usage_variance", _HEAP, "instant", "stddev", divide_by=Feature("", _HEAP, "instant", "avg")),
    Feature(_LATENCY, _LATENCY, "rate_1m", "avg", match={"request": "Produce"}),
    Feature(_REQUESTS, _REQUESTS, "rate_5m", "sum"),
    Feature("java_lang_threading_threadcount", "java_lang_threading_threadcount", "instant", "avg"),
    Feature("request_rate_variance", _REQUESTS, "rate_1m", "sum", stddev_minutes=15),
    Feature("node_memory_MemAvailable_bytes", "node_memory_MemAvailable_bytes", "instant", "avg"),
    Feature("node_disk_read_bytes_total", "node_disk_read_bytes_total", "rate_1m", "sum"),
    Feature("node_disk_write_bytes_total", "node_disk_written_bytes_total", "rate_1m", "sum"),
]


#: How far the kinds of reading look back.
READS = {"instant": LOOKBACK, "rate_5m": 300.0, "rate_1m": 60.0}


def feature_metrics(features: list[Feature]) -> list[str]:
    return sorted({f.metric for f in features} | {f.divide_by.metric for f in features if f.divide_by})


def feature_columns(features: list[Feature], windows: dict[str, float], extrapolate: bool) -> list[Column]:
    """Aggregates over the window statistics of all series at one time, one per feature."""

    def one(f: Feature) -> Column:
        stat = F.col(f.read)
        value = stat["last"]
        if f.read != "instant":
            value = counter_value(stat, F.col("ts"), windows[f.read], True, extrapolate)
        chosen = F.col("metric") == f.metric
        for name, text in f.match.items():
            chosen = chosen & (label(name) == text)
        value = F.when(chosen, value * f.scale if f.scale != 1.0 else value)
        if f.agg == "first":
            return F.min(F.when(value.isNotNull(), F.struct(series_key().alias("k"), value.alias("v"))))["v"]
        return AGGREGATES[f.agg](value)

    def column(f: Feature) -> Column:
        if f.divide_by is None:
            return one(f).alias(f.name)
        bottom = one(f.divide_by)
        return F.when(bottom != 0, one(f) / bottom).alias(f.name)

    return [column(f) for f in features]


def feature_matrix(
    samples: DataFrame,
    features: list[Feature] = FEATURES,
    step: float = 15.0,
    windows: dict[str, float] | None = None,
    subquery_step: float = 60.0,
    extrapolate: bool = True,
    slice_seconds: float = SLICE,
) -> DataFrame:
    """One row per step, one column per feature, NULL where nothing could be computed.

    All windows of all metrics come from one pass over the samples and one
    grouping by time; only the stddev-over-minutes features look at neighbouring
    rows, and those come from the already aggregated, one-row-per-step table.
    """
    windows = windows or READS
    if subquery_step % step:
        raise ValueError("subquery_step must be a multiple of step")
    known = samples.filter(F.col("metric").isin(feature_metrics(features)))
    stats = window_stats(known, windows, step, slice_seconds, (*COUNTER_FIELDS, "last"))
    wide = stats.groupBy("ts").agg(*feature_columns(features, windows, extrapolate))
    for f in features:
        if f.stddev_minutes:
            wide = _stddev_over(wide, f, step, subquery_step, slice_seconds)
    return wide.select("ts", *[f.name for f in features])


def _stddev_over(wide: DataFrame, f: Feature, step: float, inner_step: float, slice_seconds: float) -> DataFrame:
    us, inner = F.unix_micros("ts"), micros(inner_step)
    on_grid = wide.filter((us % inner == 0) & F.col(f.name).isNotNull()).select(
        "ts", F.lit(f.name).alias("metric"), F.create_map().cast("map<string,string>").alias("labels"),
        F.col(f.name).alias("value"),
    )
    spread = over_time(on_grid, "stddev", inner_step * f.stddev_minutes, step, slice_seconds)
    spread = spread.select("ts", F.col("value").alias(f.name))
    return wide.drop(f.name).join(spread, "ts", "left")
