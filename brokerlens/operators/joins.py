"""Join-shaped operators: as-of, nearest, interval, label and dimension joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brokerlens.operators import series
from brokerlens.operators.ordered import DEFAULT_SLICE, micros, sliced

_START, _END = -(2**62), 2**62


def _fill(rows: DataFrame, by: list[str], width: float, modes: list[str]) -> DataFrame:
    """For each left instant, the nearest right row at or before it (``_back``) and at or after it (``_ahead``).

    A slice gets what it cannot see as rows at the start and the end of its time:
    the last right row of the slices before it and the first of those after it.
    """
    cut = sliced(rows, width)
    edges = cut.groupBy(*by, "_slice").agg(F.max("_right").alias("_last"), F.min("_right").alias("_first"))
    outer = W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    carried = {
        "_back": (_START, F.last("_last", ignorenulls=True).over(outer.orderBy("_slice"))),
        "_ahead": (_END, F.last("_first", ignorenulls=True).over(outer.orderBy(F.desc("_slice")))),
    }
    named = edges.select(*by, "_slice", *[carried[m][1].alias(m) for m in modes])
    ends = [F.struct(F.lit(carried[m][0]).alias("_us"), F.col(m).alias("_right")) for m in modes]
    seeds = named.select(*by, "_slice", F.lit(0).alias("_side"), F.explode(F.array(*ends)).alias("_e"))
    seeds = seeds.select(*by, "_slice", "_side", "_e.*").filter("_right IS NOT NULL")
    inner = W.partitionBy(*by, "_slice").rowsBetween(W.unboundedPreceding, 0)
    order = {"_back": F.asc("_us"), "_ahead": F.desc("_us")}
    found = cut.select(*by, "_slice", "_us", "_side", "_right").unionByName(seeds)
    nearest = [F.last("_right", ignorenulls=True).over(inner.orderBy(order[m], "_side")).alias(m) for m in modes]
    return found.select(*by, "_us", "_side", *nearest).filter("_side = 1").drop("_side")


def _asof(left, right, on_ts, by, modes, width, right_ts=None):
    """Left rows with ``_back`` and/or ``_ahead``: the matched right row as a struct led by ``_us``.

    Instants are matched, not rows: left copies collapse first and are joined
    back on (key, instant), where adaptive execution may split a hot key.
    """
    left = left.withColumn("_us", F.unix_micros(F.col(on_ts).cast("timestamp")))
    us = F.unix_micros(F.col(right_ts or on_ts).cast("timestamp"))
    payload = [c for c in right.columns if c not in by]
    facts = right.withColumn("_us", us).filter("_us IS NOT NULL")
    # Of several rows at an instant the smallest; maps have no order, so they travel as sorted entries.
    maps = [c for c in payload if isinstance(right.schema[c].dataType, T.MapType)]
    held = [F.array_sort(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in payload]
    facts = facts.groupBy(*by, "_us").agg(F.min(F.struct(*held)).alias("_p"))
    facts = facts.select(*by, "_us", F.lit(0).alias("_side"), F.struct("_us", "_p.*").alias("_right"))
    asked = left.filter("_us IS NOT NULL").select(*by, "_us").distinct()
    asked = asked.withColumn("_side", F.lit(1))
    rows = facts.unionByName(asked, allowMissingColumns=True)
    found = _fill(rows, by, width, modes)
    for mode in modes if maps else ():
        match = F.col(mode)
        fields = [F.map_from_entries(match[c]).alias(c) if c in maps else match[c].alias(c) for c in payload]
        whole = F.struct(match["_us"].alias("_us"), *fields)
        found = found.withColumn(mode, F.when(match.isNotNull(), whole))
    return left.join(found, [*by, "_us"], "left"), payload


def _named(match: Column, payload: list[str], prefix: str) -> list[Column]:
    return [match[c].alias(f"{prefix}{c}") for c in payload]


def asof_backward(
    left: DataFrame, right: DataFrame, on_ts: str, by: list[str] = (), prefix: str = "right_",
    width: float = DEFAULT_SLICE, right_ts: str | None = None,
) -> DataFrame:
    """Each left row with the newest right row not after it; columns of the match get the prefix."""
    joined, payload = _asof(left, right, on_ts, list(by), ["_back"], width, right_ts)
    return joined.select(*left.columns, *_named(F.col("_back"), payload, prefix))


def asof_nearest(
    left: DataFrame, right: DataFrame, on_ts: str, by: list[str] = (), prefix: str = "right_",
    width: float = DEFAULT_SLICE, right_ts: str | None = None,
) -> DataFrame:
    """Each left row with the right row nearest in time, before or after; ties go to the earlier one."""
    joined, payload = _asof(left, right, on_ts, list(by), ["_back", "_ahead"], width, right_ts)
    back, ahead = F.col("_back"), F.col("_ahead")
    nearer = (ahead["_us"] - F.col("_us")) < (F.col("_us") - back["_us"])
    match = F.when(back.isNull() | nearer, ahead).otherwise(back)
    joined = joined.withColumn("_match", match)
    gap = F.abs(F.col("_match._us") - F.col("_us")) / F.lit(1e6)
    return joined.select(*left.columns, *_named(F.col("_match"), payload, prefix), gap.alias("gap_seconds"))


def join_series(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Inner join of two series tables on time and labels (all, or those in ``on``)."""
    key = series.series_key() if on is None else F.array(*[series.label(n) for n in on])
    left = a.select("ts", key.alias("k"), "labels", F.col("value").alias("left_value"))
    right = b.select("ts", key.alias("k"), F.col("value").alias("right_value"))
    return left.join(right, ["ts", "k"]).drop("k")


# The configuration each recovery strategy stands for.
STRATEGY_CONFIGS = {
    "QUICK_REBALANCE": {
        "leader.imbalance.check.interval.seconds": "30",
        "leader.imbalance.per.broker.percentage": "10",
        "replica.lag.time.max.ms": "10000",
        "replica.fetch.max.bytes": "1048576",
        "num.replica.fetchers": "4",
        "rebalance.priority": "speed",
    },
    "RESOURCE_OPTIMIZED": {
        "leader.imbalance.check.interval.seconds": "300",
        "leader.imbalance.per.broker.percentage": "20",
        "replica.lag.time.max.ms": "30000",
        "replica.fetch.max.bytes": "524288",
        "num.replica.fetchers": "2",
        "rebalance.priority": "resource",
    },
    "CONTROLLED_GRADUAL": {
        "leader.imbalance.check.interval.seconds": "120",
        "leader.imbalance.per.broker.percentage": "25",
        "replica.lag.time.max.ms": "30000",
        "replica.fetch.max.bytes": "1048576",
        "num.replica.fetchers": "2",
        "rebalance.priority": "controlled",
    },
}


def strategy_dimension(spark) -> DataFrame:
    rows = list(STRATEGY_CONFIGS.items())
    return spark.createDataFrame(rows, "strategy string, config map<string,string>")


def with_strategy_config(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Look up the configuration of each row's strategy; unknown strategies get NULL.

    Adaptive execution chooses the join from the sizes it meets.
    """
    return df.join(dim, "strategy", "left")


def align_labels(
    predictions: DataFrame, actuals: DataFrame, on_ts: str, by: list[str] = (), actual: str = "actual",
    width: float = DEFAULT_SLICE,
) -> DataFrame:
    """Each prediction with the actual label in force at that time."""
    out = asof_backward(predictions, actuals, on_ts, by, prefix="_actual_", width=width)
    drop = [f"_actual_{c}" for c in actuals.columns if c not in by and c != actual]
    return out.withColumnRenamed(f"_actual_{actual}", actual).drop(*drop)


def around_events(
    events: DataFrame, samples: DataFrame, before: float, during: float, after: float, by: list[str] = (),
    end_ts: str = "end_ts", width: float = DEFAULT_SLICE,
) -> DataFrame:
    """Readings around each event: the last one within ``before`` seconds up to its start, the first
    from ``during`` seconds after its start, and the first from its end, each at most ``after`` seconds later.

    The three times of an event are rows of one as-of lookup, whose matches are then checked for distance and gathered
    per event; no range join is needed and dense readings cost nothing extra.
    """
    by = list(by)
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    end = F.unix_micros(F.col(end_ts).cast("timestamp"))
    readings = samples.filter("value IS NOT NULL").select(*by, "ts", "value")
    probes = {
        "value_before": (start, "_back", before),
        "value_during": (start + micros(during), "_ahead", after),
        "value_after": (end, "_ahead", after),
    }
    times = [F.struct(F.lit(name).alias("_name"), F.timestamp_micros(at).alias("_probe")) for name, (at, _, _) in probes.items()]
    asked = events.select(
        *by, F.struct(*events.columns).alias("_event"), F.monotonically_increasing_id().alias("_row"), F.array(*times).alias("_times")
    )
    asked = asked.select(*by, "_event", "_row", F.explode("_times").alias("_t")).select(*by, "_event", "_row", "_t.*")
    joined, _ = _asof(asked, readings, "_probe", by, ["_back", "_ahead"], width, right_ts="ts")

    def found(name: str, mode: str, reach: float) -> Column:
        close = F.abs(F.col(f"{mode}._us") - F.col("_us")) <= micros(reach)
        return F.max(F.when((F.col("_name") == name) & close, F.col(f"{mode}.value"))).alias(name)

    values = [found(name, mode, reach) for name, (_, mode, reach) in probes.items()]
    gathered = joined.groupBy("_row").agg(F.any_value("_event").alias("_event"), *values)
    return gathered.select("_event.*", *probes)


def within_period(df: DataFrame, period: DataFrame, ts: str = "timestamp", by: list[str] = ()) -> DataFrame:
    """Rows inside the closed [start, end] of their key's period, or (no ``by``) of a one-row period table."""
    if by:
        bounds = period.select(*by, F.col("recovery_start").alias("_start"), F.col("recovery_end").alias("_end"))
        inside = (F.col(ts) >= F.col("_start")) & (F.col(ts) <= F.col("_end"))
        return df.join(bounds, list(by)).filter(inside).select(*df.columns)
    start, end = period.agg(F.min("recovery_start")).scalar(), period.agg(F.max("recovery_end")).scalar()
    return df.filter((F.col(ts) >= start) & (F.col(ts) <= end))


def compare_configs(df: DataFrame, metric: str, by: list[str], config: str = "configuration") -> DataFrame:
    """Means of the two configurations side by side, with the difference."""
    means = {n: F.avg(F.when(F.col(config) == v, F.col(metric))).alias(n) for n, v in PAIR.items()}
    out = df.groupBy(*by).agg(*means.values())
    return out.withColumn("difference", F.col("adaptive") - F.col("baseline"))


# Names of the two compared configurations after recoding.
PAIR = {"baseline": "baseline", "adaptive": "ARMS"}
