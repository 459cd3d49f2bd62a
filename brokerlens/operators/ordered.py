"""Time-ordered building blocks that never put a whole key in one task.

Rows are first reduced to one row per (key, instant), which collapses copies
map-side. A key is then cut into time slices, so a window function sees at most
one slice of one key. What a slice needs from its neighbours arrives as one
*seed row* per slice; finding it reads one row per (key, slice), a number
bounded by the covered time divided by the slice width, whatever the row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Short slices keep tasks small; a year of one key is still only 105,120 seed rows.
DEFAULT_SLICE = 300.0


def micros(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def instants(df: DataFrame, keys: list[str], ts: str, aggregates: dict[str, Column]) -> DataFrame:
    """One row per (key, instant) with the given aggregates; ``_us`` is epoch microseconds."""
    return (
        df.filter(F.col(ts).isNotNull())
        .groupBy(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
        .agg(*[column.alias(name) for name, column in aggregates.items()])
    )


def sliced(rows: DataFrame, width: float) -> DataFrame:
    return rows.withColumn("_slice", F.floor(F.col("_us") / F.lit(micros(width))))


def _edges(rows: DataFrame, keys: list[str], valid: Column, earlier: bool) -> DataFrame:
    """Per slice, the nearest valid row of any earlier (later) slice of the key, as a seed row."""
    rest = [c for c in rows.columns if c not in (*keys, "_us", "_slice")]
    row = F.struct("_us", *rest)
    pick = F.max if earlier else F.min
    per_slice = rows.groupBy(*keys, "_slice").agg(pick(F.when(valid, row)).alias("_edge"))
    order = F.col("_slice").asc() if earlier else F.col("_slice").desc()
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (
        per_slice.withColumn("_edge", F.last("_edge", ignorenulls=True).over(before))
        .filter(F.col("_edge").isNotNull())
        .select(*keys, "_slice", "_edge.*", F.lit(True).alias("_seed"))
    )


def _seeded(rows: DataFrame, keys: list[str], valid: Column, sides: tuple[bool, ...]) -> DataFrame:
    out = rows.withColumn("_seed", F.lit(False))
    for earlier in sides:
        out = out.unionByName(_edges(rows, keys, valid, earlier))
    return out


def with_previous(rows: DataFrame, keys: list[str], columns: dict[str, str], width: float = DEFAULT_SLICE) -> DataFrame:
    """Add, per row, values of the row before it: ``columns`` maps source name to new name."""
    return _with_neighbour(rows, keys, columns, width, earlier=True)


def with_next(rows: DataFrame, keys: list[str], columns: dict[str, str], width: float = DEFAULT_SLICE) -> DataFrame:
    """Add, per row, values of the row after it."""
    return _with_neighbour(rows, keys, columns, width, earlier=False)


def _with_neighbour(rows, keys, columns, width, earlier):
    seeded = _seeded(sliced(rows, width), keys, F.lit(True), (earlier,))
    window = W.partitionBy(*keys, "_slice").orderBy("_us")
    move = F.lag if earlier else F.lead
    return (
        seeded.select("*", *[move(src).over(window).alias(new) for src, new in columns.items()])
        .filter(~F.col("_seed"))
        .drop("_seed", "_slice")
    )


def last_seen(
    rows: DataFrame, keys: list[str], marks: dict[str, tuple[Column, bool]], width: float = DEFAULT_SLICE
) -> DataFrame:
    """Add, per mark, the ``_us`` of the last row where its condition held.

    A mark is (condition, strict); strict looks only at earlier rows.
    """
    cut = sliced(rows, width)
    flagged = cut.select("*", *[F.when(cond, F.col("_us")).alias(f"_at_{n}") for n, (cond, _) in marks.items()])
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    totals = flagged.groupBy(*keys, "_slice").agg(*[F.max(f"_at_{n}").alias(f"_at_{n}") for n in marks])
    seeds = totals.select(*keys, "_slice", *[F.max(f"_at_{n}").over(before).alias(f"_at_{n}") for n in marks])
    seeds = seeds.withColumn("_seed", F.lit(True))
    out = flagged.withColumn("_seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True)
    window = W.partitionBy(*keys, "_slice").orderBy(F.col("_seed").desc(), "_us")
    added = []
    for name, (_, strict) in marks.items():
        frame = window.rowsBetween(W.unboundedPreceding, -1 if strict else 0)
        added.append(F.max(f"_at_{name}").over(frame).alias(name))
    return out.select("*", *added).filter(~F.col("_seed")).select(*rows.columns, *marks)


def running_totals(
    rows: DataFrame, keys: list[str], columns: list[str], width: float = DEFAULT_SLICE, keep: dict[str, str] = {}
) -> DataFrame:
    """Replace each column by its running sum over time within the key.

    ``keep`` also copies columns unsummed; ``_first_us`` is the key's first instant.
    """
    copies = [F.col(source).alias(name) for source, name in keep.items()]
    cut = sliced(rows, width).select(*keys, "_slice", "_us", F.col("_us").alias("_first_us"), *columns, *copies)
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_slice").agg(F.min("_us").alias("_first_us"), *[F.sum(c).alias(c) for c in columns])
    seeds = totals.select(
        *keys,
        "_slice",
        F.lit(None).cast("bigint").alias("_us"),
        F.min("_first_us").over(before).alias("_first_us"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in columns],
    )
    window = (
        W.partitionBy(*keys, "_slice").orderBy(F.col("_us").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    )
    return (
        cut.unionByName(seeds, allowMissingColumns=True)
        .select(
            *keys,
            "_us",
            F.min("_first_us").over(window).alias("_first_us"),
            *[F.sum(c).over(window).alias(c) for c in columns],
            *keep.values(),
        )
        .filter(F.col("_us").isNotNull())
    )
