"""Ranks and exact quantiles over any number of rows.

Equal values collapse to one counted row first. Values are then cut at sampled
quantiles into buckets of similar size; a window ranks one bucket of one group,
and per-bucket totals supply the offset. Only the cut points, one number per
bucket and group of features, pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucket_count(df: DataFrame) -> int:
    """A power of two near the session's number of shuffle partitions."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(wanted - 1, 1).bit_length()


def cut_points(df: DataFrame, value: str, groups: list[str], buckets: int) -> DataFrame | list[float]:
    """Approximate quantiles that separate the buckets, per group or (no groups) overall.

    Collected so that every branch of a plan uses the very same cuts, also when
    lost tasks run again. ``groups`` must have few values, such as feature names.
    """
    shares = [i / buckets for i in range(1, buckets)]
    cuts = F.percentile_approx(value, shares, max(10_000, buckets * 10)).alias("_cuts")
    fields = df.select(*groups).schema.fields
    rows = df.filter(F.col(value).isNotNull()).groupBy(*groups).agg(cuts).collect()
    if not groups:
        return list(rows[0]["_cuts"] or []) if rows else []
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", _cuts array<double>"
    return df.sparkSession.createDataFrame([tuple(r) for r in rows], schema)


def _search(cuts: Column, value: str, buckets: int) -> Column:
    """How many cut points are below the value: a binary search over the sorted array."""
    halves = F.array(*[F.lit(buckets >> i) for i in range(1, buckets.bit_length())])
    found = F.aggregate(
        halves,
        F.lit(0),
        lambda at, step: F.when(F.get(cuts, at + step - 1) < F.col(value), at + step).otherwise(at),
    )
    # Never NULL, which also keeps the optimizer from testing the search for NULL on every input row.
    return F.coalesce(found, F.lit(0))


def placed(df: DataFrame, value: str, groups: list[str], cuts, buckets: int) -> DataFrame:
    """Add ``_bucket``. Cut points of groups are joined as a table of one row per group."""
    if groups:
        joined = df.join(F.broadcast(cuts), groups, "left")
        return joined.withColumn("_bucket", _search(F.col("_cuts"), value, buckets)).drop("_cuts")
    if not cuts:
        return df.withColumn("_bucket", F.lit(0))
    return df.withColumn("_bucket", _search(F.array(*[F.lit(float(c)) for c in cuts]), value, buckets))


def with_offsets(counted: DataFrame, keys: list[str], value: str, weights: list[str]) -> DataFrame:
    """Add, per weight, its sum over smaller values (``_before``), equal ones (``_here``) and the key (``_all``).

    ``counted`` has a ``_bucket`` and may hold several rows per (keys, value).
    Both windows share one shuffle and one sort.
    """
    up_to = W.partitionBy(*keys, "_bucket").orderBy(value).rangeBetween(W.unboundedPreceding, W.currentRow)
    equal = W.partitionBy(*keys, "_bucket", value)
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = counted.groupBy(*keys, "_bucket").agg(*[F.sum(w).alias(w) for w in weights])
    offsets = sums.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"_{w}_offset") for w in weights],
        *[F.sum(w).over(W.partitionBy(*keys)).alias(f"{w}_all") for w in weights],
    )
    ranked = counted
    for w in weights:
        ranked = ranked.withColumn(f"{w}_before", F.sum(w).over(up_to)).withColumn(f"{w}_here", F.sum(w).over(equal))
    joined = ranked.join(offsets, [*keys, "_bucket"])
    for w in weights:
        before = F.col(f"{w}_before") - F.col(f"{w}_here") + F.col(f"_{w}_offset")
        joined = joined.withColumn(f"{w}_before", before).drop(f"_{w}_offset")
    return joined


def counted(
    df: DataFrame, value: str, keys: list[str], groups: list[str] = (), extra: list[str] = (), buckets: int | None = None
) -> DataFrame:
    """One row per (keys, value, extra) with its number of copies ``n`` and its ``_bucket``.

    NULL and NaN values are left out. ``groups`` is the part of the keys, few in
    number, whose values live on different scales and so need cuts of their own.
    """
    buckets = buckets or bucket_count(df)
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    cuts = cut_points(clean, value, list(groups), buckets)
    counts = clean.groupBy(*keys, value, *extra).agg(F.count("*").alias("n"))
    return placed(counts, value, list(groups), cuts, buckets)


def ranked(counts: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Counted rows with ``n_before`` smaller, ``n_here`` equal, ``n_all`` rows of the key, and the average ``rank``."""
    return with_offsets(counts, list(keys), value, ["n"]).withColumn(
        "rank", F.col("n_before") + (F.col("n_here") + 1) / 2
    )


def average_rank(df: DataFrame, value: str, by: list[str] = (), groups: list[str] = (), name: str = "rank"):
    """Each row with the average rank of its value in its group; ties share the mean rank."""
    ranks = ranked(counted(df, value, list(by), groups), value, list(by)).select(*by, value, F.col("rank").alias(name))
    return df.join(ranks, [*by, value], "left")


def exact_quantiles(counts: DataFrame, value: str, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per key plus ``total``, from counted rows."""
    rows = ranked(counts, value, keys)

    def at(position: Column) -> Column:
        hit = (F.col("n_before") <= position) & (position < F.col("n_before") + F.col("n"))
        return F.max(F.when(hit, F.col(value)))

    sides = []
    for name, q in quantiles.items():
        position = F.lit(q) * (F.col("n_all") - 1)
        sides += [at(F.floor(position)).alias(f"{name}_low"), at(F.ceil(position)).alias(f"{name}_high")]
    found = rows.groupBy(*keys).agg(F.max("n_all").alias("total"), *sides)
    out = []
    for name, q in quantiles.items():
        position = F.lit(q) * (F.col("total") - 1)
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return found.select(*keys, "total", *out)


def lookup(df: DataFrame, small: DataFrame, keys: list[str], spread: int | None = None) -> DataFrame:
    """Inner join to one row per group, for groups so few or uneven that joining on them alone would pile up.

    Rows are dealt out by a hash of their values, the group rows repeated once per share.
    """
    spread = spread or bucket_count(df)
    hashable = [name for name, kind in df.dtypes if "map<" not in kind]
    dealt = df.withColumn("_share", F.pmod(F.xxhash64(*hashable), F.lit(spread)).cast("int"))
    repeated = small.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return dealt.join(repeated, [*keys, "_share"]).drop("_share")
