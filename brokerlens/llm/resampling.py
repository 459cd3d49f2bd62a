"""Importance resampling towards a target text collection: array-scored weights and a distributed quickselect."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from brokerlens.llm.common import free_name, per_batch, slices, written

BUCKETS, LONGEST = 10_000, 3
#: Letters A-Z become small, digits and bytes of other scripts stay, everything else separates words.
_PLAIN = bytes(
    b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
#: Random pivots of a round of the selection.
PIVOTS = 16
#: Winners sorted by one task.
RANKED_ROWS = 200_000


# Features and weights


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text, A-Z lower-cased; null has none."""
    return (text or "").encode().translate(_PLAIN).split()


def buckets_of(words: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every run of 1 to ``longest`` words: the crc32 of the run, joined by spaces, modulo ``buckets``.

    The checksum of a run carries on from that of the run one word shorter.
    """
    runs = list(map(zlib.crc32, words))
    joined = [b" " + w for w in words]
    found = [np.array(runs, dtype=np.uint32)]
    for size in range(1, min(longest, len(words))):
        runs = list(map(zlib.crc32, joined[size:], runs))
        found.append(np.array(runs, dtype=np.uint32))
    return np.concatenate(found) % np.uint32(buckets)


def bucket_counts(df: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts. Every task sends its sums; the driver gets one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, ["text"]):
                for body in part.column("text").to_pylist():
                    total += np.bincount(buckets_of(words_of(body), longest, buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    sums = df.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    held = np.zeros(buckets, dtype=np.int64)
    for row in sums.collect():
        held[row["bucket"]] = row["n"]
    return held


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 * ln of its smoothed share in the target over its share in the source)."""
    n = float(len(source))
    shares = (target + 1.0) * (float(source.sum()) + n) / ((source + 1.0) * (float(target.sum()) + n))
    return np.floor(1000 * np.log(shares)).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, key: str, text: str, longest: int = LONGEST) -> DataFrame:
    """(key, n_words, n_features, weight) of every row; the gains travel with the task, one number per bucket."""
    schema = StructType([StructField("key", docs.schema[key].dataType)])
    for name in ("n_words", "n_features", "weight"):
        schema.add(name, "long")

    def weigh(keys: list, texts: list) -> dict:
        made: dict[str, list] = {"key": keys, "n_words": [], "n_features": [], "weight": []}
        for body in texts:
            words = words_of(body)
            found = buckets_of(words, longest, len(gain))
            made["n_words"].append(len(words))
            made["n_features"].append(len(found))
            made["weight"].append(int(gain[found].sum()))
        return made

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(per_batch(weigh, ["key", "text"], schema), schema)


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))) with u from the first 32 bits of the SHA-256 of ``seed:key``; a null key is written empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


# Selection


@dataclass
class Order:
    """A composite key: columns compared in turn, each rising; nulls come first."""

    names: list[str]
    types: list[str]

    @staticmethod
    def of(df: DataFrame, names: list[str]) -> Order:
        kinds = dict(df.dtypes)
        return Order(names, [kinds[n] for n in names])

    def value(self) -> Column:
        return F.struct(*(F.col(n) for n in self.names))

    def literal(self, row) -> Column:
        return F.struct(*(F.lit(row[n]).cast(t).alias(n) for n, t in zip(self.names, self.types)))


def three_ways(df: DataFrame, order: Order, pivots: list) -> dict[int, int]:
    """Exact counts by place: 2 * i between pivots i - 1 and i, 2 * i + 1 equal to pivot i (pivots rise)."""
    value, place = order.value(), F.lit(0)
    for pivot in pivots:
        mark = order.literal(pivot)
        place = place + (value >= mark).cast("int") + (value > mark).cast("int")
    return {r["place"]: r["n"] for r in df.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()}


def kth(df: DataFrame, order: Order, k: int, pivots: int = PIVOTS, seed: int = 0):
    """The k-th row (from 1) of the composite key, by quickselect over the distributed rows.

    Each round draws random pivot keys among the rows still in question, counts exactly the rows below, at and above
    each, and goes on between two of them. Only pivots and counts reach the driver, and rounds grow with the logarithm
    of the rows. The first column of the key also bounds the scan, so that files may be skipped.
    """
    live, first, left, turn = df, order.names[0], k, 0
    while True:
        turn += 1
        drawn = live.orderBy(F.xxhash64(F.lit(seed + turn), *order.names)).limit(pivots)
        marks = drawn.select(*order.names).distinct().orderBy(order.value()).collect()
        counts, below, place = three_ways(live, order, marks), 0, 0
        for place in range(2 * len(marks) + 1):
            if below + counts.get(place, 0) >= left:
                break
            below += counts.get(place, 0)
        left -= below
        if place % 2:
            return marks[place // 2]
        if place:
            low = marks[place // 2 - 1]
            live = live.where((F.col(first) >= F.lit(low[first])) & (order.value() > order.literal(low)))
        if place < 2 * len(marks):
            high = marks[place // 2]
            live = live.where((F.col(first) <= F.lit(high[first])) & (order.value() < order.literal(high)))


def ranked(df: DataFrame, order: Order, rows: int, name: str) -> DataFrame:
    """The rows with their place (from 1) in the order: ranges of the key, each sorted by a task, written once and offset."""
    parts = max(1, -(-rows // RANKED_ROWS))
    sorted_ = df.repartitionByRange(parts, *order.names).sortWithinPartitions(*order.names)
    place = F.monotonically_increasing_id()
    sorted_ = written(sorted_.withColumn("_place", place), "ranked")
    part = F.shiftright("_place", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    offsets, before = [], 0
    for row in sizes:
        offsets.append((row["_part"], before))
        before += row["n"]
    table = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    at = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return sorted_.join(F.broadcast(table), part == F.col("_part")).withColumn(name, at).drop("_place", "_part", "_before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = 5,
    least_words: int = 20,
    seed: int = 42,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    pivots: int = PIVOTS,
) -> DataFrame:
    """(key, n_features, weight, score, rank) for every row; rank is null for rows that are not drawn.

    Features are hashed runs of words; a bucket's gain compares its share in ``target`` with that in ``docs``. A weight
    is the sum of gains, a score the weight plus Gumbel noise of the key, and the ``percent`` of the rows with at least
    ``least_words`` words and the highest scores are drawn without replacement: ties to the smaller key, null keys last,
    then fewer features. Null and empty texts have no features and weight 0 and are never drawn; repeated rows count one
    by one and may take several ranks. Empty tables give an empty result, an empty target only smoothing. Other columns
    of ``docs`` are not looked at.
    """
    source = bucket_counts(docs, text, longest, buckets)
    wanted = bucket_counts(target, target_text, longest, buckets)
    rows = weighed(docs, gains(source, wanted), key, text, longest)
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("key"), seed))
    rows = rows.withColumn("falling", -F.col("score")).withColumn("keyless", F.col("key").isNull())
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    order = Order.of(rows, ["falling", "keyless", "key", "n_features", "row"])
    fit = F.col("n_words") >= least_words
    k = percent * rows.where(fit).count() // 100
    columns = [F.col("key").alias(key), "n_features", "weight", "score"]
    rank = free_name([key], "rank")
    if k == 0:
        return rows.select(*columns, F.lit(None).cast("long").alias(rank))
    last = kth(rows.where(fit), order, k, pivots, seed)
    won = fit & (order.value() <= order.literal(last))
    winners = ranked(rows.where(won & (F.col("falling") <= last["falling"])), order, k, rank)
    rest = rows.where(~won).select(*columns, F.lit(None).cast("long").alias(rank))
    return winners.select(*columns, F.col(rank)).unionAll(rest)
