"""Workload messages: parsing both shapes, transcripts, payload sizes, word records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brokerlens.schemas import MESSAGE


def parse_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON text to one schema for real-time and batch messages; ``shape`` says which it was."""
    parsed = df.withColumn("message", F.from_json(F.col(value), MESSAGE))
    shape = (
        F.when(F.col("message.metadata").isNotNull(), "real_time")
        .when(F.col("message.batch_metadata").isNotNull(), "batch")
        .otherwise("unknown")
    )
    return parsed.withColumn("shape", shape)


def transcript(words: Column | str) -> Column:
    words = F.col(words) if isinstance(words, str) else words
    return F.array_join(F.transform(words, lambda w: w["word"]), " ")


def payload_stats(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Message count, total, average, smallest and largest payload in bytes."""
    size = F.octet_length(value)
    return df.groupBy(*by).agg(
        F.count("*").alias("messages"),
        F.sum(size).alias("total_bytes"),
        F.avg(size).alias("avg_bytes"),
        F.min(size).alias("min_bytes"),
        F.max(size).alias("max_bytes"),
    )


def running_payload(df: DataFrame, by: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Average payload of all messages up to each instant."""
    from brokerlens.operators.ordered import instants, running_totals

    steps = instants(df, by, ts, {"messages": F.count("*"), "bytes": F.sum(F.octet_length(value))})
    totals = running_totals(steps, by, ["messages", "bytes"])
    average = (F.col("bytes") / F.col("messages")).alias("avg_bytes")
    return totals.select(*by, F.timestamp_micros("_us").alias("ts"), "messages", average)


TAXONOMY = ["latency_sensitivity", "data_criticality", "processing_pattern", "resource_intensity"]


def taxonomy_counts(parsed: DataFrame) -> DataFrame:
    columns = [F.col(f"message.taxonomy.{c}").alias(c) for c in TAXONOMY]
    return parsed.select(*columns).groupBy(*TAXONOMY).agg(F.count("*").alias("messages"))


def word_offsets(parsed: DataFrame, keys: list[str], step: float = 0.3) -> DataFrame:
    """One row per word with offsets derived from its position."""
    rows = parsed.select(*keys, F.posexplode("message.results.words").alias("position", "_w"))
    return rows.select(
        *keys,
        "position",
        F.col("_w.word").alias("word"),
        (F.col("position") * step).alias("start_time"),
        ((F.col("position") + 1) * step).alias("end_time"),
    )
