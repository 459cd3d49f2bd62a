"""The driver's tables seen as telemetry: samples, counters, recoveries, classes, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brokerlens.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def broker() -> F.Column:
    return (F.col("user_id") % 3 + 1).cast("string")


def samples(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """A gauge per event type and broker; ``more`` columns of the events stay beside it."""
    return events(spark, sf_dir).select(
        "ts", F.col("event_type").alias("metric"), F.create_map(F.lit("broker"), broker()).alias("labels"), "value", *more
    )


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter of cents per event type and broker that starts again every day."""
    day = F.to_date("ts")
    by = W.partitionBy("event_type", broker(), day).orderBy("ts", "event_id")
    cents = F.round(F.col("value") * 100).cast("bigint")
    return events(spark, sf_dir).select(
        "ts",
        F.col("event_type").alias("metric"),
        F.create_map(F.lit("broker"), broker()).alias("labels"),
        F.sum(cents).over(by).cast("double").alias("value"),
    )


def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery events: one per line item, described by its order."""
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    batch = F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW")
    return line.join(order, line.l_orderkey == order.o_orderkey).select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.col("l_returnflag").alias("strategy"),
        F.when(batch, "BATCH_DATA_INTENSIVE").otherwise("REAL_TIME_EVENT_DRIVEN").alias("workload_type"),
        F.when(F.col("l_linestatus") == "F", "default").otherwise("buffer").alias("config_source"),
        F.col("l_quantity").alias("recovery_time_seconds"),
        F.col("l_discount").alias("cpu_usage_percent"),
        F.col("l_tax").alias("memory_usage_percent"),
        F.concat(F.lit("kafka"), (F.col("l_suppkey") % 3 + 1).cast("string"), F.lit(":9092")).alias("broker_url"),
        F.when(F.col("l_quantity") < 45, "SUCCESS").otherwise("FAILURE").alias("result"),
        F.col("l_extendedprice").alias("price"),
        F.col("o_totalprice").alias("total"),
    )


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workload progress rows out of events."""
    real_time = F.col("event_type").isin("click", "view")
    return events(spark, sf_dir).select(
        F.col("ts").alias("timestamp"),
        F.when(real_time, "real_time").otherwise("batch").alias("workload_type"),
        F.col("value").alias("message_rate"),
        F.octet_length("props").cast("double").alias("payload_size_bytes"),
        (F.col("user_id") % 100).cast("int").alias("batch_size"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("cpu_usage"),
        ((F.col("user_id") % 50).cast("double") / 50).alias("memory_usage"),
    )


CLASS_FEATURES = ["chars", "spaces", "newlines", "digits", "commas", "uppers", "constant"]


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled feature rows out of documents."""
    text = F.col("text")

    def without(shorter):
        return (F.length(text) - F.length(shorter)).cast("double")

    def count_of(character):
        return without(F.replace(text, F.lit(character), F.lit("")))

    def count_in(characters):
        return without(F.regexp_replace(text, f"[{characters}]+", ""))

    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.length(text).cast("double").alias("chars"),
        count_of(" ").alias("spaces"),
        count_of("\n").alias("newlines"),
        count_in("0-9").alias("digits"),
        count_of(",").alias("commas"),
        count_in("A-Z").alias("uppers"),
        F.lit(1.0).alias("constant"),
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.join(labels, "doc_id")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workload messages as JSON text: one per conversation turn, in the shape its role decides."""
    real_time = F.col("role") == "user"
    words = F.transform(
        F.split("text", " "),
        lambda w, i: F.struct(
            w.alias("word"), F.lit(0.9).alias("confidence"),
            (i * 0.3).alias("start_time"), ((i + 1) * 0.3).alias("end_time"),
        ),
    )
    taxonomy = F.struct(
        F.when(real_time, "real_time").otherwise("batch").alias("latency_sensitivity"),
        F.when(real_time, "mission_critical").otherwise("best_effort").alias("data_criticality"),
        F.when(real_time, "event_driven").otherwise("batch").alias("processing_pattern"),
        F.concat(F.lit("class_"), (F.col("turn") % 3).cast("string")).alias("resource_intensity"),
    )
    meta = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("source_id"), F.lit(16000).alias("sample_rate"),
        F.col("turn").cast("double").alias("duration_seconds"),
    )
    batch_meta = F.struct(F.col("conv_id").cast("int").alias("batch_id"), F.lit("high").alias("priority"))
    results = F.struct(F.lit(0.8).alias("confidence"), words.alias("words"), F.lit("en-US").alias("language"))
    body = F.struct(
        taxonomy.alias("taxonomy"),
        F.when(real_time, meta).alias("metadata"),
        F.when(~real_time, batch_meta).alias("batch_metadata"),
        results.alias("results"),
    )
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("key"), "role", F.to_json(body).alias("value")
    )
