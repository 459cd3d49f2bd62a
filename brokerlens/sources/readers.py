"""Scans. Schemas are given, missing-value markers become NULL, times are UTC timestamps."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brokerlens import schemas
from brokerlens.functions.scalars import json_to_map, nullify_sentinels, parse_ts


def _csv(spark: SparkSession, path: str, schema, header: bool = True) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("enforceSchema", True)
        .option("nullValue", "N/A")
        .option("escape", '"')
        .csv(path)
    )


def read_features(spark: SparkSession, path: str, names: list[str] = schemas.FEATURE_NAMES) -> DataFrame:
    """Wide telemetry rows; a byte order mark before the header does no harm."""
    return _csv(spark, path, schemas.features(names)).withColumn("timestamp", parse_ts("timestamp"))


_HEALTH = ["under_replicated_before", "under_replicated_after", "offline_before", "offline_after"]
_READINGS = ["cpu_usage_percent", "memory_usage_percent"]


def read_recovery(spark: SparkSession, path: str, version: str = "full", header: bool = True) -> DataFrame:
    """Recovery log in any of its versions, always with the full set of columns."""
    rows = _csv(spark, path, schemas.RECOVERY_VERSIONS[version], header)
    full = spark.createDataFrame([], schemas.RECOVERY)
    rows = full.unionByName(rows, allowMissingColumns=True)
    text = ["strategy", "workload_type", "config_source", "broker_url", "result", "details"]
    rows = nullify_sentinels(rows, text, [*_READINGS, *_HEALTH])
    rows = rows.withColumns({c: F.col(c).try_cast("int") for c in _HEALTH})
    return rows.withColumns({"timestamp": parse_ts("timestamp"), "applied_config": json_to_map("applied_config")})


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path, schemas.EXPERIMENT)
    numbers = [name for name, kind in rows.dtypes if kind == "double" and name != "recovery_time_seconds"]
    return nullify_sentinels(rows, numbers=numbers).withColumn("timestamp", parse_ts("timestamp"))


def read_classifications(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.CLASSIFICATION).withColumn("timestamp", parse_ts("timestamp"))


def read_workload_metrics(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.PROGRESS).withColumn("timestamp", parse_ts("timestamp"))


def read_strategy(spark: SparkSession, path: str) -> DataFrame:
    """Strategy snapshots, one JSON object per file; anything else is ignored."""
    rows = spark.read.schema(schemas.STRATEGY).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    known = rows.filter(F.col("strategy").isNotNull())
    return known.withColumn("timestamp", F.timestamp_micros((F.col("timestamp") * 1_000_000).try_cast("bigint")))


def read_results(spark: SparkSession, path: str, value_type: str = "string", lines: bool = False) -> DataFrame:
    """Result files that map keys to values, one row per entry; a missing path gives no rows.

    A file is one JSON object, or with ``lines`` one object per line.
    """
    try:
        text = spark.read.text(path, wholetext=not lines)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"key string, value {value_type}")
    parsed = F.from_json("value", f"map<string,{value_type}>")
    return text.select(F.explode(parsed).alias("key", "value"))


def read_samples(spark: SparkSession, path: str, streaming: bool = False, fmt: str = "parquet", **options) -> DataFrame:
    """Metric samples as a table or as a stream; a failed fetch is a NULL value of that metric alone.

    A stream should bound its micro-batches, for example with ``maxFilesPerTrigger=...``.
    """
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schemas.SAMPLES).options(**options).format(fmt).load(path)


def read_table_stream(spark: SparkSession, folder: str, file: str, schema, max_files: int = 1) -> DataFrame:
    """One Parquet table inside a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file).option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def read_messages(spark: SparkSession, path: str, streaming: bool = True) -> DataFrame:
    """Keyed JSON messages landed as Parquet files with ``key`` and ``value``."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema("key string, value string, ts timestamp").parquet(path)


def read_topic(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """Keyed JSON messages of a broker topic; needs Spark's Kafka connector on the class path."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    rows = stream.options(**options).load()
    return rows.select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
        F.col("timestamp").alias("ts"),
    )
