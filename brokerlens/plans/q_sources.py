"""Queries that write the given tables to a sink and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from brokerlens import schemas
from brokerlens.plans import views
from brokerlens.plans.q_learning import CLASS_FEATURES, LABEL, classes
from brokerlens.plans.registry import CLASSES_SQL, PROGRESS_SQL, RECOVERY_SQL, query, rounded, us
from brokerlens.session import scratch
from brokerlens.sources import naming, readers, sinks


def _written(spark, name, df, fmt="csv", header=True):
    path = scratch(spark, name)
    df.write.format(fmt).options(header=header, nullValue="N/A", escape='"').save(path)
    return path


_FEATURES_SQL = ", ".join(f"CASE WHEN (event_id + {i}) % 5 <> 0 THEN round(value * {i + 1}, 4) END AS {n}" for i, n in enumerate(schemas.FEATURE_NAMES))


@query("s1_features", f"SELECT epoch_us(ts) AS timestamp, CASE WHEN event_id % 50 <> 0 THEN CAST(user_id % 2 AS INTEGER) END AS workload_type, {_FEATURES_SQL} FROM events")
def s1(spark, sf):
    columns = [F.when((F.col("event_id") + i) % 5 != 0, F.col("value") * (i + 1)).alias(n) for i, n in enumerate(schemas.FEATURE_NAMES)]
    rows = views.events(spark, sf).select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.when(F.col("event_id") % 50 != 0, F.col("user_id") % 2).alias("workload_type"), *columns,
    )
    back = readers.read_features(spark, _written(spark, "features", rows))
    return rounded(back.withColumn("timestamp", us("timestamp")), schemas.FEATURE_NAMES)


def _log(spark, sf):
    """Recovery rows in the shape of the log, with its missing-value markers."""
    rows = views.recovery(spark, sf)
    return rows.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "strategy",
        F.when(F.col("line") != 1, F.col("workload_type")).otherwise("").alias("workload_type"), "config_source",
        "recovery_time_seconds", "cpu_usage_percent",
        F.when(F.col("line") == 2, -1.0).otherwise(F.col("memory_usage_percent")).alias("memory_usage_percent"), "broker_url", "result",
        F.lit(-1).alias("under_replicated_before"), F.col("line").alias("under_replicated_after"), F.lit(-1).alias("offline_before"),
        F.lit(0).alias("offline_after"), F.concat_ws("-", "id", "line", "price").alias("details"),
    )


_LOG_SQL = """ts AS timestamp, strategy, CASE WHEN line <> 1 THEN workload_type END AS workload_type, recovery_time_seconds, cpu_usage_percent,
    CASE WHEN line <> 2 THEN memory_usage_percent END AS memory_usage_percent"""


@query("s2_recovery_versions", f"WITH {RECOVERY_SQL} SELECT 'old' AS version, CAST(NULL AS VARCHAR) AS config_source, CAST(line AS INTEGER) AS under_replicated_after, {_LOG_SQL} FROM rec UNION ALL SELECT 'curated', config_source, NULL, {_LOG_SQL} FROM rec")
def s2(spark, sf):
    log = _log(spark, sf)
    old = readers.read_recovery(spark, _written(spark, "old", log.drop("config_source")), "old")
    curated = readers.read_recovery(spark, _written(spark, "curated", log.select(*log.columns[:7])), "curated")
    rows = old.withColumn("version", F.lit("old")).unionByName(curated.withColumn("version", F.lit("curated")))
    return rows.select(
        "version", us("timestamp").alias("timestamp"), "strategy", "workload_type", "config_source", "recovery_time_seconds",
        "cpu_usage_percent", "memory_usage_percent", "under_replicated_after",
    )


@query("s3_headerless_log", f"WITH {RECOVERY_SQL} SELECT {_LOG_SQL}, config_source, result, CASE WHEN config_source = 'buffer' THEN strategy END AS priority, CAST(NULL AS INTEGER) AS offline_before FROM rec")
def s3(spark, sf):
    config = F.when(F.col("config_source") == "buffer", F.create_map(F.lit("rebalance.priority"), F.col("strategy"), F.lit("a,b"), F.lit('"q"')))
    log = _log(spark, sf).withColumn("timestamp", F.to_timestamp("timestamp")).withColumn("applied_config", config)
    path = scratch(spark, "log")
    sinks.recovery_csv(log).write.options(header=False, escape='"').csv(path)
    rows = readers.read_recovery(spark, path, header=False)
    return rows.select(
        us("timestamp").alias("timestamp"), "strategy", "workload_type", "recovery_time_seconds", "cpu_usage_percent", "memory_usage_percent",
        "config_source", "result", F.col("applied_config")["rebalance.priority"].alias("priority"), "offline_before",
    )


@query("s4_logs", f"""WITH {PROGRESS_SQL} SELECT us AS timestamp, workload_type, message_rate, batch_size, cpu_usage, CAST(NULL AS VARCHAR) AS selected_strategy FROM prg
    UNION ALL SELECT epoch_us(ts), NULL, NULL, NULL, NULL, event_type FROM events""")
def s4(spark, sf):
    text = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    progress = _written(spark, "progress", views.progress(spark, sf).withColumn("timestamp", text))
    chosen = views.events(spark, sf).select(F.col("ts").alias("timestamp"), F.col("event_type").alias("selected_strategy"))
    chosen = _written(spark, "chosen", chosen.withColumn("timestamp", text))
    a = readers.read_workload_metrics(spark, progress).select("timestamp", "workload_type", "message_rate", "batch_size", "cpu_usage")
    b = readers.read_classifications(spark, chosen)
    return a.unionByName(b, allowMissingColumns=True).withColumn("timestamp", us("timestamp"))


@query("s5_snapshots", """SELECT max(epoch_us(ts)) // 1000 * 1000 AS timestamp, arg_max(event_type, ts) AS strategy, CAST(count(*) AS VARCHAR) AS events, CAST(date_trunc('day', ts) AS VARCHAR)[:10] AS workload_type FROM events GROUP BY date_trunc('day', ts)""")
def s5(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = views.events(spark, sf).groupBy(day.alias("workload_type")).agg(
        (F.floor(us(F.max("ts")) / F.lit(1000)) / 1000).alias("timestamp"), F.max_by("event_type", "ts").alias("strategy"),
        F.struct(F.count("*").alias("events"), F.lit("x").alias("rebalance.priority")).alias("config"),
    )
    path = scratch(spark, "snapshots")
    rows.withColumn("day", F.col("workload_type")).write.partitionBy("day").json(path)
    rows.limit(1).select(F.lit("[]").alias("value")).write.text(f"{path}/day=none")
    back = readers.read_strategy(spark, f"{path}/*")
    return back.select(us("timestamp").alias("timestamp"), "strategy", "workload_type", F.col("config")["events"].alias("events"))


@query("s6_results", f"WITH {PROGRESS_SQL} SELECT workload_type AS key, round(avg(cpu_usage), 4) AS mean, max(cpu_usage) AS max FROM prg GROUP BY 1")
def s6(spark, sf):
    rows = views.progress(spark, sf).groupBy("workload_type").agg(F.avg("cpu_usage").alias("mean"), F.max("cpu_usage").alias("max"))
    path = scratch(spark, "results")
    sinks.write_result_map(rows, path, "workload_type")
    missing = readers.read_results(spark, f"{path}-missing", "struct<mean:double,max:double>")
    back = readers.read_results(spark, path, "struct<mean:double,max:double>", lines=True).unionByName(missing)
    return rounded(back.select("key", "value.mean", "value.max"), ["mean"])


@query("s7_samples", "SELECT epoch_us(ts) AS ts, event_type AS metric, CAST(user_id % 3 + 1 AS VARCHAR) AS broker, CASE WHEN event_id % 9 <> 0 THEN value END AS value FROM events")
def s7(spark, sf):
    rows = views.samples(spark, sf, "event_id")
    rows = rows.withColumn("value", F.when(F.col("event_id") % 9 != 0, F.col("value"))).withColumn("kind", F.lit("GAUGE")).drop("event_id")
    path = scratch(spark, "samples")
    sinks.append_events(rows, path)
    return readers.read_samples(spark, path).select(us("ts").alias("ts"), "metric", F.col("labels")["broker"].alias("broker"), "value")


@query("s8_messages", "SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS key, CASE WHEN role = 'user' THEN 'real_time' ELSE 'batch' END AS sensitivity FROM conversations")
def s8(spark, sf):
    path = scratch(spark, "messages")
    sinks.append_events(views.messages(spark, sf).select("key", "value", F.current_timestamp().alias("ts")), path)
    rows = readers.read_messages(spark, path, streaming=False)
    return rows.select("key", F.get_json_object("value", "$.taxonomy.latency_sensitivity").alias("sensitivity"))


_NAMES = """SELECT metric, kind, label, CAST(count(*) AS BIGINT) AS n FROM (SELECT
    CASE event_type WHEN 'click' THEN 'kafka_server_brokertopicmetrics_bytesin_total' WHEN 'view' THEN 'kafka_network_requestmetrics_totaltimems'
      WHEN 'error' THEN 'kafka_controller_stats_leaderelectionrateandtimems' WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'java_lang_memory_heapmemoryusage_used' ELSE 'jvm_memory_heap_committed_bytes' END
      WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN 'kafka_cluster_partition_underreplicated_topic_x_' || CAST(user_id % 5 AS VARCHAR) ELSE 'java_nio_bufferpool_memoryused' END END AS metric,
    CASE WHEN event_type = 'click' THEN 'COUNTER' WHEN event_type = 'purchase' AND user_id % 2 = 1 THEN 'UNTYPED' ELSE 'GAUGE' END AS kind,
    CASE event_type WHEN 'click' THEN 'Topic.' || CAST(user_id % 4 AS VARCHAR) WHEN 'view' THEN 'Produce' WHEN 'error' THEN '0.' || CAST(90 + user_id % 10 AS VARCHAR)
      WHEN 'signup' THEN CASE WHEN user_id % 2 = 1 THEN 'heap' END WHEN 'purchase' THEN CASE WHEN user_id % 2 = 1 THEN 'direct' END END AS label FROM events) GROUP BY ALL"""


def _beans(spark, sf):
    user, kind = F.col("user_id"), F.col("event_type")
    bean = (
        F.when(kind == "click", F.concat(F.lit("kafka.server<type=BrokerTopicMetrics, name=BytesInPerSec, topic=Topic."), (user % 4).cast("string"), F.lit("><>Count")))
        .when(kind == "view", "kafka.network<type=RequestMetrics, name=TotalTimeMs, request=Produce><>99thPercentile")
        .when(kind == "error", F.concat(F.lit("kafka.controller<type=ControllerStats, name=LeaderElectionRateAndTimeMs><>"), (90 + user % 10).cast("string"), F.lit("thPercentile")))
        .when(kind == "signup", F.when(user % 2 == 0, "java.lang<type=Memory><HeapMemoryUsage>used").otherwise("java.lang<type=Memory><HeapMemoryUsage>committed"))
        .otherwise(
            F.when(user % 2 == 0, F.concat(F.lit("kafka.cluster<type=Partition, name=UnderReplicated, topic=x-"), (user % 5).cast("string"), F.lit("><>Value")))
            .otherwise("java.nio<type=BufferPool, name=direct><>MemoryUsed")
        )
    )
    return views.events(spark, sf).select(bean.alias("bean"))


def _named_counts(rows):
    return rows.groupBy("metric", "kind", F.get(F.map_values("labels"), 0).alias("label")).agg(F.count("*").alias("n"))


@query("s9_metric_names", _NAMES)
def s9(spark, sf):
    return _named_counts(naming.normalize_metrics(_beans(spark, sf)))


@query("s9_repeated_names", _NAMES)
def s9_repeated(spark, sf):
    return _named_counts(naming.normalize_repeated(_beans(spark, sf)))


@query("s10_append", "SELECT event_id, event_type, value FROM events UNION ALL SELECT event_id, event_type, value FROM events WHERE value > 100")
def s10(spark, sf):
    rows, path = views.events(spark, sf).select("event_id", "event_type", "value"), scratch(spark, "appended")
    sinks.append_events(rows, path, partition_by=["event_type"])
    sinks.append_events(rows.filter("value > 100"), path, partition_by=["event_type"])
    return spark.read.schema("event_id bigint, value double, event_type string").parquet(path)


def _result(name: str, fmt: str):
    @query(name, f"WITH {RECOVERY_SQL} SELECT strategy, result, CAST(count(*) AS BIGINT) AS n, round(avg(price), 2) AS mean FROM rec GROUP BY ALL")
    def run(spark, sf):
        rows = views.recovery(spark, sf).groupBy("strategy", "result").agg(F.count("*").alias("n"), F.round(F.avg("price"), 2).alias("mean"))
        path = scratch(spark, "result")
        sinks.write_result(rows, path, fmt)
        return spark.read.schema(rows.schema).option("header", True).format(fmt).load(path)


_result("s11_result_csv", "csv")
_result("s12_result_json", "json")


@query("s13_latest", "SELECT CAST(user_id % 3 + 1 AS VARCHAR) AS broker, epoch_us(max(ts)) AS ts, arg_max(event_type, ts) AS strategy FROM events GROUP BY 1")
def s13(spark, sf):
    rows = views.events(spark, sf).select(views.broker().alias("broker"), "ts", F.col("event_type").alias("strategy"))
    path = scratch(spark, "latest")
    sinks.upsert_latest(rows.filter("strategy <> 'view'"), path, 0, ["broker"])
    sinks.upsert_latest(rows.filter("strategy = 'view'"), path, 1, ["broker"])
    return sinks.read_latest(spark, path, rows.schema).withColumn("ts", us("ts"))


@query("s14_model", f"WITH {CLASSES_SQL} SELECT doc_id, true AS same FROM cls")
def s14(spark, sf):
    from brokerlens.operators import model

    rows, path = classes(spark, sf), scratch(spark, "model")
    fitted = model.train_classifier(rows, CLASS_FEATURES, LABEL)
    sinks.save_model(fitted, path)
    a = fitted.transform(rows).select("doc_id", F.col("prediction").alias("a"))
    b = sinks.load_model(path).transform(rows).select("doc_id", F.col("prediction").alias("b"))
    return a.join(b, "doc_id").select("doc_id", (F.col("a") == F.col("b")).alias("same"))
