import json
import os

import pytest
from pyspark.sql import functions as F

from brokerlens import schemas
from brokerlens.sources import naming, readers, sinks
from tests.helpers import at, samples

CONFIG = '"{""replica.lag.time.max.ms"": 30000, ""rebalance.priority"": ""controlled""}"'


def put(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    with open(path, "w", encoding=encoding) as file:
        file.write(text)
    return path


def test_features_with_byte_order_mark_and_markers(spark, folder):
    names = [n for n in schemas.FEATURE_NAMES if n not in schemas.GENERATOR_FEATURES]
    head = ",".join(["timestamp", "workload_type", *names])
    first = ",".join(["2024-01-01T00:00:00.971529", "N/A", *["N/A"] * len(names)])
    second = ",".join(["2024-01-01T00:00:15.060372", "0", "220589536", *["0.5"] * (len(names) - 1)])
    path = put(folder, "f.csv", f"{head}\n{first}\n{second}\n", "utf-8-sig")
    rows = readers.read_features(spark, path, names).orderBy("timestamp").collect()
    assert rows[0]["workload_type"] is None and rows[0][names[0]] is None and rows[0]["timestamp"] == at(0.971529)
    assert rows[1]["workload_type"] == 0 and rows[1][names[0]] == 220589536.0 and rows[1][names[-1]] == 0.5


def test_recovery_log_without_header(spark, folder):
    line = "2024-01-01 00:00:10,CONTROLLED_GRADUAL,,buffer,25.2,0.05,-1,kafka1:9092,SUCCESS,-1,2,-1,0,Recovered 'X',"
    path = put(folder, "r.csv", f"{line}{CONFIG}\n{line}\n")
    row, plain = readers.read_recovery(spark, path, header=False).collect()
    assert row["timestamp"] == at(10) and row["workload_type"] is None and row["memory_usage_percent"] is None
    assert row["under_replicated_before"] is None and row["under_replicated_after"] == 2
    assert row["applied_config"] == {"replica.lag.time.max.ms": "30000", "rebalance.priority": "controlled"}
    assert plain["applied_config"] is None


def test_recovery_versions_share_columns(spark, folder):
    curated = put(folder, "c.csv", "timestamp,strategy,workload_type,config_source,recovery_time_seconds,cpu_usage_percent,memory_usage_percent\n2024-01-01 00:00:00,S,W,default,1,0.5,20\n")
    old = put(folder, "o.csv", "timestamp,strategy,workload_type,recovery_time_seconds,cpu_usage_percent,memory_usage_percent,broker_url,result,under_replicated_before,under_replicated_after,offline_before,offline_after,details\n")
    a, b = readers.read_recovery(spark, curated, "curated"), readers.read_recovery(spark, old, "old")
    assert a.columns == b.columns == schemas.RECOVERY.replace("string", "").replace("double", "").replace("int", "").replace(" ", "").split(",")
    assert a.unionByName(b).first()["config_source"] == "default"


def test_recovery_log_round_trip(spark, folder):
    line = "2024-01-01 00:00:10,S,W,buffer,25.2,0.05,3.5,kafka1:9092,SUCCESS,1,2,3,4,text,"
    rows = readers.read_recovery(spark, put(folder, "r.csv", f"{line}{CONFIG}\n"), header=False)
    out = f"{folder}/log"
    sinks.append_events(sinks.recovery_csv(rows), out, "csv")
    assert readers.read_recovery(spark, out).collect() == rows.collect()


def test_experiments(spark, folder):
    head = ",".join(part.split(" ")[0] for part in schemas.EXPERIMENT.split(", "))
    values = "e1,2024-01-01T00:00:00,s,1,batch,True,X,kafka1:9092,5.5,-1,10,100,80,-1,0,0,0,0,SUCCESS,Automatic recovery"
    row = readers.read_experiments(spark, put(folder, "e.csv", f"{head}\n{values}\n")).first()
    assert row["arms_strategy"] is True and row["cpu_usage_percent"] is None and row["message_rate_after"] is None
    assert row["message_rate_during"] == 80.0 and row["recovery_time_seconds"] == 5.5


def test_snapshots_ignore_what_is_no_object(spark, folder):
    put(folder, "a.json", json.dumps({"timestamp": 1704067200.5, "strategy": "S", "config": {"num.replica.fetchers": 2, "x": "y"}}, indent=2))
    put(folder, "b.json", "[]")
    rows = readers.read_strategy(spark, folder).collect()
    assert len(rows) == 1 and rows[0]["timestamp"] == at(0.5) and rows[0]["config"] == {"num.replica.fetchers": "2", "x": "y"}


def test_results_and_missing_file(spark, folder):
    put(folder, "r.json", json.dumps({"real_time": 1.5, "batch": 2.0}, indent=2))
    assert {r["key"]: r["value"] for r in readers.read_results(spark, f"{folder}/r.json", "double").collect()} == {"real_time": 1.5, "batch": 2.0}
    assert readers.read_results(spark, f"{folder}/none.json", "double").count() == 0


def test_latest_snapshot_is_versioned_and_repeatable(spark, folder):
    rows = spark.createDataFrame([("a", at(1), "x"), ("a", at(3), "y"), ("b", at(2), "z")], "k string, ts timestamp, s string")
    path = f"{folder}/latest"
    assert sinks.read_latest(spark, path, rows.schema).count() == 0
    for _ in range(2):
        sinks.upsert_latest(rows.filter("s <> 'y'"), path, 0, ["k"])
    for _ in range(2):
        sinks.upsert_latest(rows.filter("s = 'y'"), path, 1, ["k"])
    assert {r["k"]: r["s"] for r in sinks.read_latest(spark, path, rows.schema).collect()} == {"a": "y", "b": "z"}
    sinks.upsert_latest(spark.createDataFrame([("b", at(9), "n")], rows.schema), path, keys=["k"])
    assert {r["k"]: r["s"] for r in sinks.read_latest(spark, path, rows.schema).collect()} == {"a": "y", "b": "n"}


def test_latest_snapshot_keeps_two_versions_and_the_newest_writer(spark, folder):
    schema, path = "k string, ts timestamp, s string", f"{folder}/latest"
    batch = lambda t, s: spark.createDataFrame([("a", at(t), s)], schema)
    read = lambda: [r["s"] for r in sinks.read_latest(spark, path, schema).collect()]
    for i in range(12):
        sinks.upsert_latest(batch(i, f"s{i}"), path, i, ["k"], writer="first")
        assert len([n for n in os.listdir(path) if n.startswith("v")]) <= 2
    before = sinks.read_latest(spark, path, schema)
    sinks.upsert_latest(batch(100, "other"), path, 0, ["k"], writer="second")  # a new checkpoint begins at 0
    assert [r["s"] for r in before.collect()] == ["s11"] and read() == ["other"]
    sinks.upsert_latest(batch(50, "earlier"), path, 1, ["k"], writer="second")
    sinks.upsert_latest(batch(200, "repeated"), path, 1, ["k"], writer="second")
    assert read() == ["other"]
    with pytest.raises(ValueError, match="older"):
        sinks.upsert_latest(batch(300, "late writer"), path, 12, ["k"], writer="first")
    os.makedirs(f"{path}/v99-died")  # a version that was never published
    assert read() == ["other"]


def test_latest_snapshot_of_a_stream_outlives_its_checkpoint(spark, folder):
    schema = "k string, ts timestamp, s string"
    spark.createDataFrame([("a", at(5), "x"), ("b", at(5), "y")], schema).write.parquet(f"{folder}/in")
    for checkpoint in ("one", "two"):
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        query = sinks.latest_sink(stream, f"{folder}/out", f"{folder}/{checkpoint}", ["k"]).trigger(availableNow=True).start()
        query.awaitTermination(120)
        spark.createDataFrame([("a", at(9), "z")], schema).write.mode("append").parquet(f"{folder}/in")
    assert {r["k"]: r["s"] for r in sinks.read_latest(spark, f"{folder}/out", schema).collect()} == {"a": "z", "b": "y"}


def named(spark, *beans):
    out = naming.normalize_metrics(spark.createDataFrame([(b,) for b in beans], "bean string"))
    return {r["bean"]: (r["metric"], r["kind"], r["labels"]) for r in out.collect()}


@pytest.mark.parametrize(
    "bean, metric, kind, labels",
    [
        ("kafka.server<type=BrokerTopicMetrics, name=MessagesInPerSec><>Count", "kafka_server_brokertopicmetrics_messagesin_total", "COUNTER", {}),
        ("kafka.server<type=BrokerTopicMetrics, name=BytesInPerSec, topic=My.Topic><>Count", "kafka_server_brokertopicmetrics_bytesin_total", "COUNTER", {"topic": "My.Topic"}),
        ("kafka.server<type=BrokerTopicMetrics, name=FailedPerSec, topic=t><>Count", "kafka_server_brokertopicmetrics_failedpersec_total", "COUNTER", {"topic": "t"}),
        ("kafka.network<type=RequestMetrics, name=TotalTimeMs, request=Produce><>99thPercentile", "kafka_network_requestmetrics_totaltimems", "GAUGE", {"request": "Produce"}),
        ("kafka.network<type=RequestMetrics, name=SendTimeMs, request=Produce><>99thPercentile", "kafka_network_requestmetrics_sendtimems_p99", "GAUGE", {"request": "Produce"}),
        ("java.lang<type=Memory><HeapMemoryUsage>max", "jvm_memory_heap_max_bytes", "GAUGE", {"area": "heap"}),
        ("kafka.log<type=LogFlushStats, name=LogFlushRateAndTimeMs><>95thPercentile", "kafka_log_logflushstats_logflushrateandtimems", "GAUGE", {"quantile": "0.95"}),
        ("kafka.server<type=FetcherLagMetrics, name=ConsumerLag, clientId=C, topic=t, partition=0><>Value", "kafka_server_fetcherlagmetrics_consumerlag", "GAUGE", {"clientid": "C", "topic": "t", "partition": "0"}),
        ("kafka.server<type=X, name=Y, clientId=C, topic=t, partition=><>Value", "kafka_server_x_y", "GAUGE", {"clientid": "C", "topic": "t"}),
        ("kafka.server<type=X, name=Y, clientId=C, brokerHost=h, brokerPort=9><>Value", "kafka_server_x_y", "GAUGE", {"clientid": "C", "broker": "h:9"}),
        ("kafka.cluster<type=Partition, name=Under-Min><>Value", "kafka_cluster_partition_under_min", "GAUGE", {}),
        ("kafka.utils<type=Throttler, name=cleaner-io><>Count", "kafka_utils_throttler_cleaner_io_count", "COUNTER", {}),
        ("java.nio<type=BufferPool, name=direct><>MemoryUsed", "java_nio_bufferpool_memoryused", "UNTYPED", {"name": "direct"}),
    ],
)
def test_metric_names(spark, bean, metric, kind, labels):
    assert named(spark, bean)[bean] == (metric, kind, labels)


def test_repeated_names_give_the_same(spark):
    rows = spark.createDataFrame([("kafka.a<type=B, name=C><>Max",)] * 3, "bean string")
    assert naming.normalize_repeated(rows).collect() == naming.normalize_metrics(rows).collect()


def test_samples_as_table_and_stream(spark, folder):
    rows = samples(spark, [(0, "m", {"i": "a"}, 1), (1, "m", {}, None)]).withColumn("kind", F.lit("GAUGE"))
    sinks.append_events(rows, f"{folder}/s")
    assert readers.read_samples(spark, f"{folder}/s").count() == 2
    assert readers.read_samples(spark, f"{folder}/s", streaming=True).isStreaming
