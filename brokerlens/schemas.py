"""Explicit schemas of every input shape; nothing is inferred."""

from __future__ import annotations

# Column names of the wide telemetry file, in file order.
FEATURE_NAMES = [
    "message_rate",
    "payload_size",
    "batch_size",
    "kafka_server_brokertopicmetrics_messagesin_total",
    "kafka_server_brokertopicmetrics_bytesin_total",
    "message_size_bytes",
    "message_rate_variance",
    "process_cpu_seconds_total",
    "java_lang_memory_heapmemoryusage_used",
    "node_disk_io_time_seconds_total",
    "memory_usage_variance",
    "kafka_network_requestmetrics_totaltimems",
    "kafka_server_brokertopicmetrics_totalproducerequests_total",
    "java_lang_threading_threadcount",
    "request_rate_variance",
    "node_memory_MemAvailable_bytes",
    "node_disk_read_bytes_total",
    "node_disk_write_bytes_total",
]
GENERATOR_FEATURES = ["message_rate", "payload_size", "batch_size"]
# The four inputs of the trained classifier, in checking order.
MODEL_FEATURES = [
    "request_rate_variance",
    "node_disk_write_bytes_total",
    "message_rate_variance",
    "node_memory_MemAvailable_bytes",
]


# Schemas are column lists as Spark's readers take them.


def features(names: list[str] = FEATURE_NAMES) -> str:
    return "timestamp string, workload_type int, " + ", ".join(f"`{name}` double" for name in names)


def _only(schema: str, keep) -> str:
    return ", ".join(column for i, column in enumerate(schema.split(", ")) if keep(i, column.split(" ")[0]))


RECOVERY = (
    "timestamp string, strategy string, workload_type string, config_source string, "
    "recovery_time_seconds double, cpu_usage_percent double, memory_usage_percent double, "
    "broker_url string, result string, under_replicated_before int, under_replicated_after int, "
    "offline_before int, offline_after int, details string, applied_config string"
)
RECOVERY_OLD = _only(RECOVERY, lambda _, name: name not in ("config_source", "applied_config"))
RECOVERY_CURATED = _only(RECOVERY, lambda i, _: i < 7)
RECOVERY_VERSIONS = {"full": RECOVERY, "old": RECOVERY_OLD, "curated": RECOVERY_CURATED}

EXPERIMENT = (
    "experiment_id string, timestamp string, scenario string, run_number int, workload_type string, "
    "arms_strategy boolean, strategy string, broker_url string, recovery_time_seconds double, "
    "cpu_usage_percent double, memory_usage_percent double, message_rate_before double, "
    "message_rate_during double, message_rate_after double, under_replicated_before double, "
    "under_replicated_after double, offline_before double, offline_after double, result string, details string"
)
PROGRESS = (
    "timestamp string, workload_type string, message_rate double, payload_size_bytes double, "
    "batch_size int, cpu_usage double, memory_usage double"
)
CLASSIFICATION = "timestamp string, selected_strategy string"
STRATEGY = (
    "timestamp double, strategy string, workload_type string, config map<string,string>, confidence double"
)
SAMPLES = "ts timestamp, metric string, labels map<string,string>, value double, kind string"

MESSAGE = (
    "taxonomy struct<latency_sensitivity:string,data_criticality:string,processing_pattern:string,"
    "resource_intensity:string>, "
    "metadata struct<source_id:string,timestamp:string,sample_rate:int,num_channels:int,"
    "duration_seconds:double,format:string>, "
    "batch_metadata struct<batch_id:int,timestamp:string,processing_pipeline:string,total_files:int,"
    "compression_type:string,format_version:string,priority:string>, "
    "audio_metadata struct<file_id:string,sample_rate:int,num_channels:int,duration_seconds:double,format:string>, "
    "results struct<transcript:string,confidence:double,"
    "words:array<struct<word:string,confidence:double,start_time:double,end_time:double>>,language:string>, "
    "features struct<mfcc:array<double>,audio_embeddings:array<double>,spectrogram:array<array<double>>>"
)
