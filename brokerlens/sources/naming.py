"""Management-bean readings to metric names, kinds and labels, by an ordered rule table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``pattern`` may match anywhere; ``$n`` in name and labels stands for its groups.

    A rule without a name keeps the reading under a name built from the bean itself.
    """

    pattern: str
    name: str | None = None
    kind: str = "UNTYPED"
    labels: dict = field(default_factory=dict, hash=False)


# The renaming rules, tried in this order, first match wins.
RULES = [
    Rule(r"kafka.server<type=BrokerTopicMetrics, name=MessagesInPerSec><>Count", "kafka_server_brokertopicmetrics_messagesin_total", "COUNTER"),
    Rule(r"kafka.server<type=BrokerTopicMetrics, name=BytesInPerSec><>Count", "kafka_server_brokertopicmetrics_bytesin_total", "COUNTER"),
    Rule(r"kafka.server<type=BrokerTopicMetrics, name=BytesOutPerSec><>Count", "kafka_server_brokertopicmetrics_bytesout_total", "COUNTER"),
    Rule(r"kafka.server<type=BrokerTopicMetrics, name=MessagesOutPerSec><>Count", "kafka_server_brokertopicmetrics_messagesout_total", "COUNTER"),
    Rule(r"kafka.server<type=BrokerTopicMetrics, name=BytesOutPerSec, topic=(.+)><>Count", "kafka_server_brokertopicmetrics_bytesout_total", "COUNTER", {"topic": "$1"}),
    Rule(r"kafka.server<type=BrokerTopicMetrics, name=BytesInPerSec, topic=(.+)><>Count", "kafka_server_brokertopicmetrics_bytesin_total", "COUNTER", {"topic": "$1"}),
    Rule(r"kafka.network<type=RequestMetrics, name=TotalTimeMs, request=(.+)><>99thPercentile", "kafka_network_requestmetrics_totaltimems", "GAUGE", {"request": "$1"}),
    Rule(r"kafka.network<type=RequestMetrics, name=RequestQueueTimeMs, request=(.+)><>Mean", "kafka_network_requestmetrics_requestqueuetimems", "GAUGE", {"request": "$1"}),
    Rule(r"kafka.network<type=RequestMetrics, name=LocalTimeMs, request=(.+)><>Mean", "kafka_network_requestmetrics_localtimems", "GAUGE", {"request": "$1"}),
    Rule(r"kafka.network<type=RequestMetrics, name=(.+), request=(.+)><>Mean", "kafka_network_requestmetrics_$1_mean", "GAUGE", {"request": "$2"}),
    Rule(r"kafka.network<type=RequestMetrics, name=(.+), request=(.+)><>99thPercentile", "kafka_network_requestmetrics_$1_p99", "GAUGE", {"request": "$2"}),
    Rule(r"kafka.server<type=BrokerTopicMetrics, name=TotalProduceRequestsPerSec><>Count", "kafka_server_brokertopicmetrics_totalproducerequests_total", "COUNTER"),
    Rule(r"kafka.server<type=BrokerTopicMetrics, name=TotalFetchRequestsPerSec><>Count", "kafka_server_brokertopicmetrics_totalfetchrequests_total", "COUNTER"),
    Rule(r"java.lang<type=Memory><HeapMemoryUsage>used", "java_lang_memory_heapmemoryusage_used", "GAUGE"),
    Rule(r"java.lang<type=Memory><HeapMemoryUsage>(\w+)", "jvm_memory_heap_$1_bytes", "GAUGE", {"area": "heap"}),
    Rule(r"java.lang<type=Memory><NonHeapMemoryUsage>(\w+)", "jvm_memory_nonheap_$1_bytes", "GAUGE", {"area": "nonheap"}),
    Rule(r"java.lang<type=Threading><>ThreadCount", "java_lang_threading_threadcount", "GAUGE"),
    Rule(r"java.lang<type=Threading><>(\w+)", "jvm_threading_$1", "GAUGE"),
    Rule(r"java.lang<type=GarbageCollector, name=(.+)><>CollectionCount", "jvm_gc_collection_count", "COUNTER", {"name": "$1"}),
    Rule(r"java.lang<type=GarbageCollector, name=(.+)><>CollectionTime", "jvm_gc_collection_time_seconds_total", "COUNTER", {"name": "$1"}),
    Rule(r"java.lang<type=OperatingSystem><>(\w+)", "jvm_os_$1", "GAUGE"),
    Rule(r"kafka.server<type=ReplicaManager><>UnderReplicatedPartitions", "kafka_server_replicamanager_underreplicatedpartitions", "GAUGE"),
    Rule(r"kafka.server<type=ReplicaManager><>PartitionCount", "kafka_server_replicamanager_partitioncount", "GAUGE"),
    Rule(r"kafka.server<type=ReplicaManager><>LeaderCount", "kafka_server_replicamanager_leadercount", "GAUGE"),
    Rule(r"kafka.server<type=KafkaRequestHandlerPool, name=RequestHandlerAvgIdlePercent><>OneMinuteRate", "kafka_server_requesthandlerpool_requesthandleravgidlepercent", "GAUGE"),
    Rule(r"kafka.controller<type=KafkaController, name=OfflinePartitionsCount><>Value", "kafka_controller_offlinepartitionscount", "GAUGE"),
    Rule(r"kafka.controller<type=KafkaController, name=ActiveControllerCount><>Value", "kafka_controller_activecontrollercount", "GAUGE"),
    Rule(r"kafka.controller<type=ControllerStats, name=LeaderElectionRateAndTimeMs><>Count", "kafka_controller_stats_leaderelectionrateandtimems_count", "COUNTER"),
    Rule(r"kafka.controller<type=ControllerStats, name=LeaderElectionRateAndTimeMs><>(\d+)thPercentile", "kafka_controller_stats_leaderelectionrateandtimems", "GAUGE", {"quantile": "0.$1"}),
    Rule(r"kafka.controller<type=ControllerStats, name=UncleanLeaderElectionsPerSec><>Count", "kafka_controller_uncleanleaderelections_total", "COUNTER"),
    Rule(r"kafka.server<type=BrokerTopicMetrics, name=ProduceMessageConversionsPerSec><>Count", "kafka_server_brokertopicmetrics_producemessageconversions_total", "COUNTER"),
    Rule(r"kafka.server<type=BrokerTopicMetrics, name=FetchMessageConversionsPerSec><>Count", "kafka_server_brokertopicmetrics_fetchmessageconversions_total", "COUNTER"),
    Rule(r"kafka.server<type=ReplicaFetcherManager, name=MaxLag, clientId=(.+)><>Value", "kafka_server_replicafetchermanager_maxlag", "GAUGE", {"clientId": "$1"}),
    Rule(r"kafka.server<type=FetcherLagMetrics, name=ConsumerLag, clientId=(.+), topic=(.+), partition=(.+)><>Value", "kafka_server_fetcherlagmetrics_consumerlag", "GAUGE", {"clientId": "$1", "topic": "$2", "partition": "$3"}),
    Rule(r"kafka.log<type=LogFlushStats, name=LogFlushRateAndTimeMs><>Count", "kafka_log_logflushstats_logflushrateandtimems_count", "COUNTER"),
    Rule(r"kafka.log<type=LogFlushStats, name=LogFlushRateAndTimeMs><>(\d+)thPercentile", "kafka_log_logflushstats_logflushrateandtimems", "GAUGE", {"quantile": "0.$1"}),
    Rule(r"kafka.server<type=BrokerTopicMetrics, name=MessagesInPerSec><>OneMinuteRate", "kafka_server_brokertopicmetrics_messagesin_rate", "GAUGE"),
    Rule(r"kafka.server<type=BrokerTopicMetrics, name=BytesInPerSec><>OneMinuteRate", "kafka_server_brokertopicmetrics_bytesin_rate", "GAUGE"),
    Rule(r"kafka.server<type=BrokerTopicMetrics, name=TotalProduceRequestsPerSec><>OneMinuteRate", "kafka_server_brokertopicmetrics_totalproducerequests_rate", "GAUGE"),
    Rule(r"kafka.server<type=BrokerTopicMetrics, name=MessagesInPerSec, topic=(.+)><>OneMinuteRate", "kafka_server_topic_messagesin_rate", "GAUGE", {"topic": "$1"}),
    Rule(r"kafka.server<type=BrokerTopicMetrics, name=BytesInPerSec, topic=(.+)><>OneMinuteRate", "kafka_server_topic_bytesin_rate", "GAUGE", {"topic": "$1"}),
    Rule(r"kafka.server<type=DelayedOperationPurgatory, name=PurgatorySize, delayedOperation=(.+)><>Value", "kafka_server_delayedoperationpurgatory_purgatorysize", "GAUGE", {"delayedOperation": "$1"}),
    Rule(r"kafka.server<type=SessionExpireListener, name=ZooKeeperDisconnectsPerSec><>Count", "kafka_server_zookeeper_disconnects_total", "COUNTER"),
    Rule(r"kafka.server<type=SessionExpireListener, name=ZooKeeperSyncConnectsPerSec><>Count", "kafka_server_zookeeper_syncconnects_total", "COUNTER"),
    Rule(r"kafka.server<type=SessionExpireListener, name=ZooKeeperExpiresPerSec><>Count", "kafka_server_zookeeper_expires_total", "COUNTER"),
    Rule(r"kafka.server<type=DynamicConfigManager, name=(.+)PerSecond><>Count", "kafka_server_dynamicconfigmanager_$1_total", "COUNTER"),
    Rule(r"kafka.server<type=(.+), name=(.+), clientId=(.+), topic=(.+), partition=(.*)><>Value", "kafka_server_$1_$2", "GAUGE", {"clientId": "$3", "topic": "$4", "partition": "$5"}),
    Rule(r"kafka.server<type=(.+), name=(.+), clientId=(.+), brokerHost=(.+), brokerPort=(.+)><>Value", "kafka_server_$1_$2", "GAUGE", {"clientId": "$3", "broker": "$4:$5"}),
    Rule(r"kafka.server<type=BrokerTopicMetrics, name=(.+), topic=(.+)><>Count", "kafka_server_brokertopicmetrics_$1_total", "COUNTER", {"topic": "$2"}),
    Rule(r"kafka.server<type=BrokerTopicMetrics, name=(.+), topic=(.+)><>FifteenMinuteRate", "kafka_server_brokertopicmetrics_$1_fifteen_minute_rate", "GAUGE", {"topic": "$2"}),
    Rule(r"kafka.server<type=BrokerTopicMetrics, name=(.+), topic=(.+)><>FiveMinuteRate", "kafka_server_brokertopicmetrics_$1_five_minute_rate", "GAUGE", {"topic": "$2"}),
    Rule(r"kafka.server<type=BrokerTopicMetrics, name=(.+), topic=(.+)><>OneMinuteRate", "kafka_server_brokertopicmetrics_$1_one_minute_rate", "GAUGE", {"topic": "$2"}),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+)><>Count", "kafka_$1_$2_$3_count", "COUNTER"),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+)><>(\d+)thPercentile", "kafka_$1_$2_$3", "GAUGE", {"quantile": "0.$4"}),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+)><>(\d+)Percentile", "kafka_$1_$2_$3", "GAUGE", {"quantile": "0.$4"}),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+)><>Mean", "kafka_$1_$2_$3_mean", "GAUGE"),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+)><>Max", "kafka_$1_$2_$3_max", "GAUGE"),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+)><>Min", "kafka_$1_$2_$3_min", "GAUGE"),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+)><>StdDev", "kafka_$1_$2_$3_stddev", "GAUGE"),
    Rule(r"kafka.(\w+)<type=(.+), name=(.+)><>Value", "kafka_$1_$2_$3", "GAUGE"),
    Rule(r".*"),
]


# The CASE over all rules is written as SQL text: one expression to hand over instead of hundreds of calls.


def _quoted(text: str) -> str:
    return "r'" + text + "'"


def _filled(bean: str, rule: Rule, template: str) -> str:
    """The template with its ``$n`` replaced by what the pattern's groups caught."""
    whole = _quoted(f"^.*(?:{rule.pattern}).*$")
    parts = [p for p in re.split(r"(\$\d)", template) if p]
    texts = [f"regexp_extract({bean}, {whole}, {p[1:]})" if re.fullmatch(r"\$\d", p) else _quoted(p) for p in parts]
    return texts[0] if len(texts) == 1 else f"concat({', '.join(texts)})"


def _safe_name(name: str) -> str:
    """Lower case, with every run of other characters as one underscore."""
    return f"lower(regexp_replace({name}, '[^a-zA-Z0-9:]+', '_'))"


def _named(metric: str, kind: str, labels: str) -> str:
    """Labels are an array of key and value; empty ones are left out."""
    known = f"map_from_entries(filter({labels}, p -> p.key <> '' AND p.value <> ''))" if labels else "map()"
    return f"named_struct('metric', {metric}, 'kind', '{kind}', 'labels', CAST({known} AS map<string,string>))"


def _from_rule(bean: str, rule: Rule) -> str:
    pairs = [f"named_struct('key', '{k.lower()}', 'value', {_filled(bean, rule, v)})" for k, v in rule.labels.items()]
    return _named(_safe_name(_filled(bean, rule, rule.name)), rule.kind, f"array({', '.join(pairs)})" if pairs else "")


def _from_bean(bean: str) -> str:
    """Name and labels of a reading no rule names: first property in the name, the others as labels."""
    properties = f"split(regexp_extract({bean}, '^[^<]*<(.*?)><', 1), ', ')"
    parts = [
        f"substring_index({bean}, '<', 1)",
        f"nullif(regexp_extract(get({properties}, 0), '^[^=]*=(.*)$', 1), '')",
        f"nullif(regexp_replace(regexp_extract({bean}, '><(.*)>[^>]*$', 1), ', ', '_'), '')",
        f"nullif(regexp_extract({bean}, '>([^>]*)$', 1), '')",
    ]
    key, value = _safe_name("substring_index(p, '=', 1)"), "regexp_extract(p, '^[^=]*=(.*)$', 1)"
    rest = f"transform(slice({properties}, 2, size({properties})), p -> named_struct('key', {key}, 'value', {value}))"
    return _named(_safe_name(f"concat_ws('_', {', '.join(parts)})"), "UNTYPED", rest)


def normalize_metrics(df: DataFrame, rules: list[Rule] = RULES, bean: str = "bean") -> DataFrame:
    """Add ``metric``, ``kind`` and ``labels``; one CASE expression, so later rules run only when needed."""
    source = f"`{bean}`"
    cases = [
        f"WHEN {source} RLIKE {_quoted(r.pattern)} THEN {_from_bean(source) if r.name is None else _from_rule(source, r)}"
        for r in rules
    ]
    named = df.withColumn("_named", F.expr(f"CASE {' '.join(cases)} END"))
    return named.select(*df.columns, "_named.metric", "_named.kind", "_named.labels")


def normalize_repeated(df: DataFrame, rules: list[Rule] = RULES, bean: str = "bean") -> DataFrame:
    """The same for tables in which few bean names repeat in many readings.

    The rules run once per distinct name and the result is joined back.
    """
    names = df.select(bean).where(F.col(bean).isNotNull()).distinct()
    return df.join(normalize_metrics(names, rules, bean), bean, "left")
