import math

import pytest
from pyspark.sql import functions as F

from brokerlens.functions import nested, rules, scalars
from brokerlens.operators import joins
from tests.helpers import at, samples


def one(df):
    return df.first().asDict()


def test_sentinels_become_null(spark):
    rows = spark.createDataFrame([("N/A", -1), ("", 0), ("x", 5)], "t string, n int")
    out = [tuple(r) for r in scalars.nullify_sentinels(rows, ["t"], ["n"]).collect()]
    assert out == [(None, None), (None, 0.0), ("x", 5.0)]


def test_parse_ts_takes_three_formats(spark):
    rows = spark.createDataFrame(
        [("2024-01-01T00:00:01.5",), ("2024-01-01 00:00:01",), ("1704067201.25",), ("N/A",), (None,), ("NaN",)], "t string"
    )
    out = [r[0] for r in rows.select(scalars.parse_ts("t")).collect()]
    assert out == [at(1.5), at(1), at(1.25), None, None, None]


def test_impute_only_fills_missing_and_leaves_empty_columns(spark):
    rows = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    assert [tuple(r) for r in scalars.impute_mean(rows, ["a", "b"]).collect()] == [(1.0, None), (2.0, None), (3.0, None)]


@pytest.mark.parametrize(
    "text, name",
    [("0", "real-time"), ("REAL_TIME_EVENT_DRIVEN", "real-time"), ("REAL-TIME", "real-time"), ("1", "batch"),
     ("BATCH_PROCESSING", "batch"), ("UNKNOWN", "unknown"), ("", "unknown"), (None, "unknown")],
)
def test_canonical_workload(spark, text, name):
    rows = spark.createDataFrame([(text,)], "w string")
    assert rows.select(scalars.canonical_workload("w")).first()[0] == name


def test_recode_keeps_unknown_values(spark):
    rows = spark.createDataFrame([("default",), ("buffer",), ("custom",)], "c string")
    out = [r[0] for r in scalars.recode(rows, "c", scalars.CONFIGURATION_NAMES).collect()]
    assert out == ["baseline", "ARMS", "custom"]


def test_rounding_is_half_to_even(spark):
    rows = spark.createDataFrame([(0.125,), (0.375,)], "x double")
    assert [r[0] for r in rows.select(scalars.round_like_pandas("x", 2)).collect()] == [0.12, 0.38]


def test_align_up_is_strictly_later(spark):
    rows = spark.createDataFrame([(at(0),), (at(29.9),), (at(30),)], "t timestamp")
    assert [r[0] for r in rows.select(scalars.align_up("t", 30)).collect()] == [at(30), at(30), at(60)]


def test_interval_and_fallback(spark):
    rows = spark.createDataFrame([(10.0, 30.0, "NaN", "7"), (10.0, None, "x", None), (10.0, 600.0, "1", "2")], "a double, b double, c string, d string")
    out = rows.select(scalars.effective_interval("a", "b"), scalars.first_usable("c", "d", unknown=-1.0)).collect()
    assert [tuple(r) for r in out] == [(5.0, 7.0), (10.0, -1.0), (10.0, 1.0)]


def test_maps(spark):
    rows = spark.createDataFrame([({"a": "1", "b": None},), ({"a": None},), ({},), (None,)], "m map<string,string>")
    out = rows.select(
        scalars.compact_map("m").alias("c"), scalars.nothing_to_apply("m").alias("n"), scalars.map_to_json("m").alias("j")
    ).collect()
    assert [r["c"] for r in out] == [{"a": "1"}, {}, {}, None]
    assert [r["n"] for r in out][:3] == [False, True, True]
    assert [r["j"] for r in out][2:] == ["", ""]


def test_brokers(spark):
    rows = spark.createDataFrame([("kafka1:9092",), ("kafka2:9093",), ("kafka3:29094",), ("broker:1",)], "broker_url string")
    out = rows.select(scalars.broker_id("broker_url"), scalars.host_of("broker_url"), scalars.jmx_port("broker_url")).collect()
    assert [tuple(r) for r in out] == [(1, "kafka1", "9980"), (2, "kafka2", "9981"), (3, "kafka3", "9982"), (None, "broker", "9980")]
    assert scalars.primary_brokers(rows).count() == 2


def test_label_matchers_are_anchored_and_see_missing_as_empty(spark):
    rows = samples(spark, [(0, "m", {"i": "kafka1:9"}, 1), (0, "m", {"i": "xkafka1:9"}, 2), (0, "m", {}, 3)])
    assert [r["value"] for r in scalars.match_labels(rows, regex={"i": "kafka1.*"}).collect()] == [1.0]
    assert [r["value"] for r in scalars.match_labels(rows, equal={"i": ""}).collect()] == [3.0]


def test_organize(spark):
    rows = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert scalars.organize(rows, ["a"], ["d"], {"b": "x"}).columns == ["d", "x", "c"]


def test_missing_feature_names_the_first(spark):
    rows = spark.createDataFrame([(1.0, None, None), (1.0, 2.0, 3.0)], "a double, b double, c double")
    assert [r[0] for r in rows.select(scalars.missing_feature(["a", "b", "c"])).collect()] == ["b", None]


def test_neg_log10_and_scenario(spark):
    rows = spark.createDataFrame([(0.001, "batch", True), (0.1, "real_time", False)], "p double, w string, a boolean")
    out = rows.select(scalars.neg_log10("p"), scalars.scenario_name("w", "a")).collect()
    assert math.isclose(out[0][0], 3) and out[0][1] == "batch_with_arms" and out[1][1] == "real_time_without_arms"


def test_strategy_rule(spark):
    rows = spark.createDataFrame(
        [(0, 95.0, None), (1, 90.0, None), (1, 89.9, 0), (1, 95.0, 0), (2, 99.0, None), (None, None, None)],
        "prediction int, confidence double, actual int",
    )
    out = rules.select_strategy(rows, actual="actual").select("strategy", "workload").collect()
    assert [r["strategy"] for r in out] == [
        "QUICK_REBALANCE", "RESOURCE_OPTIMIZED", "CONTROLLED_GRADUAL", "QUICK_REBALANCE", "CONTROLLED_GRADUAL", "CONTROLLED_GRADUAL",
    ]
    assert out[2]["workload"] == "HYBRID_UNKNOWN"


def test_effective_config(spark):
    rows = spark.createDataFrame(
        [("default", "QUICK_REBALANCE", None), ("buffer", "QUICK_REBALANCE", None), ("buffer", "NONE", None), ("x", "NONE", {"k": "1", "z": None})],
        "config_source string, strategy string, own map<string,string>",
    )
    out = rules.effective_config(rows, joins.strategy_dimension(spark), custom="own")
    got = {(r["config_source"], r["strategy"]): (r["effective"], r["config_used"], r["applied"]) for r in out.collect()}
    assert got["default", "QUICK_REBALANCE"] == ({}, "default", True)
    assert got["buffer", "QUICK_REBALANCE"][0]["num.replica.fetchers"] == "4"
    assert got["buffer", "NONE"] == (None, "buffer", False)
    assert got["x", "NONE"] == ({"k": "1"}, "custom", True)


def test_verdict_outcome_bands(spark):
    rows = spark.createDataFrame([(1, 1, "S", True, 95.0), (1, 0, "S", False, 69.9), (1, None, None, False, None)], "prediction int, actual int, strategy string, ok boolean, c double")
    assert [r["verdict"] for r in rules.alignment_verdict(rows).collect()] == ["match", "mismatch", "unknown"]
    done = rules.outcome(rows, F.col("ok")).collect()
    assert done[0]["result"] == "SUCCESS" and "'S'" in done[0]["details"] and "'DEFAULT'" in done[2]["details"]
    assert [r[0] for r in rows.select(rules.band("c", rules.CONFIDENCE_BANDS)).collect()] == ["green", "red", None]


def test_messages_of_both_shapes(spark):
    real = '{"taxonomy":{"latency_sensitivity":"real_time"},"metadata":{"source_id":"s","sample_rate":16000},"results":{"words":[{"word":"a"},{"word":"b"}]},"features":{"mfcc":[0.5]}}'
    batch = '{"taxonomy":{"latency_sensitivity":"batch"},"batch_metadata":{"batch_id":7},"features":{"spectrogram":[[1,2],[3]]}}'
    rows = nested.parse_messages(spark.createDataFrame([("1", real), ("2", batch), ("3", "broken")], "key string, value string"))
    out = {r["key"]: r for r in rows.select("key", "shape", "message", nested.transcript("message.results.words").alias("t")).collect()}
    assert (out["1"]["shape"], out["1"]["t"]) == ("real_time", "a b")
    assert out["2"]["message"]["features"]["spectrogram"] == [[1.0, 2.0], [3.0]] and out["3"]["shape"] == "unknown"
    words = nested.word_offsets(rows, ["key"]).collect()
    assert [(r["word"], round(r["start_time"], 3), round(r["end_time"], 3)) for r in words] == [("a", 0.0, 0.3), ("b", 0.3, 0.6)]


def test_payload_counts_bytes_not_characters(spark):
    rows = spark.createDataFrame([("é",), ("ab",)], "value string")
    assert one(nested.payload_stats(rows, [])) == {"messages": 2, "total_bytes": 4, "avg_bytes": 2.0, "min_bytes": 2, "max_bytes": 2}
