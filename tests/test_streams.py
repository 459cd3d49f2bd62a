"""Streams fed file by file give what the batch operators give on all rows."""

import math
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from brokerlens.functions.rules import select_strategy
from brokerlens.plans import q_streams
from brokerlens.operators import sequence, series
from brokerlens.schemas import MODEL_FEATURES
from brokerlens.sources import readers, sinks
from brokerlens.streaming import jobs
from brokerlens.streaming.features import _summary
from tests.helpers import at, since


def feed(spark, folder, rows, schema, parts=4, late=0):
    """Rows as several files, out of time order by up to ``late`` seconds, and a stream that reads one file per batch."""
    rnd = random.Random(7)
    rows = sorted(rows, key=lambda r: since(r[1]) + rnd.uniform(0, late))
    size = -(-len(rows) // parts)
    for i in range(parts):
        chunk = rows[i * size:(i + 1) * size]
        random.Random(i).shuffle(chunk)
        path = f"{folder}/in"
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            if name.endswith(".parquet"):
                stamp = 1_700_000_000 + i if not os.path.exists(f"{path}/.seen-{name}") else None
                if stamp:
                    os.utime(f"{path}/{name}", (stamp, stamp))
                    open(f"{path}/.seen-{name}", "w").close()
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def finish(spark, folder, df):
    jobs.run_available(sinks.append_stream(df, f"{folder}/out", f"{folder}/state"), 300)
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


@pytest.mark.parametrize("late", [0, 500])
def test_changes(spark, folder, late):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), at(t), rnd.choice(["x", "y"])) for t in range(0, 4000, 37)]
    rows += [("a", at(70), "x"), ("a", at(70), "y"), ("c", at(9000), "end")]  # the last closes the stream
    schema = "k string, ts timestamp, value string"
    out = finish(spark, folder, jobs.change_stream(feed(spark, folder, rows, schema, 6, late), ["k"]))
    batch = sequence.change_events(spark.createDataFrame(rows, schema), "value", ["k"])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_late_rows_of_an_earlier_file(spark, folder):
    schema = "k string, ts timestamp, value string"
    for i, part in enumerate([[(0, "x"), (60, "x")], [(30, "y"), (90, "x")], [(5000, "x")]]):
        spark.createDataFrame([("a", at(t), v) for t, v in part], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    got = [(since(r["ts"]), r["old"], r["new"]) for r in finish(spark, folder, jobs.change_stream(stream, ["k"])).collect()]
    assert sorted(got) == [(30, "x", "y"), (60, "y", "x")]


def test_forgotten_keys_have_no_state_and_no_change(spark, folder):
    schema = "k string, ts timestamp, value string"
    rows = [("a", at(0), "x"), ("b", at(0), "x"), ("b", at(900), "y"), ("c", at(5000), "x"), ("a", at(9000), "y"), ("c", at(20_000), "x"), ("c", at(40_000), "x")]
    stream = jobs.change_stream(feed(spark, folder, rows, schema, 7), ["k"], forget=1000.0)
    query = jobs.run_available(sinks.append_stream(stream, f"{folder}/out", f"{folder}/state"), 300)
    got = [tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{folder}/out").select("k", "old", "new").collect()]
    assert got == [("b", "x", "y")]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1


@pytest.mark.parametrize("late", [0, 500])
def test_strategy_in_force_equals_the_batch_join(spark, folder, late):
    rnd = random.Random(5)
    events = [(rnd.choice("ab"), at(t), t) for t in range(0, 4000, 31)] + [("z", at(30_000), -1)]
    versions = [(rnd.choice("ab"), at(t), rnd.choice(["s1", "s2", "s3"]), {"n": str(t)}) for t in range(100, 4000, 143)]
    versions += [("a", at(31), "s1", {"n": "0"}), ("z", at(30_000), "end", {})]
    event_schema, version_schema = "k string, ts timestamp, id long", "k string, ts timestamp, strategy string, config map<string,string>"
    found = jobs.in_force_stream(
        feed(spark, f"{folder}/e", events, event_schema, 5, late), feed(spark, f"{folder}/v", versions, version_schema, 5, late),
        ["k"], ["strategy", "config"],
    )
    got = sorted((r["id"], r["strategy"], str(r["config"])) for r in finish(spark, folder, found).collect() if r["id"] >= 0)
    want = []
    for k, t, i in events[:-1]:
        at_or_before = [v for v in versions if v[0] == k and v[1] <= t]
        newest = max(at_or_before, key=lambda v: v[1], default=(None, None, None, None))
        want.append((i, newest[2], str(newest[3])))
    assert got == sorted(want)


def test_one_recovery_at_a_time(spark, folder):
    schema = "broker string, ts timestamp, up boolean"
    rows = [("k", at(t), False) for t in range(0, 100, 5)] + [("k", at(101), True), ("k", at(105), False), ("k", at(5000), True)]
    gated = jobs.outage_stream(feed(spark, folder, rows, schema, 4, 300), one_at_a_time=True)
    got = sorted((since(r["ts"]), r["kind"]) for r in finish(spark, folder, gated).collect())
    # Begun at 0, given up after 60; the next attempt at the first reading after that, and one for the next outage.
    assert got == [(0, "attempt"), (0, "timeout"), (65, "attempt"), (105, "attempt"), (105, "timeout")]


@pytest.mark.parametrize("late", [0, 500])
def test_outages_attempts_and_timeouts(spark, folder, late):
    rnd = random.Random(2)
    rows = [(rnd.choice(["k1", "k2"]), at(t), rnd.random() < 0.6) for t in range(0, 3000, 9)]
    rows += [("k3", at(100), False), ("k1", at(9000), True), ("k2", at(9000), True)]
    schema = "broker string, ts timestamp, up boolean"
    out = finish(spark, folder, jobs.outage_stream(feed(spark, folder, rows, schema, 6, late)))
    table = spark.createDataFrame(rows, schema)
    expected = [(r["broker"], "attempt", since(r["ts"]), 0.0) for r in sequence.cooldown(table.filter("NOT up")).collect() if r["accepted"]]
    for r in sequence.outages(table).collect():
        expected.append((r["broker"], "recovered" if r["recovered"] else "timeout", since(r["down_at"]), r["duration_seconds"]))
    got = [(r["broker"], r["kind"], since(r["ts"]), r["seconds"]) for r in out.collect()]
    assert sorted(got) == sorted(expected)
    assert ("k3", "timeout", 100.0, 60.0) in got  # reported by the watermark alone


@pytest.mark.parametrize("late", [0, 500])
def test_sliding_counters(spark, folder, late):
    rnd = random.Random(3)
    rows, value = [], 0.0
    for t in range(0, 4000, 13):
        value = 0.0 if rnd.random() < 0.05 else value + rnd.randint(0, 5)
        rows.append(("c", at(t), {"i": "a"}, value))
    rows.append(("c", at(90_000), {"i": "a"}, 0.0))
    schema = "metric string, ts timestamp, labels map<string,string>, value double"
    out = finish(spark, folder, jobs.sliding_stream(feed(spark, folder, rows, schema, 6, late), 300, 60))
    batch = series.window_stats(spark.createDataFrame(rows, schema), {"w": 300}, 60).collect()
    expected = {since(r["ts"]): (r["w"]["n"], r["w"]["increase"] if r["w"]["n"] > 1 else None) for r in batch}
    got = {since(r["ts"]): (r["n"], r["increase"]) for r in out.collect()}
    spread = {since(r["ts"]): r["value"] for r in series.over_time(spark.createDataFrame(rows, schema), "stddev", 300, 60).collect()}
    assert all(abs(spread[since(r["ts"])] - r["deviation"]) < 1e-9 for r in out.collect())
    assert len(got) > 60 and all(expected[t] == v for t, v in got.items())
    assert set(got) == {t for t in expected if t <= 90_000 - 600}


def test_sessions_counts_throughput_and_latest(spark, folder):
    rows = [("a", at(t), "x" * (t % 3)) for t in (0, 5, 15, 26, 27, 2000, 5000)]
    schema = "k string, ts timestamp, value string"
    stream = feed(spark, folder, rows, schema, 3)
    sessions = finish(spark, folder, jobs.gap_sessions(stream, 10)).orderBy("started").collect()
    assert [(since(r["started"]), since(r["last_seen"]), r["events"]) for r in sessions] == [(0, 15, 3), (26, 27, 2), (2000, 2000, 1)]

    jobs.run_available(jobs.counts_sink(jobs.prediction_counts(stream, F.when(F.length("value") > 0, "ok").otherwise("no")), f"{folder}/n", f"{folder}/n-state"), 300)
    counts = sinks.read_latest(spark, f"{folder}/n", spark.createDataFrame([], "status string, count bigint").schema)
    assert {r["status"]: r["count"] for r in counts.collect()} == {"ok": sum(t % 3 > 0 for t in (0, 5, 15, 26, 27, 2000, 5000)), "no": sum(t % 3 == 0 for t in (0, 5, 15, 26, 27, 2000, 5000))}

    out = f"{folder}/t"
    flow = jobs.throughput_stream(stream, 60)
    jobs.run_available(sinks.append_stream(flow, out, f"{folder}/t-state"), 300)
    first = spark.read.schema(flow.schema).parquet(out).orderBy("ts").first()
    assert (first["messages"], first["bytes"]) == (5, sum(t % 3 for t in (0, 5, 15, 26, 27)))

    jobs.run_available(jobs.latest_strategy_sink(stream, f"{folder}/l", f"{folder}/l-state", ["k"]), 300)
    assert since(sinks.read_latest(spark, f"{folder}/l", stream.schema).first()["ts"]) == 5000


def test_scoring_marks_windows_without_a_feature(spark, folder):
    from brokerlens.operators import model

    train = spark.createDataFrame([(i, i % 2, float(i % 2) * 10 + i * 0.01, 1.0 * i) for i in range(60)], "id int, label int, f double, g double")
    fitted = model.train_classifier(train, ["f", "g"], "label")
    rows = [("F", at(1), {}, 10.0), ("G", at(2), {}, 5.0), ("F", at(31), {}, 0.0), ("G", at(32), {}, 5.0), ("F", at(61), {}, 0.0), ("F", at(5000), {}, 0.0)]
    schema = "metric string, ts timestamp, labels map<string,string>, value double"
    scored = jobs.score_stream(feed(spark, folder, rows, schema, 2), fitted, {"f": ("F", "avg"), "g": ("G", "avg")})
    out = {since(r["ts"]): r for r in finish(spark, folder, scored.select("ts", "prediction", "type", "confidence", "strategy", "error")).collect()}
    assert out[30]["prediction"] == 1 and out[60]["prediction"] == 0
    assert out[90]["type"] == "UNKNOWN" and out[90]["strategy"] == "CONTROLLED_GRADUAL" and out[90]["error"].endswith(": g")


def telemetry(seed=3):
    """Counters that reset now and then, a level, gaps, copies of an instant and samples off the grid."""
    rnd, rows = random.Random(seed), []
    metrics = {f.metric for f in series.FEATURES if f.name in MODEL_FEATURES}
    for metric in sorted(metrics):
        for broker in "ab":
            value = 0.0
            for t in range(0, 2400, 15):
                value = rnd.uniform(0, 5) if rnd.random() < 0.03 else value + rnd.uniform(0, 50)
                if rnd.random() < 0.9:
                    rows.append((metric, at(t + rnd.choice([0, 0, 1.25])), {"instance": broker}, value))
                if rnd.random() < 0.1:
                    rows.append((*rows[-1][:3], rows[-1][3] - 1.0))
    return rows + [(metric, at(60), {"instance": "a"}, None)]


SAMPLES = "metric string, ts timestamp, labels map<string,string>, value double"


@pytest.mark.parametrize("late", [0, 500])
def test_feature_rows_of_a_stream_equal_the_batch(spark, folder, late):
    wanted = [f for f in series.FEATURES if f.name in MODEL_FEATURES] + [
        series.Feature("first_level", "node_memory_MemAvailable_bytes"),
        series.Feature("of_b", "node_disk_written_bytes_total", "rate_5m", "avg", 100.0, {"instance": "b"}),
    ]
    rows = telemetry()
    stream = jobs.feature_matrix_stream(feed(spark, folder, [*rows, ("other", at(30_000), {}, 0.0)], SAMPLES, 5, late), wanted)
    got = {r["ts"]: r for r in finish(spark, folder, stream).collect()}
    expected = {r["ts"]: r for r in series.feature_matrix(spark.createDataFrame(rows, SAMPLES), wanted).collect()}
    assert set(got) == set(expected) and len(got) > 150
    for ts, row in expected.items():
        known, found = ([math.nan if v is None else v for v in tuple(r)[1:]] for r in (row, got[ts]))
        assert found == pytest.approx(known, rel=1e-9, abs=1e-6, nan_ok=True), ts


def test_scoring_by_the_features_of_the_model(spark, folder):
    from brokerlens.operators import model

    rows = telemetry(5)
    table = series.feature_matrix(spark.createDataFrame(rows, SAMPLES)).select("ts", *MODEL_FEATURES)
    level = "node_memory_MemAvailable_bytes"
    middle = table.approxQuantile(level, [0.5], 0.0)[0]
    fitted = model.train_classifier(table.withColumn("label", (F.col(level) > middle).cast("int")), MODEL_FEATURES, "label")
    scored = jobs.score_stream(feed(spark, folder, [*rows, ("other", at(30_000), {}, 0.0)], SAMPLES, 4, 300), fitted, seconds=15.0)
    kept = scored.select("ts", "prediction", "type", "strategy")
    batch = {r["ts"]: tuple(r) for r in select_strategy(model.classify(table, fitted, MODEL_FEATURES)).select(*kept.columns).collect()}
    got = {r["ts"]: tuple(r) for r in finish(spark, folder, kept).collect()}
    assert got == batch and {"UNKNOWN"} < {r[2] for r in got.values()}
    with pytest.raises(ValueError):
        jobs.score_stream(scored, fitted, by=["instance"])


def test_messages_stream_and_restart(spark, folder):
    rows = [(str(i), at(i), "v") for i in range(6)]
    feed(spark, folder, rows, "key string, ts timestamp, value string", 2)
    stream = readers.read_messages(spark, f"{folder}/in")
    for _ in range(2):  # the second run finds nothing new
        jobs.run_available(sinks.append_stream(stream, f"{folder}/out", f"{folder}/state"), 300)
    assert spark.read.parquet(f"{folder}/out").count() == 6


def test_a_dense_bucket_is_summed_up_in_one_pass(spark):
    rnd = random.Random(3)
    points = [(rnd.randrange(15_000), float(rnd.randrange(1000))) for _ in range(20_000)]
    highest = {}
    for us, value in points:
        highest[us] = max(value, highest.get(us, value))
    known = sorted(highest.items())
    rise = sum(b - a if b >= a else b for (_, a), (_, b) in zip(known, known[1:]))
    table = spark.createDataFrame([(points,), ([(5, 2.0)],), ([(5, 2.0), (5, 1.0)],)], "points array<struct<us: bigint, value: double>>")
    begun = time.monotonic()
    got = [tuple(r[0]) for r in table.select(_summary(F.col("points"))).collect()]
    # Sorting the samples once per sample took minutes here.
    assert time.monotonic() - begun < 30
    one = (1, 2.0, 2.0, 5, 5, 0.0)
    assert got == [(len(known), known[0][1], known[-1][1], known[0][0], known[-1][0], rise), one, one]


def test_waiting_rows_are_one_small_value_of_the_state(spark, folder):
    schema = "k string, ts timestamp, value string"
    rows = [("a", at(t / 100), "x" if t % 2 else "y") for t in range(20_000)]
    stream = jobs.change_stream(feed(spark, folder, rows, schema, 1), ["k"])
    query = jobs.run_available(sinks.append_stream(stream, f"{folder}/out", f"{folder}/state"), 300)
    state = query.lastProgress["stateOperators"][0]
    # All of them wait: the watermark is 10 minutes behind.
    assert state["numRowsTotal"] == 1 and state["memoryUsedBytes"] < 20_000 * 10


def test_large_tables_come_as_more_files(spark, folder):
    rows = [(i, at(i * 40), None if i % 5 == 0 else "x") for i in range(1000)] + [(1000, None, "y")]
    table = spark.createDataFrame(rows, "id long, ts timestamp, v string").repartition(3)
    stream = q_streams.shuffled(spark, table, "many", most=100)
    query = jobs.run_available(sinks.append_stream(stream, f"{folder}/out", f"{folder}/state"), 300)
    out = [tuple(r) for r in spark.read.schema(table.schema).parquet(f"{folder}/out").collect()]
    assert sorted(map(str, out)) == sorted(map(str, [*rows, (None, at(999 * 40 + 86_400), None)]))
    batches = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(batches) == 12 and max(batches) < 130
