"""Joins and sequence operators against plain Python on random rows, with narrow and wide slices."""

import random

import pytest
from pyspark.sql import functions as F

from brokerlens.operators import joins, sequence
from tests.helpers import at, since


def random_times(seed, n, span, keys=("a", "b")):
    rnd = random.Random(seed)
    return [(rnd.choice(keys), round(rnd.uniform(0, span), 3)) for _ in range(n)]


@pytest.mark.parametrize("seed, width", [(1, 5), (2, 60), (3, 100_000)])
def test_asof_backward_and_nearest(spark, seed, width):
    left = [(k, t, i) for i, (k, t) in enumerate(random_times(seed, 150, 900))]
    right = [(k, t, i) for i, (k, t) in enumerate(random_times(seed + 50, 60, 900))]
    right += [(k, t, i + 100) for k, t, i in right[:5]]  # same instant: the smaller row wins
    left += [(left[0][0], right[0][1], 900), ("c", 1.0, 901)]  # equal times, and a key without matches
    l = spark.createDataFrame([(k, at(t), i) for k, t, i in left], "k string, ts timestamp, id int")
    r = spark.createDataFrame([(k, at(t), i) for k, t, i in right], "k string, ts timestamp, rid int")
    back = {x["id"]: x["right_rid"] for x in joins.asof_backward(l, r, "ts", ["k"], width=width).collect()}
    near = {x["id"]: x["right_rid"] for x in joins.asof_nearest(l, r, "ts", ["k"], width=width).collect()}
    for k, t, i in left:
        same = [(rt, ri) for rk, rt, ri in right if rk == k]
        before = [(-rt, ri) for rt, ri in same if rt <= t]
        assert back[i] == (min(before)[1] if before else None)
        closest = [(round(abs(rt - t), 6), rt, ri) for rt, ri in same]
        assert near[i] == (min(closest)[2] if closest else None)
    assert len(back) == len(near) == len(left)


def test_nearest_tie_goes_to_the_earlier(spark):
    l = spark.createDataFrame([(at(10), 1)], "ts timestamp, id int")
    r = spark.createDataFrame([(at(0), 1), (at(20), 2)], "ts timestamp, rid int")
    assert joins.asof_nearest(l, r, "ts").first()["right_rid"] == 1


def test_hot_left_instant_keeps_every_row(spark):
    l = spark.range(5000).select(F.lit(at(10)).alias("ts"), "id")
    r = spark.createDataFrame([(at(5), 1)], "ts timestamp, rid int")
    out = joins.asof_backward(l, r, "ts")
    assert out.count() == 5000 and out.filter("right_rid = 1").count() == 5000


def test_around_repeated_events_with_maps_and_missing_ends(spark):
    rows = [("a", at(100), at(150), {"x": 1}), ("a", at(100), at(150), {"x": 1}), ("b", at(100), None, None), ("b", None, at(20), {})]
    events = spark.createDataFrame(rows, "k string, ts timestamp, end_ts timestamp, props map<string,int>")
    samples = spark.createDataFrame([(k, at(t), float(t)) for k in "ab" for t in range(0, 300, 7)], "k string, ts timestamp, value double")
    out = joins.around_events(events, samples, 30, 10, 30, ["k"])
    assert out.columns == [*events.columns, "value_before", "value_during", "value_after"]
    got = sorted((r["k"], r["value_before"] or 0, r["value_during"] or 0, r["value_after"] or 0) for r in out.collect())
    assert got == [("a", 98.0, 112.0, 154.0), ("a", 98.0, 112.0, 154.0), ("b", 0, 0, 21.0), ("b", 98.0, 112.0, 0)]


def test_around_events(spark):
    e = spark.createDataFrame([(at(100), at(150), 1)], "ts timestamp, end_ts timestamp, id int")
    s = spark.createDataFrame([(at(40), 1.0), (at(99), 2.0), (at(105), 3.0), (at(110), 4.0), (at(150), 5.0), (at(160), 6.0)], "ts timestamp, value double")
    row = joins.around_events(e, s, 30, 10, 30).first()
    assert (row["value_before"], row["value_during"], row["value_after"]) == (2.0, 4.0, 5.0)
    row = joins.around_events(e, s.filter("value > 5"), 30, 10, 5).first()
    assert (row["value_before"], row["value_during"], row["value_after"]) == (None, None, None)


def test_asof_takes_columns_of_maps(spark):
    r = spark.createDataFrame(
        [(at(10), "a", {"x": "1", "w": "2"}), (at(10), "b", {"x": "0"}), (at(30), "c", None)],
        "ts timestamp, strategy string, config map<string,string>",
    )
    l = spark.createDataFrame([(1, at(12)), (2, at(40)), (3, at(5))], "id int, ts timestamp")
    got = {x["id"]: (x["right_strategy"], x["right_config"]) for x in joins.asof_backward(l, r, "ts").collect()}
    assert got == {1: ("a", {"x": "1", "w": "2"}), 2: ("c", None), 3: (None, None)}


def test_within_period_of_each_key(spark):
    rows = spark.createDataFrame([("a", at(s)) for s in (5, 15, 25)] + [("b", at(15))], "k string, timestamp timestamp")
    period = spark.createDataFrame(
        [("a", at(0), at(10)), ("a", at(20), at(30)), ("c", at(0), at(99))],
        "k string, recovery_start timestamp, recovery_end timestamp",
    )
    got = joins.within_period(rows, period, by=["k"]).collect()
    assert sorted((r["k"], since(r["timestamp"])) for r in got) == [("a", 5), ("a", 25)]


def test_within_period_and_no_period(spark):
    rows = spark.createDataFrame([(at(t), 1) for t in (0, 5, 20, 22, 500)], "timestamp timestamp, v int")
    period = sequence.recovery_period(rows)
    assert since(period.first()["recovery_start"]) == 5
    assert [since(r["timestamp"]) for r in joins.within_period(rows, period).orderBy("timestamp").collect()] == [5, 20, 22]
    none = sequence.recovery_period(rows.filter("timestamp < '2024-01-01 00:00:10'"))
    assert none.count() == 0 and joins.within_period(rows, none).count() == 0


@pytest.mark.parametrize("width", [3, 50, 10_000])
def test_gaps(spark, width):
    times = sorted({t for _, t in random_times(4, 80, 600)})
    rows = spark.createDataFrame([(at(t),) for t in times + times[:9]], "timestamp timestamp")
    got = sorted((since(r["gap_start"]), since(r["gap_end"])) for r in sequence.find_gaps(rows, 10, width=width).collect())
    assert got == [(a, b) for a, b in zip(times, times[1:]) if round(b - a, 6) > 10]


def test_gap_of_exactly_ten_seconds_is_none(spark):
    rows = spark.createDataFrame([(at(0),), (at(10),), (at(20.001),)], "timestamp timestamp")
    assert [since(r["gap_start"]) for r in sequence.find_gaps(rows).collect()] == [10]


@pytest.mark.parametrize("width", [4, 100_000])
def test_changes_episodes_and_latency(spark, width):
    rnd = random.Random(5)
    rows, t = [], 0
    for _ in range(120):
        t += rnd.randint(1, 6)
        rows.append((t, rnd.choice([0, 0, 0, 1]), rnd.randint(0, 1)))
    df = spark.createDataFrame([(at(t), a, p) for t, a, p in rows], "ts timestamp, actual int, predicted int")
    changes = [(t, b, a) for (_, b, _), (t, a, _) in zip(rows, rows[1:]) if a != b]
    got = sorted((since(r["ts"]), r["old"], r["new"]) for r in sequence.change_events(df, "actual", width=width).collect())
    assert got == changes
    episodes = sorted((since(r["start"]), r["seconds"]) for r in sequence.change_episodes(df, "actual", width=width).collect())
    ends = [b[0] - a[0] for a, b in zip(changes, changes[1:])] + [None]
    assert episodes == [(c[0], e) for c, e in zip(changes, ends)]
    waiting, expected, last = None, [], None
    for t, a, p in rows:
        if last is not None and a != last:
            waiting = t
        last = a
        if waiting is not None:
            expected.append((t, float(t - waiting)))
            if a == p:
                waiting = None
    got = sorted((since(r["ts"]), r["latency_seconds"]) for r in sequence.classification_latency(df, width=width).collect())
    assert got == expected


def test_phases(spark):
    rows = spark.createDataFrame([(at(t),) for t in (0, 119, 120, 250)], "timestamp timestamp")
    t0 = "2024-01-01 00:00:00"
    assert [r["phase"] for r in sequence.phase(rows, t0, 120).collect()] == ["buffer", "buffer", "default", "buffer"]
    out = [(since(r["timestamp"]), r["config_source"], r["details"]) for r in sequence.phase_changes(rows, t0, 120).collect()]
    assert out == [(120, "default", "Switched to DEFAULT mode"), (240, "buffer", "Switched to BUFFER mode")]


@pytest.mark.parametrize("width", [7, 100_000])
def test_outages(spark, width):
    readings = [(0, 1), (5, 0), (10, 0), (15, 1), (20, 0), (100, 1), (110, 0), (110, 1)]
    df = spark.createDataFrame([("b", at(t), bool(u)) for t, u in readings], "broker string, ts timestamp, up boolean")
    out = sorted((since(r["down_at"]), r["duration_seconds"], r["recovered"]) for r in sequence.outages(df, width=width).collect())
    assert out == [(5, 10.0, True), (20, 60.0, False), (110, 60.0, False)]


def greedy(times, wait):
    kept, last = set(), None
    for t in sorted(times):
        if last is None or t - last >= wait:
            kept.add(t)
            last = t
    return kept


@pytest.mark.parametrize("seed, span, width", [(1, 300, 30), (2, 2000, 40), (3, 300, 5000), (4, 40_000, 35), (5, 700, 31)])
def test_cooldown_matches_greedy(spark, seed, span, width):
    times = {k: {t for kk, t in random_times(seed, 300, span) if kk == k} for k in ("a", "b")}
    df = spark.createDataFrame([(k, at(t)) for k in times for t in times[k]], "broker string, ts timestamp")
    out = sequence.cooldown(df, 30, width=width).collect()
    for k in times:
        assert {round(since(r["ts"]), 3) for r in out if r["broker"] == k and r["accepted"]} == greedy(times[k], 30)
    assert len(out) == sum(len(v) for v in times.values())


def test_cooldown_boundaries(spark):
    df = spark.createDataFrame([("b", at(t)) for t in (0, 10, 29, 31, 59, 62, 100, 100)], "broker string, ts timestamp")
    out = {since(r["ts"]): (r["accepted"], r["attempts"]) for r in sequence.cooldown(df, 30).collect()}
    assert [t for t in sorted(out) if out[t][0]] == [0, 31, 62, 100] and out[100][1] == 2


def test_every_nth(spark):
    df = spark.createDataFrame([("k", at(t), 10) for t in (1, 2, 3, 3, 3, 3, 9)], "k string, ts timestamp, bytes int")
    out = sorted((r["messages"], since(r["ts"])) for r in sequence.every_nth(df, 2, ["k"], width=2).collect())
    assert out == [(2, 2), (4, 3), (6, 3)]


def test_no_time_window_spans_a_whole_key(spark):
    df = spark.createDataFrame([("b", at(1), True)], "broker string, ts timestamp, up boolean")
    plan = sequence.outages(df)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "+- Window [" in line and "lead(" in line or "lag(" in line and "Window [" in line:
            assert "_slice" in line
