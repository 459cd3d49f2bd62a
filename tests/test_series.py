import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from brokerlens.operators import series
from tests.helpers import at, samples, series_rows, since

A = {"i": "a"}
KEY = (("i", "a"),)


def windows(points, window, step):
    """{grid time: sorted points in (t - window, t]} for one series."""
    out = {}
    for t, v in points:
        grid = math.ceil(t / step) * step
        while grid < t + window:
            out.setdefault(grid, []).append((t, v))
            grid += step
    return {g: sorted(p) for g, p in out.items()}


def increase_of(points):
    return sum(b if b < a else b - a for (_, a), (_, b) in zip(points, points[1:]))


def extrapolated(points, end, window):
    inc, span = increase_of(points), points[-1][0] - points[0][0]
    gap = span / (len(points) - 1)
    start, stop = points[0][0] - (end - window), end - points[-1][0]
    if start >= gap * 1.1:
        start = gap / 2
    if inc > 0 and points[0][1] >= 0:
        start = min(start, span * points[0][1] / inc)
    if stop >= gap * 1.1:
        stop = gap / 2
    return inc * (span + start + stop) / span


@pytest.mark.parametrize("seed, window, step, slice_seconds", [(1, 60, 15, 60), (2, 50, 20, 100), (3, 300, 60, 3600), (4, 7, 10, 20)])
def test_windows_match_brute_force(spark, seed, window, step, slice_seconds):
    rnd = random.Random(seed)
    rows, truth = [], {}
    for name in ("a", "b"):
        t, v, pts = 0.0, 0.0, []
        for _ in range(120):
            t += rnd.choice([1, 5, 10, 15, 100]) + rnd.choice([0, 0.25])
            v = rnd.choice([0.0, 3.0]) if rnd.random() < 0.1 else v + rnd.randint(0, 9)
            pts.append((t, v))
        rows += [(t, "c", {"i": name}, v) for t, v in pts]
        truth[name] = windows(pts, window, step)
    rows += rows[:20]  # copies of the same sample
    rnd.shuffle(rows)
    data = samples(spark, rows)
    stats = series.window_stats(data, {"w": window}, step, slice_seconds).collect()
    got = {(r["labels"]["i"], since(r["ts"])): r["w"] for r in stats}
    assert set(got) == {(n, g) for n in truth for g in truth[n]}
    for (name, g), w in got.items():
        pts = truth[name][g]
        assert w["n"] == len(pts)
        assert math.isclose(w["sum"], sum(v for _, v in pts)) and w["last"] == pts[-1][1]
        assert (w["min"], w["max"]) == (min(v for _, v in pts), max(v for _, v in pts))
        assert math.isclose(w["increase"], increase_of(pts), abs_tol=1e-9)
        assert w["changes"] == sum(a != b for (_, a), (_, b) in zip(pts, pts[1:]))
    rates = series_rows(series.increase(data, window, step, True, slice_seconds))
    for (t, _, labels), value in rates.items():
        assert math.isclose(value, extrapolated(truth[labels[0][1]][t], t, window), rel_tol=1e-9, abs_tol=1e-9)
    assert len(rates) == sum(len(p) >= 2 for n in truth for p in truth[n].values())
    spread = series_rows(series.over_time(data, "stddev", window, step, slice_seconds))
    for (t, _, labels), value in spread.items():
        values = [v for _, v in truth[labels[0][1]][t]]
        mean = sum(values) / len(values)
        assert math.isclose(value, math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)), abs_tol=1e-9)


def test_counter_reset_and_single_sample(spark):
    data = samples(spark, [(10, "c", A, 100), (20, "c", A, 110), (30, "c", A, 5), (300, "c", A, 6)])
    got = series_rows(series.rate(data, 60, 60, extrapolate=False))
    assert got == {(60.0, "c", KEY): 15 / 20}


def test_window_is_open_at_its_start_and_closed_at_its_end(spark):
    data = samples(spark, [(0, "g", A, 1), (60, "g", A, 2)])
    got = series_rows(series.over_time(data, "sum", 60, 60))
    assert got == {(0.0, "g", KEY): 1.0, (60.0, "g", KEY): 2.0}


def test_missing_values_are_ignored(spark):
    data = samples(spark, [(1, "g", A, 1), (2, "g", A, None)])
    assert series_rows(series.over_time(data, "count", 60, 60)) == {(60.0, "g", KEY): 1.0}


def test_latest_respects_lookback(spark):
    data = samples(spark, [(0, "g", A, 1), (100, "g", {"i": "b"}, 2), (400, "g", {"i": "b"}, None)])
    got = series_rows(series.latest(data, "2024-01-01 00:06:00", 300))
    assert got == {(100.0, "g", (("i", "b"),)): 2.0}


def test_aggregate_keeps_only_named_labels(spark):
    data = samples(spark, [(0, "g", {"i": "a", "k": "x"}, 1), (0, "g", {"i": "b", "k": "x"}, 3), (0, "g", {"i": "c"}, 5)])
    assert series_rows(series.agg_series(data, "sum", ["k"])) == {(0.0, "g", (("k", "x"),)): 4.0, (0.0, "g", (("k", ""),)): 5.0}
    assert series_rows(series.agg_series(data, "stddev")) == {(0.0, "g", ()): pytest.approx(math.sqrt(8 / 3))}


def bucket_rows(spark, counts, t=0):
    return samples(spark, [(t, "b", {"le": le}, c) for le, c in counts.items()])


@pytest.mark.parametrize(
    "q, counts, expected",
    [
        (0.5, {"1": 0, "2": 10, "+Inf": 10}, 1.5),
        (0.5, {"1": 10, "+Inf": 10}, 0.5),
        (0.95, {"1": 5, "2": 8, "+Inf": 10}, 2.0),
        (0.5, {"1": 4, "2": 3, "4": 8, "+Inf": 8}, 1.0),
        (0.5, {"1": 1, "2": 3}, float("nan")),
        (0.5, {"1": 0, "+Inf": 0}, float("nan")),
        (0.5, {"-1": 6, "1": 10, "+Inf": 10}, -1.0),
        (1.5, {"1": 1, "+Inf": 1}, float("inf")),
        (0.0, {"1": 0, "2": 4, "+Inf": 4}, float("nan")),
    ],
)
def test_histogram_quantile(spark, q, counts, expected):
    value = series.histogram_quantile(bucket_rows(spark, counts), q).first()["value"]
    assert (math.isnan(value) and math.isnan(expected)) or value == pytest.approx(expected)


def test_binary_or_and_division_by_zero(spark):
    a = samples(spark, [(0, "x", {"i": "a"}, 6), (0, "x", {"i": "b"}, 1)])
    b = samples(spark, [(0, "y", {"i": "a"}, 3), (0, "y", {"i": "b"}, 0), (0, "y", {"i": "c"}, 9)])
    got = {k[2]: v for k, v in series_rows(series.binary(a, b, "/")).items()}
    assert got == {(("i", "a"),): 2.0, (("i", "b"),): None}
    assert {k[1:]: v for k, v in series_rows(series.or_series(a, b)).items()} == {
        ("x", (("i", "a"),)): 6.0, ("x", (("i", "b"),)): 1.0, ("y", (("i", "c"),)): 9.0,
    }


def test_events_to_series(spark):
    events = spark.createDataFrame([(at(1), "s", 0.3), (at(1), "s", 7.0), (at(4000), "s", 1.0), (at(2), "t", 2.0)], "ts timestamp, k string, v double")
    counter = series_rows(series.to_counter(events, "n", ["k"]))
    assert counter == {(1.0, "n", (("k", "s"),)): 2.0, (4000.0, "n", (("k", "s"),)): 3.0, (2.0, "n", (("k", "t"),)): 1.0}
    summary = series_rows(series.to_summary(events, "r", ["k"], F.col("v")))
    assert summary[4000.0, "r_sum", (("k", "s"),)] == pytest.approx(8.3) and summary[1.0, "r_count", (("k", "s"),)] == 2.0
    buckets = series_rows(series.to_histogram(events, "h", ["k"], F.col("v"), [0.5, 5.0]))
    assert [buckets[4000.0, "h_bucket", (("k", "s"), ("le", le))] for le in ("0.5", "5.0", "+Inf")] == [1.0, 2.0, 3.0]
    specs = [series.SeriesSpec("n", "COUNTER", ("k",)), series.SeriesSpec("h", "HISTOGRAM", ("k",), "v"), series.SeriesSpec("now", "GAUGE", ("k",), names=("s", "t"))]
    together = series_rows(series.to_series(events, specs))
    assert together[2.0, "n", (("k", "t"),)] == 1.0 and together[1.0, "h_bucket", (("k", "s"), ("le", "10.0"))] == 2.0
    assert together[2.0, "now", (("k", "s"),)] == 0.0
    hot = series_rows(series.to_one_hot(events, "now", "k", ["s", "t"]))
    assert hot[2.0, "now", (("k", "t"),)] == 1.0 and hot[2.0, "now", (("k", "s"),)] == 0.0


def test_feature_matrix_default_columns(spark):
    rows = []
    for t in range(0, 1300, 10):
        for i in ("1", "2"):
            rows.append((t, "kafka_server_brokertopicmetrics_messagesin_total", {"i": i}, t * int(i)))
            rows.append((t, "kafka_server_brokertopicmetrics_bytesin_total", {"i": i}, t * 100 * int(i)))
            rows.append((t, "kafka_server_brokertopicmetrics_totalproducerequests_total", {"i": i}, t * t))
            rows.append((t, "java_lang_memory_heapmemoryusage_used", {"i": i}, 100 * int(i)))
            rows.append((t, "kafka_network_requestmetrics_totaltimems", {"i": i, "request": "Fetch"}, t))
        rows.append((t, "workload_type", {}, 1))
    out = series.feature_matrix(samples(spark, rows))
    assert out.columns == ["ts", *[f.name for f in series.FEATURES]]
    row = out.filter(F.col("ts") == at(1200)).first()
    assert row["workload_type"] == 1.0 and row["message_size_bytes"] == pytest.approx(100)
    assert row["kafka_server_brokertopicmetrics_messagesin_total"] == pytest.approx(3)
    assert row["message_rate_variance"] == pytest.approx(0.5) and row["memory_usage_variance"] == pytest.approx(1 / 3)
    assert row["kafka_network_requestmetrics_totaltimems"] is None and row["node_disk_read_bytes_total"] is None
    inner = series_rows(series.agg_series(series.rate(samples(spark, [r for r in rows if "produce" in r[1]]), 60, 60), "sum"))
    last = [v for (t, _, _), v in inner.items() if 300 < t <= 1200]
    mean = sum(last) / len(last)
    assert row["request_rate_variance"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in last) / len(last)))


def test_no_task_holds_a_whole_series(spark):
    data = samples(spark, [(t, "c", A, t) for t in range(0, 100)])
    plan = series.rate(data, 60, 15)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(metric" in plan and "slice" in plan and "CartesianProduct" not in plan


def test_deviations_of_large_values_from_buckets(spark):
    rnd = random.Random(11)
    rows = [("m", at(t), {"i": "a"}, 1e9 + rnd.random()) for t in range(0, 3000, 7)] + [("m", at(9000), {"i": "a"}, 5.0)]
    samples = spark.createDataFrame(rows, "metric string, ts timestamp, labels map<string,string>, value double")
    got = {since(r["ts"]): r["value"] for r in series.over_time(samples, "stddev", 900, 60).collect()}
    for end in range(60, 3900, 60):
        inside = [Fraction(v) for _, ts, _, v in rows if end - 900 < since(ts) <= end]
        if inside:
            mean = sum(inside) / len(inside)
            assert abs(got[end] - float(sum((v - mean) ** 2 for v in inside) / len(inside)) ** 0.5) < 1e-6
    assert got[9000] == 0.0 and len(got) == len([e for e in range(0, 9901, 60) if any(e - 900 < since(ts) <= e for _, ts, *_ in rows)])
