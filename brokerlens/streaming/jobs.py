"""Structured Streaming jobs. Each adds a watermark; rows later than it are dropped.

State lives per series, broker or key: a few numbers each and the rows that the
watermark has not passed yet (``ordered``), so it grows with the number of keys
and the watermark's delay and not with the stream.
"""

from __future__ import annotations

import json
from functools import reduce
from math import gcd

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brokerlens.functions.rules import select_strategy
from brokerlens.operators.model import classify
from brokerlens.operators.ordered import micros
from brokerlens.operators.series import FEATURES, label, series_key
from brokerlens.schemas import MODEL_FEATURES
from brokerlens.sources.sinks import latest_sink, upsert_latest
from brokerlens.streaming.features import feature_matrix_stream
from brokerlens.streaming.ordered import in_time_order, time

DELAY = "10 minutes"


def event_time(stream: DataFrame, ts: str = "ts", delay: str = DELAY) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def run_available(writer, timeout: float | None = None):
    """Process everything that is there now, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(timeout)
    if query.isActive:
        query.stop()
        raise TimeoutError("the stream did not finish in time")
    return query


# ---------------------------------------------------------------- scoring


def feature_stream(
    samples: DataFrame, features: dict[str, tuple[str, str]], seconds: float = 30.0, by: list[str] = (), delay=DELAY
) -> DataFrame:
    """Feature rows per aligned window: ``name -> (metric, avg | sum | max | min | stddev)``."""
    fns = {"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "stddev": F.stddev_pop}
    wanted = sorted({metric for metric, _ in features.values()})
    columns = [
        fns[fn](F.when(F.col("metric") == metric, F.col("value"))).alias(name)
        for name, (metric, fn) in features.items()
    ]
    window = F.window("ts", f"{micros(seconds)} microseconds").alias("w")
    keys = [label(b).alias(b) for b in by]
    rows = event_time(samples, delay=delay).filter(F.col("metric").isin(wanted))
    return rows.groupBy(window, *keys).agg(*columns).select(F.col("w.end").alias("ts"), *by, *features)


def score_stream(
    samples: DataFrame, model: PipelineModel, features: dict[str, tuple[str, str]] | None = None, seconds: float = 30.0,
    by: list[str] = (), delay: str = DELAY, min_confidence: float = 90.0,
) -> DataFrame:
    """Samples to feature rows, predictions and strategies.

    By default the rows are those the model is trained on: its rates and variances every ``seconds``, which divide a
    minute. With ``features`` they are plain aggregates of aligned windows (``feature_stream``).
    """
    if features:
        rows = feature_stream(samples, features, seconds, by, delay)
    elif by:
        raise ValueError("the model's features are of all series: give features to score per key")
    else:
        wanted = [f for f in FEATURES if f.name in MODEL_FEATURES]
        rows = feature_matrix_stream(samples, wanted, seconds, delay=delay)
    return select_strategy(classify(rows, model, list(features or MODEL_FEATURES)), min_confidence)


# ---------------------------------------------------------------- counters

def counter_deltas(samples: DataFrame, delay: str = DELAY, forget: float | None = None) -> DataFrame:
    """Each sample with its distance to the one before, in event-time order: samples may come late by the delay.

    Of several samples of an instant the highest counts. ``forget`` drops a series so many seconds after its last
    sample, as if it began anew.
    """

    def step(key, due, now, mark):
        last_us, last = now
        out = []
        for us, value in due:
            if last_us is not None and forget is not None and us - last_us > micros(forget):
                last_us = last = None
            if last_us is None:
                out.append((time(us), None, None, value))
            else:
                out.append((time(us), time(last_us), value - last if value >= last else value, value))
            last_us, last = us, value
        if forget is None or last_us is None:
            return out, (last_us, last), None
        ends = last_us + micros(forget)
        return (out, None, None) if ends < mark else (out, (last_us, last), ends + 1000)

    rows = event_time(samples, delay=delay)
    keyed = rows.select("metric", F.to_json(F.map_from_entries(series_key())).alias("series"), "ts", F.col("value").cast("double"))
    schema = "ts timestamp, prev_ts timestamp, delta double, value double"
    return in_time_order(keyed, ["metric", "series"], "value", max, "us bigint, last double", schema, step)


#: What a bucket of samples keeps; two neighbours merge into one. Times are microseconds.
_BUCKET = "at bigint, n bigint, total double, m2 double, highest double, first_us bigint, last_us bigint, first double, last double, increase double"
_BUCKET_NAMES = [part.split()[0] for part in _BUCKET.split(", ")]


def _rise(before: float, after: float) -> float:
    """What a counter gained between two samples; one that fell began anew at 0."""
    return after - before if after >= before else after


def _merged(a: dict, b: dict) -> dict:
    """Two neighbouring buckets as one, the earlier first; squared deviations merge without the samples."""
    n, apart = a["n"] + b["n"], b["total"] / b["n"] - a["total"] / a["n"]
    return {
        "at": b["at"], "n": n, "total": a["total"] + b["total"], "m2": a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n,
        "highest": max(a["highest"], b["highest"]), "first_us": a["first_us"], "last_us": b["last_us"], "first": a["first"],
        "last": b["last"], "increase": a["increase"] + _rise(a["last"], b["first"]) + b["increase"],
    }


def sliding_stream(samples: DataFrame, window: float = 300.0, step: float = 15.0, delay: str = DELAY) -> DataFrame:
    """Increase, rate over the covered span, mean, maximum and population deviation of each series in sliding windows.

    A window ends at ``ts`` and covers ``(ts - window, ts]``; a delta counts only if both of its samples are inside.
    Samples may come late by the delay; of several of an instant the highest counts. A series keeps one row of
    moments per bucket (the greatest length that divides window and step), not its samples, and windows merge them;
    a window is sent once the watermark has passed its end. A series without samples for a window has no state.
    """
    span, hop = micros(window), micros(step)
    width = gcd(span, hop)

    def following(buckets: list[dict], done: int | None) -> int:
        """The next window end that sees the first bucket."""
        return max(-(-buckets[0]["at"] * width // hop), done + 1 if done is not None else -(1 << 62))

    def close(buckets: list[dict], done: int | None, until: int, out: list[tuple]) -> tuple[list[dict], int | None]:
        """Send the windows that end at ``until`` or before, and let go of buckets that no later one sees."""
        while buckets:
            end = following(buckets, done) * hop
            if end > until:
                break
            buckets = [b for b in buckets if b["at"] * width > end - span]
            seen = [b for b in buckets if b["at"] * width <= end]
            if seen:
                w = reduce(_merged, seen)
                many = w["n"] > 1
                rate = w["increase"] / ((w["last_us"] - w["first_us"]) / 1e6) if many else None
                out.append((time(end), w["n"], w["increase"] if many else None, rate, w["total"] / w["n"], w["highest"], (w["m2"] / w["n"]) ** 0.5))
            done = end // hop
        return buckets, done

    def follow(key, due, now, mark):
        *columns, done = now
        buckets = [dict(zip(_BUCKET_NAMES, one)) for one in zip(*columns)] if columns[0] else []
        out: list[tuple] = []
        for us, value in due:
            buckets, done = close(buckets, done, us - 1, out)
            one = {"at": -(-us // width), "n": 1, "total": value, "m2": 0.0, "highest": value, "first_us": us, "last_us": us, "first": value, "last": value, "increase": 0.0}
            if buckets and buckets[-1]["at"] == one["at"]:
                buckets[-1] = _merged(buckets[-1], one)
            else:
                buckets.append(one)
        buckets, done = close(buckets, done, mark, out)
        if not buckets:
            return out, None, None
        return out, (*([b[n] for b in buckets] for n in _BUCKET_NAMES), done), following(buckets, done) * hop

    rows = event_time(samples, delay=delay)
    keyed = rows.select("metric", F.to_json(F.map_from_entries(series_key())).alias("series"), "ts", F.col("value").cast("double"))
    carried = ", ".join(f"{name} array<{kind}>" for name, kind in (part.split() for part in _BUCKET.split(", ")))
    result = "ts timestamp, n bigint, increase double, rate double, mean double, highest double, deviation double"
    return in_time_order(keyed, ["metric", "series"], "value", max, f"{carried}, done bigint", result, follow)


# ---------------------------------------------------------------- latest state


def latest_strategy_sink(stream: DataFrame, path: str, checkpoint: str, keys: list[str] = (), ts: str = "ts"):
    """Keep the newest strategy (per key); start it with the refresh interval as trigger."""
    return latest_sink(stream, path, checkpoint, keys, ts)


# ---------------------------------------------------------------- changes


def change_stream(
    stream: DataFrame, by: list[str], column: str = "value", ts: str = "ts", delay: str = DELAY, forget: float | None = None
) -> DataFrame:
    """Each moment a key's value changes, with the old and the new value; rows may come late by the delay.

    Of several values of an instant the highest counts. ``forget`` drops a key so many seconds after its last row, so
    that its next value is no change.
    """
    kind = {f.name: f.dataType.simpleString() for f in stream.schema}[column]

    def step(key, due, now, mark):
        last_us, last = now
        out = []
        for us, value in due:
            known = last_us is not None and (forget is None or us - last_us <= micros(forget))
            if known and value != last:
                out.append((time(us), last, value))
            last_us, last = us, value
        if forget is None or last_us is None:
            return out, (last_us, last), None
        ends = last_us + micros(forget)
        return (out, None, None) if ends < mark else (out, (last_us, last), ends + 1000)

    rows = event_time(stream, ts, delay).withColumnRenamed(ts, "ts")
    return in_time_order(rows, by, column, max, f"us bigint, last {kind}", f"ts timestamp, old {kind}, new {kind}", step)


# ---------------------------------------------------------------- strategy in force


def in_force_stream(
    events: DataFrame, versions: DataFrame, by: list[str], columns: list[str], ts: str = "ts", delay: str = DELAY
) -> DataFrame:
    """Each event with the ``columns`` of the newest version at or before its time, per key; both are streams.

    An event waits until the watermark has passed it, so a version that comes late by the delay still counts. Per
    key the state holds the version in force and what waits. Events before the first version get nulls; of several
    versions of an instant the one with the largest JSON text counts.
    """
    own = [c for c in events.columns if c not in by]
    event_type = events.select(*own).schema
    version_type = versions.select(*columns).schema

    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

    def texts(df: DataFrame, kind: str, names: list[str]) -> DataFrame:
        text = F.to_json(F.array(F.struct(F.lit(kind).alias("kind"), F.to_json(F.struct(*names), exact).alias("body"))))
        rows = df.select(*by, F.col(ts).cast("timestamp").alias("ts"), text.alias("rows"))
        return rows.withWatermark("ts", delay)

    def step(key, due, now, mark):
        version, out = now[0], []
        for us, text in due:
            rows = json.loads(text)
            version = max([r["body"] for r in rows if r["kind"] == "version"], default=version)
            out += [(time(us), r["body"], version) for r in rows if r["kind"] == "event"]
        return out, (version,), None

    both = texts(events, "event", own).unionByName(texts(versions, "version", columns))
    found = in_time_order(
        both, by, "rows", lambda a, b: f"{a[:-1]},{b[1:]}", "version string", "ts timestamp, event string, version string", step
    )
    parsed = found.select(*by, F.from_json("event", event_type, exact).alias("e"), F.from_json("version", version_type, exact).alias("v"))
    return parsed.select(*by, *[F.col(f"e.{c}").alias(c) for c in own], *[F.col(f"v.{c}").alias(c) for c in columns])


# ---------------------------------------------------------------- outages

def outage_stream(
    stream: DataFrame, cooldown: float = 30.0, timeout: float = 60.0, delay: str = DELAY, one_at_a_time: bool = False
) -> DataFrame:
    """Attempts, recoveries and timeouts per broker out of availability readings ``(broker, ts, up)``.

    ``attempt``: a down reading at least the cool-down after the previous attempt, and with ``one_at_a_time`` (not the
    default) not while that one still runs: until the broker is back, or the timeout has passed since the attempt.
    ``recovered``: back within the timeout, with the seconds it took.
    ``timeout``: still down when the timeout passed, by a later reading or by the watermark.
    Recoveries and timeouts carry the time the outage began. Readings may come late by the delay; of several of an
    instant a down one counts. A broker that is up and past its cool-down has no state.
    """
    wait, limit = micros(cooldown), micros(timeout)

    def step(key, due, now, mark):
        down, attempt, running = now
        out = []

        def expire(at: int) -> None:
            # A down time of -1 is an outage whose timeout has been reported.
            nonlocal down
            if down is not None and down >= 0 and at - down > limit:
                out.append(("timeout", time(down), float(timeout)))
                down = -1

        for at, up in due:
            expire(at)
            if up:
                if down is not None and down >= 0:
                    out.append(("recovered", time(down), (at - down) / 1e6))
                down = running = None
                continue
            if down is None:
                down = at
            free = not one_at_a_time or running is None or at - running > limit
            if free and (attempt is None or at - attempt >= wait):
                attempt = running = at
                out.append(("attempt", time(at), 0.0))
        expire(mark)
        if down is not None:
            return out, (down, attempt, running), down + limit + 1 if down >= 0 else None
        if attempt is None or attempt + wait <= mark:
            return out, None, None
        return out, (down, attempt, running), attempt + wait

    rows = event_time(stream, delay=delay).select("broker", "ts", "up")
    return in_time_order(
        rows, ["broker"], "up", lambda a, b: a and b, "down_us bigint, attempt_us bigint, running_us bigint", "kind string, ts timestamp, seconds double", step
    )


# ---------------------------------------------------------------- windows


def gap_sessions(stream: DataFrame, seconds: float = 10.0, by: list[str] = (), ts: str = "ts", delay: str = DELAY) -> DataFrame:
    """Spans without a pause longer than ``seconds``; each new span follows a gap."""
    session = F.session_window(ts, f"{micros(seconds) + 1} microseconds")
    # Spark wants a key beside a session; one time line for everything gets one that is always 0.
    keys = [F.col(k) for k in by] or [F.pmod(F.unix_micros(ts), F.lit(1)).alias("_all")]
    spans = event_time(stream, ts, delay).groupBy(*keys, session).agg(
        F.count("*").alias("events"), F.max(ts).alias("last_seen")
    )
    return spans.select(*by, F.col("session_window.start").alias("started"), "last_seen", "events")


def prediction_counts(stream: DataFrame, status: Column | str = "status") -> DataFrame:
    """Running number of predictions per status; use output mode ``update``."""
    status = F.col(status) if isinstance(status, str) else status
    return stream.groupBy(status.alias("status")).agg(F.count("*").alias("count"))


def counts_sink(counts: DataFrame, path: str, checkpoint: str):
    """Keep the highest count of each status."""

    def store(batch: DataFrame, batch_id: int) -> None:
        upsert_latest(batch, path, batch_id, ["status"], "count", checkpoint)

    return counts.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)


def throughput_stream(
    messages: DataFrame, seconds: float = 60.0, value: str = "value", by: list[str] = (), delay: str = DELAY
) -> DataFrame:
    """Messages, bytes and rates per window."""
    window = F.window("ts", f"{micros(seconds)} microseconds").alias("w")
    rows = event_time(messages, delay=delay).groupBy(window, *by).agg(
        F.count("*").alias("messages"), F.sum(F.octet_length(value)).alias("bytes")
    )
    return rows.select(
        F.col("w.start").alias("ts"), *by, "messages", "bytes",
        (F.col("messages") / F.lit(float(seconds))).alias("messages_per_second"),
        (F.col("bytes") / F.col("messages")).alias("avg_payload"),
    )
