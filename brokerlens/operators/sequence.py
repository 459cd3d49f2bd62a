"""Operators over the order of events: gaps, changes, phases, outages, cool-downs, markers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brokerlens.operators.ordered import (
    DEFAULT_SLICE,
    instants,
    last_seen,
    micros,
    running_totals,
    sliced,
    with_next,
    with_previous,
)


def _ts(column: str = "_us") -> Column:
    return F.timestamp_micros(F.col(column))


def find_gaps(
    df: DataFrame, seconds: float = 10.0, by: list[str] = (), ts: str = "timestamp", width: float = DEFAULT_SLICE
) -> DataFrame:
    """Pauses longer than ``seconds`` between consecutive distinct times, overall or per key."""
    times = instants(df, list(by), ts, {"_n": F.count("*")})
    rows = with_previous(times.select(*by, "_us"), list(by), {"_us": "_prev"}, width)
    return rows.filter(F.col("_us") - F.col("_prev") > micros(seconds)).select(
        *by,
        _ts("_prev").alias("gap_start"),
        _ts("_us").alias("gap_end"),
        ((F.col("_us") - F.col("_prev")) / F.lit(1e6)).alias("gap_seconds"),
    )


def recovery_period(
    df: DataFrame, seconds: float = 10.0, minutes: float = 2.0, by: list[str] = (), ts: str = "timestamp",
    width: float = DEFAULT_SLICE,
) -> DataFrame:
    """The period that begins at the last time before the first gap; no gap, no row."""
    first = find_gaps(df, seconds, by, ts, width).groupBy(*by).agg(F.min("gap_start").alias("recovery_start"))
    end = F.timestamp_micros(F.unix_micros("recovery_start") + micros(minutes * 60))
    return (
        first.filter(F.col("recovery_start").isNotNull())
        .withColumn("recovery_end", end)
        .withColumn("recovery_duration_seconds", F.lit(minutes * 60.0))
    )


def _changes(df: DataFrame, column: str, by: list[str], ts: str, width: float) -> DataFrame:
    """One row per change: instants whose value differs from the instant before."""
    rows = instants(df.filter(F.col(column).isNotNull()), by, ts, {column: F.max(column)})
    rows = with_previous(rows, by, {column: "_previous"}, width)
    return rows.filter(F.col("_previous").isNotNull() & (F.col(column) != F.col("_previous")))


def change_events(df: DataFrame, column: str, by: list[str] = (), ts: str = "ts", width: float = DEFAULT_SLICE):
    """Each moment the value changes, with the old and the new value."""
    rows = _changes(df, column, list(by), ts, width)
    return rows.select(*by, _ts().alias("ts"), F.col("_previous").alias("old"), F.col(column).alias("new"))


def change_episodes(df: DataFrame, column: str, by: list[str] = (), ts: str = "ts", width: float = DEFAULT_SLICE):
    """Spans between changes: value, start, end (NULL for the last) and seconds."""
    rows = _changes(df, column, list(by), ts, width).drop("_previous")
    rows = with_next(rows, list(by), {"_us": "_end"}, width)
    return rows.select(
        *by,
        column,
        _ts().alias("start"),
        _ts("_end").alias("end"),
        ((F.col("_end") - F.col("_us")) / F.lit(1e6)).alias("seconds"),
    )


def classification_latency(
    df: DataFrame, by: list[str] = (), ts: str = "ts", predicted: str = "predicted", actual: str = "actual",
    width: float = DEFAULT_SLICE,
) -> DataFrame:
    """Seconds from the last change of the actual label to each prediction, up to the first correct one."""
    by = list(by)
    rows = instants(df, by, ts, {"_pair": F.max(F.struct(actual, predicted))})
    rows = rows.select(*by, "_us", F.col(f"_pair.{actual}").alias("actual"), F.col(f"_pair.{predicted}").alias("predicted"))
    rows = with_previous(rows, by, {"actual": "_previous"}, width)
    changed = F.col("_previous").isNotNull() & (F.col("actual") != F.col("_previous"))
    correct = F.col("actual") == F.col("predicted")
    rows = last_seen(rows, by, {"_changed": (changed, False), "_correct": (correct, True)}, width)
    waiting = F.col("_correct").isNull() | (F.col("_correct") < F.col("_changed"))
    return rows.filter(F.col("_changed").isNotNull() & waiting).select(
        *by,
        _ts().alias("ts"),
        "actual",
        "predicted",
        ((F.col("_us") - F.col("_changed")) / F.lit(1e6)).alias("latency_seconds"),
    )


def phase_index(ts: Column, t0: str, seconds: float) -> Column:
    start = F.unix_micros(F.to_timestamp(F.lit(t0)))
    return F.floor((F.unix_micros(ts) - start) / F.lit(micros(seconds)))


def phase(df: DataFrame, t0: str, seconds: float, names: list[str] = ("buffer", "default"), ts: str = "timestamp"):
    """Which of the alternating phases each row falls into."""
    index = F.pmod(phase_index(F.col(ts), t0, seconds), F.lit(len(names))).cast("int")
    return df.withColumn("phase", F.array(*[F.lit(n) for n in names])[index])


def phase_changes(df: DataFrame, t0: str, seconds: float, names: list[str] = ("buffer", "default"), ts="timestamp"):
    """A mode-change recovery row for every switch from the first phase on, up to the last row's phase."""
    last = df.agg(F.max(phase_index(F.col(ts), t0, seconds)).alias("_last"))
    start = F.unix_micros(F.to_timestamp(F.lit(t0)))
    rows = last.filter("_last >= 1").select(F.explode(F.sequence(F.lit(1).cast("bigint"), "_last")).alias("_i"))
    name = F.array(*[F.lit(n) for n in names])[F.pmod("_i", F.lit(len(names))).cast("int")]
    zero, none = F.lit(0.0), F.lit(0)
    # The texts of a mode change in the recovery log.
    return rows.select(
        F.timestamp_micros(start + F.col("_i") * micros(seconds)).alias("timestamp"),
        F.lit("AUTO-SWITCH").alias("strategy"),
        F.lit("ALL").alias("workload_type"),
        name.alias("config_source"),
        zero.alias("recovery_time_seconds"),
        zero.alias("cpu_usage_percent"),
        zero.alias("memory_usage_percent"),
        F.lit("N/A").alias("broker_url"),
        F.lit("MODE_CHANGE").alias("result"),
        none.alias("under_replicated_before"),
        none.alias("under_replicated_after"),
        none.alias("offline_before"),
        none.alias("offline_after"),
        F.concat(F.lit("Switched to "), F.upper(name), F.lit(" mode")).alias("details"),
    )


def outages(
    df: DataFrame, cap: float = 60.0, by: list[str] = ("broker",), ts: str = "ts", up: str = "up",
    width: float = DEFAULT_SLICE,
) -> DataFrame:
    """Spans of unavailability per broker; longer than the cap (or never ended) means not recovered."""
    by = list(by)
    rows = instants(df, by, ts, {"_up": F.min(F.col(up).cast("int"))})
    rows = with_previous(rows, by, {"_up": "_was"}, width)
    turns = rows.filter(F.col("_up") != F.coalesce("_was", F.lit(1))).drop("_was")
    spans = with_next(turns, by, {"_us": "_end"}, width).filter("_up = 0")
    seconds = (F.col("_end") - F.col("_us")) / F.lit(1e6)
    recovered = F.coalesce(seconds <= cap, F.lit(False))
    return spans.select(
        *by,
        _ts().alias("down_at"),
        F.when(recovered, _ts("_end")).alias("up_at"),
        F.when(recovered, seconds).otherwise(F.lit(float(cap))).alias("duration_seconds"),
        recovered.alias("recovered"),
    )


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted Arrow batches regrouped so that no group is cut, each with the start positions of its groups."""
    pending = None
    for batch in batches:
        rows = batch if pending is None else pd.concat([pending, batch], ignore_index=True)
        starts = _starts(rows, keys)
        cut = starts[-1]
        pending = rows.iloc[cut:].reset_index(drop=True)
        if cut:
            yield rows.iloc[:cut], starts[:-1]
    if pending is not None and len(pending):
        yield pending, np.array([0])


def _starts(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(rows), dtype=bool)
    new[:1] = True
    for k in keys:
        codes = pd.factorize(rows[k])[0]
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


class _Slices:
    """Many slices of attempts laid end to end on one line, far enough apart not to touch."""

    def __init__(self, rows: pd.DataFrame, starts: np.ndarray, span: int, wait: int):
        self.starts, self.wait, self.far = starts, wait, span + 2 * wait + 1
        self.ends = np.append(starts[1:], len(rows))
        self.group = np.repeat(np.arange(len(starts)), self.ends - starts)
        self.times = rows["_us"].to_numpy()
        self.origin = rows["_slice"].to_numpy()[starts] * span
        self.line = self.times - self.origin[self.group] + self.group * self.far
        # The first attempt at least a cool-down later, in the same slice or else past its end.
        self.hops = np.searchsorted(self.line, self.line + wait, side="left")

    def first_from(self, us: np.ndarray) -> np.ndarray:
        """Per slice, the position of its first attempt at or after a time."""
        offset = np.clip(us - self.origin, 0, self.far - self.wait - 1)
        return np.searchsorted(self.line, offset + np.arange(len(self.starts)) * self.far, side="left")


def cooldown(
    df: DataFrame, seconds: float = 30.0, by: list[str] = ("broker",), ts: str = "ts", width: float = DEFAULT_SLICE
) -> DataFrame:
    """Attempts per key with ``accepted``: at least ``seconds`` since the last accepted one.

    Greedy and sequential, yet no task holds a key: each slice reports how its
    last accepted time depends on the time it starts with. Chains of accepted
    attempts merge quickly, so that is a handful of ranges per slice; following
    them from slice to slice gives every slice its starting time.
    """
    by, wait, span = list(by), micros(seconds), micros(width)
    if width < seconds:
        raise ValueError("a slice must be at least as long as the cool-down")
    attempts = sliced(instants(df, by, ts, {"attempts": F.count("*")}), width)
    fields = {f.name: f.dataType.simpleString() for f in attempts.schema.fields}
    keys = "".join(f"`{k}` {fields[k]}, " for k in by)
    cell = [*by, "_slice"]

    def reactions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in _whole_groups(batches, cell):
            s = _Slices(rows, starts, span, wait)
            # Follow each chain to its last attempt by doubling the distance jumped.
            last = np.where(s.hops < s.ends[s.group], s.hops, np.arange(len(rows)))
            while not np.array_equal(last, jumped := last[last]):
                last = jumped
            # The first accepted attempt lies within one cool-down of the start, or is the first after that.
            entry = np.minimum(s.first_from(s.origin + wait + 1), s.ends - 1)
            usable = np.arange(len(rows)) <= entry[s.group]
            closes = np.append(last[:-1] != last[1:], True) | (np.arange(len(rows)) == entry[s.group])
            kept = usable & closes
            yield rows.loc[kept, cell].assign(_upto=s.times[kept], _final=s.times[last[kept]])

    laid_out = attempts.repartition(*cell).sortWithinPartitions(*cell, "_us")
    found = laid_out.select(*cell, "_us").mapInPandas(reactions, f"{keys}_slice bigint, _upto bigint, _final bigint")

    def follow(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_slice", "_upto"])
        slices, starts = np.unique(pdf["_slice"].to_numpy(), return_index=True)
        upto, final = pdf["_upto"].to_numpy(), pdf["_final"].to_numpy()
        stops = np.append(starts[1:], len(pdf))
        last, entering = None, []
        for start, stop in zip(starts, stops):
            entering.append(last)
            at = start if last is None else start + int(np.searchsorted(upto[start:stop], last + wait, side="left"))
            if at < stop:
                last = int(final[at])
        out = pd.DataFrame({"_slice": slices, "_enter": pd.array(entering, dtype="Int64")})
        for name, value in zip(by, key):
            out[name] = value
        return out

    entries = found.groupBy(*by).applyInPandas(follow, f"{keys}_slice bigint, _enter bigint")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in _whole_groups(batches, cell):
            s = _Slices(rows, starts, span, wait)
            enter = rows["_enter"].to_numpy(dtype="float64", na_value=np.nan)[starts]
            never = np.isnan(enter)
            known = rows["_enter"].fillna(0).to_numpy(dtype="int64")[starts]
            at = s.first_from(np.where(never, s.origin, known + wait))
            accepted, ends = np.zeros(len(rows), dtype=bool), s.ends
            # Every round takes one step in all slices, so there are few rounds.
            while len(at):
                inside = at < ends
                at, ends = at[inside], ends[inside]
                accepted[at] = True
                at = s.hops[at]
            yield rows[[*by, "_us", "attempts"]].assign(accepted=accepted)

    rows = attempts.join(entries, cell).repartition(*cell).sortWithinPartitions(*cell, "_us")
    decided = rows.mapInPandas(decide, f"{keys}_us bigint, attempts bigint, accepted boolean")
    return decided.select(*by, _ts().alias("ts"), "attempts", "accepted")


def every_nth(
    df: DataFrame, n: int = 1000, by: list[str] = (), ts: str = "ts", size: str = "bytes", width: float = DEFAULT_SLICE
) -> DataFrame:
    """A throughput row at every n-th message. Messages of one instant count together."""
    kept, by = list(by), list(by) or ["_all"]
    df = df if kept else df.withColumn("_all", F.lit(0))
    steps = instants(df, by, ts, {"messages": F.count("*"), "bytes": F.sum(size)})
    totals = running_totals(steps, by, ["messages", "bytes"], width, keep={"messages": "_here"})
    before = F.floor((F.col("messages") - F.col("_here")) / F.lit(n))
    now = F.floor(F.col("messages") / F.lit(n))
    marks = totals.filter(now > before).withColumn("_mark", F.explode(F.sequence(before + 1, now)))
    elapsed = (F.col("_us") - F.col("_first_us")) / F.lit(1e6)
    return marks.select(
        *kept,
        _ts().alias("ts"),
        (F.col("_mark") * n).alias("messages"),
        F.when(elapsed > 0, F.col("_mark") * n / elapsed).otherwise(0.0).alias("messages_per_second"),
        F.when(elapsed > 0, F.col("bytes") / elapsed / (1024 * 1024)).otherwise(0.0).alias("mb_per_second"),
    )


def trend(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Recovery times in time order, by strategy and result."""
    return df.select(ts, "strategy", "result", "recovery_time_seconds").orderBy(ts, "strategy", "recovery_time_seconds")
