"""Keyed streams handled in event-time order: rows wait in state until the watermark has passed them."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: (key, rows in time order, carried values, watermark) -> (result rows, new carried values, time to wake at or None).
#: Times are microseconds. Carried values are None at first; returning None for them forgets the key.
Step = Callable[[tuple, list[tuple[int, Any]], tuple, int], tuple[list[tuple], tuple | None, int | None]]


def in_time_order(
    rows: DataFrame, by: list[str], value: str, pick: Callable[[Any, Any], Any], carried: str, result: str, step: Step,
    ts: str = "ts",
) -> DataFrame:
    """Apply ``step`` to the rows of each key in the order of their event times, however they arrive.

    ``rows`` has a watermark on ``ts``. A row waits in the key's state until the watermark passes its time: by then
    nothing earlier can come, since Spark drops what is later than the watermark. ``pick`` makes one value of two at
    the same instant. The state holds what one watermark delay brings and the ``carried`` columns; a timer at the
    first waiting row, or where ``step`` wants to wake, flushes a key that gets no more rows. ``result`` is the schema
    of the result after the key columns. A null value is no row.

    Spark sends a key's state along with every Arrow batch of its rows, so what waits is one compressed binary value:
    as arrays it would be turned into objects once per batch. It holds what arrived since the watermark last moved, so
    bound a micro-batch (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).
    """
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [part.split()[0] for part in result.split(", ")]

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        packed, *now = state.get if state.exists else (None, *[None] * len(carried.split(", ")))
        held = dict(zip(*pickle.loads(zlib.decompress(packed)))) if packed else {}
        if not state.hasTimedOut:
            for frame in frames:
                frame = frame.dropna(subset=[ts, value])
                for us, one in zip(frame[ts].astype("datetime64[us]").astype("int64").tolist(), frame[value].tolist()):
                    held[us] = pick(held[us], one) if us in held else one
        mark = state.getCurrentWatermarkMs() * 1000
        due = [(us, held.pop(us)) for us in sorted(held) if us <= mark]
        out, kept, wake = step(key, due, tuple(now), mark)
        if kept is None and not held:
            if state.exists:
                state.remove()
        else:
            order = sorted(held)
            waiting = zlib.compress(pickle.dumps((order, [held[us] for us in order])), 1) if held else None
            state.update((waiting, *(kept or [None] * len(now))))
            wakes = [us for us in (*order[:1], wake) if us is not None]
            if wakes:
                # A timer goes off once the watermark is past it.
                state.setTimeoutTimestamp(max(-(-min(wakes) // 1000) - 1, state.getCurrentWatermarkMs()))
        if out:
            columns = dict(zip(by, ([part] * len(out) for part in key)))
            yield pd.DataFrame({**columns, **{n: [o[i] for o in out] for i, n in enumerate(names)}})

    keys = ", ".join(f"`{k}` {fields[k]}" for k in by)
    return rows.select(*by, ts, value).groupBy(*by).applyInPandasWithState(
        follow, f"{keys}, {result}", f"held binary, {carried}", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def time(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")
