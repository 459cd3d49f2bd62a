"""Literal tables and plain-Python answers to compare with."""

from __future__ import annotations

import datetime as dt

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds: float) -> dt.datetime:
    """A time this many seconds after the start, as Spark takes it."""
    return (START + dt.timedelta(seconds=seconds)).replace(tzinfo=None)


def since(time: dt.datetime) -> float:
    return (time - START.replace(tzinfo=None)).total_seconds()


def samples(spark, rows):
    """(seconds, metric, labels, value) as a sample table."""
    data = [(at(s), m, labels, None if v is None else float(v)) for s, m, labels, v in rows]
    return spark.createDataFrame(data, "ts timestamp, metric string, labels map<string,string>, value double")


def series_rows(df):
    """{(seconds, metric, labels): value}"""
    return {
        (since(r["ts"]), r["metric"], tuple(sorted(r["labels"].items()))): r["value"] for r in df.collect()
    }
