"""Column functions: projections, recodes, parsing, sentinels, rounding, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brokerlens.operators.ordered import micros


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def project_features(df: DataFrame, names: list[str], keep: list[str] = ()) -> DataFrame:
    return df.select(*keep, *names)


def recode(df: DataFrame, column: str, mapping: dict[str, str], into: str | None = None) -> DataFrame:
    """Replace known values, keep the others."""
    pairs = [part for k, v in mapping.items() for part in (F.lit(k), F.lit(v))]
    return df.withColumn(into or column, F.coalesce(F.create_map(*pairs)[F.col(column)], F.col(column)))


# Display names of the configuration sources.
CONFIGURATION_NAMES = {"default": "baseline", "buffer": "ARMS"}


def scale(df: DataFrame, column: str, factor: float) -> DataFrame:
    return df.withColumn(column, F.col(column) * factor)


# Spellings of the two workload classes found in the inputs, in lower case.
REAL_TIME_NAMES = ["0", "real_time", "real_time_event_driven", "real-time"]
BATCH_NAMES = ["1", "batch", "batch_data_intensive", "batch_processing"]
# Class code to class name.
CLASS_NAMES = {0: "REAL_TIME_EVENT_DRIVEN", 1: "BATCH_DATA_INTENSIVE"}


def canonical_workload(column: Column | str) -> Column:
    """real-time, batch or unknown, whatever vocabulary the source used."""
    text = F.lower(F.trim(_col(column).cast("string")))
    return F.when(text.isin(REAL_TIME_NAMES), "real-time").when(text.isin(BATCH_NAMES), "batch").otherwise("unknown")


def batch_or_real_time(column: Column | str) -> Column:
    """batch for the batch class name, real-time for anything else."""
    return F.when(_col(column) == CLASS_NAMES[1], "batch").otherwise("real-time")


def class_name(code: Column | str) -> Column:
    code = _col(code)
    return F.when(code == 0, CLASS_NAMES[0]).when(code == 1, CLASS_NAMES[1]).otherwise("UNKNOWN")


def scenario_name(workload: Column | str, adaptive: Column | str) -> Column:
    # The endings of scenario names in the experiment table.
    return F.concat(_col(workload), F.when(_col(adaptive), "_with_arms").otherwise("_without_arms"))


def group_key(*columns: Column | str) -> Column:
    return F.concat_ws("_", *[_col(c) for c in columns])


def parse_ts(column: Column | str) -> Column:
    """ISO text, space-separated text or epoch seconds as a timestamp; anything else is NULL."""
    column = _col(column)
    text = column.cast("string")
    epoch = text.try_cast("double")
    return F.when(epoch.isNotNull(), F.timestamp_micros((epoch * 1_000_000).try_cast("bigint"))).otherwise(
        F.try_to_timestamp(text)
    )


def add_changes(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``name -> (before, after)``: after minus before, negative is better."""
    return df.withColumns({name: F.col(after) - F.col(before) for name, (before, after) in pairs.items()})


# What stands for a missing value, per kind of column.
MISSING_TEXT = ["N/A", ""]
MISSING_NUMBER = -1


def nullify_sentinels(df: DataFrame, text: list[str] = (), numbers: list[str] = ()) -> DataFrame:
    """Missing-value markers to NULL; number columns may arrive as text."""
    cleaned = {c: F.when(~F.trim(F.col(c)).isin(MISSING_TEXT), F.col(c)) for c in text}
    for c in numbers:
        value = F.col(c).try_cast("double")
        cleaned[c] = F.when(value != MISSING_NUMBER, value)
    return df.withColumns(cleaned)


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill NULL and NaN with the column mean; a column without values stays NULL.

    All means are one row of one scalar subquery, so the input is read once for them.
    """
    values = {c: F.col(c).cast("double") for c in columns}
    known = {c: F.when(~F.isnan(v), v) for c, v in values.items()}
    means = df.agg(F.struct(*[F.avg(v).alias(c) for c, v in known.items()])).scalar()
    return df.withColumns({c: F.coalesce(v, means[c]) for c, v in known.items()})


def where(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.filter(condition)


def match_labels(df: DataFrame, equal: dict[str, str] = {}, regex: dict[str, str] = {}, labels: str = "labels"):
    """Keep series whose labels are equal to, or fully match, the given text; a missing label is empty text."""
    for name, text in equal.items():
        df = df.filter(F.coalesce(F.col(labels)[name], F.lit("")) == text)
    for name, pattern in regex.items():
        df = df.filter(F.coalesce(F.col(labels)[name], F.lit("")).rlike(f"^(?:{pattern})$"))
    return df


def neg_log10(column: Column | str) -> Column:
    return -F.log10(_col(column))


def round_like_pandas(column: Column | str, digits: int = 2) -> Column:
    """Half to even."""
    return F.bround(_col(column), digits)


def align_up(ts: Column | str, seconds: float) -> Column:
    """The next boundary strictly after the time."""
    step = micros(seconds)
    return F.timestamp_micros((F.floor(F.unix_micros(_col(ts)) / F.lit(step)) + 1) * step)


def effective_interval(check: Column | str, generator: Column | str) -> Column:
    """The check interval, or a sixth of a known generator interval if that is shorter."""
    generator = _col(generator)
    return F.when(generator > 0, F.least(_col(check).cast("double"), generator / 6)).otherwise(_col(check).cast("double"))


def missing_feature(names: list[str]) -> Column:
    """Name of the first required feature that is NULL, else NULL."""
    return F.coalesce(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names])


def organize(df: DataFrame, drop: list[str] = (), order: list[str] = (), rename: dict[str, str] = {}) -> DataFrame:
    """Exclude, reorder (named first, rest as they are) and rename columns."""
    rest = [c for c in df.columns if c not in drop and c not in order]
    return df.select(*[c for c in order if c not in drop], *rest).withColumnsRenamed(rename)


def compact_map(column: Column | str) -> Column:
    """The map without NULL values."""
    return F.map_filter(_col(column), lambda _, v: v.isNotNull())


def nothing_to_apply(column: Column | str) -> Column:
    return F.size(compact_map(column)) == 0


def map_to_json(column: Column | str) -> Column:
    """JSON text of a map; a missing or empty map is empty text."""
    column = _col(column)
    return F.when(column.isNull() | (F.size(column) == 0), "").otherwise(F.to_json(column))


def json_to_map(column: Column | str) -> Column:
    column = _col(column)
    return F.from_json(F.when(F.trim(column) != "", column), "map<string,string>")


def broker_id(column: Column | str) -> Column:
    """The digits of a host name as a number, NULL without digits."""
    return F.regexp_replace(host_of(column), r"\D", "").try_cast("int")


def host_of(column: Column | str) -> Column:
    return F.substring_index(_col(column), ":", 1)


def jmx_port(column: Column | str) -> Column:
    # The port each broker exposes its readings on.
    return F.when(host_of(column) == "kafka2", "9981").when(host_of(column) == "kafka3", "9982").otherwise("9980")


# Ports of the primary broker addresses.
PRIMARY_PORTS = ["9092", "9093", "9094"]


def primary_brokers(df: DataFrame, column: str = "broker_url") -> DataFrame:
    return df.filter(F.col(column).rlike(":(?:" + "|".join(PRIMARY_PORTS) + ")"))


def first_usable(*columns: Column | str, unknown: float | None = None) -> Column:
    """First value that is a number; else ``unknown``."""
    usable = [F.when(~F.isnan(c), c) for c in (_col(c).try_cast("double") for c in columns)]
    return F.coalesce(*usable, F.lit(unknown).cast("double"))
