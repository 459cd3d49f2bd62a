"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def us(column: str | Column) -> Column:
    """Times are compared as whole microseconds."""
    return F.unix_micros(column)


def rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# The same views in SQL, as parts of a WITH clause.
RECOVERY_SQL = """rec AS (
  SELECT l_orderkey AS id, l_linenumber AS line, epoch_us(l_shipdate) AS ts, l_returnflag AS strategy,
    CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'BATCH_DATA_INTENSIVE'
         ELSE 'REAL_TIME_EVENT_DRIVEN' END AS workload_type,
    CASE WHEN l_linestatus = 'F' THEN 'default' ELSE 'buffer' END AS config_source,
    l_quantity AS recovery_time_seconds, l_discount AS cpu_usage_percent, l_tax AS memory_usage_percent,
    'kafka' || CAST(l_suppkey % 3 + 1 AS VARCHAR) || ':9092' AS broker_url,
    CASE WHEN l_quantity < 45 THEN 'SUCCESS' ELSE 'FAILURE' END AS result,
    l_extendedprice AS price, o_totalprice AS total
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

# Recoded as the analysis wants it: display names, percent, two workloads.
ANALYSED_SQL = RECOVERY_SQL + """, ana AS (
  SELECT *, CASE WHEN config_source = 'default' THEN 'baseline' ELSE 'ARMS' END AS configuration,
    CASE WHEN workload_type = 'BATCH_DATA_INTENSIVE' THEN 'batch' ELSE 'real-time' END AS workload_strategy,
    cpu_usage_percent * 100 AS cpu
  FROM rec)"""

SAMPLES_SQL = """smp AS (
  SELECT epoch_us(ts) AS us, event_type AS metric, CAST(user_id % 3 + 1 AS VARCHAR) AS broker, value FROM events)"""

COUNTERS_SQL = """cnt AS (
  SELECT epoch_us(ts) AS us, event_type AS metric, CAST(user_id % 3 + 1 AS VARCHAR) AS broker,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (
      PARTITION BY event_type, user_id % 3, CAST(ts AS DATE) ORDER BY ts, event_id) AS DOUBLE) AS value
  FROM events)"""

PROGRESS_SQL = """prg AS (
  SELECT epoch_us(ts) AS us, CASE WHEN event_type IN ('click', 'view') THEN 'real_time' ELSE 'batch' END AS workload_type,
    value AS message_rate, CAST(strlen(props) AS DOUBLE) AS payload_size_bytes, CAST(user_id % 100 AS INTEGER) AS batch_size,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS cpu_usage, CAST(user_id % 50 AS DOUBLE) / 50 AS memory_usage
  FROM events)"""

CLASSES_SQL = """cls AS (
  SELECT d.doc_id, l.quality AS label, CAST(length(text) AS DOUBLE) AS chars,
    CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS spaces,
    CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) AS newlines,
    CAST(length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS DOUBLE) AS digits,
    CAST(length(text) - length(replace(text, ',', '')) AS DOUBLE) AS commas,
    CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS DOUBLE) AS uppers,
    CAST(1 AS DOUBLE) AS constant
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
