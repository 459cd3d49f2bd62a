"""Run a query and its SQL side by side and report the first difference.

``python -m tests.compare [prefix ...]`` checks registered queries at $SF_DIR.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(column: pd.Series) -> pd.Series:
    """Numbers with missing values as float64, booleans as numbers, everything else as it is."""
    kind = column.dtype.kind
    known = column.dropna()
    numeric = kind in "iufb" or (len(known) and known.map(lambda v: isinstance(v, (int, float))).all())
    if not numeric:
        return column.astype(object).where(column.notna(), None)
    if kind in "iu" and len(known) == len(column):
        return column.astype("int64")
    return pd.Series(column.astype("object").where(column.notna(), None), index=column.index).astype("float64")


def _normal(df: pd.DataFrame) -> pd.DataFrame:
    df = pd.DataFrame({c: _plain(df[c]) for c in sorted(df.columns)})
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} / {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} / {len(sql_rows)}"
    a, b = _normal(spark_rows), _normal(sql_rows)
    for c in a.columns:
        numbers = a[c].dtype.kind in "if" and b[c].dtype.kind in "if"
        x, y = (a[c].astype("float64"), b[c].astype("float64")) if numbers else (a[c].astype(object), b[c].astype(object))
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = (~same).to_numpy().nonzero()[0][0]
            return f"{(~same).sum()} values of {c} differ, first: {a.loc[i].to_dict()} / {b.loc[i].to_dict()}"
        if a[c].dtype.kind != b[c].dtype.kind:
            return f"type of {c}: {a[c].dtype} / {b[c].dtype}"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if len(sys.argv) > 1 and not any(name.startswith(p) for p in sys.argv[1:]):
            continue
        start = time.time()
        try:
            rows = run(spark, sf_dir).toPandas()
            spent = time.time() - start
            if name in oracles:
                problem = difference(rows, con.execute(oracles[name]).df())
            else:
                problem = None if len(rows) else "no rows"
        except Exception as error:  # noqa: BLE001 - reported per query
            rows, spent, problem = [], time.time() - start, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:28} {len(rows):7} rows {spent:6.2f}s"
              f"{' (no sql)' if name not in oracles else ''} {problem or ''}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(main())
