"""What the corpus operators share: reading, scratch tables, names that do not clash, batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brokerlens.session import configure, scratch

#: White space that separates words everywhere here: ``[\x20\x09-\x0D]``, the white space of ``bytes.split``.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the folder all executors share and read back.

    Cuts the lineage: a lost executor costs a re-read, not the work before it.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame | Iterable[str], name: str) -> str:
    """``name``, with underscores in front until no column is called so (in either case)."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    while name.lower() in taken:
        name = "_" + name
    return name


def same(left: Column, right: Column) -> Column:
    """Equality under which two nulls are equal; still an equi-join."""
    return left.eqNullSafe(right)


def per_batch(fn: Callable[..., dict], columns: list[str], schema: StructType):
    """A ``mapInArrow`` function from one over the Python lists of some columns.

    ``fn`` returns a dict of equally long lists for ``schema``; rows may be fewer or more than the input's.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, columns):
                made = fn(*(part.column(c).to_pylist() for c in columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[f.name], type=f.type) for f in target], schema=target
                )

    return run


#: Rows of a batch are handed on in parts of about so many bytes, so that a task's Python memory is bounded.
PART_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, columns: list[str], part_bytes: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose named columns hold about ``part_bytes``; a longer row goes alone."""
    if batch.num_rows == 0:
        return
    size = sum(batch.column(c).nbytes for c in columns)
    step = max(1, int(batch.num_rows * part_bytes / max(size, 1)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def text_key(column: Column) -> Column:
    """64 bits of a text; null and empty differ from every other text and from each other."""
    return F.when(column.isNull(), F.lit(-1)).otherwise(F.xxhash64(column))
