"""Sinks: append-only event tables, result tables, the latest-state snapshot, models."""

from __future__ import annotations

import json
import uuid

import pyarrow.fs as pafs
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brokerlens.functions.scalars import map_to_json


def append_events(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = ()) -> None:
    """Append rows; a stream needs no more than the same call with a checkpoint, see ``append_stream``."""
    writer = df.write.mode("append").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def append_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"):
    """Append a stream exactly once; the caller picks the trigger by calling ``start`` on the result."""
    return df.writeStream.outputMode("append").format(fmt).option("path", path).option("checkpointLocation", checkpoint)


def recovery_csv(df: DataFrame) -> DataFrame:
    """Recovery rows as the text columns of the log: times as text, the configuration as JSON."""
    time = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    return df.withColumns({"timestamp": time, "applied_config": map_to_json("applied_config")})


def write_result(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A result table as CSV with header, or as JSON lines."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)


def write_result_map(df: DataFrame, path: str, key: str) -> None:
    """A small result table as one JSON object per row: its key mapped to its other columns."""
    values = F.struct(*[c for c in df.columns if c != key])
    text = df.select(F.to_json(F.create_map(F.col(key).cast("string"), values)).alias("value"))
    text.write.mode("overwrite").text(path)


#: The file that names the published version of a snapshot.
_POINTER = "current.json"


def _pointer(path: str) -> dict:
    """What the pointer file says: folder, number, writer, and the last batch of every writer so far."""
    store, base = pafs.FileSystem.from_uri(path)
    try:
        with store.open_input_stream(f"{base}/{_POINTER}") as file:
            return json.loads(file.read())
    except FileNotFoundError:
        return {"folder": None, "number": -1, "writer": None, "batches": {}}


def _publish(path: str, pointer: dict) -> None:
    """Name a version by one rename, then retire all versions but it and the one before, which readers may still hold."""
    store, base = pafs.FileSystem.from_uri(path)
    temporary = f"{base}/.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as file:
        file.write(json.dumps(pointer).encode())
    store.move(temporary, f"{base}/{_POINTER}")
    for found in store.get_file_info(pafs.FileSelector(base)):
        number = found.base_name.removeprefix("v").partition("-")[0]
        if found.type == pafs.FileType.Directory and number.isdigit() and int(number) < pointer["number"] - 1:
            store.delete_dir(found.path)


def upsert_latest(
    batch: DataFrame, path: str, version: int | None = None, keys: list[str] = (), ts: str = "ts", writer: str = ""
) -> None:
    """Make the newest row (per key) of the batch and of the stored snapshot the stored snapshot.

    The new state is written whole into a folder of its own and then published by renaming a pointer file, so a reader
    sees the old or the new one and a writer that dies leaves a folder that nothing names. The published version and
    the one before stay. ``version`` numbers the batches of one ``writer``: a batch that is already in is passed over.
    A new writer takes over what is stored; one that has been taken over from is refused (ValueError). One writer
    works at a time; without a version every call is a batch.
    """
    pointer = _pointer(path)
    batches = pointer["batches"]
    if writer in batches and writer != pointer["writer"]:
        raise ValueError(f"{writer!r} is older than {pointer['writer']!r}, which now keeps {path}")
    last = batches.get(writer, -1)
    version = last + 1 if version is None else version
    if version <= last:
        return
    stored = read_latest(batch.sparkSession, path, batch.schema)
    row = F.max(F.struct(ts, *[c for c in batch.columns if c != ts])).alias("_r")
    if any(f.dataType.typeName() == "map" for f in batch.schema):
        row = F.max_by(F.struct(*batch.columns), ts).alias("_r")
    newest = batch.unionByName(stored).groupBy(*keys).agg(row).filter("_r IS NOT NULL")
    number = pointer["number"] + 1
    folder = f"v{number}-{uuid.uuid4().hex}"
    newest.select(*[F.col(f"_r.{c}").alias(c) for c in batch.columns]).write.parquet(f"{path}/{folder}")
    _publish(path, {"folder": folder, "number": number, "writer": writer, "batches": {**batches, writer: version}})


def read_latest(spark: SparkSession, path: str, schema) -> DataFrame:
    """The published snapshot, or no rows. It stays readable until two further versions have been published."""
    folder = _pointer(path)["folder"]
    if folder is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{folder}")


def latest_sink(stream: DataFrame, path: str, checkpoint: str, keys: list[str] = (), ts: str = "ts"):
    """Keep the newest row (per key) of a stream. The checkpoint is the writer: a new one goes on from what is stored."""

    def store(batch: DataFrame, batch_id: int) -> None:
        upsert_latest(batch, path, batch_id, keys, ts, checkpoint)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
