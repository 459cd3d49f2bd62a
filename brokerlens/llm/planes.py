"""Token ids in files of byte or bit planes, each plane compressed by itself, with an index of chunks."""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brokerlens.llm.common import slices, written
from brokerlens.llm.pretokens import PretokenCache
from brokerlens.llm.stores import Output, new_folder, opened

#: The file: MAGIC, planes of chunk after chunk, the documents' index, a footer in JSON, its length, MAGIC.
MAGIC = b"IDPLANE1"
CHUNK_IDS = 1 << 16
END_ID = 2


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Plane k holds byte (or bit) k of every id; planes of zeros are empty."""
    if bits:
        made = [np.packbits((ids >> np.uint32(k) & np.uint32(1)).astype(np.uint8)) for k in range(32)]
    else:
        made = list(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T))
    return [plane.tobytes() if plane.any() else b"" for plane in made]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    ids = np.zeros(n, dtype=np.uint32)
    for k, plane in enumerate(planes):
        if plane:
            raw = np.frombuffer(plane, dtype=np.uint8)
            ids |= (np.unpackbits(raw, count=n) if bits else raw).astype(np.uint32) << np.uint32(k if bits else 8 * k)
    return ids


class PlaneWriter:
    """Writes one file; holds one chunk of ids and, per document, its key and number of ids."""

    def __init__(self, folder: str, name: str, chunk_ids: int, bits: bool, level: int):
        self.out, self.chunk_ids, self.bits = Output(folder, name), chunk_ids, bits
        self.packer = zstandard.ZstdCompressor(level=level)
        self.chunks: list[list] = []
        self.keys: list = []
        self.counts: list[int] = []
        self.open: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.out.write(MAGIC)

    def add(self, key, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(len(ids))
        self.total += len(ids)
        self.open.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.chunk_ids:
            held = np.concatenate(self.open)
            whole = len(held) // self.chunk_ids * self.chunk_ids
            for start in range(0, whole, self.chunk_ids):
                self._chunk(held[start : start + self.chunk_ids])
            self.open, self.waiting = [held[whole:]], len(held) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        packed = [self.packer.compress(p) if p else b"" for p in to_planes(ids, self.bits)]
        at = self.out.write(b"".join(packed))
        self.chunks.append([at, len(ids), [len(p) for p in packed]])

    def close(self) -> dict:
        if self.waiting:
            self._chunk(np.concatenate(self.open))
        index = self.packer.compress(json.dumps([self.keys, self.counts]).encode())
        footer = {"bits": self.bits, "documents": [self.out.write(index), len(index)], "chunks": self.chunks}
        raw = json.dumps(footer).encode()
        self.out.write(raw + len(raw).to_bytes(8, "little") + MAGIC)
        self.out.commit()
        return {"docs": len(self.keys), "tokens": self.total, "bytes": self.out.size}


def _footer(file) -> dict:
    file.seek(file.size() - 16)
    tail = file.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a complete file of planes")
    size = int.from_bytes(tail[:8], "little")
    file.seek(file.size() - 16 - size)
    return json.loads(file.read(size))


def read_file(folder: str, name: str) -> Iterator[tuple[object, np.ndarray]]:
    """(key, ids) of every document of a file, in order, with one chunk in memory beside the document."""
    unpacker = zstandard.ZstdDecompressor()
    with opened(folder, name) as file:
        footer = _footer(file)
        file.seek(footer["documents"][0])
        keys, counts = json.loads(unpacker.decompress(file.read(footer["documents"][1])))
        held, chunk = np.empty(0, dtype=np.uint32), 0
        for key, n in zip(keys, counts):
            parts, missing = [], n
            while missing:
                if not len(held):
                    at, size, lengths = footer["chunks"][chunk]
                    chunk += 1
                    file.seek(at)
                    planes = [unpacker.decompress(file.read(k)) if k else b"" for k in lengths]
                    held = from_planes(planes, size, footer["bits"])
                parts.append(held[:missing])
                held, missing = held[missing:], missing - min(missing, len(held))
            yield key, np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {**{b: chr(b) for b in prints}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class Encoder(PretokenCache):
    """As ``PretokenCache``; texts with a string of the tokenizer's added tokens go to the library whole."""

    def __init__(self, pattern: str, encode, tokenizer):
        super().__init__(pattern, encode)
        self.tokenizer = tokenizer
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def texts(self, texts: Iterable[str | None]) -> list[bytes]:
        held = list(texts)
        whole = {k: t for k, t in enumerate(held) if t and any(a in t for a in self.added)}
        out = super().texts("" if k in whole else t for k, t in enumerate(held))
        for k, t in whole.items():
            out[k] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out


_HELD: dict[str, Encoder] = {}


def _cache(path: str, pattern: str) -> Encoder:
    """One per worker process. Pretokens go to the library's model as they are; its own splitting was done here."""
    if path not in _HELD:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        model, letters = tokenizer.model, byte_letters()

        def encode(pretokens: list[str]) -> list[bytes]:
            spelled = (p.encode().decode("latin-1").translate(letters) for p in pretokens)
            return [array("I", [t.id for t in model.tokenize(s)]).tobytes() for s in spelled]

        _HELD[path] = Encoder(pattern, encode, tokenizer)
    return _HELD[path]


def counted(rows: DataFrame, path: str, pattern: str, text: str, name: str) -> DataFrame:
    """The rows with, in place of their text, how many ids ``write`` gives it, the end's included."""
    kept = [f for f in rows.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(path, pattern)
        for whole in batches:
            for batch in slices(whole, [text]):
                sizes = [len(ids) // 4 + 1 for ids in cache.texts(batch.column(text).to_pylist())]
                columns = {f.name: batch.column(f.name) for f in kept}
                yield pa.RecordBatch.from_pydict(columns | {name: pa.array(sizes, type=pa.int64())})

    return rows.mapInArrow(run, schema)


MANIFEST = "part int, name string, docs long, tokens long, bytes long"


def write(
    docs: DataFrame,
    path: str,
    pattern: str,
    text: str = "text",
    key: str = "doc_id",
    chunk_ids: int = CHUNK_IDS,
    bits: bool = False,
    level: int = 3,
) -> tuple[str, DataFrame]:
    """Encode all texts into plane files, one per range of keys; gives (folder, manifest of its complete files).

    Rows are range-partitioned by key, then text, then their place in the input, so that one key with very many rows
    spreads over files too. Files appear by renaming and count only once the manifest, a table written by Spark,
    lists them. The key is a number or a string; null keys come first. A null text is encoded as an empty one.
    """
    folder = new_folder(docs.sparkSession, "planes")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    order = ["key", F.xxhash64("text"), "place"]
    rows = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order)
    rows = rows.sortWithinPartitions(*order).drop("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, writer = _cache(path, pattern), None
        end = np.array([END_ID], dtype="<u4").tobytes()
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}.planes"
        for whole in batches:
            for batch in slices(whole, ["text"]):
                writer = writer or PlaneWriter(folder, name, chunk_ids, bits, level)
                made = cache.texts(batch.column("text").to_pylist())
                for k, ids in zip(batch.column("key").to_pylist(), made):
                    writer.add(k, np.frombuffer(ids + end, dtype="<u4"))
        if writer:
            done = writer.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "name": pa.array([name]),
                **{c: pa.array([done[c]], pa.int64()) for c in ("docs", "tokens", "bytes")},
            })

    return folder, written(rows.mapInArrow(run, MANIFEST), "manifest")


def read(spark, folder: str, manifest: DataFrame, key: T.StructField) -> DataFrame:
    """Per document, from the files: key, start (ids of all documents before it), n_tokens, ids_crc32.

    One row per file, its name and number of ids, passes through the driver to lay the files end to end.
    """
    at, files = 0, []
    for row in manifest.orderBy("part").select("name", "tokens").collect():
        files.append((row["name"], at))
        at += row["tokens"]
    schema = T.StructType([T.StructField(key.name, key.dataType)])
    schema = schema.add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                rows: list[tuple] = []
                for k, ids in read_file(folder, name):
                    rows.append((k, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _table(rows, target)
                        rows = []
                if rows:
                    yield _table(rows, target)

    listed = spark.createDataFrame(files, "name string, start long")
    return listed.repartition(max(1, len(files))).mapInArrow(run, schema)


def _table(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), target)], schema=target)
