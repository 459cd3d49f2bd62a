"""Exact top-k inner products by a uniform threshold over parts of the vectors, in three phases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brokerlens.llm.common import written

SCALE = 256
PARTS = 2
QUERY_BLOCK = 4096
#: Of an exact product in floating point: no partial sum may exceed it.
EXACT = 1 << 53


def _quantised(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values.astype(np.float64)).astype(np.int64)


def _valid(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """(id, quantised vector) of a batch's rows; null and non-finite ones are passed over."""
    for key, vector in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist()):
        if key is None or vector is None or any(x is None for x in vector):
            continue
        values = np.array(vector, dtype=np.float64)
        if np.isfinite(values).all():
            yield key, _quantised(values).astype("<i8").tobytes()


def _with_vec(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = list(_valid(batch))
        yield pa.RecordBatch.from_pydict({
            "id": pa.array([i for i, _ in pairs], pa.int64()), "vec": pa.array([v for _, v in pairs], pa.binary())
        })


def _classes_of(batch: pa.RecordBatch, keep: int) -> dict[bytes, list[int]]:
    """The ``keep`` smallest ids of each different quantised vector."""
    out: dict[bytes, list[int]] = {}
    for key, vector in _valid(batch):
        out.setdefault(vector, []).append(key)
    return {v: sorted(set(ids))[:keep] for v, ids in out.items()}


def vector_classes(vectors: DataFrame, keep: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(class, vec, ids): each different quantised vector once, with its ``keep`` smallest ids.

    Every batch keeps that many ids per vector before the shuffle, so a vector that very many rows share brings a few
    ids per batch to its group.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _classes_of(batch, keep)
            yield pa.RecordBatch.from_pydict({
                "vec": pa.array(list(found), pa.binary()), "ids": pa.array(list(found.values()), pa.list_(pa.int64()))
            })

    few = rows.mapInArrow(run, "vec binary, ids array<long>")
    whole = few.groupBy("vec").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    ids = F.slice(F.array_sort(F.array_distinct("ids")), 1, keep)
    return written(whole.select(F.monotonically_increasing_id().alias("class"), "vec", ids.alias("ids")), "classes")


def _matrix(blobs: list[bytes], width: int) -> np.ndarray:
    """Vectors of different lengths as rows; a missing component counts as zero."""
    out = np.zeros((len(blobs), width), dtype=np.int64)
    for k, blob in enumerate(blobs):
        row = np.frombuffer(blob, dtype="<i8")[:width]
        out[k, : len(row)] = row
    return out


def _product(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products, exact: in floating point where no sum can leave its whole numbers, else in integers."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(points).max(initial=0)) * max(1, queries.shape[1])
    if most < EXACT:
        return (queries.astype(np.float64) @ points.astype(np.float64).T).astype(np.int64)
    return queries @ points.T


def _nodes(classes: DataFrame, parts: int) -> DataFrame:
    """(class, part, piece): node ``part`` holds that part of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, blobs = batch.column("class").to_pylist(), batch.column("vec").to_pylist()
            for part in range(parts):
                cut = [_cut(b, part, parts) for b in blobs]
                yield pa.RecordBatch.from_pydict({
                    "class": pa.array(keys, pa.int64()), "part": pa.array([part] * len(keys), pa.int32()),
                    "piece": pa.array(cut, pa.binary()),
                })

    nodes = classes.select("class", "vec").mapInArrow(run, "class long, part int, piece binary")
    return written(nodes.repartition("part", F.pmod(F.xxhash64("class"), F.lit(64))), "nodes")


def _cut(blob: bytes, part: int, parts: int) -> bytes:
    """Every ``parts``-th component, so that vectors of different lengths are cut alike."""
    return np.frombuffer(blob, dtype="<i8")[part::parts].tobytes()


def _query_piece(queries: list[bytes], part: int, parts: int) -> np.ndarray:
    cut = [_cut(b, part, parts) for b in queries]
    return _matrix(cut, max((len(b) // 8 for b in cut), default=0))


def top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    parts: int = PARTS,
    key: str = "vec_id",
    vector: str = "embedding",
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, <key>, score): for each row whose key ``every`` divides, its k best other rows.

    Scores are inner products of floor(256 * x); ties go to the smaller key; fewer than k rows give what there is.
    Vectors that are null, or hold a null or non-finite component, and rows without a key take no part; repeated
    rows of a key count once per different vector. Vectors of another length than the query's count with zeros. Scores must fit in 64 bits.

    Equal vectors are one class with its k + 1 smallest keys, which is all that any query can use. Every node holds
    one part of the vectors' components. Queries are taken in blocks of ``query_block``; for each block

    1. the nodes send the k + 1 best partial scores per query, and the classes met are scored exactly; the last of
       the k + 1 best of them is a cutoff c that the answer cannot fall below,
    2. the cutoffs are sent to all nodes, and these send every entry of c / parts or more: a class below that in
       every part is below c; classes sent by all nodes are known exactly and raise the cutoff,
    3. the classes whose known parts leave them a chance are scored exactly from the missing parts.
    """
    spark, need = vectors.sparkSession, k + 1
    classes = vector_classes(vectors, need, key, vector)
    nodes = _nodes(classes, parts)
    asked = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    asked = asked.where(F.col("id") % every == 0).mapInArrow(_with_vec, "id long, vec binary").distinct()
    numbered = asked.select("vec").distinct().select(F.monotonically_increasing_id().alias("class"), "vec")
    numbered = written(numbered, "asked")
    blocks = _ranges(numbered, query_block)
    found = None
    for low, high in blocks:
        block = numbered.where((F.col("class") >= low) & (F.col("class") < high)).orderBy("class").collect()
        best = _block(spark, nodes, [r["class"] for r in block], [bytes(r["vec"]) for r in block], need, parts)
        best = written(best, "best")
        found = best if found is None else found.unionAll(best)
    schema = f"query_id long, rank int, {key} long, score long"
    if found is None:
        return spark.createDataFrame([], schema)
    held = found.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("other"))
    each = asked.join(numbered, "vec").select(F.col("class").alias("query"), F.col("id").alias("query_id"))
    pairs = each.join(held, "query").where("query_id <> other")
    # The same key may come with several vectors; its best score counts.
    pairs = pairs.groupBy("query_id", "query", "other").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "other")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("other").alias(key), "score")


def _ranges(numbered: DataFrame, size: int) -> list[tuple[int, int]]:
    """Bounds of class numbers that hold about ``size`` queries each, from counts per partition-made prefix."""
    bucket = F.shiftright("class", 8)
    counts = numbered.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).orderBy("b")
    out, low, held, last = [], None, 0, None
    for row in counts.toLocalIterator():
        if low is None:
            low = row["b"] << 8
        if held and held + row["n"] > size:
            out.append((low, row["b"] << 8))
            low, held = row["b"] << 8, 0
        held, last = held + row["n"], (row["b"] + 1) << 8
    return out + ([(low, last)] if low is not None else [])


def _block(spark, nodes: DataFrame, ids: list[int], queries: list[bytes], need: int, parts: int) -> DataFrame:
    """(query, class, score): all classes that can be among the ``need`` best of each query of a block."""
    pieces = spark.sparkContext.broadcast([_query_piece(queries, p, parts) for p in range(parts)])
    per_part = "query int, class long, part int, partial long"

    def by_part(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        part = batch.column("part").to_numpy(zero_copy_only=False)
        keys = batch.column("class").to_numpy(zero_copy_only=False)
        blobs = batch.column("piece").to_pylist()
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            q = pieces.value[p]
            for start in range(0, len(at), 4096):
                some = at[start : start + 4096]
                yield int(p), keys[some], _product(q, _matrix([blobs[i] for i in some], q.shape[1]))

    def rows(p: int, keys: np.ndarray, scores: np.ndarray, q: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "query": pa.array(q.astype(np.int32)), "class": pa.array(keys[c]),
            "part": pa.array(np.full(len(q), p, dtype=np.int32)), "partial": pa.array(scores[q, c]),
        })

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, keys, scores in by_part(batch):
                n = min(need, len(keys))
                top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                q = np.repeat(np.arange(len(scores)), n)
                yield rows(p, keys, scores, q, top.ravel())

    lists = nodes.mapInArrow(first, per_part)
    place = F.row_number().over(Window.partitionBy("query", "part").orderBy(F.desc("partial"), "class"))
    met = lists.withColumn("place", place).where(F.col("place") <= need).select("query", "class").distinct()
    exact = written(_scored(spark, nodes, met, pieces, parts), "met")
    cutoff = _cutoffs(exact, need, len(ids))
    sent = spark.sparkContext.broadcast(cutoff)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, keys, scores in by_part(batch):
                q, c = np.nonzero(scores >= -(-sent.value // parts)[:, None])
                yield rows(p, keys, scores, q, c)

    entries = nodes.mapInArrow(second, per_part).groupBy("query", "class").agg(
        F.sum("partial").alias("known"), F.count("*").alias("parts")
    )
    entries = written(entries, "entries")
    whole = entries.where(F.col("parts") == parts).select("query", "class", F.col("known").alias("score"))
    higher = np.maximum(cutoff, _cutoffs(whole.unionAll(exact).distinct(), need, len(ids)))
    limits = spark.createDataFrame(
        [(q, int(c), int(t)) for q, (c, t) in enumerate(zip(-(-cutoff // parts), higher))], "query int, below long, cutoff long"
    )
    # An unsent part is below the node's threshold, so this much at most:
    most = F.col("known") + (parts - F.col("parts")) * (F.col("below") - 1)
    open_ = entries.where(F.col("parts") < parts).join(limits, "query").where(most >= F.col("cutoff"))
    solved = _scored(spark, nodes, open_.select("query", "class"), pieces, parts)
    every = whole.unionAll(solved).unionAll(exact).distinct().join(limits.select("query", "cutoff"), "query")
    names = spark.createDataFrame(list(enumerate(ids)), "query int, name long")
    kept = every.where(F.col("score") >= F.col("cutoff")).join(names, "query")
    return kept.select(F.col("name").alias("query"), "class", "score")


def _cutoffs(scored: DataFrame, need: int, n: int) -> np.ndarray:
    """Per query of the block the ``need``-th best score; the least long where there are fewer."""
    out = np.full(n, -(1 << 62), dtype=np.int64)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "class"))
    for row in scored.withColumn("place", place).where(F.col("place") == need).select("query", "score").collect():
        out[row["query"]] = row["score"]
    return out


SHARDS = 64


def _scored(spark, nodes: DataFrame, pairs: DataFrame, pieces, parts: int) -> DataFrame:
    """(query, class, score) of given pairs, exactly, from all parts. Pairs meet the vectors shard by shard."""
    shard = F.pmod(F.xxhash64("class"), F.lit(SHARDS)).cast("int").alias("shard")
    schema = "query int, class long, partial long"

    def solve(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "class": [], "partial": []}
        q, c = (asked.column(x).to_numpy() for x in ("query", "class"))
        keys, part, blobs = held.column("class").to_numpy(), held.column("part").to_numpy(), held.column("piece").to_pylist()
        for p in range(parts):
            at = np.flatnonzero(part == p)
            at = at[np.argsort(keys[at])]
            matrix = _matrix([blobs[i] for i in at], pieces.value[p].shape[1])
            row = np.searchsorted(keys[at], c)
            for start in range(0, len(q), 50_000):
                s = slice(start, start + 50_000)
                out["query"].append(q[s])
                out["class"].append(c[s])
                out["partial"].append(np.einsum("ij,ij->i", pieces.value[p][q[s]], matrix[row[s]]))
        empty = np.empty(0, dtype=np.int64)
        joined = {name: np.concatenate(v) if v else empty for name, v in out.items()}
        return pa.table({
            "query": pa.array(joined["query"].astype(np.int32)), "class": pa.array(joined["class"].astype(np.int64)),
            "partial": pa.array(joined["partial"].astype(np.int64)),
        })

    asked = pairs.select("query", "class", shard).groupBy("shard")
    held = nodes.select("class", "part", "piece", shard).groupBy("shard")
    partial = asked.cogroup(held).applyInArrow(solve, schema)
    return partial.groupBy("query", "class").agg(F.sum("partial").alias("score"))
