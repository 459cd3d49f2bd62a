"""Byte-level BPE by padded numpy matrices: every row merges its leftmost pair of least rank each round."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brokerlens.llm.common import slices
from brokerlens.llm.pretokens import PretokenCache

NONE = np.iinfo(np.int32).max
#: Bytes up to which pretokens share a matrix; longer than the last one they are merged one by one.
BUCKETS = (4, 6, 8, 10, 12, 16, 24, 32, 64, 128)
#: Cells of a matrix.
CELLS = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Merges:
    """The vocabulary as a hashed table from pairs of ids to the id, and so rank, of their concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, dtype=np.uint64) << np.uint64(32)) | np.array(right, dtype=np.uint64)
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys = np.full(1 << self.bits, (1 << 64) - 1, dtype=np.uint64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        self._fill(keys, np.array(merged, dtype=np.int32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        """Fibonacci hashing: the upper bits of a product with 2^64 over the golden ratio."""
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot, probes = self._slot(keys), 1
        while len(keys):
            free = np.flatnonzero(self.values[slot] == NONE)
            _, winner = np.unique(slot[free], return_index=True)
            won = free[winner]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            rest = np.ones(len(keys), dtype=bool)
            rest[won] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
            probes += bool(len(keys))
        self.probes = probes

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, ``NONE`` without one; negative ids are padding."""
        out = np.full(left.shape, NONE, dtype=np.int32)
        at = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        keys = (left.ravel()[at].astype(np.uint64) << np.uint64(32)) | right.ravel()[at].astype(np.uint64)
        slot, flat = self._slot(keys), out.reshape(-1)
        for _ in range(self.probes):
            held = self.keys[slot]
            hit = held == keys
            flat[at[hit]] = self.values[slot[hit]]
            going = ~hit & (self.values[slot] != NONE)
            at, keys, slot = at[going], keys[going], (slot[going] + 1) & ((1 << self.bits) - 1)
            if not len(at):
                break
        return out

    def merge_matrix(self, rows: np.ndarray) -> list[np.ndarray]:
        """Final ids per row of a matrix of ids padded by -1 on the right.

        Ranks of pairs are kept beside the ids; a round merges one pair in each row that still has one, moves the
        row's tail up by a cell, and looks up only the two pairs that are new. Finished rows leave the matrix.
        """
        n, width = rows.shape
        out: list[np.ndarray] = [rows[0][:0]] * n
        ids = np.concatenate([rows, np.full((n, 1), -1, dtype=np.int32)], axis=1)
        rank = np.full(ids.shape, NONE, dtype=np.int32)
        if width > 1:
            rank[:, : width - 1] = self.look_up(ids[:, : width - 1], ids[:, 1:width])
        live = np.arange(n)
        while len(live):
            place = rank.argmin(axis=1)  # the leftmost of equal ranks
            each = np.arange(len(live))
            least = rank[each, place]
            done = least == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[live[k]] = ids[k][ids[k] >= 0]
                keep = ~done
                live, ids, rank, place, least = live[keep], ids[keep], rank[keep], place[keep], least[keep]
                if not len(live):
                    break
                widest = int((ids >= 0).sum(axis=1).max())
                ids, rank = ids[:, : widest + 1], rank[:, : widest + 1]
                each = np.arange(len(live))
            ids[each, place] = least
            column = np.arange(ids.shape[1] - 1)
            tail = column[None, :] > place[:, None]
            ids[:, :-1] = np.where(tail, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(tail, rank[:, 1:], rank[:, :-1])
            ids[:, -1], rank[:, -1] = -1, NONE
            rank[each, place] = self.look_up(ids[each, place], ids[each, np.minimum(place + 1, ids.shape[1] - 1)])
            before = place > 0
            b, p = each[before], place[before]
            rank[b, p - 1] = self.look_up(ids[b, p - 1], ids[b, p])
        return out

    def merge_long(self, token: bytes) -> np.ndarray:
        """The same rule for one long pretoken: a heap of (rank, place) over a linked list, so no quadratic rounds."""
        ids: list[int] = self.first[np.frombuffer(token, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, held = self.ranks, [bytes([b]) for b in token]
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                rank = ranks.get(held[i] + held[j])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, len(held[i]), len(held[j])))

        for i in range(n - 1):
            push(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if held[i] else n
            if j >= n or len(held[i]) != a or len(held[j]) != b:
                continue
            held[i] += held[j]
            held[j], ids[i], after[i] = b"", rank, after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x, h in zip(ids, held) if h], dtype=np.int32)

    def encode(self, pretokens: list[str]) -> list[bytes]:
        """Ids of pretokens as little-endian unsigned 32-bit integers; one that is a token itself is that token."""
        out: list[bytes] = [b""] * len(pretokens)
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for k, pretoken in enumerate(pretokens):
            raw = pretoken.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                out[k] = rank.to_bytes(4, "little")
                continue
            width = next((w for w in BUCKETS if len(raw) <= w), 0)
            if width:
                buckets.setdefault(width, []).append((k, raw))
            elif raw:
                out[k] = self.merge_long(raw).astype("<u4").tobytes()
        for width, rows in buckets.items():
            for start in range(0, len(rows), max(1, CELLS // width)):
                part = rows[start : start + max(1, CELLS // width)]
                padded = np.frombuffer(b"".join(raw.ljust(width, b"\0") for _, raw in part), dtype=np.uint8)
                matrix = self.first[padded].reshape(len(part), width)
                lengths = np.array([len(raw) for _, raw in part])
                matrix[np.arange(width)[None, :] >= lengths[:, None]] = -1
                for (k, _), ids in zip(part, self.merge_matrix(matrix)):
                    out[k] = ids.astype("<u4").tobytes()
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of a text's ids."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_HELD: dict[tuple[str, str], PretokenCache] = {}


def _cache(path: str, pattern: str) -> tuple[Merges, PretokenCache]:
    """One per worker process; it lives on between tasks."""
    if (path, pattern) not in _HELD:
        merges = Merges(read_ranks(path))
        cache = PretokenCache(pattern, merges.encode)
        cache.merges = merges
        _HELD[path, pattern] = cache
    held = _HELD[path, pattern]
    return held.merges, held


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256.

    ``path`` names the rank file on every executor. A null text is encoded as an empty one: no ids, the digests of no
    bytes. Repeated rows each get a row; other columns are left out.
    """
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)])
    schema = schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    body = "body" if key != "body" else "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, cache = _cache(path, pattern)
        for whole in batches:
            for batch in slices(whole, [body]):
                ids = cache.texts(batch.column(body).to_pylist())
                yield pa.RecordBatch.from_pydict({
                    key: batch.column(key),
                    "n_tokens": pa.array([len(i) // 4 for i in ids], type=pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in ids], type=pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(merges.decode(i)).hexdigest() for i in ids], type=pa.string()),
                })

    return docs.select(key, F.col(text).alias(body)).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with their ids as a column of binary (little-endian unsigned 32-bit integers)."""
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cache = _cache(path, pattern)
        for whole in batches:
            for batch in slices(whole, [text]):
                columns = {c: batch.column(c) for c in batch.schema.names}
                made = cache.texts(batch.column(text).to_pylist())
                yield pa.RecordBatch.from_pydict(columns | {ids: pa.array(made, type=pa.binary())})

    return docs.mapInArrow(run, schema)
