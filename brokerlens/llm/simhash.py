"""SimHash near-duplicates by vantage-point trees over fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brokerlens.llm.common import free_name, slices, written
from brokerlens.llm.components import components

SHINGLE, BITS = 3, 3
_BIT = np.uint64(1)


# Fingerprints


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of every run of ``size`` words, A-Z lower-cased, joined by spaces."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    whole, starts, at = b" ".join(words), [], 0
    for word in words:
        starts.append(at)
        at += len(word) + 1
    starts.append(at)
    digest = xxhash.xxh64_intdigest
    return [digest(whole[a : b - 1], 42) for a, b in zip(starts, starts[size:])]


_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """A bit is 1 if over half of the hashes have it; 0 without words."""
    hashes = np.array(shingle_hashes(text, size), dtype="<u8")
    if not len(hashes):
        return 0
    bytes_ = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 200:
        sums = np.unpackbits(bytes_, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        sums = np.concatenate([np.bincount(bytes_[:, k], minlength=256) @ _BITS_OF_BYTE for k in range(8)])
    return int(np.packbits(2 * sums > len(hashes), bitorder="little").view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprint(docs: DataFrame, text: str, name: str, size: int, columns: list[str]) -> DataFrame:
    """The named columns and the fingerprint as a signed long."""
    schema = T.StructType([f for f in docs.schema.fields if f.name in columns]).add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, [text]):
                made = [signed(fingerprint(t, size)) for t in batch.column(text).to_pylist()]
                kept = {c: batch.column(c) for c in batch.schema.names if c in columns}
                yield pa.RecordBatch.from_pydict(kept | {name: pa.array(made, type=pa.int64())})

    return docs.select(*dict.fromkeys([*columns, text])).mapInArrow(run, schema)


# The tree that deals fingerprints to shards


@dataclass(frozen=True)
class Node:
    """Inner points have masked distance ``mu`` or less to the vantage point; both children within ``radius`` get a query."""

    vantage: int
    mask: int
    radius: int
    mu: int
    inner: "Node | int"
    outer: "Node | int"


LOW, HIGH = (1 << 32) - 1, ((1 << 32) - 1) << 32


def _distance(points: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((points ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int64)


def _split(points: np.ndarray, masks, rng: np.random.Generator, tries: int = 6):
    """(cost, vantage, mask, radius, mu) of the best split found, or None if no distance splits the points.

    Cost: the rows that both sides would get together, weighed by how even the sides are.
    """
    best = None
    n = len(points)
    for mask, radius in masks:
        for vantage in points[rng.integers(0, n, tries)]:
            far = np.bincount(_distance(points, int(vantage), mask), minlength=65)
            below = np.cumsum(far)
            for mu in {int(np.searchsorted(below, n // 2)), max(0, int(np.searchsorted(below, n // 2)) - 1)}:
                inside = int(below[mu])
                if inside == 0 or inside == n:
                    continue
                visits_in = int(below[min(64, mu + radius)])
                visits_out = n - (int(below[mu - radius]) if mu - radius >= 0 else 0)
                cost = max(visits_in, visits_out) / n + 0.25 * (visits_in + visits_out) / n
                if best is None or cost < best[0]:
                    best = (cost, int(vantage), mask, radius, mu)
    return best


def grow(sample: np.ndarray, mask: int, radius: int, shards: int, bits: int, seed: int = 1) -> tuple[Node | int, int]:
    """A tree with about ``shards`` leaves, numbered from 0, over a sample of fingerprints.

    Pairs sought differ by ``radius`` bits at most under ``mask`` and by ``bits`` at most elsewhere, so a node may
    measure by either part.
    """
    rng = np.random.default_rng(seed)
    rest = ~mask & ((1 << 64) - 1)
    count = 0

    def build(points: np.ndarray, wanted: int):
        nonlocal count
        found = _split(points, [(mask, radius)], rng) if wanted > 1 and len(points) >= 4 else None
        if wanted > 1 and len(points) >= 4 and (found is None or found[0] > 1.35):
            other = _split(points, [(rest, bits)], rng)
            found = other if found is None or (other and other[0] < found[0]) else found
        if found is None:
            count += 1
            return count - 1
        _, vantage, by, r, mu = found
        inside = _distance(points, vantage, by) <= mu
        share = round(wanted * float(inside.mean()))
        share = min(max(share, 1), wanted - 1)
        return Node(vantage, by, r, mu, build(points[inside], share), build(points[~inside], wanted - share))

    return build(sample, shards), count


def route(tree: Node | int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the point, shard, whether it is the point's home) for the home and every shard its ball overlaps."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    stack = [(tree, np.arange(len(points)), np.ones(len(points), dtype=bool))]
    while stack:
        node, at, home = stack.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            out.append((at, node, home))
            continue
        d = _distance(points[at], node.vantage, node.mask)
        inside = d <= node.mu
        inner, outer = d - node.radius <= node.mu, d + node.radius > node.mu
        stack.append((node.inner, at[inner], home[inner] & inside[inner]))
        stack.append((node.outer, at[outer], home[outer] & ~inside[outer]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return (
        np.concatenate([a for a, _, _ in out]),
        np.concatenate([np.full(len(a), s) for a, s, _ in out]),
        np.concatenate([h for _, _, h in out]),
    )


# Pairs within a shard


class Forest:
    """Union-find over the points of one shard; keeps the links that joined two sets."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def flatten(self) -> None:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return
            self.parent = up


LEAF = 48


def shard_links(points: np.ndarray, home: np.ndarray, bits: int = BITS, seed: int = 1) -> list[tuple[int, int]]:
    """Links that connect what the pairs within ``bits`` bits connect that have a point at home here.

    A vantage-point tree holds the points at home. Each subtree is asked with its own points and with visitors and
    points of other subtrees whose ball crosses its bound. A
    node whose points and queries are all one set already is left; a ball of points that all lie within ``bits``
    bits of each other is linked to one of them. So a dense group costs a forest, not all its pairs.
    """
    n = len(points)
    forest, rng = Forest(n), np.random.default_rng(seed)
    stack = [(np.flatnonzero(home), np.flatnonzero(~home))]
    everything = (1 << 64) - 1
    while stack:
        own, guests = stack.pop()
        if not len(own) or len(own) + len(guests) < 2:
            continue
        if len(own) + len(guests) > 8:
            forest.flatten()
            sets = forest.parent[np.concatenate([own, guests])]
            if (sets == sets[0]).all():
                continue
        if len(own) <= LEAF:
            block = max(1, 4_000_000 // len(own))
            rows = np.concatenate([own, guests])
            for start in range(0, len(rows), block):
                part = rows[start : start + block]
                near = np.bitwise_count(points[part][:, None] ^ points[own][None, :]) <= bits
                a, b = np.nonzero(near)
                for i, j in zip(part[a], own[b]):
                    if i != j:
                        forest.join(int(i), int(j))
            continue
        centre = int(own[rng.integers(0, len(own))])
        d = np.bitwise_count(points[own] ^ points[centre]).astype(np.int64)
        for i in own[d <= bits]:
            forest.join(centre, int(i))
        if d.max() * 2 <= bits:
            # All own points are linked to the centre now, so any of them within reach links a guest.
            g = np.bitwise_count(points[guests] ^ points[centre])
            guests = guests[g <= bits + d.max()]
            for start in range(0, len(guests), max(1, 4_000_000 // len(own))):
                part = guests[start : start + max(1, 4_000_000 // len(own))]
                near = np.bitwise_count(points[part][:, None] ^ points[own][None, :]) <= bits
                hit = near.any(axis=1)
                for i, j in zip(part[hit], own[near[hit].argmax(axis=1)]):
                    forest.join(int(i), int(j))
            continue
        found = _split(points[own], [(everything, bits)], rng)
        if found is None:
            vantage, mu = int(points[centre]), 0
        else:
            _, vantage, _, _, mu = found
        own_d, guest_d = _distance(points[own], vantage, everything), _distance(points[guests], vantage, everything)
        inner, outer = own[own_d <= mu], own[own_d > mu]
        # Inner points whose ball reaches out ask the outer side; that covers every pair across the bound.
        cross = own[(own_d <= mu) & (own_d + bits > mu)]
        stack.append((inner, guests[guest_d - bits <= mu]))
        stack.append((outer, np.concatenate([guests[guest_d + bits > mu], cross])))
    return forest.links


def _links_of_shard(pdf: pd.DataFrame, bits: int) -> pd.DataFrame:
    points = pdf["fp"].to_numpy().view(np.uint64)
    links = shard_links(points, pdf["home"].to_numpy(dtype=bool), bits)
    a = np.array([i for i, _ in links], dtype=np.int64)
    b = np.array([j for _, j in links], dtype=np.int64)
    values = pdf["fp"].to_numpy()
    return pd.DataFrame({"a": values[a], "b": values[b]})


def near_links(prints: DataFrame, bits: int = BITS, shard_rows: int = 512, sample_rows: int = 200_000) -> DataFrame:
    """(a, b): links between the distinct fingerprints of ``fp`` that connect what pairs within ``bits`` bits connect.

    Two fingerprints within ``bits`` (3 at most, else 2 * r + 1) bits agree but for ``bits // 2`` bits in their lower
    or their upper half. So there is one tree for each half, that measures by this half and its small radius: a
    fingerprint is in few shards besides its home, where whole fingerprints would meet a bound at every second node.
    A shard has about ``shard_rows`` of its own, or more where that would take over ``sample_rows`` / 16 shards. The trees
    are grown on a random sample of an eighth of the fingerprints and at most ``sample_rows``, and are sent to every
    task; the sample decides only how even shards are, not what is found.
    """
    total = prints.count()
    shards = max(1, min(total // shard_rows, sample_rows // 16))
    share = min(0.125, sample_rows / max(total, 1))
    keep = F.pmod(F.xxhash64("fp", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000)
    sample = prints.where(keep).select("fp").limit(2 * sample_rows).toPandas()["fp"].to_numpy(dtype=np.int64)
    points = np.sort(sample).view(np.uint64)
    radius = bits // 2
    trees, shift = [], 0
    for mask in (LOW, HIGH):
        tree, count = grow(points, mask, radius, shards, bits)
        trees.append((tree, shift))
        shift += count
    shared = prints.sparkSession.sparkContext.broadcast(trees)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 20_000):
                fp = whole.column("fp").slice(start, 20_000).to_numpy(zero_copy_only=False)
                for tree, first in shared.value:
                    at, shard, home = route(tree, fp.view(np.uint64))
                    yield pa.RecordBatch.from_pydict(
                        {"shard": pa.array(shard + first, pa.int64()), "fp": pa.array(fp[at]), "home": pa.array(home)}
                    )

    dealt = prints.select("fp").mapInArrow(deal, "shard long, fp long, home boolean")
    found = dealt.groupBy("shard").applyInPandas(lambda pdf: _links_of_shard(pdf, bits), "a long, b long")
    return found.where("a <> b")


def classes(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, component_id) for fingerprints ``fp`` with the smallest ``id`` of their documents."""
    links = written(near_links(prints, bits), "edges")
    found = components(links)
    member = prints.join(found, prints["fp"] == found["node"], "left").select(
        "fp", "id", F.coalesce("component", "fp").alias("component")
    )
    least = member.groupBy("component").agg(F.min("id").alias("component_id"))
    return member.join(least, "component").select("fp", "component_id")


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, bits: int = BITS
) -> DataFrame:
    """(key, fingerprint, component_id) for every row.

    Texts link at ``bits`` or fewer differing bits of their SimHash fingerprints; component_id is the smallest key
    reachable. A null or empty text, or one of blanks, has fingerprint zero and links like any other. Rows with equal
    fingerprints are one point of the search, so copies cost nothing there. Null keys are passed over when the
    smallest is chosen; a component of null keys only has component_id null. An empty table gives an empty table.
    """
    return _with_component(docs, text, key, size, bits, [key]).select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _with_component(docs: DataFrame, text: str, key: str, size: int, bits: int, columns: list[str]) -> DataFrame:
    rows = docs.select(*(F.col(c) for c in columns), F.col(text).alias(free_name(columns, "body")))
    rows = written(with_fingerprint(rows, rows.columns[-1], "fp", size, columns), "prints")
    prints = written(rows.groupBy("fp").agg(F.min(key).alias("id")), "distinct")
    found = written(classes(prints, bits), "classes")
    return rows.join(found, "fp")


def representatives(
    docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, bits: int = BITS
) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest key, repeated rows of it once.

    In a component without keys one row stays. Columns stay as they are.
    """
    taken = [*docs.columns]
    fp = free_name(taken, "fp")
    rows = docs.withColumn(free_name([*taken, fp], "row"), F.monotonically_increasing_id())
    row = rows.columns[-1]
    rows = written(rows, "rows")
    light = rows.select(F.col(row).alias("r"), F.col(key).alias("k"), F.col(text).alias("t"))
    light = written(with_fingerprint(light, "t", "fp", size, ["r", "k"]), "prints")
    prints = written(light.groupBy("fp").agg(F.min("k").alias("id")), "distinct")
    found = written(near_links(prints, bits), "edges")
    member = components(found)
    rooted = light.join(member, light["fp"] == member["node"], "left").select(
        "r", "k", F.coalesce("component", "fp").alias("c")
    )
    # Nulls last: the smallest pair of (key is null, key, row).
    first = rooted.groupBy("c").agg(F.min(F.struct(F.col("k").isNull().alias("n"), "k", "r"))["r"].alias("r"))
    return rows.join(first.select(F.col("r").alias(row)), row, "left_semi").select(*docs.columns)
