"""Exact Jaccard join of word n-gram sets, found with signature trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from brokerlens.llm.common import PART_BYTES, free_name, per_batch, slices, written
from brokerlens.llm.components import components

SIZE, PERCENT = 4, 85
#: Counters of grams by the upper bits of their hashes, and the 64-bit words of a class's stored bitmap. Sets of up to as
#: many grams as it has bits have one; larger ones have a byte to count every 8 to 16 grams.
COUNTERS, WORDS = 1 << 16, 16
#: Members and grams of a shard, and members of a leaf.
BLOCK, BLOCK_GRAMS, LEAF = 2048, 1_000_000, 16
#: Rows of shared grams that are looked at together; a group of more rows than that is kept whole.
MET_ROWS = 1 << 17
#: Class ids are sent to every task up to so many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


# Sets of grams


# A word's hash is the sum of its letters' values times rising powers of an odd step, in 64 bits.
_STEP, _CHUNK = 0x9E3779B97F4A7C15, 1 << 16
_LETTER = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], dtype=np.uint64)
_LETTER[65:91] = _LETTER[97:123]
_GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_UP = np.cumprod(np.r_[np.uint64(1), np.full(_CHUNK, _STEP, dtype=np.uint64)])
_DOWN = np.cumprod(np.r_[np.uint64(1), np.full(_CHUNK, pow(_STEP, -1, 1 << 64), dtype=np.uint64)])


def word_hashes(body: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased; a chunk of many words at a time."""
    letters = np.frombuffer(body, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(_GAP[letters], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    out, at = np.zeros(len(starts), dtype=np.uint64), 0
    while at < len(starts):
        base = starts[at]
        last = int(np.searchsorted(ends, base + _CHUNK, side="right"))
        if last > at:
            values = _LETTER[letters[base : ends[last - 1]]]
            sums = np.zeros(len(values) + 1, dtype=np.uint64)
            np.cumsum(values * _UP[: len(values)], out=sums[1:])
            out[at:last] = (sums[ends[at:last] - base] - sums[starts[at:last] - base]) * _DOWN[starts[at:last] - base]
            at = last
            continue
        whole = 0
        for low in range(int(base), int(ends[at]), _CHUNK):  # one word longer than a chunk
            values = _LETTER[letters[low : min(low + _CHUNK, ends[at])]]
            whole += int((values * _UP[: len(values)]).sum(dtype=np.uint64)) * pow(_STEP, low - int(base), 1 << 64)
        out[at] = whole % (1 << 64)
        at += 1
    return out


def runs(body: bytes, size: int = SIZE) -> np.ndarray:
    """64-bit hashes of the runs of ``size`` words (fewer words: the whole sequence), A-Z lower-cased.

    A run's hash is a polynomial of its words' hashes.
    """
    marks = word_hashes(body)
    width = min(size, len(marks))
    out = np.full(len(marks) - width + 1 if width else 0, width, dtype=np.uint64)
    for at in range(width):
        out *= _LETTER[1] | np.uint64(1)
        out += marks[at : at + len(out)]
    return out


def grams(body: bytes, size: int = SIZE) -> np.ndarray:
    """The distinct hashes of the runs, sorted; empty without words."""
    found = np.sort(runs(body, size))
    return found[np.append(True, found[1:] != found[:-1])] if len(found) else found


def needed(sizes: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """The least overlap at which two sets of these sizes together reach ``percent`` of their union."""
    return -(-percent * sizes // (100 + percent))


def prefix(found: np.ndarray, ranks: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first grams in one order for all sets: linked sets share one of them at least.

    The order is by how common the grams of a counter are, so that grams of many documents come last.
    """
    n = len(found)
    order = np.lexsort((found, ranks[(found >> np.uint64(48)).astype(np.int64)]))
    return found[order[: n - -(-percent * n // 100) + 1]] if n else found


def reach(sizes: np.ndarray, places: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How far sets reach whose first gram in common with another stands at these places of their order.

    Only grams from there on can be common, so two sets can link by that gram only if each one's reach is at least
    ``percent`` times the other's size. Linked sets have a first common gram, where this holds.
    """
    return 100 * sizes - (100 + percent) * places


def bitmap(found: np.ndarray, words: int) -> np.ndarray:
    """64 * ``words`` bits (a power of two), those of the set's hashes on."""
    out = np.zeros(64 * words, dtype=bool)
    out[(found & np.uint64(64 * words - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def scale(n: int) -> int:
    """0 for sets whose signature is a bitmap; then one more for every doubling of the size."""
    return ((n - 1) // (64 * WORDS)).bit_length() if n else 0


def signature(found: np.ndarray, at: int) -> bytes:
    """What a set tells of its grams at a scale: a bitmap, or counts by their hashes (up to 255, which ``extra`` makes up for).

    A bitmap of a set much larger than its bits is all ones and lets every pair pass. Two unrelated sets have different
    counts of most remainders, so the sum of the smaller ones stays below the overlap that a link needs.
    """
    if not at:
        return bitmap(found, WORDS).tobytes()
    count = 4 * WORDS << at
    return np.minimum(np.bincount((found & np.uint64(count - 1)).astype(np.int64), minlength=count), 255).astype(np.uint8).tobytes()


def signatures(found: np.ndarray, percent: int = PERCENT) -> list[tuple[int, bytes]]:
    """(scale, signature) at the scales from that of the set to that of the largest set it may link.

    Two sets that may link have one scale in common, that of the larger.
    """
    n = len(found)
    return [(at, signature(found, at)) for at in range(scale(n), scale(n * 100 // percent) + 1)] if n else []


def stacked(loads: list[bytes], counted: bool = False) -> np.ndarray:
    """Signatures of one scale, a row each."""
    return np.frombuffer(b"".join(loads), dtype=np.uint8 if counted else np.uint64).reshape(len(loads), -1)


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bits two signatures have in common, or the sum of the smaller counts."""
    each = np.minimum(a, b) if a.dtype == np.uint8 else np.bitwise_count(a & b)
    return each.sum(axis=-1, dtype=np.int64)


def merged(rows: np.ndarray) -> np.ndarray:
    """A signature with which none of these has more in common than with another: OR of bits, the largest counts."""
    return np.maximum.reduce(rows, axis=0) if rows.dtype == np.uint8 else np.bitwise_or.reduce(rows, axis=0)


# The signature tree of a shard


@dataclass
class Node:
    """Members order[low:high]: their signatures merged, the range of their sizes, and the most grams that share a bit."""

    low: int
    high: int
    bits: np.ndarray
    least: int
    most: int
    extra: int
    parts: tuple[Node, Node] | None = None


class Shard:
    """Members of a shard: set sizes, signatures, and the class of each, by which known links are passed over."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, label: np.ndarray, home: np.ndarray, percent: int, leaf: int = LEAF, places: np.ndarray | int = 0):
        self.sizes, self.bits, self.home, self.percent, self.leaf = sizes, bits, home, percent, leaf
        self.reach = reach(sizes, places, percent)
        self.extra = sizes - shared(bits, bits)
        self.label = np.unique(label, return_inverse=True)[1]
        self.members: dict[int, list[int]] = {}
        for i, c in enumerate(self.label.tolist()):
            self.members.setdefault(c, []).append(i)
        self.order = np.argsort(sizes, kind="stable")
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, j: int) -> None:
        self.links.append((i, j))
        a, b = int(self.label[i]), int(self.label[j])
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        gone = self.members.pop(b)
        self.label[gone] = a
        self.members[a] += gone

    def grow(self, low: int, high: int) -> Node:
        """Halves by size while sizes are too far apart, then by overlap with one member's signature, down to leaves."""
        rows = self.order[low:high]
        node = Node(low, high, merged(self.bits[rows]), int(self.sizes[rows].min()), int(self.sizes[rows].max()), int(self.extra[rows].max()))
        if high - low > self.leaf:
            if node.least * 100 < self.percent * node.most:
                by = self.sizes[rows]
            else:
                by = -shared(self.bits[rows], self.bits[rows[len(rows) // 2]])
            self.order[low:high] = rows[np.argsort(by, kind="stable")]
            middle = (low + high) // 2
            node.parts = self.grow(low, middle), self.grow(middle, high)
        return node

    def apart(self, a: Node, b: Node) -> bool:
        """No member of one can link a member of the other, or all are linked already."""
        if a.most * 100 < self.percent * b.least or b.most * 100 < self.percent * a.least:
            return True
        overlap = int(shared(a.bits, b.bits)) + min(a.extra, b.extra)
        if min(overlap, a.most, b.most) < needed(a.least + b.least, self.percent):
            return True
        return self.single(a, b)

    def single(self, a: Node, b: Node) -> bool:
        first = self.label[self.order[a.low]]
        return bool((self.label[self.order[a.low : a.high]] == first).all() and (self.label[self.order[b.low : b.high]] == first).all())

    def search(self, linked: Callable[[int, int], bool]) -> list[tuple[int, int]]:
        """A forest of links that connects what all links connect: both sides of the tree are walked together."""
        stack = [(root := self.grow(0, len(self.sizes)), root)]
        while stack:
            a, b = stack.pop()
            if a is b:
                if self.single(a, a):
                    continue
                if a.parts:
                    left, right = a.parts
                    stack += [(left, right), (left, left), (right, right)]
                    continue
            elif self.apart(a, b):
                continue
            elif a.parts or b.parts:
                if not b.parts or a.parts and a.high - a.low >= b.high - b.low:
                    stack += [(part, b) for part in a.parts]
                else:
                    stack += [(a, part) for part in b.parts]
                continue
            self.meet(self.order[a.low : a.high], self.order[b.low : b.high], a is b, linked)
        return self.links

    def meet(self, rows: np.ndarray, others: np.ndarray, own: bool, linked: Callable[[int, int], bool]) -> None:
        """Pairs of two leaves, or of one, whose signatures leave room for the overlap they need."""
        total = self.sizes[rows][:, None] + self.sizes[others][None, :]
        overlap = shared(self.bits[rows][:, None, :], self.bits[others][None, :, :])
        overlap += np.minimum(self.extra[rows][:, None], self.extra[others][None, :])
        smaller = np.minimum(self.sizes[rows][:, None], self.sizes[others][None, :])
        near = np.minimum(overlap, smaller) >= needed(total, self.percent)
        near &= self.reach[rows][:, None] >= self.percent * self.sizes[others][None, :]
        near &= self.reach[others][None, :] >= self.percent * self.sizes[rows][:, None]
        near &= self.home[rows][:, None] | self.home[others][None, :]
        near &= self.label[rows][:, None] != self.label[others][None, :]
        if own:
            near = np.triu(near, 1)
        for i, j in zip(*np.nonzero(near)):
            i, j = int(rows[i]), int(others[j])
            if self.label[i] != self.label[j] and linked(i, j):
                self.join(i, j)


def possible(group: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links that sizes and stored signatures allow; groups without a scale hold bitmaps."""
    counted = "scale" in group.column_names and group.column("scale")[0].as_py() > 0
    return _shard(group, stacked(group.column("load").to_pylist(), counted), percent).search(lambda i, j: True)


def possible_in_leaves(rows: pa.RecordBatch, group: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for many groups of a leaf's size at once: pairs of rows at equal distances, all groups together."""
    n, comp, home, place, scales = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("n", "comp", "home", "place", "scale"))
    far = reach(n, place.astype(np.int64), percent)
    left, right = [], []
    for gap in range(1, LEAF):
        a = np.flatnonzero(group[:-gap] == group[gap:])
        if not len(a):
            break
        b = a + gap
        near = (far[a] >= percent * n[b]) & (far[b] >= percent * n[a]) & (comp[a] != comp[b]) & (home[a] | home[b])
        left.append(a[near])
        right.append(b[near])
    a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right))
    near = np.zeros(len(a), dtype=bool)
    for at in np.unique(scales[a]).tolist():
        pairs = np.flatnonzero(scales[a] == at)
        some, flat = np.unique(np.concatenate([a[pairs], b[pairs]]), return_inverse=True)
        marks, x, y = stacked(rows.column("load").take(pa.array(some)).to_pylist(), at > 0), flat[: len(pairs)], flat[len(pairs) :]
        extra = n[some] - shared(marks, marks)
        near[pairs] = shared(marks[x], marks[y]) + np.minimum(extra[x], extra[y]) >= needed(n[a[pairs]] + n[b[pairs]], percent)
    return a[near], b[near]


def certain(group: pa.Table, percent: int, size: int) -> list[tuple[int, int]]:
    """Links of the whole sets, counted gram by gram after the tree of this shard's own bitmaps."""
    unpack = zstandard.ZstdDecompressor().decompress
    sets = [grams(unpack(load), size) for load in group.column("load").to_pylist()]
    words = 4
    while words < 256 and 16 * words < max(map(len, sets)):
        words *= 2
    shard = _shard(group, np.stack([bitmap(s, words) for s in sets]), percent)

    def linked(i: int, j: int) -> bool:
        short, long = (sets[i], sets[j]) if len(sets[i]) < len(sets[j]) else (sets[j], sets[i])
        at = np.searchsorted(long, short)
        both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
        return both >= needed(len(short) + len(long), percent)

    return shard.search(linked)


def _shard(group: pa.Table, bits: np.ndarray, percent: int) -> Shard:
    column = lambda name: group.column(name).to_numpy()
    return Shard(column("n").astype(np.int64), bits, column("comp"), column("home"), percent, places=column("place").astype(np.int64))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (least, node) that connect what the links (a, b) connect, each node to the least it reaches."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[rest]], nodes[rest]


def met(sizes: np.ndarray, places: np.ndarray, group: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether a member of a group (numbered from 0 upwards) has another one in it that both reaches allow."""
    order = np.lexsort((sizes, group))
    n, grp = sizes[order], group[order]
    far = reach(n, places[order], percent)
    # By size: those small enough for a member's reach come first in its group, and the best reach of these decides.
    span = int(max(n.max(), far.max() // percent)) + 2
    ends = np.searchsorted(grp * span + n, grp * span + np.maximum(far // percent, -1), side="right") - 1
    step = int(far.max() - far.min()) + 1
    lift = grp * step + (far - far.min())
    best = np.maximum.accumulate(lift)
    second = np.maximum.accumulate(np.minimum(np.concatenate([[-1], best[:-1]]), lift))
    # A member counts for others only; the best of the group before lies below all of this one.
    own = (ends >= np.arange(len(n))) & (best[ends] == lift)
    other = np.where(own, second[ends], best[ends]) - grp * step
    out = np.zeros(len(n), dtype=bool)
    out[order] = (ends >= 0) & (other >= 0) & (other + far.min() >= percent * n)
    return out


# Shards in Spark


def by_group(find: Callable[[pa.Table], list[tuple[int, int]]], in_leaves=None):
    """A ``mapInArrow`` function over partitions sorted by (grp, block): links (a, b) that connect what each group's links do.

    Groups that fit a leaf and end within their batch are handed to ``in_leaves`` together, if given.
    """

    def made(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        least, node = stars(ids[a], ids[b])
        return pa.RecordBatch.from_pydict({"a": pa.array(least, pa.int64()), "b": pa.array(node, pa.int64())})

    def links(group: pa.Table) -> Iterator[pa.RecordBatch]:
        if group.num_rows > 1:
            found = np.array(find(group), dtype=np.int64).reshape(-1, 2)
            yield made(group.column("id").to_numpy(), found[:, 0], found[:, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        mark = None
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, block = batch.column("grp").to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
            edges = np.flatnonzero((grp[1:] != grp[:-1]) | (block[1:] != block[:-1])) + 1
            lows, highs = np.concatenate([[0], edges]), np.concatenate([edges, [len(grp)]])
            sizes = highs - lows
            whole = np.zeros(len(lows), dtype=bool)
            if in_leaves is not None:
                whole[1:-1] = sizes[1:-1] <= LEAF
                number = np.repeat(np.arange(len(lows)), sizes)
                rows = np.flatnonzero((whole & (sizes > 1))[number])
                if len(rows):
                    part = batch.take(pa.array(rows))
                    yield made(part.column("id").to_numpy(), *in_leaves(part, number[rows]))
            for low, high in zip(lows[~whole].tolist(), highs[~whole].tolist()):
                if held and mark != (grp[low], block[low]):
                    yield from links(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(low, high - low))
                mark = grp[low], block[low]
        if held:
            yield from links(pa.Table.from_batches(held))

    return run


def by_reach(percent: int, most: int = MET_ROWS):
    """A ``mapInArrow`` function over partitions sorted by grp: the rows (grp, id, n, place) that ``met`` keeps.

    Groups of more than ``most`` rows pass whole, so a task holds about that many rows.
    """

    def kept(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        grp, n, place = (rows.column(c).to_numpy() for c in ("grp", "n", "place"))
        number = np.cumsum(np.append(0, grp[1:] != grp[:-1]))
        some = np.flatnonzero((np.bincount(number) > 1)[number])
        if len(some):
            some = some[met(n[some].astype(np.int64), place[some].astype(np.int64), number[some], percent)]
            yield from rows.take(pa.array(some)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, passing = 0, None
        for batch in batches:
            grp = batch.column("grp").to_numpy()
            if passing is not None:
                end = int(np.searchsorted(grp, passing, side="right"))
                if end:
                    yield batch.slice(0, end)
                if end == len(grp):
                    continue
                batch, grp, passing = batch.slice(end), grp[end:], None
            if not len(grp):
                continue
            held.append(batch)
            count += len(grp)
            if count < most:
                continue
            rows = pa.Table.from_batches(held)
            start = int(np.searchsorted(rows.column("grp").to_numpy(), grp[-1]))
            if start:
                yield from kept(rows.slice(0, start))
                held = rows.slice(start).to_batches()
                count -= start
            if count >= most:
                yield from held
                held, count, passing = [], 0, grp[-1]
        if held:
            yield from kept(pa.Table.from_batches(held))

    return run


def _searched(rows: DataFrame, loads: DataFrame, find: tuple) -> DataFrame:
    """(a, b) of the rows (grp, block, id, n, place, comp, home), each with its load."""
    # Loads may have a scale or width beside the id.
    kind = [c for c in loads.columns if c not in ("id", "load")]
    wide = rows.join(loads, ["id", *kind]).select("grp", "block", "id", "n", "place", "comp", "home", *kind, "load")
    dealt = wide.repartition("grp", "block").sortWithinPartitions("grp", "block")
    return written(dealt.mapInArrow(by_group(*find), "a long, b long"), "links")


def _in_block(rows: DataFrame, salt: int) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(salt)), F.col("blocks")))


def forest(members: DataFrame, loads: DataFrame, find: tuple, block: int = BLOCK, grams_: int | None = None) -> DataFrame:
    """Links (a, b) among members (grp, id, n, place, comp) of equal ``grp`` that connect, with comp, what all links connect.

    ``place`` is where the group's gram stands in the order of a member's set (0: the group has no such gram).

    A group of up to ``block`` members (and ``grams_`` grams) is one shard. A larger one is dealt to blocks by a hash
    of the ids, and again by another hash; then only members outside its largest class so far can lack a link, and
    these visit every block. So no task holds a large group and no pair of different classes goes unseen.
    """
    count = F.ceil(F.count("*") / block) if grams_ is None else F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / grams_))
    sizes = members.groupBy("grp").agg(F.count("*").alias("m"), count.cast("long").alias("blocks")).where("m > 1")
    rows = written(members.join(sizes.drop("m"), "grp").withColumn("home", F.lit(True)), "members")
    links = _searched(_in_block(rows, 1), loads, find)
    large = rows.where("blocks > 1")
    if large.isEmpty():
        return links
    links = links.unionAll(_searched(_in_block(large, 2), loads, find))
    large = classed(large, links).drop("old")
    within = large.groupBy("grp", "comp").agg(F.count("*").alias("m"))
    main = within.groupBy("grp").agg(F.max(F.struct("m", "comp"))["comp"].alias("main"), F.count("*").alias("classes"))
    torn = written(large.join(main.where("classes > 1").drop("classes"), "grp"), "torn")
    homes = _in_block(torn, 1)
    guests = homes.where("comp <> main").withColumn("own", F.col("block"))
    guests = guests.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("block <> own")
    visits = homes.drop("main").unionByName(guests.drop("main", "own").withColumn("home", F.lit(False)))
    return links.unionAll(_searched(visits, loads, find))


def classed(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with comp replaced by the class that the links and the old comp (kept as ``old``) make of it."""
    # A class so far is one node: links join classes, not only members.
    known = rows.where("id <> comp").select("id", "comp").distinct()
    found = written(components(links.select("a", "b").unionAll(known.select(F.col("id").alias("a"), F.col("comp").alias("b")))), "found")
    small = found.count() * 16 <= BROADCAST_BYTES
    found = found.withColumnsRenamed({"node": "id", "component": "comp"})
    old = rows.withColumnRenamed("comp", "old")
    return old.join(F.broadcast(found) if small else found, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _chosen(rows: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """The rows whose ``row`` is an id; ids go to every task only if they are small."""
    return rows.join(F.broadcast(ids) if count * 16 <= BROADCAST_BYTES else ids, rows["row"] == ids["id"], "left_semi")


def representatives(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows whose ``row`` is the id of their class (high, low, id, m), without those of no set.

    Only classes of more than one row are looked up, and go to every task if they are small.
    """
    copied = classes.where("m > 1").select("high", "low", "id")
    small = copied.count() * 32 <= BROADCAST_BYTES
    marked = rows.where("n > 0").join(F.broadcast(copied) if small else copied, ["high", "low"], "left")
    return marked.where("id is null or id = row").drop("id")


def gram_ranks(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """The places of the counters when ordered by how many grams of all documents they count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, ["text"]):
                found = np.concatenate([runs((t or "").encode(), size) for t in part.column("text").to_pylist()])
                total += np.bincount((found >> np.uint64(48)).astype(np.int64), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, "at long, n long")
    sums = np.zeros(COUNTERS, dtype=np.int64)
    for row in parts.groupBy("at").agg(F.sum("n").alias("n")).collect():
        sums[row["at"]] = row["n"]
    return np.argsort(np.argsort(sums, kind="stable")).astype(np.uint16)


def with_sets(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """(row, key, load, n, high, low, first, bits): a number per row, the text compressed, the set's size, 128 bits of it, its prefix and signatures."""
    ranks = gram_ranks(docs, text, size)
    schema = StructType([StructField("row", docs.sparkSession.range(0).schema["id"].dataType), StructField("key", docs.schema[key].dataType)])
    for name, kind in (("load", "binary"), ("n", "long"), ("high", "long"), ("low", "long"), ("first", "array<long>"), ("bits", "array<struct<scale: int, load: binary>>")):
        schema.add(name, StructType.fromDDL(f"x {kind}")["x"].dataType)

    def describe(rows: list, keys: list, texts: list) -> dict:
        bodies = [(t or "").encode() for t in texts]
        sets, pack = [grams(body, size) for body in bodies], zstandard.ZstdCompressor().compress
        digests = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=">i8") for s in sets]
        return {
            "row": rows, "key": keys, "load": list(map(pack, bodies)), "n": [len(s) for s in sets],
            "high": [int(d[0]) for d in digests], "low": [int(d[1]) for d in digests],
            "first": [prefix(s, ranks, percent).view(np.int64) for s in sets],
            "bits": [signatures(s, percent) for s in sets],
        }

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    return written(rows.mapInArrow(per_batch(describe, ["row", "key", "text"], schema), schema), "sets")


def class_links(rows: DataFrame, classes: DataFrame, size: int = SIZE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(a, b): links between classes of equal sets, of ``rows`` from ``with_sets``, connecting all that are linked."""
    own = representatives(rows, classes)
    # A gram's upper 40 bits name its group: they take less room, and sets that meet for nothing are not linked.
    entries = own.select(F.col("row").alias("id"), "n", F.posexplode("first").alias("place", "gram"))
    entries = entries.select(F.shiftright("gram", 24).alias("grp"), "id", F.col("n").cast("int"), "place")
    dealt = entries.repartition("grp").sortWithinPartitions("grp")
    entries = written(dealt.mapInArrow(by_reach(percent), "grp long, id long, n int, place int"), "shared")
    entries = entries.withColumn("n", F.col("n").cast("long"))
    bits = own.select(F.col("row").alias("id"), F.inline("bits"))
    allowed = (lambda group: possible(group, percent)), (lambda rows, group: possible_in_leaves(rows, group, percent))
    # Sets that agree in their first gram, mostly copies, make classes; other grams matter where classes meet.
    first = entries.where("place = 0").select("grp", "id", "n", "place", F.col("id").alias("comp"))
    links = forest(_at_scales(first, percent), bits, allowed, block)
    entries = written(classed(entries.select("grp", "id", "n", "place", F.col("id").alias("comp")), links).drop("old"), "shared")
    meeting = entries.groupBy("grp").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    links = links.unionAll(forest(_at_scales(entries.join(meeting.select("grp"), "grp"), percent), bits, allowed, block))
    near = written(_clusters(links), "near")
    chosen = _chosen(rows, near.select("id"), near.count())
    texts = written(chosen.select(F.col("row").alias("id"), "n", "load"), "texts")
    # Long sets fill the stored bitmaps: what they connect is looked at again with bitmaps as wide as sets need.
    wide = written(texts.mapInArrow(_wide(size, percent), "id long, n long, width long, load binary"), "wide")
    members = near.join(wide.drop("load"), "id").select(F.concat_ws(":", "grp", "width").alias("grp"), "id", "n", F.lit(0).alias("place"), F.col("id").alias("comp"), "width")
    near = _clusters(forest(members, wide.drop("n"), allowed[:1], block, 16 * BLOCK_GRAMS))
    members = near.join(texts.select("id", "n"), "id").select("grp", "id", "n", F.lit(0).alias("place"), F.col("id").alias("comp"))
    return forest(members, texts.drop("n"), (lambda group: certain(group, percent, size),), block, BLOCK_GRAMS)


def _at_scales(members: DataFrame, percent: int) -> DataFrame:
    """The members once for each scale of theirs, which makes groups of its own."""
    size = lambda n: F.length(F.bin(F.floor((n - 1) / (64 * WORDS)))) * (n > 64 * WORDS).cast("int")
    scales = F.sequence(size(F.col("n")), size(F.floor(F.col("n") * 100 / percent)))
    return members.withColumn("scale", F.explode(scales)).withColumn("grp", F.col("grp") * 64 + F.col("scale"))


def _clusters(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("component").alias("grp"), F.col("node").alias("id"))


def _wide(size: int, percent: int):
    """(id, n, width, bitmap) of packed texts, with bits for twice the set's size, and for up to the largest set it may link.

    Two sets that may link have one width in common, that of the larger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in slices(batch, ["load"], PART_BYTES // 8):
                made = []
                for i, n, load in zip(*(part.column(c).to_pylist() for c in ("id", "n", "load"))):
                    found = grams(unpack(load), size)
                    least, most = ((2 * m // 64).bit_length() for m in (n, n * 100 // percent))
                    made += [(i, n, 1 << w, bitmap(found, 1 << w).tobytes()) for w in range(least, most + 1)]
                columns = [pa.array(c, k) for c, k in zip(zip(*made), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "width", "load"])

    return run


def linked(
    docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, percent: int = PERCENT, block: int = BLOCK
) -> DataFrame:
    """(key, n_shingles, component_id) for every row.

    A row's set is that of its distinct runs of ``size`` words (fewer words: the whole sequence), as 64-bit hashes.
    Two rows link when their overlap is at least ``percent`` of their union; component_id is the smallest key
    reachable by links. Equal sets are one class, so copies cost nothing after counting. Linked sets share a gram of
    their prefixes; groups of equal grams are searched by signature trees over stored bitmaps for what may link, and
    the classes connected so are searched again with wider bitmaps and then over whole sets, counting each link exactly.

    Null and empty texts, or blanks alone, have no set, size 0 and no links, not even to each other: their component_id
    is their own key. Very long texts are sets like any other. Repeated rows each get a row; null keys are passed over
    when the smallest is chosen, so a component of null keys only has component_id null. An empty table gives an empty
    table. Other columns of ``docs`` are not looked at.
    """
    names = [key, free_name([key], "n_shingles"), free_name([key], "component_id")]
    rows = with_sets(docs, key, text, size, percent)
    classes = rows.where("n > 0").groupBy("high", "low").agg(F.min("row").alias("id"), F.min("key").alias("least"), F.count("*").alias("m"))
    classes = written(classes, "classes")
    links = class_links(rows, classes, size, percent, block)
    found = written(components(links), "found")
    rooted = classes.join(found, classes["id"] == found["node"], "left").withColumn("root", F.coalesce("component", "id"))
    least = rooted.groupBy("root").agg(F.min("least").alias("reached"))
    named = rooted.join(least, "root").select("high", "low", "reached")
    some = rows.where("n > 0").join(named, ["high", "low"]).select("key", "n", "reached")
    none = rows.where("n = 0").select("key", "n", F.col("key").alias("reached"))
    return some.unionAll(none).toDF(*names)
