"""Best-fit packing of documents into sequences, where documents of a source or a duplicate cluster keep apart."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from brokerlens.llm import planes
from brokerlens.llm.common import text_key

CAPACITY = 2048
SHARD_ROWS = 2048


def pack(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """(bin, place in the bin, start) per item (size, source, cluster), placed in the order given.

    Bins are ordered by their residual and carry a bitmap of sources and one of clusters. The search begins at the
    first bin that the size fits and goes on to its successors until one has neither the item's source nor its
    cluster: the tightest compatible bin; among equal residuals the oldest. Without one a bin is opened. Clusters of
    one item cannot conflict and have no bit.
    """
    sources = {s: 1 << k for k, s in enumerate(dict.fromkeys(s for _, s, _ in items))}
    often = Counter(c for _, _, c in items)
    clusters = {c: 1 << k for k, c in enumerate(c for c, n in often.items() if n > 1)}
    order: list[tuple[int, int]] = []
    held: list[list[int]] = []  # per bin: sources, clusters, items, filled
    out = []
    for size, source, cluster in items:
        s, c = sources[source], clusters.get(cluster, 0)
        at = bisect_left(order, (size, -1))
        while at < len(order):
            found = held[order[at][1]]
            if not (found[0] & s or found[1] & c):
                break
            at += 1
        if at < len(order):
            number = order.pop(at)[1]
        else:
            number = len(held)
            held.append([0, 0, 0, 0])
        own = held[number]
        out.append((number, own[2], own[3]))
        own[0] |= s
        own[1] |= c
        own[2] += 1
        own[3] += size
        insort(order, (capacity - own[3], number))
    return out


def pieces(
    docs: DataFrame, capacity: int, text: str, key: str, source: str, tokenizer: tuple[str, str] | None = None
) -> DataFrame:
    """(key, piece, copy, size, source, cluster): what is to be placed.

    A document needs the tokens that ``tokenizer`` makes of its text and one for its end; a longer one than a bin is
    cut into pieces of a full bin and a rest, so piece k begins at its token k * capacity. Equal rows are counted
    first and numbered as copies, so many of them neither gather in a shuffle nor in a shard.
    """
    rows = docs.select(
        F.col(key).alias("key"), F.xxhash64(F.col(source)).alias("source"), text_key(F.col(text)).alias("cluster"),
        F.col(text).alias("body"),
    )
    if tokenizer is None:
        size = F.ceil(F.coalesce(F.octet_length("body"), F.lit(0)) / 4).cast("long") + 1
        rows = rows.withColumn("total", size).drop("body")
    else:
        rows = planes.counted(rows, *tokenizer, "body", "total")
    rows = rows.groupBy("key", "source", "cluster", "total").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    parts = F.ceil(F.col("total") / capacity).cast("long")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    left = F.col("total") - F.col("piece") * capacity
    return rows.select("key", "piece", "copy", F.least(left, F.lit(capacity)).alias("size"), "source", "cluster")


def best_fit(
    docs: DataFrame,
    capacity: int = CAPACITY,
    shard_rows: int = SHARD_ROWS,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    tokenizer: tuple[str, str] | None = None,
) -> DataFrame:
    """(key, piece, n_tokens, bin, slot, start) for every piece of every row.

    ``tokenizer`` is a file of the tokenizers library and its pattern, as ``planes.write`` takes them; tokens are
    counted by encoding every text. Without one they are an estimate, a token for every 4 bytes and one for the end.

    Pieces are dealt by a hash into shards of about ``shard_rows``; each shard is packed by itself, largest first,
    which costs at most its last open bins. The pieces of one source, however many, spread over all shards and are
    at most one to a bin, as are copies of one text. A null source is a source of its own; null and empty texts take
    one token for their end. Repeated rows are all placed. An empty table gives an empty table.
    """
    rows = pieces(docs, capacity, text, key, source, tokenizer)
    shards = max(1, -(-docs.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key", "cluster", "piece", "copy"), F.lit(shards)))
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind)])
    for name in ("piece", "n_tokens", "bin", "slot", "start"):
        schema = schema.add(name, "long")

    target = to_arrow_schema(schema)

    def place(shard: pa.Table) -> pa.Table:
        held = zip(*(shard.column(c).to_pylist() for c in ("key", "piece", "copy", "size", "source", "cluster", "shard")))
        held = sorted(held, key=lambda r: (-r[3], r[0] is None, "" if r[0] is None else r[0], r[1], r[2], r[5]))
        made = pack([(size, origin, cluster) for _, _, _, size, origin, cluster, _ in held], capacity)
        rows = [(r[0], r[1], r[3], (r[6] << 32) + b, slot, start) for r, (b, slot, start) in zip(held, made)]
        return pa.table([pa.array(c, type=f.type) for c, f in zip(zip(*rows), target)], schema=target)

    return rows.groupBy("shard").applyInArrow(place, schema)
