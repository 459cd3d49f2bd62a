"""Toxicity by compression distance: which of two zstandard dictionaries makes a window shorter."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brokerlens.llm.common import WORD, free_name, slices

LEVEL = 13
#: Differences of lengths, in bytes, that count apart; smaller and larger ones join the ends.
LEAST, MOST = -2, 7
MEMO_WORDS = 300_000
LONGEST_WINDOW = 64


@dataclass(frozen=True)
class Model:
    """Two dictionaries, the carrier every window starts with, and the calibration of a document's lengths."""

    toxic: bytes
    ordinary: bytes
    carrier: bytes
    centre: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]


def windows(text: str | None) -> list[bytes]:
    """The lower-cased (A-Z) words of a text; a longer word gives a window for every ``LONGEST_WINDOW`` bytes."""
    out = []
    for word in (text or "").encode().lower().split():
        if len(word) <= LONGEST_WINDOW:
            out.append(word)
        else:
            out += [word[i : i + LONGEST_WINDOW] for i in range(0, len(word), LONGEST_WINDOW)]
    return out


class Distance:
    """Bytes that the toxic dictionary saves on a window against the ordinary one.

    A window is compressed behind a carrier that both dictionaries hold, so that the costs a block has once are paid
    by it and a few saved bytes show.
    """

    def __init__(self, toxic: bytes, ordinary: bytes, carrier: bytes):
        parameters = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )

        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=parameters)
            return zstandard.ZstdCompressor(dict_data=held, compression_params=parameters)

        self.carrier = carrier
        self.by_toxic, self.by_ordinary = compressor(toxic), compressor(ordinary)
        self.memo: dict[bytes, int] = {}

    def of(self, window: bytes) -> int:
        saved = self.memo.get(window)
        if saved is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            framed = self.carrier + window + b" "
            saved = len(self.by_ordinary.compress(framed)) - len(self.by_toxic.compress(framed))
            saved = self.memo[window] = min(max(saved, LEAST), MOST)
        return saved

    def measures(self, text: str | None) -> list[float]:
        """Shares and logged counts of the windows by bytes saved, and their number."""
        found = windows(text)
        counts = [0] * (MOST - LEAST + 1)
        for window in found:
            counts[self.of(window) - LEAST] += 1
        n = max(1, len(found))
        shares = [c / n for c in counts]
        return [*(math.sqrt(s) for s in shares), *(math.log1p(c) for c in counts[2 - LEAST :]), math.log1p(len(found))]


def score_of(model: Model, measures: list[float]) -> float:
    z = (np.array(measures) - model.centre) / model.spread
    return float(1 / (1 + np.exp(-np.clip(z @ model.weights[:-1] + model.weights[-1], -30, 30))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _prefixes(words: Column) -> Column:
    """The distinct words and their beginnings of 3 to 7 characters, these marked by a star."""
    def starts(k: int) -> Column:
        longer = F.filter(words, lambda w: F.length(w) > k)
        return F.transform(longer, lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))

    return F.array_distinct(F.concat(words, *(starts(k) for k in range(3, 8))))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    label: str = "toxic",
    key: str = "doc_id",
    per_class: int = 4000,
    dictionary_bytes: int = 65_536,
    toxic_bytes: int = 16_384,
    least_z: float = 5.0,
    least_lift: float = 5.0,
) -> Model:
    """Fit on the documents of at most ``per_class`` label rows of each class, those whose hashed key is smallest.

    Half of them trains the dictionaries. The ordinary one is filled with the most frequent words of ordinary texts.
    The toxic one holds the same and besides the words of toxic texts that occur, or begin like words that occur, in
    markedly more toxic than ordinary documents (by ``least_z`` standard errors and ``least_lift`` times). The other
    half calibrates: a logistic fit of the label on a document's distribution of saved bytes, weighted to the shares
    that the classes have among all label rows. Labels other than 0 and 1, null keys and keys without a document take
    no part. With a class missing, every score is the share of label 1.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(
        F.col(key).alias("k"), F.col(label).cast("int").alias("y"), F.xxhash64(F.col(key), F.lit(7)).alias("h")
    )
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    positive, negative = totals.get(1, 0), totals.get(0, 0)
    chosen = known.where("y = 1").orderBy("h").limit(per_class).unionAll(known.where("y = 0").orderBy("h").limit(per_class))
    body = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = body.join(F.broadcast(chosen), "k").drop("k")  # a few thousand keys at most
    sample = sample.dropDuplicates(["text", "y"])  # copies would make their words look frequent
    sample = sample.persist()
    try:
        half = F.pmod(F.col("h"), F.lit(1 << 20)) < (1 << 19)
        words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})")))
        train = sample.where(half).select("y", words.alias("words"))
        size = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
        n1, n0 = size.get(1, 0), size.get(0, 0)
        if not n1 or not n0:
            return _constant(positive, negative)
        counted = (
            train.select("y", F.explode(_prefixes(F.col("words"))).alias("token"))
            .groupBy("token").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
        )
        p1, p0 = F.col("a") / max(n1, 1), F.col("b") / max(n0, 1)
        pooled = (F.col("a") + F.col("b")) / (n1 + n0)
        z = (p1 - p0) / F.sqrt(pooled * (1 - pooled) * (1 / max(n1, 1) + 1 / max(n0, 1)) + 1e-12)
        lift = p1 / ((F.col("b") + 0.5) / (n0 + 1))
        often = counted.where((F.col("a") >= 4) & (z >= least_z) & (lift >= least_lift))
        marked = {r["token"] for r in often.orderBy(z.desc(), "token").select("token").limit(5000).collect()}
        by_word = counted.where(~F.col("token").endswith("*"))
        toxic_words = by_word.where("a > 0").orderBy(F.desc("a"), "token").select("token", "a").limit(200_000).toLocalIterator()
        picked = _filled((r[0] for r in toxic_words if _is_marked(r[0], marked)), toxic_bytes)
        usual = by_word.where("b > 0").orderBy(F.desc("b"), "token").select("token").limit(20_000).toLocalIterator()
        common = [w for w in (r[0] for r in usual) if not _is_marked(w, marked)]
        carrier = (" " + " ".join(sorted(common[:6])) + " ").encode()
        ordinary = _filled(common, dictionary_bytes) + carrier
        toxic = picked + ordinary
        pairs = _measured(sample.where(~half), toxic, ordinary, carrier).collect()
    finally:
        sample.unpersist()
    x, y = np.array([r["measures"] for r in pairs]), np.array([r["y"] for r in pairs], dtype=float)
    if not y.any() or y.all():
        return _constant(positive, negative)
    return Model(toxic, ordinary, carrier, *_logistic(x, y, positive, negative))


def fit_tables(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """Fit on the labelled documents outside the held-out part."""
    return fit(docs, labels.where(~held_out(F.col(key))), text, key=key)


def _constant(positive: int, negative: int) -> Model:
    share = (positive + 1e-3) / (positive + negative + 1)
    n = len(Distance(b" ", b" ", b" ").measures(""))
    return Model(b" ", b" ", b" ", (0.0,) * n, (1.0,) * n, (0.0,) * n + (math.log(share / (1 - share)),))


def _is_marked(word: str, marked: set[str]) -> bool:
    return word in marked or any(word[:k] + "*" in marked for k in range(3, min(8, len(word))))


def _filled(words, size: int) -> bytes:
    """Words with spaces around, the first ones last, where matches are cheapest."""
    out, used = [], 0
    for word in words:
        piece = f" {word} ".encode()
        if used + len(piece) > size:
            break
        out.append(piece)
        used += len(piece)
    return b"".join(reversed(out)) or b" "


def _measured(rows: DataFrame, toxic: bytes, ordinary: bytes, carrier: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(toxic, ordinary, carrier)
        for whole in batches:
            for batch in slices(whole, ["text"]):
                made = [distance.measures(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict(
                    {"y": batch.column("y"), "measures": pa.array(made, type=pa.list_(pa.float64()))}
                )

    return rows.select("y", "text").mapInArrow(run, "y int, measures array<double>")


def _logistic(x: np.ndarray, y: np.ndarray, positive: int, negative: int, penalty: float = 1.0):
    """Centre, spread and weights (the constant last) of a penalised logistic fit by Newton steps."""
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.c_[(x - centre) / spread, np.ones(len(x))]
    share = positive / (positive + negative)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    w, ridge = np.zeros(z.shape[1]), penalty * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, centre)), tuple(map(float, spread)), tuple(map(float, w))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3, keep_below: bool = False) -> DataFrame:
    """The rows with score (0 to 1) and predicted (1 from ``threshold`` on).

    With ``keep_below`` only rows under the threshold, and no new columns. A null text scores as an empty one: by its
    lack of words. Equal texts get equal scores. A name the table already has gets an underscore in front.
    """
    name = free_name(docs, "score")
    verdict = free_name([*docs.columns, name], "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema if keep_below else T.StructType(list(docs.schema.fields)).add(name, "double").add(verdict, "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        distance = Distance(held.toxic, held.ordinary, held.carrier)
        for whole in batches:
            for batch in slices(whole, [text]):
                scores = [score_of(held, distance.measures(t)) for t in batch.column(text).to_pylist()]
                if keep_below:
                    yield batch.filter(pa.array([s < threshold for s in scores], type=pa.bool_()))
                    continue
                columns = {c: batch.column(c) for c in batch.schema.names}
                columns[name] = pa.array(scores, type=pa.float64())
                columns[verdict] = pa.array([int(s >= threshold) for s in scores], type=pa.int32())
                yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, schema)
