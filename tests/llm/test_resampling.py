import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brokerlens.llm import resampling


def plain_features(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def plain(docs, target, percent=5, least=20):
    """(doc_id, n_features, weight, score, rank) by counting everything and sorting everything."""
    found = [(key, *plain_features(text)) for key, text in docs]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for text in target for b in plain_features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10000.0) / ((s[b] + 1.0) * (big_t + 10000.0)))) for b in range(10000)}
    rows = []
    for key, n, f in found:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    won = fit[: percent * len(fit) // 100]
    out = Counter((*r[:4], i + 1) for i, r in enumerate(won))
    for r in won:
        rows.remove(r)
    return out + Counter((*r[:4], None) for r in rows)


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_equals_counting_and_sorting_all(spark):
    sf = "/root/testdata/sf0.001"
    docs, target = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    assert rows_of(resampling.resample(docs, target)) == want


@pytest.mark.parametrize("percent", [30, 100])
def test_edge_rows(spark, crowded, corpus, percent):
    target = spark.createDataFrame([("naïve café line",), (None,), ("",)], "text string")
    want = plain([(r["doc_id"], r["text"]) for r in corpus.collect()], ["naïve café line", None, ""], percent, 1)
    assert rows_of(resampling.resample(crowded, target, percent=percent, least_words=1, pivots=2)) == want
    assert rows_of(resampling.resample(crowded, target.limit(0), percent=50)).total() == corpus.count()


def test_empty_table(spark, nothing):
    out = resampling.resample(nothing, spark.createDataFrame([], "text string"))
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"] and out.count() == 0


@pytest.mark.parametrize("k", [1, 2, 499, 500, 777, 1500])
def test_selection_over_ties_and_nulls(spark, k):
    rows = [(i * i % 7, None if i % 3 == 0 else i % 5, i) for i in range(1500)]
    df = spark.createDataFrame(rows, "a long, b long, row long").repartition(5)
    order = resampling.Order.of(df, ["a", "b", "row"])
    want = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))[k - 1]
    assert tuple(resampling.kth(df, order, k, pivots=3)) == want


def test_ranks_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANKED_ROWS", 40)
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("a"), "id")
    got = resampling.ranked(df, resampling.Order.of(df, ["a", "id"]), 1000, "rank").collect()
    assert sorted((r["a"], r["rank"]) for r in got) == [(i, i + 1) for i in range(1000)]
