import zlib

import numpy as np
from pyspark.sql import functions as F

from brokerlens.llm import queries, toxicity
from tests.llm.conftest import TEXTS


def test_held_out_rows_are_told_apart(spark):
    rows = queries.QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    assert len(rows) == 10_000 and rows["score"].between(0, 1).all()
    assert (rows["held_out"] == rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (rows["predicted"] == (rows["score"] >= 0.3)).all()
    both = rows[rows["held_out"]].merge(labels, on="doc_id")
    toxic, clean = (both[both["toxic"] == y]["score"].to_numpy() for y in (1, 0))
    auc = (toxic[:, None] > clean[None, :]).mean() + (toxic[:, None] == clean[None, :]).mean() / 2
    assert auc > 0.88 and (clean >= 0.3).mean() < 0.04


def test_edge_rows_and_clashing_names(spark, corpus, crowded, nothing):
    labels = spark.createDataFrame([(1, 1), (3, 0), (8, 0), (7, 1), (None, 1), (2, None), (99, 5)], "doc_id long, toxic int")
    model = toxicity.fit_tables(corpus, labels)
    scores = toxicity.score(corpus, model).collect()
    assert len(scores) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in scores)
    assert len({r["score"] for r in scores if r["text"] == TEXTS[0][1]}) == 1
    assert toxicity.score(crowded, model).columns[-2:] == ["_score", "_predicted"]
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.score(crowded, model, keep_below=True).columns == crowded.columns


def test_a_missing_class_gives_its_share(spark, corpus):
    for labels in ([], [(1, 0)], [(1, 1), (8, 1)]):
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        model = toxicity.fit(corpus, table)
        found = {round(r["score"], 6) for r in toxicity.score(corpus, model).collect()}
        assert len(found) == 1 and (found.pop() > 0.5) == (len(labels) == 2)


def test_distance_prefers_the_dictionary_that_has_the_word():
    distance = toxicity.Distance(b" dreadful " * 3 + b" the of and in ", b" the of and in ", b" the of ")
    assert distance.of(b"dreadful") > distance.of(b"pleasant")
    assert np.isfinite(distance.measures("x" * 100_000)).all()
