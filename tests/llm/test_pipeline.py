import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from brokerlens.llm import packing, pii, quality, simhash, toxicity
from tests.llm.test_packing import plain as plain_pack
from tests.llm.test_quality import plain as plain_measures, plain_cleaned
from tests.llm.test_simhash import plain_classes

SF = "/root/testdata/sf0.01"


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = [docs.toPandas().sort_values("doc_id").reset_index(drop=True)]
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, docs, SF)
        if at < len(corpus_pipeline.STAGES) - 1:
            assert frame.columns == docs.columns
            docs = corpus_pipeline.written(frame, "stage")
            held.append(docs.toPandas().sort_values("doc_id").reset_index(drop=True))
        else:
            packed = frame.toPandas()
    start, good, mild, single, safe = held
    measures = start["text"].map(plain_measures)
    passing = {i for i, m in zip(start["doc_id"], measures) if m[0] >= 50 and 100 * m[4] <= 50 * m[0]}
    assert set(good["doc_id"]) <= passing
    cleaned = plain_cleaned(list(zip(start["doc_id"], start["text"], start["source"])))
    assert dict(zip(good["doc_id"], good["text"])) == cleaned
    before = dict(zip(start["doc_id"], start["text"]))
    assert sum(before[i] != text for i, text in cleaned.items()) > 50  # lines that a host repeats do go
    assert (good["n_chars"] == good["text"].str.len()).all()
    model = toxicity.fit_tables(spark.createDataFrame(good), spark.read.parquet(f"{SF}/labels.parquet"))
    distance = toxicity.Distance(model.toxic, model.ordinary, model.carrier)
    calm = {i for i, t in zip(good["doc_id"], good["text"]) if toxicity.score_of(model, distance.measures(t)) < 0.3}
    assert set(mild["doc_id"]) == calm
    prints = np.array([simhash.fingerprint(t) for t in mild["text"]], dtype=np.uint64)
    first = mild.assign(c=plain_classes(prints)).groupby("c")["doc_id"].min()
    assert set(single["doc_id"]) == set(first)
    field = pii.fit(spark.createDataFrame(single))
    assert safe["text"].tolist() == [pii.redacted(t, pii.find(t, field)[1]) for t in single["text"]]
    assert (safe["n_chars"] == safe["text"].str.len()).all()
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    need = dict(zip(safe["doc_id"], safe["text"].map(lambda t: len(encoder.encode(t, add_special_tokens=False).ids) + 1)))
    assert packed.groupby("doc_id")["n_tokens"].sum().to_dict() == need
    source = dict(zip(safe["doc_id"], safe["source"]))
    for _, shard in packed.groupby(packed["bin"] // (1 << 32)):
        order = shard.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True])
        placed = plain_pack([(n, source[i], i) for n, i in zip(order["n_tokens"], order["doc_id"])], packing.CAPACITY)
        assert [(b & 0xFFFFFFFF, s, t) for b, s, t in zip(order["bin"], order["slot"], order["start"])] == placed


def test_run_and_edge_rows(spark, corpus, tmp_path):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "n_tokens", "bin", "slot", "start"] and out.count() > 500
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {7, 8}
    assert quality.clean(corpus).count() <= 2
