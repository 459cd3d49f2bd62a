import random

from brokerlens.llm import packing
from tests.llm.conftest import TEXTS


def plain(items, capacity):
    bins, out = [], []
    for size, source, cluster in items:
        fit = [(capacity - sum(s for s, _, _ in held), k) for k, held in enumerate(bins)
               if sum(s for s, _, _ in held) + size <= capacity and all(source != b and cluster != c for _, b, c in held)]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append([])
        out.append((k, len(bins[k]), sum(s for s, _, _ in bins[k])))
        bins[k].append((size, source, cluster))
    return out


def test_equals_search_over_all_bins():
    rng = random.Random(3)
    for _ in range(30):
        items = [(rng.randint(1, 60), rng.randint(0, 6), rng.randint(0, 25)) for _ in range(150)]
        assert packing.pack(items, 100) == plain(items, 100)


def test_query_keeps_everything_apart_and_within(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.best_fit(docs).toPandas()
    texts = docs.toPandas().set_index("doc_id")
    need = texts["text"].map(lambda t: -(-len(t.encode()) // 4) + 1)
    assert (rows.groupby("doc_id")["n_tokens"].sum().sort_index() == need.sort_index()).all()
    assert rows.groupby("bin")["n_tokens"].sum().max() <= packing.CAPACITY
    rows["source"], rows["text"] = rows["doc_id"].map(texts["source"]), rows["doc_id"].map(texts["text"])
    assert not rows.duplicated(["bin", "source"]).any() and not rows.duplicated(["bin", "text"]).any()
    for _, held in rows.sort_values("slot").groupby("bin"):
        assert held["slot"].tolist() == list(range(len(held)))
        assert held["start"].tolist() == [0, *held["n_tokens"].cumsum().tolist()[:-1]]


def test_edge_rows_and_clashing_names(spark, crowded, nothing):
    rows = packing.best_fit(crowded).toPandas()
    assert (rows["piece"] == 0).sum() == len(TEXTS) and rows["doc_id"].isna().sum() == 1
    assert (rows[rows["doc_id"] == 5]["bin"].nunique()) == 2
    assert rows[rows["doc_id"] == 6]["n_tokens"].sum() == 30_002
    assert packing.best_fit(nothing).count() == 0


def test_sizes_are_tokens_of_the_library(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from brokerlens.llm import queries

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    need = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect()}
    for rows in (queries.QUERIES["op5_packing"](spark, sf), corpus_pipeline.pack_sequences(spark, docs, sf)):
        rows = rows.toPandas()
        assert rows.groupby("doc_id")["n_tokens"].sum().to_dict() == need
        assert rows.groupby("bin")["n_tokens"].sum().max() <= packing.CAPACITY
    edge = corpus_pipeline.pack_sequences(spark, corpus, sf).toPandas()
    assert edge[edge["doc_id"].isin([2, 3])]["n_tokens"].tolist() == [1, 1]
    assert (edge["piece"] == 0).sum() == len(TEXTS)
