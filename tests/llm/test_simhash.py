import re

import numpy as np
import pytest
import xxhash

from brokerlens.llm import components, simhash
from tests.llm.conftest import TEXTS


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(points, bits=3):
    parent = list(range(len(points)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= bits):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(points))]


def cloud(seed):
    """Lone points, chains of near points, and a dense ball."""
    rng = np.random.default_rng(seed)
    flip = lambda x, k, within=64: int(x) ^ sum(1 << int(b) for b in rng.choice(within, k, replace=False))
    points = [int(x) for x in rng.integers(0, 1 << 63, 200)]
    for x in points[:50]:
        for _ in range(rng.integers(1, 25)):
            x = flip(x, rng.integers(0, 4))
            points.append(x)
    points += [flip(points[0], rng.integers(0, 6), 64 if seed % 2 else 16) for _ in range(500)]
    return np.unique(np.array(points, dtype=np.uint64))


@pytest.mark.parametrize("seed", range(4))
def test_shards_find_the_classes_of_all_pairs(seed):
    points = cloud(seed)
    np.random.default_rng(9).shuffle(points)
    whole = simhash.shard_links(points, np.ones(len(points), dtype=bool))
    links = []
    for mask in (simhash.LOW, simhash.HIGH):
        tree, shards = simhash.grow(points[::3], mask, 1, 40, 3)
        at, shard, home = simhash.route(tree, points)
        assert sorted(at[home]) == list(range(len(points)))
        for s in range(shards):
            own = at[shard == s]
            links += [(own[i], own[j]) for i, j in simhash.shard_links(points[own], home[shard == s])]
    for found in (whole, links):
        forest = simhash.Forest(len(points))
        for i, j in found:
            assert np.bitwise_count(points[i] ^ points[j]) <= 3
            forest.join(int(i), int(j))
        forest.flatten()
        assert forest.parent.tolist() == plain_classes(points)


def test_fingerprints_equal_plain_ones():
    for text in [t for _, t, *_ in TEXTS if t is None or len(t) < 5000] + ["A b", "\x1cx \x85y z", "a b c d " * 100]:
        assert simhash.fingerprint(text) == plain_print(text)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = simhash.near_duplicates(docs).toPandas()
    texts = docs.toPandas().set_index("doc_id")["text"]
    assert len(rows) == len(texts)
    sample = rows[rows["doc_id"] % 20 == 0]
    assert all(int(f, 16) == plain_print(texts[i]) for i, f in zip(sample["doc_id"], sample["fingerprint"]))
    points = np.array([int(f, 16) for f in rows["fingerprint"]], dtype=np.uint64)
    rows["class"] = plain_classes(points)
    assert (rows.groupby("class")["doc_id"].transform("min") == rows["component_id"]).all()


def test_edge_rows_and_clashing_names(spark, corpus, crowded, nothing):
    rows = simhash.near_duplicates(crowded).collect()
    assert len(rows) == len(TEXTS)
    empty = {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16}
    assert empty == {2} and {r["component_id"] for r in rows if r["doc_id"] in (1, 5)} == {1}
    kept = simhash.representatives(crowded)
    assert kept.columns == crowded.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 6, 7, 8]
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.representatives(nothing).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5, 5)]
    found = dict(map(tuple, components.components(spark.createDataFrame(path, "a long, b long")).collect()))
    assert {found[i] for i in range(301)} == {0} and {found[1000 + i] for i in range(400)} == {1000}
