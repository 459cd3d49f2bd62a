import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brokerlens.llm import jaccard


def plain_set(text, size=4):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def plain(rows, size=4, percent=85):
    """(doc_id, n, component) by comparing every set with every other."""
    sets = [plain_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    distinct = {}
    for i, s in enumerate(sets):
        if s:
            parent[i] = distinct.setdefault(s, i)
    items = list(distinct.items())
    for k, (s, i) in enumerate(items):
        for t, j in items[k + 1 :]:
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            r = root(i)
            least[r] = min(least.get(r, key), key)
    return sorted(((k, len(s), least.get(root(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def texts(seed):
    """Lone texts, chains of edits, a dense group of near copies, a passage that many share, and sizes at the bound."""
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    out = [word(int(rng.integers(1, 120))) for _ in range(60)]
    for base in out[:25]:
        now = list(base)
        for _ in range(int(rng.integers(1, 8))):
            now = list(now)
            for _ in range(int(rng.integers(0, 3))):
                now[int(rng.integers(0, len(now)))] = f"e{rng.integers(0, 1000)}"
            out.append(now)
    dense = word(150)
    for _ in range(120):
        near = list(dense)
        for _ in range(int(rng.integers(0, 4))):
            near[int(rng.integers(0, 150))] = f"x{rng.integers(0, 9)}"
        out.append(near)
    passage = word(40)
    out += [word(int(rng.integers(0, 12))) + passage + word(int(rng.integers(0, 12))) for _ in range(60)]
    long = word(103)
    out += [long[: 103 - k] for k in range(0, 40, 2)] + [word(2000)] * 2
    rng.shuffle(out)
    return [(i, " ".join(words)) for i, words in enumerate(out)]


@pytest.mark.parametrize(("seed", "block"), [(0, 2048), (1, 16), (2, 5)])
def test_equals_comparing_all_pairs(spark, seed, block):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in jaccard.linked(df, block=block).collect()), key=str)
    assert got == plain(rows)


def test_equals_comparing_all_pairs_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted((tuple(r) for r in jaccard.linked(df).collect()), key=str) == plain(rows)


def test_edge_rows(spark, crowded, corpus, nothing):
    got = sorted((tuple(r) for r in jaccard.linked(crowded).collect()), key=str)
    assert got == plain([(r["doc_id"], r["text"]) for r in corpus.collect()])
    out = jaccard.linked(nothing)
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and out.count() == 0


@pytest.mark.parametrize("percent", [50, 85, 100])
@pytest.mark.parametrize("leaf", [2, 16])
def test_a_tree_loses_no_link(percent, leaf):
    rng = np.random.default_rng(percent + leaf)
    sets = [np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 200)), dtype=np.uint64)) for _ in range(80)]
    for s in sets[:40]:
        for _ in range(5):
            keep = s[rng.random(len(s)) < rng.choice([0.8, 0.9, 0.97])]
            sets.append(np.unique(np.append(keep, rng.integers(0, 1 << 63, int(rng.integers(1, 6)), dtype=np.uint64))))
    size = np.array([len(s) for s in sets])
    shard = jaccard.Shard(size, np.stack([jaccard.bitmap(s, 8) for s in sets]), np.arange(len(sets)), np.ones(len(sets), bool), percent, leaf)
    plain_sets = [set(s.tolist()) for s in sets]
    linked = lambda i, j: 100 * len(plain_sets[i] & plain_sets[j]) >= percent * len(plain_sets[i] | plain_sets[j])
    shard.search(linked)
    for i in range(len(sets)):
        for j in range(i):
            assert not linked(i, j) or shard.label[i] == shard.label[j]
    assert all(linked(i, j) for i, j in shard.links) and len(shard.links) < len(sets)


def test_words_are_hashed_alike_wherever_they_stand():
    words = [b"a", b"b", b"ab", b"ba", "é".encode(), b"x" * 70_000, b"y" * 200_000, b"end"]
    alone = [int(jaccard.word_hashes(w)[0]) for w in words]
    assert len(set(alone)) == len(words)
    rng = np.random.default_rng(0)
    order = rng.integers(0, len(words), 50)
    body = b" \n".join(words[i].upper() if words[i].isascii() else words[i] for i in order)
    assert jaccard.word_hashes(b"\t" + body + b"\x0b").tolist() == [alone[i] for i in order]
    assert jaccard.word_hashes(b"").tolist() == jaccard.word_hashes(b" \r\n").tolist() == []


def test_groups_that_cross_batches():
    rows = [(g, 0, g * 10 + i) for g in range(4) for i in range(3)]
    column = lambda k: pa.array([r[k] for r in rows], pa.int64())
    count = lambda rows, group: (np.flatnonzero(np.diff(group, prepend=-1)), np.flatnonzero(np.diff(group, append=-1)))
    whole = pa.RecordBatch.from_pydict({"grp": column(0), "block": column(1), "id": column(2)})
    find = lambda group: [(0, group.num_rows - 1)]
    for step, run in itertools.product((1, 2, 5, 12), (jaccard.by_group(find), jaccard.by_group(find, count))):
        out = [b for b in run(iter([whole.slice(i, step) for i in range(0, 12, step)]))]
        assert sorted((a, b) for batch in out for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist())) == [(g * 10, g * 10 + 2) for g in range(4)]


@pytest.mark.parametrize("percent", [50, 85, 100])
def test_members_within_reach_are_those_of_a_pair_within_reach(percent):
    rng = np.random.default_rng(percent)
    group = np.sort(rng.integers(0, 150, 600))
    sizes = rng.integers(1, 60, 600)
    places = (rng.random(600) * (sizes - -(-percent * sizes // 100) + 1)).astype(np.int64)
    far = [[min(sizes[i] - places[i], sizes[j] - places[j]) >= jaccard.needed(sizes[i] + sizes[j], percent) for j in range(600)] for i in range(600)]
    near = [any(i != j and group[i] == group[j] and far[i][j] for j in range(600)) for i in range(600)]
    assert jaccard.met(sizes, places, group, percent).tolist() == near and 0 < sum(near) < 600


@pytest.mark.parametrize("step", [1, 3, 7, 40])
@pytest.mark.parametrize("most", [4, 10, 100])
def test_groups_are_kept_alike_however_their_rows_arrive(step, most):
    # Groups of one row, of two within reach, of two that stand too late in their sets for each other, and a large one.
    rows = [(0, 1, 100, 0), (1, 2, 100, 0), (1, 3, 99, 3), (2, 4, 100, 0), (2, 5, 100, 15)] + [(3, i, 50, 0) for i in range(6, 18)]
    rows += [(4, 18, 10, 0), (5, 19, 20, 1), (5, 20, 20, 1)]
    batch = pa.RecordBatch.from_pydict({name: pa.array([r[k] for r in rows], pa.int64()) for k, name in enumerate(("grp", "id", "n", "place"))})
    out = jaccard.by_reach(85, most)(iter([batch.slice(i, step) for i in range(0, len(rows), step)]))
    assert sorted(x for b in out for x in b["id"].to_pylist()) == [2, 3, *range(6, 18), 19, 20]


def test_links_of_a_chain_become_a_star():
    order = np.random.default_rng(0).permutation(500)
    a, b = jaccard.stars(order[:-1] * 3, order[1:] * 3)
    assert a.tolist() == [0] * 499 and sorted(b.tolist()) == [3 * i for i in range(1, 500)]
    a, b = jaccard.stars(np.array([5, 9, 7, 7]), np.array([9, 5, 8, 7]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(5, 9), (7, 8)]


def test_no_overlap_is_larger_than_signatures_allow():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
    alike = np.arange(900, dtype=np.uint64) << np.uint64(20)  # all of one remainder, more than a byte counts
    sets = [np.unique(np.append(base[low : low + n], extra)) for low, n in ((0, 1100), (150, 1300), (0, 5000), (400, 5200), (900, 100)) for extra in (alike, base[:0])]
    assert {jaccard.scale(len(s)) for s in sets} == {0, 1, 2, 3}
    for at in range(5):
        marks = jaccard.stacked([jaccard.signature(s, at) for s in sets], at > 0)
        extra = np.array([len(s) for s in sets]) - jaccard.shared(marks, marks)
        assert at == 0 or marks.max() == 255 and extra.max() >= 900 - 255
        whole = jaccard.merged(marks)
        for i, s in enumerate(sets):
            assert jaccard.shared(marks[i], whole) == jaccard.shared(marks[i], marks[i])
            for j, t in enumerate(sets):
                assert len(np.intersect1d(s, t)) <= jaccard.shared(marks[i], marks[j]) + min(extra[i], extra[j])


@pytest.mark.parametrize("percent", [30, 50, 85, 100])
def test_sets_that_may_link_have_a_scale_in_common(spark, percent):
    sizes = [1, 2, 869, 870, 871, 872, 1023, 1024, 1025, 1204, 1205, 1740, 1741, 2047, 2048, 2049, 2409, 4096, 4097, 70_000]
    own = [[at for at, _ in jaccard.signatures(np.arange(n, dtype=np.uint64), percent)] for n in sizes]
    for n, scales in zip(sizes, own):
        for m, others in zip(sizes, own):
            assert m * percent > n * 100 or n * percent > m * 100 or jaccard.scale(max(n, m)) in {*scales} & {*others}
    members = spark.createDataFrame([(-7, n) for n in sizes], "grp long, n long")
    found = {}
    for r in jaccard._at_scales(members, percent).collect():
        assert r["grp"] == -7 * 64 + r["scale"]
        found.setdefault(r["n"], []).append(r["scale"])
    assert [sorted(found[n]) for n in sizes] == own


def test_equals_comparing_all_pairs_where_scales_meet(spark):
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    out = []
    for size in (900, 1027, 1110, 1200, 2051, 2200, 2400):
        for share in (0.83, 0.849, 0.851, 0.87, 0.95):
            long = word(size)
            near = [f"e{i}" if rng.random() < (1 - share) / 3 else w for i, w in enumerate(long)]
            out += [long, long[: int(size * share) + 3], near]
    rows = [(i, " ".join(words)) for i, words in enumerate(out)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in jaccard.linked(df).collect()), key=str) == plain(rows)


def test_long_sets_that_only_share_a_passage_are_told_apart_in_their_groups(spark, monkeypatch):
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage = word(150)
    out = [word(1900) + passage for _ in range(60)]
    out.append([*out[0][:700], "other", *out[0][701:]])
    rows = [(i, " ".join(words)) for i, words in enumerate(out)]
    seen = []
    # Without ranks the passage stands anywhere in the order, as passages do that a large table's counters do not show.
    monkeypatch.setattr(jaccard, "gram_ranks", lambda *_: np.zeros(jaccard.COUNTERS, dtype=np.uint16))
    write = jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: seen.append((name, made := write(df, name))) or made)
    got = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)
    met = next(df.count() for name, df in seen if name == "shared")
    assert met > 120 and next(df.count() for name, df in seen if name == "near") == 2


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_one_row_stands_for_equal_sets(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "BROADCAST_BYTES", most)
    rows = [(4, 1, 7, 7), (1, 1, 7, 7), (9, 1, 7, 8), (2, 3, 5, 7), (3, 3, 5, 7), (0, 0, 6, 6), (8, 0, 6, 6), (6, 2, 9, 9)]
    df = spark.createDataFrame(rows, "row long, n long, high long, low long").repartition(3)
    classes = df.where("n > 0").groupBy("high", "low").agg(F.min("row").alias("id"), F.count("*").alias("m"))
    out = jaccard.representatives(df, classes)
    assert sorted((r["row"], r["n"], r["high"], r["low"]) for r in out.collect()) == [(1, 1, 7, 7), (2, 3, 5, 7), (6, 2, 9, 9), (9, 1, 7, 8)]
