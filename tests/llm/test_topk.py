import numpy as np
import pytest

from brokerlens.llm import topk


def plain(rows, k, every):
    held = {}
    for key, vector in rows:
        if key is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector):
            held.setdefault(key, set()).add(tuple(int(np.floor(256 * x)) for x in vector))
    out = set()
    for q, vectors in held.items():
        for v in vectors if q % every == 0 else ():
            scores = []
            for other, vs in held.items():
                if other != q:
                    scores.append((-max(sum(a * b for a, b in zip(v, w)) for w in vs), other))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("case", ["plain", "ties", "long values", "few", "one"])
def test_equals_scores_of_all_rows(spark, case):
    rng = np.random.default_rng(4)
    n, scale = {"few": (4, 1), "one": (1, 1), "long values": (80, 1e6)}.get(case, (230, 1))
    data = [(i, (scale * rng.normal(size=9)).tolist()) for i in range(n)]
    if case == "ties":
        data = [(i, [float(i % 3), 0.5]) for i in range(120)] + [(500 + i, [1.0, 0.5]) for i in range(200)]
        data += [(0, [0.0, 0.5]), (50, [1.0])]
    if case == "plain":
        data += [(1000, None), (1050, [float("nan")] * 9), (1100, [0.1, None] + [0.0] * 7), (None, [9.0] * 9), (1150, [1.0] * 9)]
    table = spark.createDataFrame([(*r, "x", 1) for r in data], "vec_id long, embedding array<double>, class string, score int")
    rows = [tuple(r) for r in topk.top_k(table, k=5, every=10, query_block=300).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain(data, 5, 10)


def test_an_empty_table_has_no_rows(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
