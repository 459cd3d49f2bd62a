import numpy as np
import pytest

from brokerlens.llm import whitening


def plain(vectors, components=8):
    """Exact deviations, and the eigenvectors of the whole covariance matrix."""
    x = np.floor(np.array(vectors, dtype=np.float64) * 1024).astype(np.int64) + 100000
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, sums)) for row in x]
    centred = (x * n - sums) / n
    matrix = centred.T @ centred / n
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return n, deviation, centred @ axes / np.sqrt(values), values / np.trace(matrix)


def checked(out, keys, vectors, components=8):
    n, deviation, white, explained = plain(vectors, components)
    assert len(out) == len(keys) * white.shape[1]
    got = {(r["vec_id"], r["component"]): r for r in out}
    for j in range(white.shape[1]):
        column = np.array([got[k, j + 1]["whitened"] for k in keys])
        side = np.sign(column @ white[:, j])
        assert np.abs(side * column - white[:, j]).max() < 1e-9
        assert all(abs(got[k, j + 1]["explained"] / explained[j] - 1) < 1e-9 for k in keys)
    assert all(got[k, 1]["n"] == n and got[k, 1]["deviation"] == d for k, d in zip(keys, deviation))
    assert 0 <= out[0]["identity_error"] < 1e-9 and len({r["identity_error"] for r in out}) == 1


def test_equals_the_whole_matrix(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    held = df.orderBy("vec_id").toPandas()
    sound = [v is not None and all(x is not None and np.isfinite(x) for x in v) for v in held["embedding"]]
    held = held[sound]
    checked(whitening.whiten(df).collect(), held["vec_id"].tolist(), held["embedding"].tolist())


@pytest.mark.parametrize("size", [1, 3, 12, 40])
def test_broken_repeated_and_clashing_rows(spark, size):
    rng = np.random.default_rng(size)
    good = (rng.normal(size=(60, size)) * np.linspace(1, 3, size)).tolist()
    rows = [(i, v) for i, v in enumerate(good)] + [(100, good[0]), (None, good[1])]
    bad = [(200, None), (201, [float("nan")] * size), (202, [None, *good[0][1:]]), (203, [0.5] * (size + 1)), (204, []), (205, [float("-inf")] * size)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows + bad], "vec_id long, embedding array<double>, component string, x int")
    out = whitening.whiten(df.repartition(4)).collect()
    checked(out, [k for k, _ in rows], [v for _, v in rows])


def test_without_variance_there_are_no_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = spark.createDataFrame([(1, [0.5, 1.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(one).count() == 0 and whitening.whiten(one.unionAll(one)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}


def test_large_deviations_are_exact_or_null(spark):
    df = spark.createDataFrame([(1, [3e6]), (2, [-3e6]), (3, [1.0])], "vec_id long, embedding array<double>")
    want = plain([[3e6], [-3e6], [1.0]])[1]
    assert {r["vec_id"]: r["deviation"] for r in whitening.whiten(df).collect()} == {1: want[0] if want[0] < 1 << 63 else None, 2: want[1] if want[1] < 1 << 63 else None, 3: want[2]}


@pytest.mark.parametrize("case", ["random", "repeated", "low rank", "decay"])
def test_solver_against_whole_matrices(case):
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.normal(size=(90, 90)))[0]
    values = {"random": rng.random(90), "repeated": np.repeat([3.0, 2.0, 1.0], 30), "low rank": np.r_[5.0, 4.0, 3.0, np.zeros(87)], "decay": 0.5 ** np.arange(90)}[case]
    matrix = turn * values @ turn.T
    calls = []

    def times(block):
        calls.append(block.shape[1])
        return matrix @ block

    found, axes = whitening.jacobi_davidson(times, 90, 8)
    assert np.allclose(found, np.sort(values)[::-1][:8], atol=1e-13 * values.max())
    assert np.abs(axes.T @ axes - np.eye(8)).max() < 1e-13
    assert np.linalg.norm(matrix @ axes - axes * found, axis=0).max() < 1e-13 * values.max()
    assert len(calls) < 150
