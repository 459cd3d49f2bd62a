"""Whitening of vectors by their leading principal axes, found matrix-free with the Jacobi-Davidson method."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from brokerlens.llm.common import written

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Steps of the inner solver for one correction equation.
INNER = 4

Multiply = Callable[[np.ndarray], np.ndarray]


# The eigenvalue solver: it sees the matrix only through products with a few vectors.


def minres(multiply: Multiply, shifts: np.ndarray, away: np.ndarray, right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t, orthogonal to ``away``, of P (A - shift I) P t = right, P the projector off ``away``.

    One column of ``right`` per shift; the columns go in lockstep, so a step is one product with all of them.
    """

    def off(block: np.ndarray) -> np.ndarray:
        return block - away @ (away.T @ block)

    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros_like(a), where=b != 0)

    v = off(right)
    beta = np.linalg.norm(v, axis=0)
    floor, eta = 1e-14 * beta, beta.copy()
    v, before = over(v, np.broadcast_to(beta, v.shape)), np.zeros_like(v)
    x, w, w_before = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    c = c_before = np.ones_like(beta)
    s = s_before = np.zeros_like(beta)
    for _ in range(steps):
        p = off(multiply(v) - v * shifts)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * before
        following = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_before * s * beta
        size = np.hypot(delta, following)
        w, w_before = over(v - s_before * beta * w_before - (s * alpha + c_before * c * beta) * w, np.broadcast_to(size, v.shape)), w
        turn, drop = over(delta, size), over(following, size)
        x = x + turn * eta * w
        eta = -drop * eta
        before, v = v, over(p, np.broadcast_to(following, p.shape))
        beta, c_before, c, s_before, s = following, c, turn, s, drop
        if (np.abs(eta) <= floor).all():
            break
    return off(x)


def orthonormal(block: np.ndarray, *held: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block adds to the held ones; directions that add nothing are left out."""
    for _ in range(2):
        for basis in held:
            block = block - basis @ (basis.T @ block)
        lengths = np.linalg.norm(block, axis=0)
        block = block[:, lengths > 0] / lengths[lengths > 0]
        left, values, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, values > 1e-8]
    return block


def jacobi_davidson(multiply: Multiply, size: int, wanted: int, seed: int = 0, inner: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric semi-definite matrix.

    Rayleigh-Ritz on a growing subspace; each unfinished pair adds the solution of its correction equation, and pairs
    are locked from the largest on when their residual is at the rounding error of a product. ``multiply`` returns
    the matrix times a block of vectors.
    """
    wanted = min(wanted, size)
    most, kept = min(size, 6 * wanted), min(size, 2 * wanted)
    basis = orthonormal(np.random.default_rng(seed).normal(size=(size, kept)))
    image = multiply(basis)
    locked, stale, best = np.zeros((size, 0)), 0, np.inf
    largest = 0.0
    while locked.shape[1] < wanted:
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        largest = max(largest, float(values[0]))
        left = wanted - locked.shape[1]
        rest = image[:, :left] - basis[:, :left] * values[:left]
        rest -= locked @ (locked.T @ rest)
        errors = np.linalg.norm(rest, axis=0)
        limit = 4 * np.sqrt(size) * np.finfo(float).eps * largest
        done = int(np.argmin(np.append(errors <= limit, False)))
        # Rounding may keep a residual just above the limit, and a full subspace has nothing to add.
        stale, best = (0, errors.max()) if errors.max() < 0.5 * best else (stale + 1, best)
        if basis.shape[1] + locked.shape[1] == size or stale >= 5 and (errors <= 1e3 * limit).all():
            done = left
        if done:
            locked = np.concatenate([locked, basis[:, :done]], axis=1)
            basis, image = basis[:, done:], image[:, done:]
            stale, best = 0, np.inf
            if locked.shape[1] == wanted:
                break
            values, rest, left = values[done:], rest[:, done:], left - done
        away = np.concatenate([locked, basis[:, :left]], axis=1)
        steps = minres(multiply, values[:left], away, -rest, inner)
        if basis.shape[1] + left > most:
            basis, image = basis[:, :kept], image[:, :kept]
        added = orthonormal(steps, locked, basis)
        if not added.shape[1]:
            added = orthonormal(np.random.default_rng(basis.shape[1]).normal(size=(size, 1)), locked, basis)
        basis, image = np.concatenate([basis, added], axis=1), np.concatenate([image, multiply(added)], axis=1)
    # One last turn among the locked ones, from a product with them alone.
    locked, _ = np.linalg.qr(locked)
    small = locked.T @ multiply(locked)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], locked @ turn[:, ::-1]


# Vectors in Spark


def whole_numbers(df: DataFrame, vector: str, columns: list[str], scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``columns`` and x, the vector as whole numbers floor(scale * c) + shift, of rows whose vector is complete.

    Vectors that are null or empty, or hold null, NaN or infinite entries, are left out, as are those whose length
    is not the commonest one (the longer of equally common ones).
    """
    # A null entry gives null here, which counts as false.
    sound = F.forall(F.col(vector), lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(sound, F.lit(False)))
    lengths = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
    common = lengths.agg(F.max(F.struct("n", "d"))["d"].alias("d")).first()["d"]
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long"))
    return rows.where(F.size(vector) == F.lit(common)).select(*(F.col(c) for c in columns), x.alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(rows: DataFrame, make: Callable[[np.ndarray], np.ndarray], shape: tuple, kind: str) -> np.ndarray:
    """The sum over all batches of the array that ``make`` gives for one; tasks add up first, the cluster adds their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(_matrix(batch))
                total = part if total is None else total + part
        if total is not None:
            flat = np.ravel(total)
            yield pa.RecordBatch.from_pydict({"at": np.arange(len(flat)), "value": flat})

    parts = rows.select("x").mapInArrow(run, f"at long, value {kind}")
    out = np.zeros(shape, dtype=np.int64 if kind == "long" else np.float64)
    for row in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
        out.flat[row["at"]] = row["value"]
    return out


class Centred:
    """The vectors less their mean, and products of their covariance with blocks of vectors."""

    def __init__(self, rows: DataFrame, n: int, size: int):
        self.rows, self.n, self.size = rows, n, size
        self.sums = _sums(rows, lambda x: x.sum(axis=0), (size,), "long")
        # Whole and broken part of the mean: the first is taken off without rounding.
        self.whole = self.sums // n
        self.broken = (self.sums - self.whole * n) / n

    def take(self) -> Callable[[np.ndarray], np.ndarray]:
        whole, broken = self.whole, self.broken
        return lambda x: (x - whole).astype(np.float64) - broken

    def times(self, block: np.ndarray) -> np.ndarray:
        """The covariance times the block: one pass over the vectors, no matrix of it is built."""
        centre = self.take()

        def part(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return c.T @ (c @ block)

        return _sums(self.rows, part, block.shape, "double") / self.n

    def trace(self) -> float:
        centre = self.take()
        return float(_sums(self.rows, lambda x: np.array([np.square(centre(x)).sum()]), (1,), "double")[0]) / self.n

    def deviations(self) -> Callable[[np.ndarray], list[int | None]]:
        """Exact sums of (n * x - S)^2 per row; None where the sum does not fit a long."""
        n, sums, size = self.n, self.sums, self.size

        def exact(x: np.ndarray) -> list[int | None]:
            most = max(float(np.abs(x).max()) * n, float(np.abs(sums).max()))
            if most < 2.0**62:
                d = x * n - sums
                if float(np.abs(d).max()) ** 2 * size < 2.0**62:
                    return np.square(d).sum(axis=1).tolist()
            totals = [sum((int(a) * n - int(b)) ** 2 for a, b in zip(row, sums)) for row in x]
            return [t if t < 1 << 63 else None for t in totals]

        return exact


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, seed: int = 0) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for every complete row and component.

    Rows are whole numbers x (see ``whole_numbers``), n of them; the components are unit eigenvectors of their
    covariance (divisor n) by falling eigenvalue e, numbered from 1. whitened is the centred x projected on the
    component over sqrt(e); deviation the exact sum of (n * x - S)^2 (null where it does not fit a long); explained
    e over the trace; identity_error the largest entry of the covariance of all whitened columns minus the identity.

    Null and broken vectors are left out (``whole_numbers`` says which). Vectors without variance along a component
    cannot be whitened: components whose eigenvalue is zero to rounding are left out, so equal rows only, or a single
    one, give no rows, as does an empty table. Repeated rows count one by one, a null key is kept. Other columns are
    not looked at. Each step of the solver is one pass over a table of whole numbers written once to the shared folder.
    """
    schema = StructType([StructField(key, df.schema[key].dataType), *StructType.fromDDL(
        "component int, n long, deviation long, whitened double, explained double, identity_error double"
    ).fields])
    rows = written(whole_numbers(df.select(F.col(key).alias("key"), F.col(vector).alias("v")), "v", ["key"]), "vectors")
    first = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    if not first["n"]:
        return df.sparkSession.createDataFrame([], schema)
    centred = Centred(rows, first["n"], first["d"])
    trace = centred.trace()
    if trace == 0:
        return df.sparkSession.createDataFrame([], schema)
    values, axes = jacobi_davidson(centred.times, first["d"], components, seed)
    real = values > 64 * first["d"] * np.finfo(float).eps * values[0]
    values, axes = values[real], axes[:, real]
    centre, exact, n = centred.take(), centred.deviations(), first["n"]
    to_white = axes / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centre(x) @ to_white
        return np.concatenate([w.sum(axis=0)[None, :], w.T @ w])

    sums = _sums(rows, moments, (len(values) + 1, len(values)), "double") / n
    error = float(np.abs(sums[1:] - np.outer(sums[0], sums[0]) - np.eye(len(values))).max())
    explained, count = values / trace, len(values)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            at = pa.array(np.repeat(np.arange(len(x)), count))
            m = len(x) * count
            made = [
                batch.column("key").take(at), np.tile(np.arange(1, count + 1), len(x)), np.full(m, n),
                pa.array(exact(x), pa.int64()).take(at), (centre(x) @ to_white).ravel(), np.tile(explained, len(x)), np.full(m, error),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(made, target)], schema=target)

    return rows.mapInArrow(emit, schema)
