"""Logistic regressions of all folds at once: every Newton step is one aggregate over the rows.

A step adds up, for each fold's regression, the loss, its gradient and its matrix of second derivatives over the rows
of the other folds. These are a few numbers per partition; their sums are solved in the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Logistic:
    """A fitted regression; ``weights`` belong to the scaled features."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float

    @property
    def raw(self) -> list[float]:
        """Weights of the features as they are, the constant last."""
        slopes = [w / s for w, s in zip(self.weights, self.std)]
        return [*slopes, self.intercept - sum(b * m for b, m in zip(slopes, self.mean))]


def chance(fits: list[Logistic], fold: str | None = None) -> Column:
    """The chance of class 1; with ``fold``, by the regression of the row's fold."""
    which = F.lit(0) if fold is None else F.col(fold)
    rows = F.array(*[F.array(*[F.lit(float(b)) for b in fit.raw]) for fit in fits])
    terms = [F.col(name).cast("double") * F.get(F.get(rows, which), F.lit(i)) for i, name in enumerate(fits[0].features)]
    margin = sum(terms, F.get(F.get(rows, which), F.lit(len(terms))))
    return 1 / (1 + F.exp(-margin))


def fit_folds(
    rows: DataFrame, features: list[str], label: str, fold: str | None = None, k: int = 1, strength: float = 1.0,
    scaler: dict[str, tuple[float, float]] | None = None, max_steps: int = 100,
) -> list[Logistic]:
    """One regression per fold, fitted to the rows of all other folds; without ``fold`` one, fitted to all rows.

    Minimises ``strength`` times the logistic loss plus half the squared weights of the scaled features; the intercept
    is free. Unless a scaler is given, each regression standardises by the rows it is fitted to. Labels are 0 and 1 and
    nothing is null. ``rows`` is read once and then once a step, so keep it; about ten steps are usual. A regression
    without rows predicts 1/2.
    """
    own = F.lit(-1) if fold is None else F.col(fold)
    kept = rows.select(
        *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y"),
        own.cast("int").alias("fold"),
    )
    count, mean, std = _scales(kept, len(features), k)
    if scaler is not None:
        mean[:] = [scaler[f][0] for f in features]
        std[:] = [scaler[f][1] for f in features]
    size = len(features) + 1
    penalty = np.diag([1.0 / strength] * len(features) + [0.0])
    best, reached = [np.zeros(size) for _ in range(k)], [np.inf] * k
    tried: dict[int, np.ndarray] = {i: best[i] for i in range(k) if count[i]}
    for _ in range(max_steps):
        if not tried:
            break
        for i, (loss, gradient, second) in _sums(kept, mean, std, tried, size).items():
            w = tried[i]
            loss += w @ penalty @ w / 2
            if loss > reached[i] * (1 + 1e-12) + 1e-12:
                tried[i] = (best[i] + w) / 2  # too far: the loss rose
                continue
            best[i], reached[i] = w, loss
            gradient = gradient + penalty @ w
            move = np.linalg.lstsq(second + penalty, gradient, rcond=None)[0]
            tried[i] = w - move
            if gradient @ move <= 1e-12 * (1 + loss):
                best[i] = tried.pop(i)  # what is left to gain falls with its square
    return [
        Logistic(tuple(features), *(tuple(map(float, v)) for v in (mean[i], std[i], best[i][:-1])), float(best[i][-1]))
        for i in range(k)
    ]


def _scales(kept: DataFrame, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, means and deviations of what each regression is fitted to, from one row of moments per fold."""
    parts = [c for i in range(width) for c in (F.avg(f"x{i}"), F.var_pop(f"x{i}") * F.count("*"))]
    folds = [tuple(r) for r in kept.groupBy("fold").agg(F.count("*"), *parts).collect()]
    count, mean, std = np.zeros(k), np.zeros((k, width)), np.ones((k, width))
    for i in range(k):
        others = np.array([r[1:] for r in folds if r[0] != i], dtype=float).reshape(-1, 1 + 2 * width)
        n, means, squares = others[:, :1], others[:, 1::2], others[:, 2::2]
        count[i] = n.sum()
        if count[i]:
            mean[i] = (n * means).sum(axis=0) / count[i]
            spread = (squares + n * (means - mean[i]) ** 2).sum(axis=0)
            std[i] = np.sqrt(spread / count[i])
    # A constant column scales by 1; rounding leaves some of them a little deviation.
    return count, mean, np.where(std > 1e-14 * (1 + np.abs(mean)), std, 1.0)


def _sums(kept: DataFrame, mean, std, tried: dict[int, np.ndarray], size: int):
    """Loss, gradient and second derivatives of each regression at its trial weights: one aggregate."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {i: np.zeros(1 + size + size * size) for i in tried}
        for batch in batches:
            *columns, y, fold = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            raw = np.column_stack(columns) if columns else np.empty((len(y), 0))
            for i, w in tried.items():
                use = fold != i
                x = np.hstack([(raw[use] - mean[i]) / std[i], np.ones((int(use.sum()), 1))])
                margin, known = x @ w, y[use]
                p = 0.5 * (1 + np.tanh(margin / 2))
                total[i][0] += (np.logaddexp(0, margin) - known * margin).sum()
                total[i][1:size + 1] += x.T @ (p - known)
                total[i][size + 1:] += (x.T @ (x * (p * (1 - p))[:, None])).ravel()
        for i, values in total.items():
            names = [pa.array([i] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()), pa.array(values)]
            yield pa.RecordBatch.from_arrays(names, ["model", "place", "value"])

    found = {i: np.zeros(1 + size + size * size) for i in tried}
    parts = kept.mapInArrow(add, "model int, place int, value double")
    for i, place, value in parts.groupBy("model", "place").agg(F.sum("value")).collect():
        found[i][place] = value
    return {i: (v[0], v[1:size + 1], v[size + 1:].reshape(size, size)) for i, v in found.items()}
