"""Analysis of variance and pairwise comparison out of cell statistics.

Spark reduces the rows to count, mean and sum of squared deviations per cell;
what remains is arithmetic on as many rows as there are groups.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell_stats(df: DataFrame, y: list[str], keys: list[str]) -> DataFrame:
    """n, mean and within sum of squares per metric and cell, from one aggregate over the rows."""
    clean = {m: F.col(m).cast("double") for m in y}
    wide = df.groupBy(*keys).agg(
        *[F.count(clean[m]).alias(f"{m}__n") for m in y],
        *[F.avg(clean[m]).alias(f"{m}__mean") for m in y],
        *[F.var_pop(clean[m]).alias(f"{m}__var") for m in y],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(f"{m}__n").alias("n"),
                F.col(f"{m}__mean").alias("mean"),
                (F.col(f"{m}__var") * F.col(f"{m}__n")).alias("ss"),
            )
            for m in y
        ]
    )
    return wide.select(*keys, F.explode(rows).alias("_r")).select("_r.*", *keys).filter("n > 0")


def beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(1 - x, b, a)
    front = math.exp(
        a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    ) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def f_tail(f: float, df1: float, df2: float) -> float:
    """Probability that an F variable with these degrees of freedom exceeds f."""
    if not math.isfinite(f) or df2 <= 0:
        return float("nan") if math.isnan(f) or df2 <= 0 else 0.0
    return beta_tail(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(96)
_ERF = np.vectorize(math.erf)


def _normal(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _ERF(x / math.sqrt(2)))


def _range_below(w: np.ndarray, groups: int) -> np.ndarray:
    """Probability that the range of standard normal values stays below w."""
    z = 8.5 * _NODES
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * _WEIGHTS * 8.5
    inner = _normal(z[None, :]) - _normal(z[None, :] - w[:, None])
    return np.clip(groups * (density[None, :] * np.maximum(inner, 0) ** (groups - 1)).sum(axis=1), 0, 1)


def _log_scale_density(u: np.ndarray, df: float) -> np.ndarray:
    """Log density of the scale estimate s = 1 + u; the large terms of the gamma function cancel on paper."""
    a = df / 2
    if a > 20:
        front = 0.5 * math.log(a / (2 * math.pi)) - 1 / (12 * a) + 1 / (360 * a**3) - 1 / (1260 * a**5)
    else:
        front = a * math.log(a) - a - math.lgamma(a)
    return math.log(2) + front + (df - 1) * np.log1p(u) - a * (2 * u + u * u)


def studentized_range_tail(q: float, groups: int, df: float) -> float:
    """Probability that the studentised range exceeds q, by integrating over the scale estimate.

    The interval that holds its mass is cut at halves towards 0, where few degrees of freedom need a fine grid.
    """
    if q <= 0:
        return 1.0
    spread = 9 / math.sqrt(2 * df)
    low, high = max(0.0, 1 - spread), 1 + spread + 4 / df
    edges = [low, high]
    if low == 0.0:
        edges = [0.0, *(high / 2**i for i in range(40, -1, -1))]
    total = 0.0
    for a, b in zip(edges, edges[1:]):
        s = a + (b - a) * (_NODES + 1) / 2
        weights = np.exp(_log_scale_density(s - 1, df)) * _WEIGHTS * (b - a) / 2
        total += float((weights * (1 - _range_below(q * s, groups))).sum())
    return float(np.clip(total, 0, 1))


def studentized_range_quantile(alpha: float, groups: int, df: float) -> float:
    low, high = 0.0, 8.0
    while studentized_range_tail(high, groups, df) > alpha:
        low, high = high, 2 * high
    while high - low > 1e-9 * high:
        middle = (low + high) / 2
        if studentized_range_tail(middle, groups, df) > alpha:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def _no_rows(text: list[str] = (), whole: list[str] = (), real: list[str] = (), flag: list[str] = ()) -> pd.DataFrame:
    kinds = {"object": text, "int64": whole, "float64": real, "bool": flag}
    return pd.DataFrame({c: pd.Series(dtype=kind) for kind, names in kinds.items() for c in names})


_ANOVA = "metric string, term string, df double, sum_sq double, f double, p double"


def _residual(design: np.ndarray, mean: np.ndarray, n: np.ndarray) -> float:
    root = np.sqrt(n)
    fit, *_ = np.linalg.lstsq(design * root[:, None], mean * root, rcond=None)
    return float((n * (mean - design @ fit) ** 2).sum())


def _dummies(values: pd.Series) -> np.ndarray:
    return pd.get_dummies(values.astype(str)).to_numpy(dtype=float)


def anova_two_way(df: DataFrame, y: list[str], a: str, b: str) -> DataFrame:
    """Two-way analysis of variance with interaction and Type II sums of squares, per metric."""

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, ss = (pdf[c].to_numpy(dtype=float) for c in ("n", "mean", "ss"))
        in_a, in_b = _dummies(pdf[a]), _dummies(pdf[b])
        rss_a, rss_b = _residual(in_a, mean, n), _residual(in_b, mean, n)
        both = np.hstack([in_a, in_b])
        rss_both = _residual(both, mean, n)
        df_a, df_b = in_a.shape[1] - 1, in_b.shape[1] - 1
        df_ab = len(pdf) - 1 - df_a - df_b
        df_error, error = n.sum() - len(pdf), ss.sum()
        rows = []
        for term, freedom, square in ((a, df_a, rss_b - rss_both), (b, df_b, rss_a - rss_both), (f"{a}:{b}", df_ab, rss_both)):
            square = max(square, 0.0)
            f = (square / freedom) / (error / df_error) if freedom > 0 and df_error > 0 and error > 0 else float("nan")
            rows.append((term, freedom, square, f, f_tail(f, freedom, df_error)))
        rows.append(("Residual", df_error, error, None, None))
        out = pd.DataFrame(rows, columns=["term", "df", "sum_sq", "f", "p"])
        out.insert(0, "metric", pdf["metric"].iloc[0])
        return out

    return cell_stats(df, y, [a, b]).groupBy("metric").applyInPandas(table, _ANOVA)


def anova_one_way(df: DataFrame, y: list[str], group: str) -> DataFrame:
    """One-way analysis of variance per metric; fewer than two groups give no row."""

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = ["metric", "groups", "df_between", "df_within", "f", "p"]
        if len(pdf) < 2:
            return _no_rows(text=columns[:1], whole=columns[1:2], real=columns[2:])
        n, mean, ss = (pdf[c].to_numpy(dtype=float) for c in ("n", "mean", "ss"))
        grand = (n * mean).sum() / n.sum()
        between, within = (n * (mean - grand) ** 2).sum(), ss.sum()
        df1, df2 = len(pdf) - 1, n.sum() - len(pdf)
        f = (between / df1) / (within / df2) if df2 > 0 and within > 0 else float("nan")
        return pd.DataFrame([(pdf["metric"].iloc[0], len(pdf), float(df1), df2, f, f_tail(f, df1, df2))], columns=columns)

    schema = "metric string, groups bigint, df_between double, df_within double, f double, p double"
    return cell_stats(df, y, [group]).groupBy("metric").applyInPandas(table, schema)


def tukey_hsd(df: DataFrame, y: list[str], group: str, alpha: float = 0.05) -> DataFrame:
    """Every pair of groups: mean difference, adjusted p-value, confidence bounds, decision."""

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(group).reset_index(drop=True)
        groups, freedom = len(pdf), float(pdf["n"].sum() - len(pdf))
        columns = ["metric", "group1", "group2", "meandiff", "p_adj", "lower", "upper", "reject"]
        if groups < 2 or freedom <= 0:
            return _no_rows(text=columns[:3], real=columns[3:7], flag=columns[7:])
        error = pdf["ss"].sum() / freedom
        limit = studentized_range_quantile(alpha, groups, freedom)
        rows = []
        for i in range(groups):
            for j in range(i + 1, groups):
                diff = pdf["mean"][j] - pdf["mean"][i]
                scale = math.sqrt(error / 2 * (1 / pdf["n"][i] + 1 / pdf["n"][j]))
                p = studentized_range_tail(abs(diff) / scale, groups, freedom) if scale > 0 else float("nan")
                reach = limit * scale
                names = str(pdf[group][i]), str(pdf[group][j])
                rows.append((pdf["metric"][0], *names, diff, p, diff - reach, diff + reach, abs(diff) > reach))
        return pd.DataFrame(rows, columns=columns)

    schema = (
        "metric string, group1 string, group2 string, meandiff double, p_adj double, "
        "lower double, upper double, reject boolean"
    )
    return cell_stats(df, y, [group]).groupBy("metric").applyInPandas(table, schema)


def flag_significant(df: DataFrame, alpha: float = 0.05, p: str = "p") -> DataFrame:
    return df.withColumn("significant", F.coalesce(~F.isnan(p) & (F.col(p) < alpha), F.lit(False)))
