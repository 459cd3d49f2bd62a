"""Feature selection: rank correlation, mutual information, scores, correlation matrix."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brokerlens.operators.ranks import bucket_count, counted, cut_points, placed, ranked, with_offsets
from brokerlens.operators.summary import no_nan


def long_features(df: DataFrame, features: list[str], label: str, keep: list[str] = ()) -> DataFrame:
    """One row per (row, feature): feature, value, label."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    rows = df.filter(F.col(label).isNotNull()).select(*keep, F.col(label).alias("label"), F.explode(pairs).alias("_p"))
    return rows.select(*keep, "_p.feature", "_p.value", "label").filter("value IS NOT NULL")


def _all_features(df: DataFrame, features: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(f,) for f in features], "feature string")


def feature_scores(df: DataFrame, features: list[str], label: str, bins: int = 16) -> DataFrame:
    """Absolute rank correlation and binned mutual information of each feature, in one pass.

    Counts per (feature, value, label) are ranked once; what is kept of them is one
    row per (feature, bin, label). Ranks are centred on their known mean so that
    sums of squares stay accurate. A constant feature has no rank correlation.
    """
    rows = long_features(df, features, label)
    ranks = ranked(counted(rows, "value", ["feature"], ["feature"], ["label"]), "value", ["feature"])
    x, n = F.col("rank") - (F.col("n_all") + 1) / 2, F.col("n")
    # Equal values share their smallest rank and so their bin.
    bin_of = F.floor(F.col("n_before") * bins / F.col("n_all")).alias("bin")
    cells = ranks.groupBy("feature", bin_of, "label").agg(
        F.sum("n").alias("n"), F.sum(n * x).alias("x"), F.sum(n * x * x).alias("xx"), F.max("n_all").alias("t")
    )
    in_bin = F.sum("n").over(W.partitionBy("feature", "bin"))
    in_class = F.sum("n").over(W.partitionBy("feature", "label"))
    part = n / F.col("t") * F.log(n.cast("double") * F.col("t") / (in_bin.cast("double") * in_class))
    classes = cells.withColumn("part", part).groupBy("feature", "label").agg(
        *[F.sum(c).alias(c) for c in ("n", "x", "xx", "part")], F.max("t").alias("t")
    )
    # A label contributes through the sum of its centred feature ranks, so only classes are left to rank.
    below = W.partitionBy("feature").orderBy("label").rowsBetween(W.unboundedPreceding, -1)
    label_rank = F.coalesce(F.sum("n").over(below), F.lit(0)) + (n + 1) / 2
    classes = classes.withColumn("y", label_rank - (F.col("t") + 1) / 2)
    y = F.col("y")
    sums = classes.groupBy("feature").agg(
        F.sum(F.col("x") * y).alias("xy"), F.sum("xx").alias("xx"), F.sum(n * y * y).alias("yy"), F.sum("part").alias("mi")
    )
    found = sums.select(
        "feature",
        F.abs(F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy")))).alias("spearman"),
        F.greatest("mi", F.lit(0.0)).alias("mi"),
    )
    return _all_features(df, features).join(found, "feature", "left")


def spearman(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Absolute rank correlation of each feature with the label; a constant feature gets NULL."""
    return feature_scores(df, features, label).select("feature", "spearman")


def normalize_max(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Divide by the largest value, NaN and NULL left out. Meant for one row per feature."""
    best = F.max(no_nan(column)).over(W.partitionBy(F.lit(1)))
    return df.withColumn(name or f"normalized_{column}", F.try_divide(no_nan(column), best))


def _digamma(n: Column) -> Column:
    """The digamma function of a positive number: shifted up, then its asymptotic series."""
    shifts = 6
    x = n.cast("double") + shifts
    inverse = 1 / (x * x)
    series = F.log(x) - 0.5 / x - inverse * (F.lit(1 / 12) - inverse * (F.lit(1 / 120) - inverse * F.lit(1 / 252)))
    for i in range(shifts):
        series = series - 1 / (n.cast("double") + i)
    return series


def mutual_information(
    df: DataFrame, features: list[str], label: str, method: str = "binned", bins: int = 16, k: int = 3
) -> DataFrame:
    """Mutual information in nats between each feature and the class label, never below 0.

    ``binned`` cuts values at their rank quantiles; ``neighbours`` estimates from
    the distance to the k-th nearest row of the same class. In the latter a value
    with more than k copies in its class counts k neighbours there and as many of
    other classes as their share of the copies asks for, which is what noise too
    small to matter would give on average. NULL and NaN take no part.
    """
    if method == "binned":
        return feature_scores(df, features, label, bins).select("feature", "mi")
    found = _neighbours(long_features(df, features, label), k)
    return _all_features(df, features).join(found, "feature", "left")


def _kth_distance(window: W, k: int) -> Column:
    """Distance to the k-th nearest of the rows around the current one, in one sorted class."""
    value = F.col("value")
    around = [F.abs(F.lag("value", i).over(window) - value) for i in range(1, k + 1)]
    around += [F.abs(F.lead("value", i).over(window) - value) for i in range(1, k + 1)]
    near = F.array_sort(F.array_compact(F.array(*around)))
    # A class of fewer than k + 1 rows uses as many neighbours as it has.
    return F.get(near, F.least(F.lit(k), F.size(near)) - 1)


def _neighbours(rows: DataFrame, k: int) -> DataFrame:
    rows = rows.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    buckets = bucket_count(rows)
    cuts = cut_points(rows, "value", ["feature"], buckets)
    counts = rows.groupBy("feature", "label", "value").agg(F.count("*").alias("n"))
    counts = placed(counts, "value", ["feature"], cuts, buckets)
    # Copies are neighbours at distance 0, and more than k of them decide the radius, so k + 1 stand for all.
    few = counts.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k + 1)).cast("int"))))
    cell = W.partitionBy("feature", "label", "_bucket")
    place = few.withColumn("_i", F.row_number().over(cell.orderBy("value", "_copy")))
    place = place.withColumn("_m", F.count("*").over(cell)).withColumn("_r", _kth_distance(cell.orderBy("value", "_copy"), k))
    inner = (F.col("_i") > k) & (F.col("_i") <= F.col("_m") - k)
    rim = (F.col("_i") <= 2 * k) | (F.col("_i") > F.col("_m") - 2 * k)
    whole_class = W.partitionBy("feature", "label").orderBy("value", "_copy")
    edge = place.filter(rim).withColumn("_r", _kth_distance(whole_class, k)).filter(~inner)
    radii = place.filter(inner).unionByName(edge)
    # A class of one row has no neighbour, and so no radius; it takes no further part.
    radii = radii.groupBy("feature", "label", "value").agg(F.max("n").alias("n"), F.max("_r").alias("radius"))
    radii = radii.filter("radius IS NOT NULL")
    # Points strictly inside the radius: those below the upper end, less those not above the lower end.
    points = radii.groupBy("feature", "value").agg(F.sum("n").alias("here"))
    both = F.array(
        F.struct((F.col("value") + F.col("radius")).alias("end"), F.lit(1).alias("side")),
        F.struct((F.col("value") - F.col("radius")).alias("end"), F.lit(-1).alias("side")),
    )
    ends = radii.select("feature", "label", F.col("value").alias("at"), "n", "radius", F.explode(both).alias("_e"))
    ends = ends.select("feature", "label", "at", "n", "radius", F.col("_e.end").alias("value"), "_e.side")
    wanted = ends.select("feature", "value").distinct().withColumn("here", F.lit(0).cast("bigint"))
    line = points.unionByName(wanted).groupBy("feature", "value").agg(F.sum("here").alias("here"))
    line = with_offsets(placed(line, "value", ["feature"], cuts, buckets), ["feature"], "value", ["here"])
    met = ends.join(line.select("feature", "value", F.col("here_before").alias("below"), "here"), ["feature", "value"])
    count = F.sum(F.when(F.col("side") == 1, F.col("below")).otherwise(-(F.col("below") + F.col("here"))))
    inside = met.groupBy("feature", "label", "at", "n", "radius").agg(count.alias("m"))
    # At radius 0 both ends are the point itself, which leaves its copies in all classes, counted negatively.
    tied = F.least(F.lit(k), F.col("n") - 1) * -F.col("m") / F.col("n")
    m = F.greatest(F.when(F.col("radius") == 0, tied).otherwise(F.col("m").cast("double")), F.lit(1.0))
    cells = inside.groupBy("feature", "label").agg(
        F.sum("n").alias("n_class"), F.sum(F.col("n") * _digamma(m)).alias("psi_m")
    )
    size = F.col("n_class")
    term = size * (_digamma(F.least(F.lit(k), size - 1)) - _digamma(size)) - F.col("psi_m")
    sums = cells.groupBy("feature").agg(F.sum(term).alias("s"), F.sum("n_class").alias("t"))
    return sums.select("feature", F.greatest(_digamma(F.col("t")) + F.col("s") / F.col("t"), F.lit(0.0)).alias("mi"))


def aggregate_scores(scores: DataFrame, information: DataFrame | None = None) -> DataFrame:
    """Sum of both normalised scores per feature; NULL if either is missing.

    ``information`` replaces the mutual information that ``scores`` came with.
    """
    both = scores if information is None else scores.select("feature", "spearman").join(information, "feature")
    both = normalize_max(normalize_max(both, "spearman"), "mi")
    return both.withColumn("score", F.col("normalized_spearman") + F.col("normalized_mi"))


def select_features(scores: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Features whose score is strictly above the threshold."""
    return scores.filter(no_nan("score") > threshold)


def pearson_matrix(df: DataFrame, columns: list[str], lower: bool = False) -> DataFrame:
    """Pairwise correlation in long form, all pairs in one aggregate."""
    pairs = [(b, a) for a, b in combinations_with_replacement(columns, 2)]
    # A pair without variance would divide by zero, so its correlation is computed from moments.
    found = [
        F.try_divide(F.covar_pop(a, b), F.nullif(_both_std(a, b), F.lit(0.0))).alias(f"c{i}")
        for i, (a, b) in enumerate(pairs)
    ]
    wide = df.agg(*found)
    cells = []
    for i, (a, b) in enumerate(pairs):
        if a == b and lower:
            continue
        cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")))
        if a != b and not lower:
            cells.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"c{i}").alias("r")))
    return wide.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def _both_std(a: str, b: str) -> Column:
    """Product of both deviations over the rows where both columns have a value."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.stddev_pop(F.when(both, F.col(a))) * F.stddev_pop(F.when(both, F.col(b)))
