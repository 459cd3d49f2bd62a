"""Workload classification with Spark ML: splits, folds, scaling, training, scoring, evaluation."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool
from statistics import fmean, pstdev

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brokerlens.functions.scalars import CLASS_NAMES
from brokerlens.operators import logistic
from brokerlens.operators.ranks import bucket_count


def class_positions(df: DataFrame, label: str, ids: list[str], seed: int = 42, buckets: int | None = None) -> DataFrame:
    """Add ``_position`` (from 1, in seeded hash order) and ``_size`` within each class.

    Hashes are spread evenly, so equal hash ranges of a class are equal shares of
    it: a window numbers one range, and range totals supply the offset.
    """
    buckets = buckets or bucket_count(df)
    hashed = F.xxhash64(F.lit(seed), *[F.col(c) for c in ids])
    rows = df.withColumn("_hash", hashed).withColumn("_range", F.shiftright(F.col("_hash"), 64 - buckets.bit_length() + 1))
    totals = rows.groupBy(label, "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy(label).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        label,
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(W.partitionBy(label)).alias("_size"),
    )
    inside = W.partitionBy(label, "_range").orderBy("_hash", *ids)
    # The window already partitions by class and range, so the join moves only the totals.
    placed = rows.withColumn("_row", F.row_number().over(inside)).join(offsets, [label, "_range"])
    return placed.withColumn("_position", F.col("_row") + F.col("_offset")).drop("_hash", "_range", "_row", "_offset")


def stratified_split(df: DataFrame, label: str, ids: list[str], test: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split``: in every class, exactly the rounded share of rows is ``test``."""
    placed = class_positions(df, label, ids, seed)
    split = F.when(F.col("_position") <= F.round(F.col("_size") * test), "test").otherwise("train")
    return placed.withColumn("split", split).drop("_position", "_size")


def stratified_folds(df: DataFrame, label: str, ids: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``: each class is dealt out evenly over k folds."""
    placed = class_positions(df, label, ids, seed)
    return placed.withColumn("fold", F.pmod("_position", F.lit(k)).cast("int")).drop("_position", "_size")


def _moments(df: DataFrame, columns: list[str]):
    return df.agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"{c}__mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}__std") for c in columns],
    ).first()


def fit_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, one aggregate; a constant column scales by 1."""
    return _as_scaler(_moments(df, columns), columns)


def _as_scaler(row, columns: list[str]) -> dict[str, tuple[float, float]]:
    return {c: (row[f"{c}__mean"] or 0.0, row[f"{c}__std"] or 1.0) for c in columns}


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - mean) / std for c, (mean, std) in scaler.items()})


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns standardised by their own mean and population deviation, without an action.

    All of them are one row of one scalar subquery, so the input is read once for them.
    """
    both = [F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns]
    known = df.agg(F.struct(*both)).scalar()
    std = {c: F.coalesce(F.nullif(known[c]["std"], F.lit(0.0)), F.lit(1.0)) for c in columns}
    return df.withColumns({c: (F.col(c) - known[c]["mean"]) / std[c] for c in columns})


def _scaling_stage(scaler: dict[str, tuple[float, float]]) -> SQLTransformer:
    terms = [f"(`{c}` - ({mean!r}D)) / {std!r}D AS `_scaled_{c}`" for c, (mean, std) in scaler.items()]
    return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


def _clean(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    names = [*features, label] if label else features
    return df.dropna(subset=names)


def train_classifier(
    df: DataFrame, features: list[str], label: str, strength: float = 1.0, max_iter: int = 1000,
    scaler: dict[str, tuple[float, float]] | None = None,
) -> PipelineModel:
    """Standardise and fit a logistic regression with an L2 penalty of inverse strength ``strength``."""
    rows = _clean(df, features, label).select(*features, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        moments = _moments(rows, features)
        scaler, n = scaler or _as_scaler(moments, features), moments["n"]
        stages = [
            _scaling_stage(scaler),
            VectorAssembler(inputCols=[f"_scaled_{f}" for f in features], outputCol="_vector"),
            LogisticRegression(
                featuresCol="_vector", labelCol=label, regParam=1.0 / (strength * max(n, 1)), elasticNetParam=0.0,
                standardization=False, maxIter=max_iter, tol=1e-12,
            ),
        ]
        return Pipeline(stages=stages).fit(rows)
    finally:
        rows.unpersist()


def classify(df: DataFrame, model: PipelineModel, features: list[str]) -> DataFrame:
    """Add prediction, both probabilities, confidence, type and error.

    A row that lacks a required feature, or has NaN there, keeps a NULL prediction, type UNKNOWN,
    confidence 0 and names the first missing feature.
    """
    filled = df.withColumns({f"_given_{f}": F.col(f) for f in features})
    known = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    filled = filled.withColumn("_missing", F.coalesce(*(F.when(known[f].isNull(), F.lit(f"_given_{f}")) for f in features)))
    filled = filled.withColumns({f: F.coalesce(known[f], F.lit(0.0)) for f in features})
    scored = model.transform(filled)
    missing = F.col("_missing")
    known = missing.isNull()
    chance = vector_to_array("probability")
    code = F.col("prediction").cast("int")
    confidence = chance[code] * 100
    return scored.select(
        *[F.col(f"_given_{c}").alias(c) if c in features else F.col(c) for c in df.columns],
        F.when(known, code).alias("prediction"),
        F.when(known, F.create_map(F.lit(CLASS_NAMES[0]), chance[0] * 100, F.lit(CLASS_NAMES[1]), chance[1] * 100)).alias(
            "probabilities"
        ),
        F.when(known, confidence).otherwise(0.0).alias("confidence"),
        F.when(known, F.when(code == 0, CLASS_NAMES[0]).otherwise(CLASS_NAMES[1])).otherwise("UNKNOWN").alias("type"),
        F.when(~known, F.concat(F.lit("Missing required feature: "), F.regexp_replace(missing, "^_given_", ""))).alias("error"),
    )


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] = ()) -> DataFrame:
    pairs = df.select(*by, F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction"))
    return pairs.groupBy(*by, "label", "prediction").agg(F.count("*").alias("count"))


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] = ()
) -> DataFrame:
    """Precision, recall, F1 and support per class, with overall accuracy and macro F1 on each row; per group of ``by``.

    Rows without a prediction count as misses of their class; they are no class of their own.
    Rows without a label are left out.
    """
    counts = confusion(df, label, prediction, by).filter("label IS NOT NULL")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)
    sides = F.explode(
        F.array(
            F.struct(F.col("label").alias("class"), F.col("count").alias("actual"), F.lit(0).cast("bigint").alias("claimed"), hit.alias("hit")),
            F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("count").alias("claimed"), F.lit(0).cast("bigint").alias("hit")),
        )
    )
    classes = counts.select(*by, sides.alias("_s")).select(*by, "_s.*").filter("class IS NOT NULL").groupBy(*by, "class")
    sums = classes.agg(F.sum("actual").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hit").alias("hit"))
    precision = F.coalesce(F.try_divide("hit", "claimed"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    scored = sums.withColumns({"precision": precision, "recall": recall})
    both = F.col("precision") + F.col("recall")
    scored = scored.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), both), F.lit(0.0)))
    everything = W.partitionBy(*by or [F.lit(1)])
    return scored.withColumns(
        {
            "accuracy": F.sum("hit").over(everything) / F.sum("support").over(everything),
            "macro_f1": F.avg("f1").over(everything),
        }
    ).drop("claimed", "hit")


def forest(features: list[str], label: str, trees: int = 100, depth: int = 12, seed: int = 42) -> Pipeline:
    """Each row's node in every tree is kept from level to level, so that no level walks the trees from their roots."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="_vector"),
            RandomForestClassifier(
                featuresCol="_vector", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed,
                featureSubsetStrategy="sqrt", cacheNodeIds=True, checkpointInterval=-1,
            ),
        ]
    )


#: Rows of a partition when folds are scored; a smaller table stays as it is.
DEALT = 50_000

_SCORES = "n_features int, accuracy_mean double, accuracy_std double, f1_mean double, f1_std double"


def _fold_scores(
    df: DataFrame, sets: list[list[str]], label: str, ids: list[str], fit, k: int, seed: int, parallelism: int
) -> list[tuple]:
    """Scores of every feature set over the same stratified folds.

    Fits of all sets and folds are independent jobs, so several run at a time;
    each one is distributed by Spark. Rows are reduced to the needed columns and kept; those of
    a large table are dealt out evenly, since folds leave whole classes in one partition.
    """
    names = sorted({f for features in sets for f in features})
    if not names:
        return [(0, 0.0, 0.0, 0.0, 0.0) for _ in sets]
    rows = stratified_folds(_clean(df, names, label), label, ids, k, seed).select(*names, label, "fold")
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)

    def score(job: tuple[int, int]) -> tuple[float, float]:
        features, fold = sets[job[0]], job[1]
        fitted = fit(rows.filter(F.col("fold") != fold).select(*features, label), features)
        tested = fitted.transform(rows.filter(F.col("fold") == fold).select(*features, label))
        found = classification_report(tested, label).select("accuracy", "macro_f1").first()
        return found["accuracy"], found["macro_f1"]

    jobs = [(i, fold) for i, features in enumerate(sets) if features for fold in range(k)]
    try:
        rows = _dealt(rows)
        with ThreadPool(parallelism) as pool:
            scores = dict(zip(jobs, pool.map(inheritable_thread_target(score), jobs)))
    finally:
        rows.unpersist()
    out = []
    for i, features in enumerate(sets):
        if not features:
            out.append((0, 0.0, 0.0, 0.0, 0.0))
            continue
        accuracy, f1 = zip(*[scores[i, fold] for fold in range(k)])
        out.append((len(features), fmean(accuracy), pstdev(accuracy), fmean(f1), pstdev(f1)))
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    """Kept rows in partitions of about ``DEALT``; kept again if they had to be dealt out."""
    n = rows.count()
    if n <= DEALT:
        return rows
    even = rows.repartition(-(-n // DEALT)).persist(StorageLevel.MEMORY_AND_DISK)
    even.count()
    rows.unpersist()
    return even


def out_of_fold(
    df: DataFrame, features: list[str], label: str, ids: list[str], k: int = 5, seed: int = 42,
    scaler: dict[str, tuple[float, float]] | None = None, strength: float = 1.0,
) -> DataFrame:
    """Each row's ``fold``, ``chance`` of class 1 and ``prediction`` by the regression fitted to the other folds.

    Labels are 0 and 1. Rows with a null feature or label are left out.
    """
    rows = stratified_folds(_clean(df, features, label), label, ids, k, seed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fits = logistic.fit_folds(rows, features, label, "fold", k, strength, scaler)
    finally:
        rows.unpersist()
    scored = rows.withColumn("chance", logistic.chance(fits, "fold"))
    return scored.withColumn("prediction", (F.col("chance") > 0.5).cast("int"))


def cross_validate(
    df: DataFrame, features: list[str], label: str, ids: list[str], estimator: Estimator | None = None, k: int = 5,
    seed: int = 42, scaler: dict[str, tuple[float, float]] | None = None, parallelism: int = 4,
) -> DataFrame:
    """Accuracy and macro F1 over stratified folds: mean and population deviation, one row.

    Without an estimator a scaled logistic regression is used; its scaler is fitted
    inside each fold unless one fitted elsewhere is passed in. With labels 0 and 1 its folds
    share their passes over the rows; other labels are fitted fold by fold.
    """
    if estimator is None and features:
        rows = stratified_folds(_clean(df, features, label), label, ids, k, seed).select(*features, label, "fold")
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if rows.filter(~F.col(label).isin(0, 1)).isEmpty():
                chance = logistic.chance(logistic.fit_folds(rows, features, label, "fold", k, scaler=scaler), "fold")
                scored = rows.withColumn("prediction", (chance > 0.5).cast("int"))
                report = classification_report(scored, label, by=["fold"])
                found = report.groupBy("fold").agg(F.any_value("accuracy"), F.any_value("macro_f1")).collect()
                accuracy, f1 = [r[1] for r in found], [r[2] for r in found]
                score = (len(features), *(g(v) if v else None for v in (accuracy, f1) for g in (fmean, pstdev)))
                return df.sparkSession.createDataFrame([score], _SCORES)
        finally:
            rows.unpersist()

    def fit(train: DataFrame, names: list[str]):
        if estimator is not None:
            return estimator.fit(train)
        return train_classifier(train, names, label, scaler=scaler)

    scores = _fold_scores(df, [features], label, ids, fit, k, seed, parallelism)
    return df.sparkSession.createDataFrame(scores, _SCORES)


# Score thresholds tried by the sweep.
THRESHOLDS = [0.8, 1.0, 1.2, 1.4, 1.6, 1.8]


def threshold_sweep(
    df: DataFrame, scores: DataFrame, label: str, ids: list[str], thresholds: list[float] = THRESHOLDS,
    trees: int = 100, depth: int = 12, k: int = 5, seed: int = 42, parallelism: int = 4,
) -> DataFrame:
    """Cross-validated forest per threshold; equal feature sets are fitted once."""
    ranked = [(r["feature"], r["score"]) for r in scores.select("feature", "score").orderBy("feature").collect()]
    chosen = [tuple(f for f, s in ranked if s is not None and s > t) for t in thresholds]
    sets = list(dict.fromkeys(chosen))
    fit = _forest_fit(label, trees, depth)
    found = dict(zip(sets, _fold_scores(df, [list(s) for s in sets], label, ids, fit, k, seed, parallelism)))
    rows = [(float(t), ", ".join(c) or "None", *found[c]) for t, c in zip(thresholds, chosen)]
    return df.sparkSession.createDataFrame(rows, f"threshold double, features string, {_SCORES}")


def _forest_fit(label: str, trees: int, depth: int):
    return lambda train, names: forest(names, label, trees, depth).fit(train)


def _names(model: Model | PipelineModel) -> list[str]:
    stages = model.stages
    assembler = next(s for s in stages if isinstance(s, VectorAssembler))
    return [n.removeprefix("_scaled_") for n in assembler.getInputCols()]


def importances(model: PipelineModel, spark: SparkSession | None = None) -> DataFrame:
    """Importance of each feature of a forest, largest first."""
    spark = spark or SparkSession.active()
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    rows = spark.createDataFrame(list(zip(_names(model), values)), "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature")


def coefficients(model: PipelineModel, spark: SparkSession | None = None) -> DataFrame:
    """Coefficient of each feature of a logistic regression, largest first."""
    spark = spark or SparkSession.active()
    values = [float(v) for v in model.stages[-1].coefficients.toArray()]
    rows = spark.createDataFrame(list(zip(_names(model), values)), "feature string, coefficient double")
    return rows.orderBy(F.desc("coefficient"), "feature")


def compare_feature_sets(
    df: DataFrame, sets: dict[str, list[str]], label: str, ids: list[str], trees: int = 100, depth: int = 12, k: int = 5,
    seed: int = 42, parallelism: int = 4,
) -> DataFrame:
    """Cross-validated accuracy and F1 of named feature sets, one row each."""
    scores = _fold_scores(df, list(sets.values()), label, ids, _forest_fit(label, trees, depth), k, seed, parallelism)
    rows = [(name, n, accuracy, f1) for name, (n, accuracy, _, f1, _) in zip(sets, scores)]
    return df.sparkSession.createDataFrame(rows, "feature_set string, features int, accuracy double, f1 double")
