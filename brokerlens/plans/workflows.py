"""The three ways the operators are used together.

Offline: telemetry table to selected features, comparison and trained model.
Analysis: recovery log to statistics. Online lives in ``streaming.jobs``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlens.functions.scalars import CONFIGURATION_NAMES, batch_or_real_time, impute_mean, recode, scale
from brokerlens.operators import features, joins, model, sequence, stats, summary
from brokerlens.schemas import MODEL_FEATURES
from brokerlens.sources.sinks import write_result


@dataclass
class Selection:
    """Everything feature selection finds."""

    scores: DataFrame
    selected: list[str]
    sweep: DataFrame
    importances: DataFrame | None
    final: DataFrame
    comparison: DataFrame

    def write(self, folder: str) -> None:
        """Result tables as CSV folders."""
        tables = {
            "aggregated_feature_importance": summary.sort_scores(self.scores, "score"),
            "threshold_evaluation": self.sweep,
            "feature_set_comparison": self.comparison,
            "final_cross_validation": self.final,
        }
        if self.importances is not None:
            tables["rf_feature_importance"] = self.importances
        for name, table in tables.items():
            write_result(table, f"{folder}/{name}")


def choose_features(
    df: DataFrame, names: list[str], label: str, ids: list[str], threshold: float = 0.8, method: str = "neighbours",
    trees: int = 100, depth: int = 12, k: int = 5,
) -> Selection:
    """Impute, score by rank correlation plus mutual information, sweep thresholds, compare with all features."""
    rows = impute_mean(df.filter(F.col(label).isNotNull()).select(*ids, label, *names), names)
    rows = rows.withColumn(label, F.col(label).cast("int")).persist()
    try:
        information = None if method == "binned" else features.mutual_information(rows, names, label, method)
        scores = features.aggregate_scores(features.feature_scores(rows, names, label), information)
        # One row per feature; kept as literals so that later steps do not score again.
        found = scores.collect()
        scores = df.sparkSession.createDataFrame(found, scores.schema)
        selected = [r["feature"] for r in found if r["score"] is not None and r["score"] > threshold]
        sweep = model.threshold_sweep(rows, scores, label, ids, trees=trees, depth=depth, k=k)
        fitted = model.forest(selected, label, trees, depth).fit(rows) if selected else None
        importances = model.importances(fitted, df.sparkSession) if fitted else None
        estimator = model.forest(selected, label, trees, depth) if selected else None
        final = model.cross_validate(rows, selected, label, ids, estimator, k)
        sets = {"All Features": names, "Selected Features": selected}
        comparison = model.compare_feature_sets(rows, sets, label, ids, trees, depth, k)
    finally:
        rows.unpersist()
    return Selection(scores, selected, sweep, importances, final, comparison)


@dataclass
class Training:
    model: PipelineModel
    report: DataFrame
    confusion: DataFrame
    folds: DataFrame
    coefficients: DataFrame


def train(
    df: DataFrame, label: str, ids: list[str], names: list[str] = MODEL_FEATURES, test: float = 0.2, seed: int = 42, k: int = 5
) -> Training:
    """Stratified split, scaled logistic regression, evaluation on the held-out part, cross-validation."""
    rows = model.stratified_split(df.dropna(subset=[*names, label]), label, ids, test, seed)
    fitted = model.train_classifier(rows.filter("split = 'train'"), names, label)
    scored = model.classify(rows.filter("split = 'test'"), fitted, names)
    return Training(
        fitted,
        model.classification_report(scored, label),
        model.confusion(scored, label),
        model.cross_validate(df, names, label, ids, k=k, seed=seed),
        model.coefficients(fitted, df.sparkSession),
    )


METRICS = summary.METRICS


def analysis_rows(recovery: DataFrame) -> DataFrame:
    """Recovery rows with display names, CPU in percent, two workloads and their combined group."""
    rows = recode(recovery, "config_source", CONFIGURATION_NAMES, "configuration")
    rows = scale(rows, "cpu_usage_percent", 100.0)
    rows = rows.withColumn("workload_strategy", batch_or_real_time("workload_type"))
    return rows.withColumn("group", F.concat_ws("_", "configuration", "workload_strategy"))


def compare_configurations(recovery: DataFrame) -> dict[str, DataFrame]:
    """Two-way tests, pairwise tests, group statistics and percentage differences."""
    rows = analysis_rows(recovery)
    keys = ["configuration", "workload_strategy"]
    return {
        "anova": stats.flag_significant(stats.anova_two_way(rows, METRICS, *keys)),
        "tukey": stats.tukey_hsd(rows, METRICS, "group"),
        "summary": summary.summarize(rows, keys, METRICS, ["mean", "std", "min", "max"]),
        "difference": summary.percent_diff(rows, ["workload_strategy"], METRICS),
    }


def recovery_statistics(recovery: DataFrame) -> dict[str, DataFrame]:
    """The tables of the recovery statistics report."""
    time, resources = ["recovery_time_seconds"], ["cpu_usage_percent", "memory_usage_percent"]
    health = ["under_replicated_before", "under_replicated_after", "offline_before", "offline_after"]
    return {
        "overview": summary.overview(recovery),
        "by_strategy": summary.summarize(recovery, ["strategy"], time, digits=2),
        "resources": summary.summarize(recovery, ["strategy"], resources, ["mean"], digits=2),
        "by_workload": summary.summarize(recovery, ["workload_type"], time, digits=2),
        "success": summary.success_rate(recovery, ["strategy"]),
        "trend": sequence.trend(recovery),
        "correlation": features.pearson_matrix(recovery, [*time, *resources, *health], lower=True),
    }


def recovery_window(metrics: DataFrame, classifications: DataFrame, gap: float = 10.0, minutes: float = 2.0):
    """Find the recovery period, then recovery times, resource use and the strategy test inside it."""
    period = sequence.recovery_period(metrics, gap, minutes)
    inside = joins.within_period(metrics, period)
    usage = ["cpu_usage", "memory_usage"]
    near = joins.asof_nearest(classifications, inside.select("timestamp", *usage), "timestamp", prefix="")
    near = near.select("selected_strategy", *usage)
    return {
        "period": period,
        "metrics": inside,
        "recovery_times": summary.recovery_time(inside),
        "resources": summary.summarize(inside, ["workload_type"], usage, ["mean", "max", "min"], nested=True),
        "anova": stats.flag_significant(stats.anova_one_way(near, usage, "selected_strategy")),
    }
