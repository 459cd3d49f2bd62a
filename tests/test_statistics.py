import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brokerlens.operators import features, logistic, model, ranks, stats, summary
from brokerlens.plans import workflows

# Recovery seconds of a published 120-row comparison, 30 per cell.
CELLS = {
    ("default", "REAL_TIME_EVENT_DRIVEN"): "12.58971 11.82715 12.61452 12.55116 11.97074 12.14824 15.27464 15.82068 15.43854 16.8982 11.62957 15.76137 17.34445 14.42889 17.74543 14.07933 17.57982 15.18173 11.7079 10.19534 16.22248 14.25857 16.47111 17.61594 16.83104 11.87739 17.60007 10.3325 10.3109 11.96248",
    ("default", "BATCH_DATA_INTENSIVE"): "20.47399 22.32114 18.89544 18.19259 21.12759 21.55399 24.94731 24.96947 15.03433 19.77383 22.59792 18.09428 21.17788 17.64526 18.74118 20.60699 17.37606 21.60162 21.9057 19.60851 21.10817 16.88164 15.63866 19.32325 23.34076 24.23931 15.61089 18.78468 16.36488 19.83946",
    ("buffer", "REAL_TIME_EVENT_DRIVEN"): "16.06927 13.64734 10.58781 17.16975 15.99249 13.76313 11.81474 14.29108 15.55285 12.25714 17.94909 12.19096 11.58664 15.76492 16.85462 10.55909 10.61592 13.76561 13.62907 10.82209 10.33166 15.67094 14.58712 14.73506 10.01306 14.5733 15.23085 17.58478 14.00402 15.20168",
    ("buffer", "BATCH_DATA_INTENSIVE"): "16.91696 15.2846 19.54348 15.51544 19.95877 24.14145 20.01146 15.81425 16.73653 15.01264 24.86067 20.97928 16.4106 21.19146 18.20777 18.839 23.41079 21.20156 21.64378 19.96415 21.541 24.92496 17.65983 24.36695 23.29779 24.58816 19.83651 18.33136 23.08553 17.79941",
}


@pytest.fixture(scope="module")
def recovery(spark):
    rows = [
        (c, w, float(v), 0.01 * i, float(i % 7))
        for (c, w), text in CELLS.items()
        for i, v in enumerate(text.split())
    ]
    schema = "config_source string, workload_type string, recovery_time_seconds double, cpu_usage_percent double, memory_usage_percent double"
    return spark.createDataFrame(rows, schema)


def test_group_means_and_two_way_test(recovery):
    found = workflows.compare_configurations(recovery)
    means = {(r["configuration"], r["workload_strategy"]): r["recovery_time_seconds_mean"] for r in found["summary"].collect()}
    assert means["baseline", "batch"] == pytest.approx(19.9259, abs=1e-4)
    assert means["ARMS", "batch"] == pytest.approx(20.0359, abs=1e-4)
    assert means["baseline", "real-time"] == pytest.approx(14.2090, abs=1e-4)
    assert means["ARMS", "real-time"] == pytest.approx(13.8939, abs=1e-4)
    f = {r["term"]: r for r in found["anova"].filter("metric = 'recovery_time_seconds'").collect()}
    assert f["configuration"]["f"] == pytest.approx(0.0438, abs=1e-4)
    assert f["workload_strategy"]["f"] == pytest.approx(146.4591, abs=1e-3)
    assert f["configuration:workload_strategy"]["f"] == pytest.approx(0.1882, abs=1e-4)
    assert f["Residual"]["df"] == 116
    assert not f["configuration"]["significant"] and f["workload_strategy"]["significant"]
    change = {(r["workload_strategy"], r["metric"]): r for r in found["difference"].collect()}
    assert change["real-time", "recovery_time_seconds"]["percent"] == pytest.approx(-2.22, abs=0.01)
    assert change["batch", "recovery_time_seconds"]["percent"] == pytest.approx(0.55, abs=0.01)
    pairs = {(r["group1"], r["group2"]): r for r in found["tukey"].filter("metric = 'recovery_time_seconds'").collect()}
    assert pairs["ARMS_batch", "ARMS_real-time"]["meandiff"] == pytest.approx(-6.142, abs=1e-3)
    assert pairs["ARMS_batch", "ARMS_real-time"]["reject"]
    assert pairs["ARMS_batch", "baseline_batch"]["p_adj"] == pytest.approx(0.9986, abs=5e-4)


@pytest.mark.parametrize("f, a, b, p", [(4.965, 1, 10, 0.05), (3.098, 3, 20, 0.05), (10.044, 1, 10, 0.01), (2.758, 3, 60, 0.05), (1.0, 5, 5, 0.5)])
def test_f_tail_against_tables(f, a, b, p):
    assert stats.f_tail(f, a, b) == pytest.approx(p, abs=2e-4)


@pytest.mark.parametrize("q, k, df, p", [(3.877, 3, 10, 0.05), (3.737, 4, 60, 0.05), (3.633, 4, 1_000_000, 0.05), (5.270, 3, 10, 0.01), (2.772, 2, 1e9, 0.05)])
def test_range_tail_against_tables(q, k, df, p):
    assert stats.studentized_range_tail(q, k, df) == pytest.approx(p, abs=3e-4)
    assert stats.studentized_range_quantile(p, k, df) == pytest.approx(q, abs=2e-2)


def test_two_way_with_unequal_cells_matches_full_regression(spark):
    rnd = np.random.default_rng(3)
    rows = [(a, b, float(rnd.normal(i + 2 * j + (i == j), 1))) for i, a in enumerate("xyz") for j, b in enumerate("pq") for _ in range(int(rnd.integers(3, 30)))]
    pdf = pd.DataFrame(rows, columns=["a", "b", "v"])

    def rss(*terms):
        design = np.hstack([pd.get_dummies(t).to_numpy(float) for t in terms])
        fit = np.linalg.lstsq(design, pdf.v, rcond=None)[0]
        return ((pdf.v - design @ fit) ** 2).sum()

    cell = pdf.a + pdf.b
    expected = {"a": rss(pdf.b) - rss(pdf.a, pdf.b), "b": rss(pdf.a) - rss(pdf.a, pdf.b), "a:b": rss(pdf.a, pdf.b) - rss(cell), "Residual": rss(cell)}
    out = {r["term"]: r["sum_sq"] for r in stats.anova_two_way(spark.createDataFrame(pdf), ["v"], "a", "b").collect()}
    assert out == pytest.approx(expected)


def test_one_way_needs_two_groups(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, v double")
    assert stats.anova_one_way(rows, ["v"], "g").count() == 0
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.0)], "g string, v double")
    assert stats.anova_one_way(rows, ["v"], "g").first()["f"] == pytest.approx(13.5)


@pytest.mark.parametrize("buckets_of", [2, 4, 16])
def test_average_rank_and_quantiles(spark, buckets_of):
    rnd = random.Random(buckets_of)
    rows = [(rnd.choice("ab"), float(rnd.choice([0, 1, 5]) if rnd.random() < 0.5 else rnd.randint(-50, 50))) for _ in range(400)]
    pdf = pd.DataFrame(rows, columns=["k", "v"])
    df = spark.createDataFrame(pdf)
    counts = ranks.counted(df, "v", ["k"], buckets=buckets_of)
    expected = pdf.assign(r=pdf.groupby("k").v.rank())
    expected = {(k, v): r for k, v, r in expected.itertuples(index=False)}
    assert {(r["k"], r["v"]): r["rank"] for r in ranks.ranked(counts, "v", ["k"]).collect()} == expected
    for row in ranks.exact_quantiles(counts, "v", ["k"], {"a": 0.25, "b": 0.5, "c": 0.9}).collect():
        values = pdf[pdf.k == row["k"]].v
        assert [row["a"], row["b"], row["c"]] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.9])))
    assert ranks.average_rank(df, "v", ["k"]).count() == 400


def test_box_statistics(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0, None, float("nan")]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    row = summary.box_stats(df, ["g"], "v").first()
    assert (row["n"], row["q1"], row["median"], row["q3"]) == (5, 2.0, 3.0, 4.0)
    assert (row["whisker_low"], row["whisker_high"], row["outliers"]) == (1.0, 4.0, 1)
    assert [r["v"] for r in summary.box_outliers(df, ["g"], "v").collect()] == [100.0]
    assert summary.box_stats(df, ["g"], "v", exact=False).first()["median"] == 3.0


def random_classes(seed=1, n=150):
    rnd = np.random.default_rng(seed)
    label = rnd.integers(0, 2, n)
    return pd.DataFrame({
        "id": range(n), "label": label, "a": rnd.normal(0, 1, n) * 8 + label * 12, "b": rnd.integers(0, 5, n).astype(float),
        "c": np.round(rnd.normal(0, 4, n)), "flat": 1.0,
    })


def neighbours_brute_force(x, y, k=3):
    psi = lambda n: (math.lgamma(n + 1e-5) - math.lgamma(n - 1e-5)) / 2e-5
    total = 0.0
    for i in range(len(x)):
        same = np.sort(np.abs(np.delete(x[y == y[i]], np.flatnonzero(np.flatnonzero(y == y[i]) == i)) - x[i]))
        size = len(same) + 1
        kk = min(k, size - 1)
        r = same[kk - 1]
        # Among copies the k nearest of the class come with their share of the other classes' copies.
        m = kk * (x == x[i]).sum() / ((x == x[i]) & (y == y[i])).sum() if r == 0 else (np.abs(x - x[i]) < r).sum()
        total += psi(kk) - psi(size) - psi(m)
    return max(psi(len(x)) + total / len(x), 0)


def test_scores(spark):
    pdf = random_classes()
    pdf["a"] = np.round(pdf.a * 4) / 4  # halves and quarters add without rounding
    df, names = spark.createDataFrame(pdf), ["a", "b", "c", "flat"]
    found = {r["feature"]: r for r in features.feature_scores(df, names, "label").collect()}
    for name in names[:3]:
        expected = abs(np.corrcoef(pdf[name].rank(), pdf.label.rank())[0, 1])
        assert found[name]["spearman"] == pytest.approx(expected)
    assert found["flat"]["spearman"] is None and found["flat"]["mi"] == 0
    near = {r["feature"]: r["mi"] for r in features.mutual_information(df, names[:3], "label", "neighbours").collect()}
    for name in names[:3]:
        assert near[name] == pytest.approx(neighbours_brute_force(pdf[name].to_numpy(), pdf.label.to_numpy()), abs=1e-6)


def test_neighbours_of_tied_values_and_missing_ones(spark):
    rows = [(i, i % 2, float(i % 2), float(i % 4), float(i % 3), 0.001 * i) for i in range(240)]
    pdf = pd.DataFrame(rows, columns=["id", "label", "same", "four", "apart", "x"])
    names = ["same", "four", "apart"]
    found = {r["feature"]: r["mi"] for r in features.mutual_information(spark.createDataFrame(pdf), names, "label", "neighbours").collect()}
    # The label itself and values that tell it have its entropy, ln 2; an independent value has nothing.
    assert found["same"] == pytest.approx(math.log(2), abs=0.02) and found["four"] == pytest.approx(math.log(2), abs=0.02)
    assert found["apart"] == pytest.approx(0, abs=0.02)
    more = pd.concat([pdf, pd.DataFrame([(1000 + i, i % 2, *[float("nan")] * 4) for i in range(60)], columns=pdf.columns)])
    again = {r["feature"]: r["mi"] for r in features.mutual_information(spark.createDataFrame(more), names, "label", "neighbours").collect()}
    assert again == pytest.approx(found)
    chosen = workflows.choose_features(spark.createDataFrame(pdf), ["same", "apart"], "label", ["id"], trees=3, k=2)
    assert chosen.selected == ["same"]


def test_studentised_range_has_no_limits():
    # Published tables.
    assert stats.studentized_range_quantile(0.01, 10, 1) == pytest.approx(246, abs=1)
    assert stats.studentized_range_tail(1351, 3, 1) == pytest.approx(0.001, rel=0.01)
    assert stats.studentized_range_quantile(0.05, 3, 10) == pytest.approx(3.877, abs=0.002)
    near, far = (stats.studentized_range_tail(3.5, 4, df) for df in (25_000, 25_001))
    assert near == pytest.approx(far, rel=1e-5)
    assert stats.studentized_range_tail(3.633, 4, 1e9) == pytest.approx(0.05, abs=2e-4)


def test_report_without_and_classify_with_missing_values(spark):
    rows = [(1, 1), (0, 0), (1, None)]
    report = {r["class"]: r for r in model.classification_report(spark.createDataFrame(rows, "label int, prediction int")).collect()}
    assert set(report) == {0, 1} and report[1]["recall"] == 0.5 and report[0]["f1"] == 1.0
    train = spark.createDataFrame([(float(i), i % 5 * 1.0, int(i > 20)) for i in range(40)], "a double, b double, label int")
    fitted = model.train_classifier(train, ["a", "b"], "label")
    odd = spark.createDataFrame([(float("nan"), 1.0), (1.0, None), (3.0, float("nan")), (30.0, 1.0)], "a double, b double")
    out = [(r["type"], r["error"]) for r in model.classify(odd, fitted, ["a", "b"]).collect()]
    assert [t == "UNKNOWN" for t, _ in out] == [True, True, True, False]
    assert [e for _, e in out] == ["Missing required feature: a", "Missing required feature: b", "Missing required feature: b", None]


def test_scores_normalise_sum_and_select(spark):
    # Published scores of four features (rank correlation, mutual information).
    rows = [("w", 0.8, 0.6), ("x", 0.4, 0.6), ("y", 0.2, 0.0), ("z", float("nan"), 0.0)]
    scores = features.aggregate_scores(spark.createDataFrame(rows, "feature string, spearman double, mi double"))
    got = {r["feature"]: r["score"] for r in scores.collect()}
    assert got == {"w": 2.0, "x": 1.5, "y": 0.25, "z": None}
    assert {r["feature"] for r in features.select_features(scores, 1.5).collect()} == {"w"}
    assert [r["feature"] for r in summary.sort_scores(scores, "score").collect()][-1] == "z"
    assert [r["feature"] for r in summary.top_k(scores, "score", 2).collect()] == ["w", "x"]


def test_pearson_matrix(spark):
    pdf = random_classes()
    df = spark.createDataFrame(pdf)
    got = {(r["a"], r["b"]): r["r"] for r in features.pearson_matrix(df, ["a", "b", "flat"]).collect()}
    assert len(got) == 9 and got["a", "b"] == pytest.approx(pdf.a.corr(pdf.b)) and got["a", "flat"] is None
    assert set((r["a"], r["b"]) for r in features.pearson_matrix(df, ["a", "b"], lower=True).collect()) == {("b", "a")}


def test_split_folds_and_scaling(spark):
    pdf = random_classes(n=203)
    df = spark.createDataFrame(pdf)
    split = model.stratified_split(df, "label", ["id"]).toPandas()
    sizes = split.groupby(["label", "split"]).size()
    for label, n in pdf.label.value_counts().items():
        assert sizes[label, "test"] == round(n * 0.2) and sizes[label].sum() == n
    again = model.stratified_split(df.repartition(7), "label", ["id"]).toPandas()
    assert split.set_index("id").split.sort_index().equals(again.set_index("id").split.sort_index())
    folds = model.stratified_folds(df, "label", ["id"], 5).toPandas().groupby(["label", "fold"]).size()
    for label in (0, 1):
        assert folds[label].max() - folds[label].min() <= 1
    scaled = model.scaled(df, ["a", "flat"]).toPandas()
    assert scaled.a.mean() == pytest.approx(0) and scaled.a.std(ddof=0) == pytest.approx(1) and (scaled.flat == 0).all()


def newton(x, y, strength=1.0):
    """Minimum of strength * logistic loss + |w|^2 / 2, intercept free."""
    design = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(design.shape[1])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = strength * design.T @ (p - y) + penalty @ w
        hessian = strength * design.T @ (design * (p * (1 - p))[:, None]) + penalty
        w -= np.linalg.solve(hessian, gradient)
    return w


def test_logistic_regression_reaches_the_penalised_optimum(spark, folder):
    from brokerlens.sources import sinks

    pdf = random_classes()
    df = spark.createDataFrame(pdf)
    fitted = model.train_classifier(df, ["a", "b"], "label")
    x = ((pdf[["a", "b"]] - pdf[["a", "b"]].mean()) / pdf[["a", "b"]].std(ddof=0)).to_numpy()
    expected = newton(x, pdf.label.to_numpy())
    got = {r["feature"]: r["coefficient"] for r in model.coefficients(fitted, spark).collect()}
    assert [got["a"], got["b"], fitted.stages[-1].intercept] == pytest.approx(list(expected), abs=2e-3)
    sinks.save_model(fitted, f"{folder}/model")
    gaps = df.withColumn("b", F.when(F.col("id") != 0, F.col("b")))
    out = {r["id"]: r for r in model.classify(gaps, sinks.load_model(f"{folder}/model"), ["a", "b"]).collect()}
    assert (out[0]["type"], out[0]["confidence"], out[0]["prediction"], out[0]["error"]) == ("UNKNOWN", 0.0, None, "Missing required feature: b")
    assert 50 <= out[1]["confidence"] <= 100 and sum(out[1]["probabilities"].values()) == pytest.approx(100)
    assert out[1]["probabilities"][out[1]["type"]] == pytest.approx(out[1]["confidence"])


@pytest.mark.parametrize("strength", [1.0, 50.0])
def test_folds_fitted_together_equal_separate_fits(spark, strength):
    pdf = random_classes(n=300)
    pdf["fold"] = pdf.index % 4
    pdf["shifted"] = pdf["b"] * 1e-3 + 1e6
    names = ["a", "shifted"]
    fits = logistic.fit_folds(spark.createDataFrame(pdf), names, "label", "fold", 4, strength)
    for fold, fit in enumerate(fits):
        train = pdf[pdf.fold != fold]
        mean, std = train[names].mean(), train[names].std(ddof=0)
        assert fit.mean == pytest.approx(tuple(mean)) and fit.std == pytest.approx(tuple(std), rel=1e-6)
        expected = newton(((train[names] - mean) / std).to_numpy(), train.label.to_numpy(), strength)
        assert [*fit.weights, fit.intercept] == pytest.approx(list(expected), abs=1e-5)
    both = model.cross_validate(spark.createDataFrame(pdf), names, "label", ["id"], k=4).first()
    rows = model.out_of_fold(spark.createDataFrame(pdf), names, "label", ["id"], k=4).toPandas()
    hits = (rows.label == rows.prediction).groupby(rows.fold).mean()
    assert (both["accuracy_mean"], both["accuracy_std"]) == pytest.approx((hits.mean(), hits.std(ddof=0)))


def test_regressions_of_odd_tables(spark):
    schema = "x double, flat double, label int, fold int"
    split = [(float(i), 7.1, int(i >= 20), i % 2) for i in range(40)]  # separable, with a constant column
    (fit,) = logistic.fit_folds(spark.createDataFrame(split, schema), ["x", "flat"], "label", strength=1e6)
    chance = spark.createDataFrame(split, schema).select("label", logistic.chance([fit]).alias("p")).collect()
    assert all(abs(r["p"] - r["label"]) < 0.1 for r in chance) and fit.std[1] == 1.0 and abs(fit.weights[1]) < 1e-6
    fits = logistic.fit_folds(spark.createDataFrame([(1.0, 1.0, 1, 0), (2.0, 1.0, 1, 0)], schema), ["x"], "label", "fold", 2)
    assert fits[0].raw == [0.0, 0.0]  # no rows but its own
    assert logistic.chance(fits, "fold") is not None and fits[1].intercept > 10  # one class only
    three = spark.createDataFrame([(i, float(i % 3), i % 3) for i in range(60)], "id int, x double, label int")
    assert model.cross_validate(three, ["x"], "label", ["id"], k=2).first()["accuracy_mean"] > 0.6
    empty = model.cross_validate(three.filter("id < 0"), ["x"], "label", ["id"], k=2).first()
    assert tuple(empty) == (1, None, None, None, None)


def test_report(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (2, 1)], "label int, prediction int")
    out = {r["class"]: r for r in model.classification_report(rows).collect()}
    assert out[1]["precision"] == pytest.approx(1 / 3) and out[0]["recall"] == pytest.approx(2 / 3) and out[2]["f1"] == 0
    assert out[0]["accuracy"] == pytest.approx(0.6)


def test_choose_features_and_train(spark, folder):
    pdf = random_classes(n=200)
    pdf.loc[3, "a"] = None
    df = spark.createDataFrame(pdf)
    found = workflows.choose_features(df, ["a", "b", "flat"], "label", ["id"], method="binned", trees=5, depth=4, k=3)
    assert found.selected == ["a"]
    sweep = {r["threshold"]: r for r in found.sweep.collect()}
    assert sweep[0.8]["features"] == "a" and sweep[0.8]["accuracy_mean"] > 0.6 and len(sweep) == 6
    assert [r["feature_set"] for r in found.comparison.collect()] == ["All Features", "Selected Features"]
    found.write(folder)
    assert spark.read.option("header", True).csv(f"{folder}/threshold_evaluation").count() == 6
    trained = workflows.train(df, "label", ["id"], ["a", "b"], k=3)
    assert trained.report.count() == 2 and trained.folds.first()["accuracy_mean"] > 0.6


def test_no_features_score_zero(spark):
    df = spark.createDataFrame(random_classes())
    assert tuple(model.cross_validate(df, [], "label", ["id"]).first()) == (0, 0.0, 0.0, 0.0, 0.0)


def test_folds_of_a_large_table_are_dealt_out_evenly(spark, monkeypatch):
    # One class and one key hold nearly all rows, so that dealing by either would leave them in one partition.
    df = spark.range(4000).select((F.col("id") % 3).alias("id"), F.col("id").cast("double").alias("x"), (F.col("id") % 50 == 0).cast("int").alias("label"))
    seen = []

    class Fitted:
        def transform(self, rows):
            return rows.withColumn("prediction", F.lit(0))

    def fit(train, names):
        seen.append([r["count"] for r in train.groupBy(F.spark_partition_id()).count().collect()])
        return Fitted()

    def scores():
        seen.clear()
        return model._fold_scores(df, [["x"]], "label", ["id"], fit, 4, 42, 2)

    before = scores()
    monkeypatch.setattr(model, "DEALT", 500)
    assert scores() == before  # the same rows in the same folds
    assert len(seen) == 4 and all(sum(sizes) == 3000 and len(sizes) == 8 and max(sizes) < 600 for sizes in seen)


def test_forests_keep_the_nodes_of_rows(spark):
    stage = model.forest(["a", "b"], "label", 3, 4).getStages()[-1]
    assert stage.getCacheNodeIds() and stage.getCheckpointInterval() == -1


def test_forest_queries_read_the_texts_once(spark, monkeypatch):
    from brokerlens.plans import q_learning

    rows = spark.createDataFrame(random_classes(n=60)).withColumnRenamed("id", "doc_id")
    monkeypatch.setattr(q_learning, "classes", lambda spark, sf: rows)
    with q_learning.kept_classes(spark, "") as kept:
        assert kept.storageLevel.useMemory and kept.count() == 60
    assert not rows.storageLevel.useMemory
