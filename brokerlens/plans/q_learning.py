"""Queries of feature selection, models and statistical tests."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from brokerlens.operators import features, model, stats
from brokerlens.plans import views
from brokerlens.plans.q_joins import WIDTH
from brokerlens.plans.q_summary import METRICS, analysed
from brokerlens.plans.registry import ANALYSED_SQL, CLASSES_SQL, PROGRESS_SQL, query, rounded
from brokerlens.plans.views import CLASS_FEATURES

LABEL, IDS = "label", ["doc_id"]
TREES, DEPTH = 100, 12

_LONG = f"{CLASSES_SQL}, lng AS (UNPIVOT (SELECT label, {', '.join(CLASS_FEATURES)} FROM cls) ON {', '.join(CLASS_FEATURES)} INTO NAME feature VALUE v)"
_RANKED = _LONG + """, rk AS (SELECT feature, v, label, count(*) OVER (PARTITION BY feature) AS n,
      rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS rv,
      rank() OVER (PARTITION BY feature ORDER BY label) + (count(*) OVER (PARTITION BY feature, label) - 1) / 2 AS rl FROM lng),
    sp AS (SELECT feature, abs(covar_pop(rv, rl) / nullif(stddev_pop(rv) * stddev_pop(rl), 0)) AS spearman FROM rk GROUP BY feature)"""
_BINNED = """, bn AS (SELECT feature, label, floor((rank() OVER (PARTITION BY feature ORDER BY v) - 1) * 16 / count(*) OVER (PARTITION BY feature)) AS bin FROM lng),
    ce AS (SELECT feature, bin, label, count(*) AS n FROM bn GROUP BY ALL),
    tm AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS b, sum(n) OVER (PARTITION BY feature, label) AS c FROM ce),
    mi AS (SELECT feature, greatest(sum(n / t * ln(n * t / (b * c))), 0) AS mi FROM tm GROUP BY feature)"""


def classes(spark, sf):
    return views.classes(spark, sf)


@contextmanager
def kept_classes(spark, sf):
    """The feature rows, kept while a query passes over them again and again: texts are read once."""
    rows = classes(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


@query("m1_spearman", f"WITH {_RANKED} SELECT feature, round(spearman, 6) AS spearman FROM sp")
def m1(spark, sf):
    return rounded(features.spearman(classes(spark, sf), CLASS_FEATURES, LABEL), ["spearman"], 6)


@query("m2_normalized", f"WITH {_RANKED} SELECT feature, round(spearman, 6) AS spearman, round(spearman / max(spearman) OVER (), 6) AS normalized_spearman FROM sp")
def m2(spark, sf):
    rows = features.normalize_max(features.spearman(classes(spark, sf), CLASS_FEATURES, LABEL), "spearman")
    return rounded(rows, ["spearman", "normalized_spearman"], 6)


@query("m3_information_binned", f"WITH {_RANKED} {_BINNED} SELECT feature, round(mi, 6) AS mi FROM mi")
def m3(spark, sf):
    return rounded(features.mutual_information(classes(spark, sf), CLASS_FEATURES, LABEL), ["mi"], 6)


# Every pair of rows is compared here, which only a small table allows. Digamma of n is the (n - 1)-th harmonic number, less a constant.
_NEIGHBOURS = f"""WITH {_LONG}, ln AS (SELECT feature, label, v, row_number() OVER () AS id, count(*) OVER (PARTITION BY feature) AS t, count(*) OVER (PARTITION BY feature, label) AS c FROM lng),
    h AS (SELECT i AS n, sum(CASE WHEN i > 1 THEN 1 / (i - 1) ELSE 0 END) OVER (ORDER BY i) AS psi FROM range(1, (SELECT count(*) + 2 FROM cls)) r(i)),
    d AS (SELECT a.feature, a.id, a.label, a.v, a.t, a.c, abs(a.v - b.v) AS d, row_number() OVER (PARTITION BY a.feature, a.id ORDER BY abs(a.v - b.v)) AS i
          FROM ln a JOIN ln b ON a.feature = b.feature AND a.label = b.label AND a.id <> b.id),
    r AS (SELECT * FROM d WHERE i = least(3, c - 1)),
    w AS (SELECT r.feature, r.id, r.label, r.t, r.c, r.d, count(*) FILTER (abs(o.v - r.v) < r.d) AS near, count(*) FILTER (o.v = r.v) AS copies,
          count(*) FILTER (o.v = r.v AND o.label = r.label) AS own FROM r JOIN ln o ON r.feature = o.feature GROUP BY ALL),
    x AS (SELECT *, greatest(CASE WHEN d = 0 THEN least(3, own - 1) * copies / own ELSE near END, 1) AS x FROM w),
    m AS (SELECT feature, id, t, c, ln(x + 6) - 1 / (2 * (x + 6)) - 1 / (12 * power(x + 6, 2)) + 1 / (120 * power(x + 6, 4)) - 1 / (252 * power(x + 6, 6))
          - 1 / x - 1 / (x + 1) - 1 / (x + 2) - 1 / (x + 3) - 1 / (x + 4) - 1 / (x + 5) + 0.5772156649015329 AS psi FROM x)
    SELECT feature, round(greatest(any_value(ht.psi) + avg(hk.psi - hc.psi - m.psi), 0), 5) AS mi FROM m JOIN h ht ON ht.n = t JOIN h hk ON hk.n = least(3, c - 1)
      JOIN h hc ON hc.n = c GROUP BY feature"""


@query("m3_information_neighbours", _NEIGHBOURS)
def m3_neighbours(spark, sf):
    return rounded(features.mutual_information(classes(spark, sf), CLASS_FEATURES, LABEL, "neighbours"), ["mi"], 5)


def scores(rows):
    return features.aggregate_scores(features.feature_scores(rows, CLASS_FEATURES, LABEL))


@query("m4_selected", f"""WITH {_RANKED} {_BINNED}, nm AS (SELECT sp.feature, spearman / max(spearman) OVER () AS a, mi / max(mi) OVER () AS b FROM sp JOIN mi ON sp.feature = mi.feature)
    SELECT feature, round(a + b, 6) AS score FROM nm WHERE a + b > 0.8""")
def m4(spark, sf):
    rows = features.select_features(scores(classes(spark, sf)), 0.8)
    return rounded(rows.select("feature", "score"), ["score"], 6)


@query("m5_threshold_sweep")
def m5(spark, sf):
    with kept_classes(spark, sf) as rows:
        return model.threshold_sweep(rows, scores(rows), LABEL, IDS, trees=TREES, depth=DEPTH)


@query("m6_forest_cv")
def m6(spark, sf):
    whole = model.forest(CLASS_FEATURES, LABEL, TREES, DEPTH)
    with kept_classes(spark, sf) as rows:
        return model.cross_validate(rows, CLASS_FEATURES, LABEL, IDS, whole)


@query("m7_importances")
def m7(spark, sf):
    fitted = model.forest(CLASS_FEATURES, LABEL, TREES, DEPTH).fit(classes(spark, sf))
    return model.importances(fitted, spark)


@query("m8_compare_sets")
def m8(spark, sf):
    with kept_classes(spark, sf) as rows:
        selected = features.select_features(scores(rows), 0.8).select("feature").orderBy("feature").collect()
        sets = {"All Features": CLASS_FEATURES, "Selected Features": [r["feature"] for r in selected]}
        return model.compare_feature_sets(rows, sets, LABEL, IDS, TREES, DEPTH)


_MATRIX = ["recovery_time_seconds", "cpu_usage_percent", "memory_usage_percent", "price"]


def _pearson_sql(pairs) -> str:
    rows = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM ana" for a, b in pairs)
    return f"WITH {ANALYSED_SQL} {rows}"


@query("m9_pearson", _pearson_sql([(a, b) for a in _MATRIX for b in _MATRIX]))
def m9(spark, sf):
    return rounded(features.pearson_matrix(analysed(spark, sf), _MATRIX), ["r"], 6)


@query("m9_pearson_lower", _pearson_sql([(b, a) for i, a in enumerate(_MATRIX) for b in _MATRIX[i + 1:]]))
def m9_lower(spark, sf):
    return rounded(features.pearson_matrix(analysed(spark, sf), _MATRIX, lower=True), ["r"], 6)


@query("m10_split_sizes", f"""WITH {CLASSES_SQL}, c AS (SELECT label, count(*) AS n FROM cls GROUP BY label)
    SELECT label, split, CAST(CASE WHEN split = 'test' THEN round(n * 0.2) ELSE n - round(n * 0.2) END AS BIGINT) AS n FROM c CROSS JOIN (VALUES ('test'), ('train')) t(split)""")
def m10_sizes(spark, sf):
    rows = model.stratified_split(classes(spark, sf), LABEL, IDS)
    return rows.groupBy("label", "split").agg(F.count("*").alias("n"))


@query("m10_split")
def m10(spark, sf):
    return model.stratified_split(classes(spark, sf), LABEL, IDS).select("doc_id", "label", "split")


@query("m11_scaled", f"WITH {CLASSES_SQL} SELECT doc_id, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END, 6) AS {c}" for c in CLASS_FEATURES) + " FROM cls")
def m11(spark, sf):
    rows = model.scaled(classes(spark, sf), CLASS_FEATURES)
    return rounded(rows.select("doc_id", *CLASS_FEATURES), CLASS_FEATURES, 6)


def _fitted(spark, sf):
    rows = model.stratified_split(classes(spark, sf), LABEL, IDS)
    return model.train_classifier(rows.filter("split = 'train'"), CLASS_FEATURES, LABEL), rows


@query("m12_trained_scores")
def m12(spark, sf):
    fitted, rows = _fitted(spark, sf)
    return fitted.transform(rows.filter("split = 'test'")).select("doc_id", "label", F.col("prediction").cast("int").alias("prediction"))


@query("m13_classified")
def m13(spark, sf):
    fitted, rows = _fitted(spark, sf)
    gaps = rows.withColumn("digits", F.when(F.col("doc_id") % 11 != 0, F.col("digits")))
    out = model.classify(gaps, fitted, CLASS_FEATURES)
    return out.select("doc_id", "prediction", "confidence", "type", "error")


_PREDICTED = "prd AS (SELECT label, CASE WHEN chars > 400 THEN 1 ELSE 0 END AS prediction FROM cls)"


def predicted(spark, sf):
    return classes(spark, sf).withColumn("prediction", (F.col("chars") > 400).cast("int"))


@query("m14_confusion", f"WITH {CLASSES_SQL}, {_PREDICTED} SELECT CAST(label AS INTEGER) AS label, prediction, CAST(count(*) AS BIGINT) AS count FROM prd GROUP BY ALL")
def m14(spark, sf):
    return model.confusion(predicted(spark, sf))


@query("m14_report", f"""WITH {CLASSES_SQL}, {_PREDICTED}, k(class) AS (VALUES (0), (1)),
    s AS (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (label = class AND prediction = class) AS hit, count(*) FILTER (prediction = class) AS claimed FROM prd CROSS JOIN k GROUP BY class),
    f AS (SELECT class, support, hit, coalesce(hit / nullif(claimed, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r FROM s),
    g AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM f)
    SELECT class, CAST(support AS BIGINT) AS support, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round(sum(hit) OVER () / sum(support) OVER (), 6) AS accuracy, round(avg(f1) OVER (), 6) AS macro_f1 FROM g""")
def m14_report(spark, sf):
    return rounded(model.classification_report(predicted(spark, sf)), ["precision", "recall", "f1", "accuracy", "macro_f1"], 6)


@query("m15_logistic_cv")
def m15(spark, sf):
    return model.cross_validate(classes(spark, sf), CLASS_FEATURES, LABEL, IDS)


@query("m16_coefficients")
def m16(spark, sf):
    return model.coefficients(_fitted(spark, sf)[0], spark)


# ---------------------------------------------------------------- decided cases

# A two-valued feature and a label that goes with it in seven of ten and two of ten rows; ``echo`` is a label as a feature.
_PARITY = f"""{CLASSES_SQL}, par AS (SELECT *, avg(label) OVER (PARTITION BY odd) AS share FROM (
    SELECT doc_id, CAST(chars AS BIGINT) % 2 AS odd, CAST(doc_id % 10 < CASE WHEN chars % 2 = 1 THEN 7 ELSE 2 END AS INTEGER) AS label FROM cls))"""
_WEAK = 1e9  # so weak a penalty that the fitted chance is the share of the class


def parity(spark, sf):
    odd = F.col("chars").cast("bigint") % 2
    chosen = F.col("doc_id") % 10 < F.when(odd == 1, 7).otherwise(2)
    return classes(spark, sf).select("doc_id", odd.cast("double").alias("odd"), chosen.cast("int").alias("label"))


def echo(spark, sf):
    return classes(spark, sf).select("doc_id", "label", F.col("label").cast("double").alias("echo"), "constant")


@query("m12_fitted_chance", f"WITH {_PARITY} SELECT doc_id, round(share, 4) AS chance FROM par")
def m12_chance(spark, sf):
    rows = parity(spark, sf)
    fitted = model.train_classifier(rows, ["odd"], LABEL, _WEAK)
    return rounded(fitted.transform(rows).select("doc_id", vector_to_array("probability")[1].alias("chance")), ["chance"])


@query("m13_decided", f"""WITH {_PARITY} SELECT doc_id, CASE WHEN doc_id % 11 > 0 THEN CAST(share > 0.5 AS INTEGER) END AS prediction,
    CASE WHEN doc_id % 11 > 0 THEN round(greatest(share, 1 - share) * 100, 2) ELSE 0.0 END AS confidence,
    CASE WHEN doc_id % 11 = 0 THEN 'UNKNOWN' WHEN share > 0.5 THEN 'BATCH_DATA_INTENSIVE' ELSE 'REAL_TIME_EVENT_DRIVEN' END AS type,
    CASE WHEN doc_id % 11 = 0 THEN 'Missing required feature: odd' END AS error FROM par""")
def m13_decided(spark, sf):
    rows = parity(spark, sf)
    fitted = model.train_classifier(rows, ["odd"], LABEL, _WEAK)
    gaps = rows.withColumn("odd", F.when(F.col("doc_id") % 11 != 0, F.col("odd")))
    out = model.classify(gaps, fitted, ["odd"]).select("doc_id", "prediction", "confidence", "type", "error")
    return rounded(out, ["confidence"], 2)


@query("m15_out_of_fold", f"WITH {_PARITY} SELECT doc_id, CAST(share > 0.5 AS INTEGER) AS prediction FROM par")
def m15_out_of_fold(spark, sf):
    return model.out_of_fold(parity(spark, sf), ["odd"], LABEL, IDS).select("doc_id", "prediction")


# With nothing to go by every fold predicts the commoner class, and folds differ by a row at most.
_MAJORITY = f"""{CLASSES_SQL}, cn AS (SELECT label, count(*) AS n FROM cls GROUP BY label),
    fo AS (SELECT f, label, n // 5 + CAST(f BETWEEN 1 AND n % 5 AS INTEGER) AS n FROM cn CROSS JOIN range(5) r(f)),
    ac AS (SELECT f, arg_max(n, a) / sum(n) AS p, count(*) AS kinds FROM fo JOIN (SELECT label, n AS a FROM cn) USING (label) WHERE n > 0 GROUP BY f),
    ma AS (SELECT avg(p) AS accuracy, stddev_pop(p) AS accuracy_std, avg(2 * p / (1 + p) / kinds) AS f1, stddev_pop(2 * p / (1 + p) / kinds) AS f1_std FROM ac)"""
_CV = "round({0}, 6) AS accuracy_mean, round({1}, 6) AS accuracy_std, round({2}, 6) AS f1_mean, round({3}, 6) AS f1_std"
_CV_COLUMNS = ["accuracy_mean", "accuracy_std", "f1_mean", "f1_std"]


@query("m15_majority_cv", f"WITH {_MAJORITY} SELECT 1 AS n_features, {_CV.format('accuracy', 'accuracy_std', 'f1', 'f1_std')} FROM ma")
def m15_majority(spark, sf):
    return rounded(model.cross_validate(echo(spark, sf), ["constant"], LABEL, IDS), _CV_COLUMNS, 6)


@query("m16_two_valued", f"""WITH {_PARITY}, sh AS (SELECT max(share) FILTER (odd = 1) AS p, max(share) FILTER (odd = 0) AS q, stddev_pop(odd) AS s FROM par)
    SELECT 'odd' AS feature, round(s * (ln(p / (1 - p)) - ln(q / (1 - q))), 3) AS coefficient FROM sh""")
def m16_two_valued(spark, sf):
    fitted = model.train_classifier(parity(spark, sf), ["odd"], LABEL, _WEAK)
    return rounded(model.coefficients(fitted, spark), ["coefficient"], 3)


@query("m16_gradient", " UNION ALL ".join(f"SELECT '{f}' AS feature, 0.0::DOUBLE AS gradient" for f in CLASS_FEATURES))
def m16_gradient(spark, sf):
    """The slope of the penalised loss a row, at the fitted coefficients: nothing at the optimum."""
    rows = classes(spark, sf)
    fitted = model.train_classifier(rows, CLASS_FEATURES, LABEL)
    weight = {r["feature"]: r["coefficient"] for r in model.coefficients(fitted, spark).collect()}
    miss = vector_to_array("probability")[1] - F.col(LABEL)
    slopes = fitted.transform(rows).agg(*[(F.avg(miss * F.col(f"_scaled_{f}")) + F.lit(weight[f]) / F.count("*")).alias(f) for f in CLASS_FEATURES])
    long = slopes.unpivot([], CLASS_FEATURES, "feature", "gradient")
    return long.withColumn("gradient", F.round("gradient", 5) + 0.0)


@query("m5_decided", " UNION ALL ".join(
    f"SELECT {t}::DOUBLE AS threshold, 'echo' AS features, 1 AS n_features, 1.0::DOUBLE AS accuracy_mean, 0.0::DOUBLE AS accuracy_std, 1.0::DOUBLE AS f1_mean, 0.0::DOUBLE AS f1_std" for t in model.THRESHOLDS))
def m5_decided(spark, sf):
    rows = echo(spark, sf)
    found = features.aggregate_scores(features.feature_scores(rows, ["echo", "constant"], LABEL))
    return model.threshold_sweep(rows, found, LABEL, IDS, trees=10, depth=3)


@query("m5_sets", f"""WITH {_RANKED} {_BINNED}, nm AS (SELECT sp.feature, spearman / max(spearman) OVER () + mi / max(mi) OVER () AS score FROM sp JOIN mi ON sp.feature = mi.feature)
    SELECT t AS threshold, coalesce(string_agg(feature, ', ' ORDER BY feature) FILTER (score > t), 'None') AS features, CAST(count(*) FILTER (score > t) AS INTEGER) AS n_features
    FROM nm CROSS JOIN (SELECT unnest({model.THRESHOLDS})::DOUBLE AS t) GROUP BY t""")
def m5_sets(spark, sf):
    rows = classes(spark, sf)
    return model.threshold_sweep(rows, scores(rows), LABEL, IDS, trees=1, depth=1, k=2).select("threshold", "features", "n_features")


@query("m6_majority_cv", f"WITH {_MAJORITY} SELECT 1 AS n_features, {_CV.format('accuracy', 'accuracy_std', 'f1', 'f1_std')} FROM ma")
def m6_majority(spark, sf):
    trees = model.forest(["constant"], LABEL, 20, 3)
    return rounded(model.cross_validate(echo(spark, sf), ["constant"], LABEL, IDS, trees), _CV_COLUMNS, 6)


@query("m7_decided", "SELECT 'echo' AS feature, 1.0::DOUBLE AS importance UNION ALL SELECT 'constant', 0.0")
def m7_decided(spark, sf):
    fitted = model.forest(["constant", "echo"], LABEL, TREES, DEPTH).fit(echo(spark, sf))
    return rounded(model.importances(fitted, spark), ["importance"], 6)


@query("m8_decided", f"""WITH {_MAJORITY} SELECT 'Echo' AS feature_set, 1 AS features, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS f1
    UNION ALL SELECT 'Constant', 1, round(accuracy, 6), round(f1, 6) FROM ma""")
def m8_decided(spark, sf):
    sets = {"Echo": ["echo"], "Constant": ["constant"]}
    return rounded(model.compare_feature_sets(echo(spark, sf), sets, LABEL, IDS, 20, 3), ["accuracy", "f1"], 6)


# ---------------------------------------------------------------- tests

_CELLS = "cel AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, configuration AS a, workload_strategy AS b, count({m}) AS n, avg({m}) AS m, var_pop({m}) * count({m}) AS ss FROM ana GROUP BY ALL" for m in METRICS) + ")"

# With two levels each, a main effect adjusted for the other is a weighted mean of differences.
_TWO_WAY = f"""WITH {ANALYSED_SQL}, {_CELLS},
    da AS (SELECT metric, b, max(m) FILTER (a = 'ARMS') - max(m) FILTER (a = 'baseline') AS d, 1 / sum(1 / n) AS w FROM cel GROUP BY metric, b),
    db AS (SELECT metric, a, max(m) FILTER (b = 'batch') - max(m) FILTER (b = 'real-time') AS d, 1 / sum(1 / n) AS w FROM cel GROUP BY metric, a),
    ta AS (SELECT metric, sum(w * d) * sum(w * d) / sum(w) AS main, sum(w * d * d) - sum(w * d) * sum(w * d) / sum(w) AS crossed FROM da GROUP BY metric),
    tb AS (SELECT metric, sum(w * d) * sum(w * d) / sum(w) AS main FROM db GROUP BY metric),
    er AS (SELECT metric, sum(ss) AS ss, sum(n) - count(*) AS df FROM cel GROUP BY metric),
    al AS (SELECT metric, 'configuration' AS term, main AS q, 1 AS d FROM ta UNION ALL SELECT metric, 'workload_strategy', main, 1 FROM tb
      UNION ALL SELECT metric, 'configuration:workload_strategy', crossed, 1 FROM ta UNION ALL SELECT metric, 'Residual', ss, df FROM er)
    SELECT al.metric, term, CAST(d AS DOUBLE) AS df, round(q, 4) AS sum_sq, CASE WHEN term <> 'Residual' THEN round(q / (er.ss / er.df), 4) END AS f FROM al JOIN er ON al.metric = er.metric"""


@query("m17_two_way", _TWO_WAY)
def m17(spark, sf):
    rows = stats.anova_two_way(analysed(spark, sf), METRICS, "configuration", "workload_strategy")
    return rounded(rows.drop("p"), ["sum_sq", "f"])


@query("m17_two_way_p")
def m17_p(spark, sf):
    return stats.anova_two_way(analysed(spark, sf), METRICS, "configuration", "workload_strategy")


@query("m18_tukey", f"""WITH {ANALYSED_SQL}, g AS (SELECT configuration || '_' || workload_strategy AS grp, avg(recovery_time_seconds) AS m FROM ana GROUP BY 1)
    SELECT x.grp AS group1, y.grp AS group2, round(y.m - x.m, 6) AS meandiff FROM g x JOIN g y ON x.grp < y.grp""")
def m18(spark, sf):
    rows = analysed(spark, sf).withColumn("grp", F.concat_ws("_", "configuration", "workload_strategy"))
    out = stats.tukey_hsd(rows, ["recovery_time_seconds"], "grp")
    return rounded(out.select("group1", "group2", "meandiff"), ["meandiff"], 6)


@query("m18_tukey_p")
def m18_p(spark, sf):
    rows = analysed(spark, sf).withColumn("grp", F.concat_ws("_", "configuration", "workload_strategy"))
    return stats.tukey_hsd(rows, METRICS, "grp")


_ONE_WAY = f"""WITH {PROGRESS_SQL}, k AS (SELECT epoch_us(ts) AS us, CASE user_id % 3 WHEN 0 THEN 'QUICK_REBALANCE' WHEN 1 THEN 'RESOURCE_OPTIMIZED' ELSE 'CONTROLLED_GRADUAL' END AS strategy FROM events WHERE event_type = 'purchase'),
    m AS (SELECT * FROM prg WHERE workload_type = 'real_time'),
    b AS (SELECT k.us, strategy, m.us AS mus, cpu_usage, memory_usage FROM k ASOF LEFT JOIN m ON k.us >= m.us),
    a AS (SELECT k.us, m.us AS mus, cpu_usage, memory_usage FROM k ASOF LEFT JOIN m ON k.us <= m.us),
    nr AS (SELECT strategy, CASE WHEN b.mus IS NULL OR a.mus - a.us < b.us - b.mus THEN a.cpu_usage ELSE b.cpu_usage END AS cpu_usage,
      CASE WHEN b.mus IS NULL OR a.mus - a.us < b.us - b.mus THEN a.memory_usage ELSE b.memory_usage END AS memory_usage FROM b JOIN a ON b.us = a.us),
    l AS (SELECT strategy, 'cpu_usage' AS metric, cpu_usage AS v FROM nr UNION ALL SELECT strategy, 'memory_usage', memory_usage FROM nr),
    c AS (SELECT metric, strategy, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss FROM l GROUP BY ALL), g AS (SELECT metric, avg(v) AS m FROM l GROUP BY metric)
    SELECT c.metric, CAST(count(*) AS BIGINT) AS groups, CAST(count(*) - 1 AS DOUBLE) AS df_between, CAST(sum(n) - count(*) AS DOUBLE) AS df_within,
      round(sum(n * (c.m - g.m) * (c.m - g.m)) / (count(*) - 1) / (sum(ss) / (sum(n) - count(*))), 4) AS f FROM c JOIN g ON c.metric = g.metric GROUP BY c.metric"""


@query("m19_one_way", _ONE_WAY)
def m19(spark, sf):
    return rounded(_one_way(spark, sf).drop("p"), ["f"])


def _one_way(spark, sf):
    from brokerlens.operators.joins import STRATEGY_CONFIGS, asof_nearest

    names = F.array(*[F.lit(n) for n in STRATEGY_CONFIGS])
    chosen = views.events(spark, sf).filter("event_type = 'purchase'").select(
        F.col("ts").alias("timestamp"), F.get(names, (F.col("user_id") % 3).cast("int")).alias("strategy")
    )
    readings = views.progress(spark, sf).filter("workload_type = 'real_time'").select("timestamp", "cpu_usage", "memory_usage")
    near = asof_nearest(chosen, readings, "timestamp", prefix="", width=WIDTH)
    near = near.select("strategy", "cpu_usage", "memory_usage")
    return stats.anova_one_way(near, ["cpu_usage", "memory_usage"], "strategy")


# With three groups the tail of F has a closed form.
@query("m20_significant", f"""SELECT *, p < 0.05 AS significant FROM (SELECT metric, groups, df_between, df_within, f, round(power(1 + 2 * exact / df_within, -df_within / 2), 6) AS p FROM (
    {_ONE_WAY.replace("AS f FROM c JOIN g", "AS f, sum(n * (c.m - g.m) * (c.m - g.m)) / (count(*) - 1) / (sum(ss) / (sum(n) - count(*))) AS exact FROM c JOIN g")}))""")
def m20(spark, sf):
    return rounded(rounded(stats.flag_significant(_one_way(spark, sf)), ["f"]), ["p"], 6)
