"""Registered ML queries.

Preparation (codes, design matrix, split, scaler) and every evaluator are
value-checked against SQL; evaluators are checked through the relational
segment-mean predictor (same code path as the MLlib models). Model fits are
rows-only, at the reference's tree counts and rounds; on one feature their
results are known in closed form and are value-checked as well.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.compat import money, round_even
from ..ml import evaluate as E
from ..ml import linear
from ..ml.importance import permutation_importance
from ..ml.models import fit_model, train_and_evaluate
from ..ml.prepare import encode_categories, prepared, scaler_stats
from ..ml.quantile import fit_quantile_models, predict_band
from ..ml.relational import GROUP_MODELS, train_group_models
from ..ml.store import bundle_completeness
from ..operators.ranking import best_model, first_by_actual
from ..schema import CATEGORY_COLS, FEATURES, KEY_COLS, QUANTILE_ALPHAS, SECONDARY_TARGETS
from ..session import broadcast_if_small
from .catalog import base_table, code_tables, prepared_table, register, report, session_key
from .sqlbase import BIN_EDGE, BIN_IDX, EDGES_CTE, R6, RN, with_base

KEY = "RestaurantID, Yr, Mo"
# Reference strength. Forests without a depth limit grow to MLlib's deepest, 30; with five
# folds that is six such forests, so the cross-validated set grows them to depth 10;
# the single forest of m6 is full. The quantile models get 50 of the reference's 150
# rounds here (the library's default is 150). README says what both cost.
FULL = dict(n_trees=100, rf_depth=30, rounds=100)
CROSS_VALIDATED = dict(n_trees=100, rf_depth=10, rounds=100)
QUANTILE_ROUNDS = 50
_MEMO: dict = {}


def release() -> None:
    """Drop the fitted models and unpersist their predictions and metrics."""
    for v in _MEMO.values():
        for x in v if isinstance(v, tuple) else ():
            if hasattr(x, "unpersist"):
                x.unpersist()
    _MEMO.clear()


def _bt(spark, sf_dir):
    return base_table(spark, sf_dir)


def _trained(spark, sf_dir):
    """Main-target models fitted once per (session, input) in this process."""
    k = (*session_key(spark, sf_dir), "main")
    if k not in _MEMO:
        prep = prepared_table(spark, sf_dir)
        fitted, preds, metrics = train_and_evaluate(prep, **CROSS_VALIDATED)
        _MEMO[k] = (prep, fitted, preds, metrics)
    return _MEMO[k]


def _quantile_models(spark, sf_dir):
    """Lower / median / upper quantile boosters, fitted once per process."""
    k = (*session_key(spark, sf_dir), "quantile")
    if k not in _MEMO:
        prep = prepared_table(spark, sf_dir)
        _MEMO[k] = fit_quantile_models(prep.where(~F.col("is_test")), rounds=QUANTILE_ROUNDS)
    return _MEMO[k]


# --- SQL building blocks ------------------------------------------------------------
def _hash(seed, mod):
    return (f"CAST(CAST(('0x' || substr(md5(concat_ws('|', CAST(RestaurantID AS VARCHAR), CAST(Yr AS VARCHAR), "
            f"CAST(Mo AS VARCHAR), '{seed}')), 1, 8)) AS BIGINT) % {mod} AS INT)")


def _codes(src):
    return [f"c_{c} AS (SELECT {c}, CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INT) AS {c}_enc "
            f"FROM (SELECT DISTINCT {c} FROM {src} WHERE {c} IS NOT NULL) d)" for c in CATEGORY_COLS]


def _enc_join(src):
    return (f"SELECT {src}.*, " + ", ".join(f"c_{c}.{c}_enc" for c in CATEGORY_COLS) + f" FROM {src} "
            + " ".join(f"LEFT JOIN c_{c} ON c_{c}.{c} = {src}.{c}" for c in CATEGORY_COLS))


_FEAT_SQL = ", ".join(f"COALESCE(CAST({f} AS DOUBLE), 0e0) AS {f}" for f in FEATURES)
_PREP_CTES = [*_codes("t"), f"e AS ({_enc_join('t')})",
              f"sp AS (SELECT {KEY}, Segment, {_FEAT_SQL}, COALESCE(TotalNetProfit, 0e0) AS label, "
              f"{_hash(42, 100)} < 20 AS is_test, {_hash(43, 5)} AS fold FROM e)"]
_SM_CTES = _PREP_CTES + [
    "sm AS (SELECT sp.*, s.m AS pred, s.m - 1.96e0 * s.s AS lower, s.m + 1.96e0 * s.s AS upper FROM sp "
    "LEFT JOIN (SELECT Segment, avg(label) AS m, stddev_samp(label) AS s FROM sp WHERE NOT is_test "
    "GROUP BY Segment) s ON s.Segment = sp.Segment)"]


def _metrics_sql(by="'Segment Mean'"):
    e = "(label - pred)"
    return (f"{R6(f'sqrt(avg({e} * {e}))')} AS RMSE, "
            f"{R6(f'1e0 - sum({e} * {e}) / (count(*) * var_pop(label))')} AS R2, "
            f"{R6(f'avg(abs({e}))')} AS MAE, CAST(count(*) AS BIGINT) AS n")


def _sm_spark(spark, sf_dir):
    return E.segment_mean_predictions(prepared_table(spark, sf_dir))


# --- M1-M4 ------------------------------------------------------------------------------
@register("m1_label_encoding", sql=with_base(
    f"SELECT {KEY}, " + ", ".join(f"{c}_enc" for c in CATEGORY_COLS) + " FROM e", *_codes("t"),
    f"e AS ({_enc_join('t')})"))
def m1_label_encoding(spark, sf_dir):
    bt = _bt(spark, sf_dir)
    return encode_categories(bt, codes=code_tables(spark, sf_dir)).select(*KEY_COLS, *[c + "_enc" for c in CATEGORY_COLS])


@register("m1_label_encoding_non_outliers", sql=with_base(
    f"SELECT {KEY}, " + ", ".join(f"{c}_enc" for c in CATEGORY_COLS) + " FROM e",
    "nt AS (SELECT * FROM t WHERE NOT IsOutlier)", *_codes("nt"), f"e AS ({_enc_join('nt')})"))
def m1_label_encoding_non_outliers(spark, sf_dir):
    nt = _bt(spark, sf_dir).where(~F.col("IsOutlier"))
    codes = code_tables(spark, sf_dir, non_outliers=True)
    return encode_categories(nt, codes=codes).select(*KEY_COLS, *[c + "_enc" for c in CATEGORY_COLS])


@register("m2_design_matrix", sql=with_base(
    f"SELECT {KEY}, " + ", ".join(R6(f) + f" AS {f}" for f in FEATURES) + f", {R6('label')} AS label FROM sp",
    *_PREP_CTES))
def m2_design_matrix(spark, sf_dir):
    return report(prepared_table(spark, sf_dir).drop("Segment", "is_test", "fold"))


@register("m3_split_folds", sql=with_base(f"SELECT {KEY}, is_test, fold FROM sp", *_PREP_CTES))
def m3_split_folds(spark, sf_dir):
    return prepared_table(spark, sf_dir).select(*KEY_COLS, "is_test", "fold")


@register("m4_scaler_stats", sql=with_base(" UNION ALL ".join(
    f"SELECT {i} AS feature_order, '{f}' AS feature, {R6(f'avg({f})')} AS mean, {R6(f'stddev_pop({f})')} AS std_pop, "
    f"{R6(f'CASE WHEN stddev_pop({f}) = 0 OR stddev_pop({f}) IS NULL THEN 1e0 ELSE stddev_pop({f}) END')} AS scale "
    "FROM sp WHERE NOT is_test" for i, f in enumerate(FEATURES)), *_PREP_CTES))
def m4_scaler_stats(spark, sf_dir):
    prep = prepared_table(spark, sf_dir)
    return report(scaler_stats(prep.where(~F.col("is_test"))))


# --- M9-M12, M15, M19, T3 on the segment-mean predictor -----------------------------------
@register("m10_segment_mean_test_metrics", sql=with_base(
    f"SELECT 'Segment Mean' AS model, {_metrics_sql()} FROM sm WHERE is_test", *_SM_CTES))
def m10_segment_mean_test_metrics(spark, sf_dir):
    return report(E.regression_metrics(_sm_spark(spark, sf_dir).where(F.col("is_test"))))


@register("m9_segment_mean_cv_folds", sql=with_base(
    f"SELECT 'Segment Mean' AS model, fold, {_metrics_sql()} FROM ("
    "SELECT tr.*, (g.S - f.s) / CAST(g.C - f.c AS DOUBLE) AS pred FROM tr "
    "JOIN (SELECT fold, Segment, sum(label) AS s, count(*) AS c FROM tr GROUP BY fold, Segment) f "
    "ON f.fold = tr.fold AND f.Segment = tr.Segment "
    "JOIN (SELECT Segment, sum(label) AS S, count(*) AS C FROM tr GROUP BY Segment) g ON g.Segment = tr.Segment) x "
    "GROUP BY fold", *_PREP_CTES, "tr AS (SELECT * FROM sp WHERE NOT is_test)"))
def m9_segment_mean_cv_folds(spark, sf_dir):
    return report(E.fold_metrics_segment_mean(prepared_table(spark, sf_dir)))


@register("m11_segment_mean_residual_quantiles", sql=with_base(
    f"SELECT 'Segment Mean' AS model, {R6('quantile_cont(label - pred, 0.025)')} AS residual_low, "
    f"{R6('quantile_cont(label - pred, 0.975)')} AS residual_high FROM sm WHERE is_test", *_SM_CTES))
def m11_segment_mean_residual_quantiles(spark, sf_dir):
    return report(E.residual_quantiles(_sm_spark(spark, sf_dir).where(F.col("is_test"))))


@register("m12_segment_mean_intervals", sql=with_base(
    f"SELECT {KEY}, {R6('pred')} AS pred, {R6('pred + lo')} AS emp_lower, {R6('pred + hi')} AS emp_upper "
    "FROM sm, (SELECT quantile_cont(label - pred, 0.025) AS lo, quantile_cont(label - pred, 0.975) AS hi "
    "FROM sm WHERE is_test) q WHERE is_test", *_SM_CTES))
def m12_segment_mean_intervals(spark, sf_dir):
    test = _sm_spark(spark, sf_dir).where(F.col("is_test"))
    out = E.with_empirical_interval(test, E.residual_quantiles(test))
    return report(out.select(*KEY_COLS, "pred", "emp_lower", "emp_upper"))


@register("m15_segment_mean_coverage", sql=with_base(
    f"SELECT 'Segment Mean' AS model, "
    f"{R6('avg(CASE WHEN COALESCE(label >= lower AND label <= upper, false) THEN 1e0 ELSE 0e0 END) * 100e0')} AS coverage_pct, "
    f"{R6('avg(upper - lower)')} AS mean_width, {R6('avg(abs(label - pred))')} AS median_mae FROM sm WHERE is_test",
    *_SM_CTES))
def m15_segment_mean_coverage(spark, sf_dir):
    return report(E.coverage(_sm_spark(spark, sf_dir).where(F.col("is_test"))))


@register("m19_segment_mean_residuals", sql=with_base(
    f"SELECT 'Segment Mean' AS model, {KEY}, {R6('label')} AS label, {R6('pred')} AS pred, "
    f"{R6('label - pred')} AS residual FROM sm WHERE is_test", *_SM_CTES))
def m19_segment_mean_residuals(spark, sf_dir):
    return report(E.residuals(_sm_spark(spark, sf_dir).where(F.col("is_test"))))


@register("t3_first120_by_actual", sql=with_base(
    f"SELECT {KEY}, {R6('label')} AS label, {R6('lower')} AS lower, {R6('pred')} AS pred, {R6('upper')} AS upper, "
    f"CAST(row_number() OVER (ORDER BY label, {KEY}) - 1 AS INT) AS idx FROM sm WHERE is_test "
    f"ORDER BY label, {KEY} LIMIT 120", *_SM_CTES))
def t3_first120_by_actual(spark, sf_dir):
    test = _sm_spark(spark, sf_dir).where(F.col("is_test")).select(*KEY_COLS, "label", "lower", "pred", "upper")
    return report(first_by_actual(test, 120, "label"))


# --- M14 on a relational band (segment quantiles of the training labels) --------------------------
@register("m14_segment_quantile_band", sql=with_base(
    f"SELECT {KEY}, {R6('least(q.lo, q.up)')} AS band_lower, {R6('q.md')} AS band_median, "
    f"{R6('greatest(q.lo, q.up)')} AS band_upper FROM sp JOIN (SELECT Segment, quantile_cont(label, 0.025) AS lo, "
    "quantile_cont(label, 0.5) AS md, quantile_cont(label, 0.975) AS up FROM sp WHERE NOT is_test GROUP BY Segment) q "
    "ON q.Segment = sp.Segment WHERE is_test", *_PREP_CTES))
def m14_segment_quantile_band(spark, sf_dir):
    from ..functions.quantiles import exact_quantiles
    d = prepared_table(spark, sf_dir)
    q = exact_quantiles(d.where(~F.col("is_test")), "label",
                        {"q_lower": 0.025, "q_median": 0.5, "q_upper": 0.975}, by=["Segment"])
    band = d.where(F.col("is_test")).join(broadcast_if_small(q), "Segment")
    return report(band.select(*KEY_COLS, *E.quantile_band("q_lower", "q_median", "q_upper")))


# --- M5-M8 one model at a time (fit on train, metrics on test; rows-only) -------------------------
def _single_model(name, **params):
    def q(spark, sf_dir):
        prep = prepared_table(spark, sf_dir)
        _, _, metrics = train_and_evaluate(prep, models=[name], cv=False, **{**FULL, **params})
        return metrics
    return q


register("m5_linear_regression")(_single_model("Linear Regression"))
register("m6_random_forest")(_single_model("Random Forest"))
register("m7_gradient_boosting")(_single_model("Gradient Boosting"))
register("m8_boosted_trees_deep")(_single_model("Boosted Trees (deep)"))
register("m8_regularised_boosting")(_single_model("Regularised Boosting"))


# --- A25: actual range of the test labels (reference-line ends) ------------------------------
@register("a25_actual_range", sql=with_base(
    f"SELECT {R6('min(label)')} AS min_value, {R6('max(label)')} AS max_value FROM sp WHERE is_test", *_PREP_CTES))
def a25_actual_range(spark, sf_dir):
    from ..operators.aggregates import value_range
    return report(value_range(prepared_table(spark, sf_dir).where(F.col("is_test")), "label"))


# --- M5-M9, M18, M20, T5, S6: MLlib models (rows-only) ---------------------------------------
@register("m5_m9_model_metrics")
def m5_m9_model_metrics(spark, sf_dir):
    return _trained(spark, sf_dir)[3]


@register("t5_best_model")
def t5_best_model(spark, sf_dir):
    metrics = _trained(spark, sf_dir)[3]
    return metrics.orderBy(F.col("R2").desc_nulls_last(), F.col("model_order").asc()).limit(1) \
        .select("model", "R2")


@register("m18_m19_test_predictions")
def m18_m19_test_predictions(spark, sf_dir):
    preds = _trained(spark, sf_dir)[2]
    return preds.select("model", *KEY_COLS, "label", "pred", (F.col("label") - F.col("pred")).alias("residual"))


@register("m12_model_intervals")
def m12_model_intervals(spark, sf_dir):
    _, _, preds, metrics = _trained(spark, sf_dir)
    return E.with_empirical_interval(preds, metrics)


def comparison(m):
    """The metrics table as display text."""
    pm = lambda a, b, d: F.concat(F.format_number(a, d), F.lit(" ± "), F.format_number(b, d))
    return m.orderBy("model_order").select(
        "model", money("RMSE").alias("RMSE"), F.format_number("R2", 4).alias("R2"), money("MAE").alias("MAE"),
        pm(F.col("CV_RMSE_mean"), F.col("CV_RMSE_std"), 0).alias("CV_RMSE"),
        pm(F.col("CV_R2_mean"), F.col("CV_R2_std"), 4).alias("CV_R2"),
        pm(F.col("CV_MAE_mean"), F.col("CV_MAE_std"), 0).alias("CV_MAE"))


@register("m20_model_comparison")
def m20_model_comparison(spark, sf_dir):
    return comparison(_trained(spark, sf_dir)[3])


@register("s6_bundle_completeness")
def s6_bundle_completeness(spark, sf_dir):
    return bundle_completeness(_trained(spark, sf_dir)[3])


# --- the same reports on the relational model set (SQL-checked) ---------------------------------
_GM_CTES = _PREP_CTES + [
    "rp AS (" + " UNION ALL ".join(
        f"SELECT '{n}' AS model, {i} AS model_order, {KEY}, label, is_test, fold, m.p AS pred FROM sp "
        f"JOIN (SELECT {g} AS g, avg(label) AS p FROM sp WHERE NOT is_test GROUP BY 1) m ON m.g = sp.{g}"
        for i, (n, g) in enumerate(GROUP_MODELS)) + ")",
    "rt AS (SELECT model, model_order, sqrt(avg((label - pred) * (label - pred))) AS RMSE, "
    "1e0 - sum((label - pred) * (label - pred)) / (count(*) * var_pop(label)) AS R2, avg(abs(label - pred)) AS MAE, "
    "quantile_cont(label - pred, 0.025) AS residual_low, quantile_cont(label - pred, 0.975) AS residual_high "
    "FROM rp WHERE is_test GROUP BY model, model_order)",
    "tr AS (SELECT * FROM sp WHERE NOT is_test)",
    "cf AS (" + " UNION ALL ".join(
        f"SELECT '{n}' AS model, tr.fold, label, (a.S - f.s) / CAST(a.C - f.c AS DOUBLE) AS pred FROM tr "
        f"JOIN (SELECT fold, {g} AS g, sum(label) AS s, count(*) AS c FROM tr GROUP BY 1, 2) f ON f.fold = tr.fold AND f.g = tr.{g} "
        f"JOIN (SELECT {g} AS g, sum(label) AS S, count(*) AS C FROM tr GROUP BY 1) a ON a.g = tr.{g}"
        for n, g in GROUP_MODELS) + ")",
    "cv AS (SELECT model, avg(RMSE) AS rm, stddev_pop(RMSE) AS rs, avg(R2) AS qm, stddev_pop(R2) AS qs, avg(MAE) AS am, "
    "stddev_pop(MAE) AS asd FROM (SELECT model, fold, sqrt(avg((label - pred) * (label - pred))) AS RMSE, "
    "1e0 - sum((label - pred) * (label - pred)) / (count(*) * var_pop(label)) AS R2, avg(abs(label - pred)) AS MAE "
    "FROM cf GROUP BY model, fold) x GROUP BY model)"]


def _group_models(spark, sf_dir):
    """The relational models and their reports, made once per (session, input)."""
    k = (*session_key(spark, sf_dir), "group means")
    if k not in _MEMO:
        fitted, preds, metrics = train_group_models(prepared_table(spark, sf_dir))
        _MEMO[k] = (fitted, preds, metrics.persist())
    return _MEMO[k]


@register("m5_m9_group_model_metrics", sql=with_base(
    f"SELECT rt.model, model_order, {R6('RMSE')} AS RMSE, {R6('R2')} AS R2, {R6('MAE')} AS MAE, {R6('residual_low')} AS residual_low, "
    f"{R6('residual_high')} AS residual_high, {R6('rm')} AS CV_RMSE_mean, {R6('rs')} AS CV_RMSE_std, {R6('qm')} AS CV_R2_mean, "
    f"{R6('qs')} AS CV_R2_std, {R6('am')} AS CV_MAE_mean, {R6('asd')} AS CV_MAE_std FROM rt JOIN cv ON cv.model = rt.model", *_GM_CTES))
def m5_m9_group_model_metrics(spark, sf_dir):
    return report(_group_models(spark, sf_dir)[2].drop("n"))


@register("t5_best_group_model", sql=with_base(
    f"SELECT model, {R6('R2')} AS R2 FROM rt ORDER BY rt.R2 DESC NULLS LAST, model_order LIMIT 1", *_GM_CTES))
def t5_best_group_model(spark, sf_dir):
    return report(best_model(_group_models(spark, sf_dir)[2]).select("model", "R2"))


@register("m18_m19_group_model_predictions", sql=with_base(
    f"SELECT model, {KEY}, {R6('label')} AS label, {R6('pred')} AS pred, {R6('label - pred')} AS residual FROM rp WHERE is_test", *_GM_CTES))
def m18_m19_group_model_predictions(spark, sf_dir):
    return report(E.residuals(_group_models(spark, sf_dir)[1]))


@register("m12_group_model_intervals", sql=with_base(
    f"SELECT rp.model, {KEY}, {R6('pred')} AS pred, {R6('pred + residual_low')} AS emp_lower, {R6('pred + residual_high')} AS emp_upper "
    "FROM rp JOIN rt ON rt.model = rp.model WHERE is_test", *_GM_CTES))
def m12_group_model_intervals(spark, sf_dir):
    _, preds, metrics = _group_models(spark, sf_dir)
    return report(E.with_empirical_interval(preds, metrics).select("model", *KEY_COLS, "pred", "emp_lower", "emp_upper"))


def _pm_sql(a, b, d):
    return f"format('{{:,.{d}f}}', {a}) || ' ± ' || format('{{:,.{d}f}}', {b})"


@register("m20_group_model_comparison", sql=with_base(
    f"SELECT rt.model, '$' || format('{{:,.0f}}', RMSE) AS RMSE, format('{{:,.4f}}', R2) AS R2, '$' || format('{{:,.0f}}', MAE) AS MAE, "
    f"{_pm_sql('rm', 'rs', 0)} AS CV_RMSE, {_pm_sql('qm', 'qs', 4)} AS CV_R2, {_pm_sql('am', 'asd', 0)} AS CV_MAE "
    "FROM rt JOIN cv ON cv.model = rt.model", *_GM_CTES))
def m20_group_model_comparison(spark, sf_dir):
    return comparison(_group_models(spark, sf_dir)[2])


@register("s6_group_model_completeness", sql=with_base("SELECT model, '' AS missing, true AS complete FROM rt", *_GM_CTES))
def s6_group_model_completeness(spark, sf_dir):
    return bundle_completeness(_group_models(spark, sf_dir)[2])


@register("b3_residual_histogram", sql=with_base(
    f"SELECT CAST(i AS INT) AS bin, {R6(BIN_EDGE('he', 'i', 50, False))} AS lo, {R6(BIN_EDGE('he', 'i', 50, True))} AS hi, "
    "CAST(COALESCE(c.cnt, 0) AS BIGINT) AS count FROM he, (SELECT unnest(range(1, 51)) AS i) ii LEFT JOIN "
    f"(SELECT {BIN_IDX('residual', 'he', 50)} AS b, count(*) AS cnt FROM res, he GROUP BY 1) c ON c.b = ii.i", *_GM_CTES,
    "res AS (SELECT label - pred AS residual FROM rp WHERE is_test AND model = 'Segment Mean')", EDGES_CTE("he", "res", "residual", 50)))
def b3_residual_histogram(spark, sf_dir):
    from ..operators.distributions import histogram
    r = E.residuals(_group_models(spark, sf_dir)[1]).where(F.col("model") == "Segment Mean")
    return report(histogram(r, "residual", 50))


# --- M5-M8 on one feature: the learners' own results in closed form -----------------------------
_SEG_MEAN_SQL = (f"SELECT {KEY}, {RN('m.p', 4)} AS pred FROM sp JOIN (SELECT Segment_enc AS g, avg(label) AS p FROM sp "
                 "WHERE NOT is_test GROUP BY 1) m ON m.g = sp.Segment_enc WHERE is_test")


def _on_segment(name, **params):
    """Fitted on the segment code alone, trees of this depth equal the segment means."""
    def q(spark, sf_dir):
        prep = prepared_table(spark, sf_dir)
        model = fit_model(name, prep.where(~F.col("is_test")), features=["Segment_enc"], **params)
        out = model.predict(prep.where(F.col("is_test")), keep=KEY_COLS)
        return out.select(*KEY_COLS, round_even("pred", 4).alias("pred"))
    return q


register("m6_random_forest_on_segment", sql=with_base(_SEG_MEAN_SQL, *_PREP_CTES))(_on_segment("Random Forest", n_trees=5, bootstrap=False))
register("m7_gradient_boosting_on_segment", sql=with_base(_SEG_MEAN_SQL, *_PREP_CTES))(_on_segment("Gradient Boosting", rounds=3))
register("m8_boosted_trees_deep_on_segment", sql=with_base(_SEG_MEAN_SQL, *_PREP_CTES))(_on_segment("Boosted Trees (deep)", rounds=3))


# One round of one split: base value, every candidate's regularised gain, the best split's leaf values
_STUMP = ["DeliveryRadiusKM", "CuisineType_enc", "Segment_enc", "Subregion_enc"]
_PART = "({g}) * ({g}) / (({h}) + 1e0)"
_STUMP_CTES = _PREP_CTES + [
    "tr AS (SELECT sp.*, (SELECT avg(label) FROM sp WHERE NOT is_test) AS base FROM sp WHERE NOT is_test)",
    "cand AS (" + " UNION ALL ".join(
        f"SELECT {i} AS f, v AS point, sum(g) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS GL, "
        "sum(h) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS HL, sum(g) OVER () AS G, sum(h) OVER () AS H "
        f"FROM (SELECT CAST({f} AS DOUBLE) AS v, sum(base - label) AS g, CAST(count(*) AS DOUBLE) AS h FROM tr GROUP BY 1) d{i}"
        for i, f in enumerate(_STUMP)) + ")",
    f"best AS (SELECT * FROM cand WHERE HL >= 1 ORDER BY {_PART.format(g='GL', h='HL')} + {_PART.format(g='G - GL', h='H - HL')} "
    f"- {_PART.format(g='G', h='H')} DESC, f, point LIMIT 1)"]


@register("m8_regularised_stump", sql=with_base(
    f"SELECT {KEY}, {RN('(SELECT avg(label) FROM sp WHERE NOT is_test) + CASE WHEN (CASE best.f ' + ' '.join(f'WHEN {i} THEN {f}' for i, f in enumerate(_STUMP)) + ' END) < best.point THEN -0.3e0 * GL / (HL + 1e0) ELSE -0.3e0 * (G - GL) / (H - HL + 1e0) END', 4)} AS pred "
    "FROM sp, best WHERE is_test", *_STUMP_CTES))
def m8_regularised_stump(spark, sf_dir):
    """One round and one split over four features: the SQL scores every candidate itself."""
    prep = prepared_table(spark, sf_dir)
    model = fit_model("Regularised Boosting", prep.where(~F.col("is_test")), features=_STUMP, rounds=1, max_depth=1)
    out = model.predict(prep.where(F.col("is_test")), keep=KEY_COLS)
    return out.select(*KEY_COLS, round_even("pred", 4).alias("pred"))


# Ten shrunken rounds on the segment code: each takes rate * n / (n + lambda) of what a segment still lacks
register("m8_regularised_boosting_on_segment", sql=with_base(
    f"SELECT {KEY}, {RN('m.p - (m.p - b.base) * power(1e0 - 0.3e0 * m.n / (m.n + 1e0), 10)', 4)} AS pred FROM sp "
    "JOIN (SELECT Segment_enc AS g, avg(label) AS p, CAST(count(*) AS DOUBLE) AS n FROM sp WHERE NOT is_test GROUP BY 1) m ON m.g = sp.Segment_enc, "
    "(SELECT avg(label) AS base FROM sp WHERE NOT is_test) b WHERE is_test", *_PREP_CTES))(_on_segment("Regularised Boosting", rounds=10))


@register("m5_linear_regression_on_aov", sql=with_base(
    f"SELECT {KEY}, {RN('c.i + c.s * AOV', 4)} AS pred FROM sp, (SELECT regr_slope(label, AOV) AS s, regr_intercept(label, AOV) AS i "
    "FROM sp WHERE NOT is_test) c WHERE is_test", *_PREP_CTES))
def m5_linear_regression_on_aov(spark, sf_dir):
    prep = prepared_table(spark, sf_dir)
    model = fit_model("Linear Regression", prep.where(~F.col("is_test")), features=["AOV"])
    out = model.predict(prep.where(F.col("is_test")), keep=KEY_COLS)
    return out.select(*KEY_COLS, round_even("pred", 4).alias("pred"))


# Two features solved in closed form; the library solves the same sums in general
_TWO = ["AOV", "DeliveryRadiusKM"]
_OLS2 = ("(SELECT {k} b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM (SELECT {k} (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) AS b1, "
         "(c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) AS b2, m1, m2, my FROM (SELECT {k} var_pop(AOV) AS v1, "
         "var_pop(DeliveryRadiusKM) AS v2, covar_pop(AOV, DeliveryRadiusKM) AS v12, covar_pop(AOV, label) AS c1, "
         "covar_pop(DeliveryRadiusKM, label) AS c2, avg(AOV) AS m1, avg(DeliveryRadiusKM) AS m2, avg(label) AS my "
         "FROM {src}) a) b)")


@register("m5_linear_regression_from_sums", sql=with_base(
    f"SELECT {KEY}, {RN('c.b0 + c.b1 * AOV + c.b2 * DeliveryRadiusKM', 4)} AS pred FROM sp, "
    f"{_OLS2.format(k='', src='sp WHERE NOT is_test')} c WHERE is_test", *_PREP_CTES))
def m5_linear_regression_from_sums(spark, sf_dir):
    prep = prepared_table(spark, sf_dir)
    model, _ = linear.fit_folds(prep.where(~F.col("is_test")), _TWO, None)
    return model.predict(prep.where(F.col("is_test")), keep=KEY_COLS).withColumn("pred", round_even("pred", 4))


@register("m9_linear_cv_folds_from_sums", sql=with_base(
    f"SELECT '{linear.NAME}' AS model, fold, {RN('sqrt(avg(e * e))', 4)} AS RMSE, "
    f"{RN('1e0 - sum(e * e) / (count(*) * var_pop(label))', 4)} AS R2, {RN('avg(abs(e))', 4)} AS MAE, CAST(count(*) AS BIGINT) AS n "
    "FROM (SELECT tr.fold, label, label - (c.b0 + c.b1 * AOV + c.b2 * DeliveryRadiusKM) AS e FROM tr JOIN "
    + _OLS2.format(k="held,", src="(SELECT held, tr.* FROM tr JOIN (SELECT DISTINCT fold AS held FROM tr) h ON h.held <> tr.fold) o GROUP BY held")
    + " c ON c.held = tr.fold) x GROUP BY fold", *_PREP_CTES, "tr AS (SELECT * FROM sp WHERE NOT is_test)"))
def m9_linear_cv_folds_from_sums(spark, sf_dir):
    train = prepared_table(spark, sf_dir).where(~F.col("is_test"))
    _, by_fold = linear.fit_folds(train, _TWO)
    held = linear.held_out_predictions(train, by_fold).withColumn("model", F.lit(linear.NAME))
    m = E.regression_metrics(held, by=("model", "fold"))
    return m.withColumns({c: round_even(c, 4) for c in ("RMSE", "R2", "MAE")})


# --- M13, M14, M15 ------------------------------------------------------------------------------
@register("m13_m15_quantile_coverage")
def m13_m15_quantile_coverage(spark, sf_dir):
    prep = prepared_table(spark, sf_dir)
    band = predict_band(_quantile_models(spark, sf_dir), prep.where(F.col("is_test")))
    return E.coverage(band.withColumn("model", F.lit("Quantile Boosting")),
                      lower="q_lower", upper="q_upper", median="q_median")


# On the segment code alone each round moves a segment a tenth of the way to its own quantile
# (the smallest label whose cumulative count reaches the level), from the quantile of all labels
ROUNDS_ON_SEGMENT = 8
_BAND_TERM = "q.{b} - (q.{b} - a.{b}) * pow(0.9e0, " + str(ROUNDS_ON_SEGMENT) + ")"
BAND_ON_SEGMENT_SQL = (
    f"SELECT {KEY}, " + ", ".join(f"{RN(_BAND_TERM.format(b=b), 4)} AS q_{b}" for b in QUANTILE_ALPHAS)
    + " FROM sp JOIN (SELECT Segment_enc AS g, " + ", ".join(f"quantile_disc(label, {a}) AS {b}" for b, a in QUANTILE_ALPHAS.items())
    + " FROM sp WHERE NOT is_test GROUP BY 1) q ON q.g = sp.Segment_enc, (SELECT "
    + ", ".join(f"quantile_cont(label, {a}) AS {b}" for b, a in QUANTILE_ALPHAS.items()) + " FROM sp WHERE NOT is_test) a WHERE is_test")


def band_on_segment(models, prep):
    band = predict_band(models, prep.where(F.col("is_test")))
    return band.select(*KEY_COLS, *[round_even(f"q_{b}", 4).alias(f"q_{b}") for b in QUANTILE_ALPHAS])


@register("m13_quantile_boosting_on_segment", sql=with_base(BAND_ON_SEGMENT_SQL, *_PREP_CTES))
def m13_quantile_boosting_on_segment(spark, sf_dir):
    prep = prepared_table(spark, sf_dir)
    models = fit_quantile_models(prep.where(~F.col("is_test")), rounds=ROUNDS_ON_SEGMENT, features=["Segment_enc"])
    return band_on_segment(models, prep)


# --- M16 ------------------------------------------------------------------------------------------
@register("m16_permutation_importance")
def m16_permutation_importance(spark, sf_dir):
    prep, fitted, _, _ = _trained(spark, sf_dir)
    test = prep.where(F.col("is_test"))
    return permutation_importance(fitted["Random Forest"], test, n_repeats=10)


# One cycle per repeat over the test rows in the order of a portable hash; the next row is the donor
_IMPORTANCE = ["Segment_enc", "CuisineType_enc", "AOV"]
_IMP_CTES = _GM_CTES + [
    "te AS (SELECT sp.*, r, CAST(('0x' || substr(md5(concat_ws('|', CAST(RestaurantID AS VARCHAR), CAST(Yr AS VARCHAR), "
    "CAST(Mo AS VARCHAR), '42:' || CAST(r AS VARCHAR))), 1, 8)) AS BIGINT) AS h FROM sp, (SELECT unnest(range(0, 10)) AS r) rr WHERE is_test)",
    f"dn AS (SELECT r, label, COALESCE(lead(Segment_enc) OVER w, first_value(Segment_enc) OVER w) AS donor FROM te "
    f"WINDOW w AS (PARTITION BY r ORDER BY h, {KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))",
    "pr AS (SELECT r, 1e0 - sum((label - m.p) * (label - m.p)) / (count(*) * var_pop(label)) AS R2 FROM dn "
    "JOIN (SELECT Segment_enc AS g, avg(label) AS p FROM sp WHERE NOT is_test GROUP BY 1) m ON m.g = dn.donor GROUP BY r)",
    "b0 AS (SELECT R2 AS b FROM rt WHERE model = 'Segment Mean')"]


@register("m16_group_model_importance", sql=with_base(
    f"SELECT 'Segment_enc' AS feature, 0 AS feature_order, {R6('b')} AS baseline_r2, {R6('avg(b - R2)')} AS importance_mean, "
    f"{R6('stddev_pop(b - R2)')} AS importance_std FROM pr, b0 GROUP BY b " + " ".join(
        f"UNION ALL SELECT '{f}', {i}, {R6('b')}, 0e0, 0e0 FROM b0" for i, f in enumerate(_IMPORTANCE) if i), *_IMP_CTES))
def m16_group_model_importance(spark, sf_dir):
    """Importance to the segment means: of the segment code, and of two features that they do not read."""
    fitted = _group_models(spark, sf_dir)[0]
    test = prepared_table(spark, sf_dir).where(F.col("is_test"))
    return report(permutation_importance(fitted["Segment Mean"], test, _IMPORTANCE, n_repeats=10))


# --- M17 ------------------------------------------------------------------------------------------
def secondary_targets(spark, sf_dir, fit):
    """Metrics of every secondary target's models (outliers out, codes of the rest); ``fit`` takes a
    prepared table and gives the metrics."""
    bt = _bt(spark, sf_dir)
    out = None
    for target in SECONDARY_TARGETS:
        metrics = fit(prepared(bt, target=target, exclude_outliers=True,
                               codes=code_tables(spark, sf_dir, non_outliers=True)))
        best = best_model(metrics).select(F.col("model").alias("_best"))
        m = (metrics.join(F.broadcast(best), F.lit(True), "left")   # one row
             .select(F.lit(target).alias("target"), "model", "RMSE", "R2", "MAE", "n",
                     (F.col("model") == F.col("_best")).alias("is_best")))
        out = m if out is None else out.unionByName(m)
    return out


@register("m17_secondary_targets")
def m17_secondary_targets(spark, sf_dir):
    return secondary_targets(spark, sf_dir, lambda prep: train_and_evaluate(
        prep, models=["Random Forest", "Boosted Trees (deep)"], cv=False, **CROSS_VALIDATED)[2])


_SECONDARY_CTES = [
    "nt AS (SELECT * FROM t WHERE NOT IsOutlier)", *_codes("nt"), f"e AS ({_enc_join('nt')})",
    "sp AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS target, {', '.join(c + '_enc' for c in CATEGORY_COLS)}, COALESCE({t}, 0e0) AS label, "
        f"{_hash(42, 100)} < 20 AS is_test FROM e" for t in SECONDARY_TARGETS) + ")",
    "rp AS (" + " UNION ALL ".join(
        f"SELECT sp.target, '{n}' AS model, {i} AS model_order, label, m.p AS pred FROM sp JOIN (SELECT target, {g} AS g, avg(label) AS p "
        f"FROM sp WHERE NOT is_test GROUP BY 1, 2) m ON m.target = sp.target AND m.g = sp.{g} WHERE is_test"
        for i, (n, g) in enumerate(GROUP_MODELS)) + ")",
    "rt AS (SELECT target, model, model_order, sqrt(avg((label - pred) * (label - pred))) AS RMSE, "
    "1e0 - sum((label - pred) * (label - pred)) / (count(*) * var_pop(label)) AS R2, avg(abs(label - pred)) AS MAE, "
    "CAST(count(*) AS BIGINT) AS n FROM rp GROUP BY 1, 2, 3)"]


@register("m17_group_model_secondary_targets", sql=with_base(
    f"SELECT target, model, {R6('RMSE')} AS RMSE, {R6('R2')} AS R2, {R6('MAE')} AS MAE, n, "
    "row_number() OVER (PARTITION BY target ORDER BY rt.R2 DESC NULLS LAST, model_order) = 1 AS is_best FROM rt", *_SECONDARY_CTES))
def m17_group_model_secondary_targets(spark, sf_dir):
    return report(secondary_targets(spark, sf_dir, lambda prep: train_group_models(prep)[2]))
