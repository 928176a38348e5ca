"""Relational model evaluation (M10-M12, M14, M15, M19) over a predictions
table ``(model, keys..., label, pred[, lower, upper])``.

Every metric is one grouped aggregate by ``model`` (a handful of groups,
map-side combined); residual quantiles use the skew-proof exact quantile
operator; the per-model interval offsets are a table with one row per model
(bounded by the model list) joined back. None of this depends on how the
predictions were produced, so the same code scores MLlib models and the
SQL-checkable segment-mean predictor below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..schema import INTERVAL_PROBS, KEY_COLS
from ..session import broadcast_if_small


def regression_metrics(preds: DataFrame, by=("model",), label: str = "label",
                       pred: str = "pred") -> DataFrame:
    """RMSE, R^2 (1 - SSE / (n var_pop)), MAE per group in one pass."""
    e = F.col(label) - F.col(pred)
    return preds.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("RMSE"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.count(F.lit(1)) * F.var_pop(label))).alias("R2"),
        F.avg(F.abs(e)).alias("MAE"),
        F.count(F.lit(1)).alias("n"))


def residuals(preds: DataFrame, key_cols=KEY_COLS) -> DataFrame:
    """Actual, predicted and residual (actual - predicted)."""
    return preds.select("model", *key_cols, "label", "pred",
                        (F.col("label") - F.col("pred")).alias("residual"))


def residual_quantiles(preds: DataFrame, probs=INTERVAL_PROBS) -> DataFrame:
    """Empirical residual quantiles per model (linear interpolation)."""
    r = preds.select("model", (F.col("label") - F.col("pred")).alias("residual"))
    return exact_quantiles(r, "residual", {"residual_low": probs[0], "residual_high": probs[1]},
                           by=["model"], bounded_groups=True)   # one group per model in the list


def with_empirical_interval(preds: DataFrame, offsets: DataFrame) -> DataFrame:
    """``pred + residual_low`` .. ``pred + residual_high`` (offsets: one row per model)."""
    o = offsets.select("model", "residual_low", "residual_high")
    return (preds.join(F.broadcast(o), "model", "left")
            .withColumns({"emp_lower": F.col("pred") + F.col("residual_low"),
                          "emp_upper": F.col("pred") + F.col("residual_high")})
            .drop("residual_low", "residual_high"))


def quantile_band(lower, median, upper):
    """(min(l, u), median, max(l, u)) as three columns."""
    lo, md, up = [F.col(c) if isinstance(c, str) else c for c in (lower, median, upper)]
    return F.least(lo, up).alias("band_lower"), md.alias("band_median"), F.greatest(lo, up).alias("band_upper")


def coverage(preds: DataFrame, by=("model",), lower: str = "lower", upper: str = "upper",
             median: str = "pred", label: str = "label") -> DataFrame:
    """% of rows inside the raw [lower, upper] (inclusive, not reordered),
    mean width and the median model's MAE."""
    y = F.col(label)
    inside = (y >= F.col(lower)) & (y <= F.col(upper))
    return preds.groupBy(*by).agg(
        (F.avg(F.coalesce(inside, F.lit(False)).cast("double")) * 100.0).alias("coverage_pct"),
        F.avg(F.col(upper) - F.col(lower)).alias("mean_width"),
        F.avg(F.abs(y - F.col(median))).alias("median_mae"))


def _with_group(prep: DataFrame, segments: DataFrame | None, by: str, key_cols) -> DataFrame:
    """``prep`` with the group column: its own, or joined from ``segments`` by the row key."""
    return prep if by in prep.columns else prep.join(segments.select(*key_cols, by), key_cols)


def segment_mean_predictions(prep: DataFrame, segments: DataFrame | None = None, by: str = "Segment",
                             key_cols=KEY_COLS, z: float = 1.96) -> DataFrame:
    """A relational predictor used to check the evaluators against SQL.

    ``prep`` has keys, ``label``, ``is_test``, ``fold``; ``segments`` maps keys
    to the group column. Prediction = mean label of the row's group among
    training rows; band = pred -/+ z * sample std.
    """
    d = _with_group(prep, segments, by, key_cols)
    stats = (d.where(~F.col("is_test")).groupBy(by)
             .agg(F.avg("label").alias("_m"), F.stddev_samp("label").alias("_s")))
    out = d.join(broadcast_if_small(stats), by, "left")     # one row per group value
    return out.select(F.lit("Segment Mean").alias("model"), *key_cols, by, "is_test", "fold", "label",
                      F.col("_m").alias("pred"), (F.col("_m") - z * F.col("_s")).alias("lower"),
                      (F.col("_m") + z * F.col("_s")).alias("upper"))


def fold_metrics_segment_mean(prep: DataFrame, segments: DataFrame | None = None, by: str = "Segment",
                              key_cols=KEY_COLS, model: str = "Segment Mean") -> DataFrame:
    """M9 on the segment-mean predictor: for each fold, fit on the other
    training folds, score the held-out fold; then mean and population std."""
    d = _with_group(prep.where(~F.col("is_test")), segments, by, key_cols)
    per_fold_group = d.groupBy("fold", by).agg(F.sum("label").alias("_fs"), F.count(F.lit(1)).alias("_fc"))
    tot = d.groupBy(by).agg(F.sum("label").alias("_gs"), F.count(F.lit(1)).alias("_gc"))
    # mean of the group over the other folds = (total - this fold) / (count - this fold)
    loo = (per_fold_group.join(tot, by)
           .select("fold", by, F.try_divide(F.col("_gs") - F.col("_fs"),
                                            (F.col("_gc") - F.col("_fc")).cast("double")).alias("pred")))
    scored = d.join(broadcast_if_small(loo), ["fold", by], "left").withColumn("model", F.lit(model))
    m = regression_metrics(scored, by=("model", "fold"))
    return m


def cv_summary(fold_metrics: DataFrame) -> DataFrame:
    """Mean and population std of the per-fold metrics, per model."""
    return fold_metrics.groupBy("model").agg(
        F.avg("RMSE").alias("CV_RMSE_mean"), F.stddev_pop("RMSE").alias("CV_RMSE_std"),
        F.avg("R2").alias("CV_R2_mean"), F.stddev_pop("R2").alias("CV_R2_std"),
        F.avg("MAE").alias("CV_MAE_mean"), F.stddev_pop("MAE").alias("CV_MAE_std"))
