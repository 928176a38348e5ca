"""A model set made of relational operators: group means behind the ``predict`` interface.

Each model predicts the mean training label of a row's category code. The set goes
through the same evaluation, comparison, interval and scenario code as the fitted MLlib
models, and all of its results can be computed in plain SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY_COLS
from ..session import broadcast_if_small
from .evaluate import cv_summary, fold_metrics_segment_mean, regression_metrics, residual_quantiles

GROUP_MODELS = [("Cuisine Mean", "CuisineType_enc"), ("Segment Mean", "Segment_enc"), ("Subregion Mean", "Subregion_enc")]


@dataclass
class GroupMeanModel:
    name: str
    by: str
    means: DataFrame      # one row per code: by, _mean

    def predict(self, df: DataFrame, keep=None) -> DataFrame:
        """Add ``pred`` (NULL for a code without training rows); ``keep`` columns are carried."""
        keep = list(keep) if keep is not None else df.columns
        means = self.means.select(F.col(self.by).alias("_code"), "_mean")
        return df.join(means, F.col(self.by).cast("double") == F.col("_code"), "left").select(*keep, F.col("_mean").alias("pred"))


    def thresholds(self) -> dict:
        """No split points: the prediction is the same for every mix."""
        return {}


@dataclass
class BinMeanModel:
    """Mean training label per cell of fixed split points of some features, the overall mean elsewhere."""
    name: str
    points: dict          # feature -> sorted split points; a value's bin is how many lie below it
    means: DataFrame      # _b0, _b1, ... , _mean
    overall: float

    def predict(self, df: DataFrame, keep=None) -> DataFrame:
        keep = list(keep) if keep is not None else df.columns
        x = df.select("*", *[b.alias(f"_x{i}") for i, b in enumerate(_bins(self.points))])
        on = [x[f"_x{i}"] == self.means[f"_b{i}"] for i in range(len(self.points))]
        out = x.join(F.broadcast(self.means), on, "left")          # one row per cell of fixed points
        return out.select(*[x[k] for k in keep], F.coalesce("_mean", F.lit(self.overall)).alias("pred"))

    def thresholds(self) -> dict:
        return self.points


def _bins(points: dict):
    for f, ts in points.items():
        b = F.lit(0)
        for t in ts:
            b = b + F.when(F.col(f) > t, 1).otherwise(0)
        yield b


def fit_bin_mean(name: str, train: DataFrame, points: dict) -> BinMeanModel:
    means = (train.groupBy(*[b.alias(f"_b{i}") for i, b in enumerate(_bins(points))]).agg(F.avg("label").alias("_mean")))
    return BinMeanModel(name, points, means, train.agg(F.avg("label")).first()[0])


def fit_group_mean(name: str, train: DataFrame, by: str) -> GroupMeanModel:
    means = train.groupBy(F.col(by).cast("double").alias(by)).agg(F.avg("label").alias("_mean"))
    return GroupMeanModel(name, by, broadcast_if_small(means))


def train_group_models(prep: DataFrame, models=GROUP_MODELS, key_cols=KEY_COLS):
    """Like ``train_and_evaluate``: (fitted, test predictions, metrics with CV) of the group means."""
    train, test = prep.where(~F.col("is_test")), prep.where(F.col("is_test"))
    fitted = {name: fit_group_mean(name, train, by) for name, by in models}
    preds = folds = None
    for name, by in models:
        p = fitted[name].predict(test, keep=[*key_cols, "label"]).withColumn("model", F.lit(name))
        f = fold_metrics_segment_mean(prep, by=by, key_cols=key_cols, model=name)
        preds, folds = (p, f) if preds is None else (preds.unionByName(p), folds.unionByName(f))
    order = F.create_map(*[x for i, (m, _) in enumerate(models) for x in (F.lit(m), F.lit(i))])
    metrics = (regression_metrics(preds).join(residual_quantiles(preds), "model", "left")
               .join(cv_summary(folds), "model", "left").withColumn("model_order", order[F.col("model")]))
    return fitted, preds, metrics
