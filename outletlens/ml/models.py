"""Distributed regressors.

A linear fit is a :class:`FittedModel`: an MLlib ``PipelineModel``
(``VectorAssembler`` + regressor) plus the train-fitted population-std scaler
applied to the flat columns first (M18: only the linear model sees scaled inputs).
In cross-validation it needs no fits a fold: all its models come from one table of
sums (:mod:`.linear`). Forests and boosted trees (:mod:`.trees`) are fitted for the whole
training set and all folds together, from one binned copy of the rows; the
learners run side by side from a small driver thread pool, each fit itself distributed.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES, KEY_COLS, MODEL_ORDER
from . import boosting, linear, trees
from .evaluate import cv_summary, regression_metrics, residual_quantiles
from .prepare import check_finite, Scaler, fit_scaler

@dataclass
class FittedModel:
    name: str
    pipeline: PipelineModel
    scaler: Scaler | None = None
    features: list = field(default_factory=lambda: list(FEATURES))

    def predict(self, df: DataFrame, keep=None) -> DataFrame:
        """Add ``pred``; ``keep`` columns are carried through."""
        keep = list(keep) if keep is not None else [c for c in df.columns if c not in self.features]
        # narrow projection: scaling (linear model only) fuses into the scan stage
        x = self.scaler.transform(df, self.features) if self.scaler else df
        out = self.pipeline.transform(x)
        return out.select(*keep, F.col("prediction").alias("pred"))

    def thresholds(self) -> None:
        """A linear model is not made of steps."""
        return None


def fit_model(name: str, train: DataFrame, features=FEATURES, **params):
    check_finite(train, features)
    if name == boosting.NAME:      # not MLlib: parameters of other learners are left out
        own = {k: v for k, v in params.items() if k not in ("n_trees", "rf_depth", "bootstrap")}
        return boosting.fit_boosted(train, features, **own)
    if name in trees.LEARNERS:
        blocks = trees.binned(train, features)
        try:
            return trees.fit_learner(blocks, name, **params)[0]
        finally:
            blocks.unpersist()
    if name != linear.NAME:
        raise ValueError(f"unknown model {name!r}")
    scaler = fit_scaler(train, features)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error"),
                            LinearRegression(featuresCol="features", labelCol="label", regParam=0.0,
                                             elasticNetParam=0.0, solver="auto")])
    return FittedModel(name, pipe.fit(scaler.transform(train, features).select(*features, "label")), scaler, list(features))


def _persist(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def train_and_evaluate(prep: DataFrame, models=MODEL_ORDER, features=FEATURES, cv: bool = True,
                       folds: int = 5, parallelism: int = 4, key_cols=KEY_COLS, **params):
    """Fit every model on the training split, score the test split, and run
    ``folds``-fold CV on the training split. The linear model and its fold models come from
    one aggregate, a tree learner's from one set of jobs; other learners are fitted fold by fold.

    Returns ``(fitted: dict, predictions DataFrame, metrics DataFrame)``;
    metrics has one row per model with RMSE, R2, MAE, residual quantiles and
    the CV means / population stds, and ``model_order`` for tie-breaking.
    """
    train = _persist(prep.where(~F.col("is_test")).select(*key_cols, *features, "label", "fold"))
    test = prep.where(F.col("is_test")).select(*key_cols, *features, "label")
    fits = [None, *range(folds)] if cv else [None]
    jobs = [(m, f) for m in models if m not in trees.LEARNERS for f in (fits if m != linear.NAME else [None])]
    grown = [m for m in models if m in trees.LEARNERS]
    blocks = trees.binned(check_finite(train, features), features, fits) if grown else None
    linear_folds = {}

    def run(job):
        m, f = job
        if m in grown:                    # the whole set and all folds together
            return [((m, f), fit) for f, fit in zip(fits, trees.fit_learner(blocks, m, **params))]
        if m == linear.NAME:
            whole, by_fold = linear.fit_folds(train, features, "fold" if cv else None)
            linear_folds.update(by_fold)
            return [(job, whole)]
        data = train if f is None else train.where(F.col("fold") != f)
        return [(job, fit_model(m, data, features, **params))]

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        fitted_all = dict(x for done in pool.map(run, [*[(m, None) for m in grown], *jobs]) for x in done)
    if blocks:
        blocks.unpersist()
    fitted = {m: fitted_all[(m, None)] for m in models}

    preds = None
    for i, m in enumerate(models):
        p = fitted[m].predict(test, keep=[*key_cols, "label"]).withColumn("model", F.lit(m))
        preds = p if preds is None else preds.unionByName(p)
    preds = _persist(preds)          # the residual quantiles read them several times
    order = F.create_map(*[x for i, m in enumerate(models) for x in (F.lit(m), F.lit(i))])
    metrics = regression_metrics(preds).join(residual_quantiles(preds), "model", "left")
    if cv:
        fold_preds = None
        for m in models:
            if m == linear.NAME:
                parts = [linear.held_out_predictions(train, linear_folds).withColumn("model", F.lit(m))]
            else:
                parts = [fitted_all[(m, f)].predict(train.where(F.col("fold") == f), keep=["label"])
                         .withColumns({"model": F.lit(m), "fold": F.lit(f)}) for f in range(folds)]
            for p in parts:
                fold_preds = p if fold_preds is None else fold_preds.unionByName(p)
        metrics = metrics.join(cv_summary(regression_metrics(fold_preds, by=("model", "fold"))),
                               "model", "left")
    # scored and measured once, then the training copy goes
    metrics = _persist(metrics.withColumn("model_order", order[F.col("model")]))
    metrics.count()
    train.unpersist()
    return fitted, preds, metrics


def best_model_name(metrics: DataFrame) -> str:
    """T5: highest test R^2, first in declaration order on ties (one row)."""
    row = metrics.orderBy(F.col("R2").desc_nulls_last(), F.col("model_order").asc()).first()
    return row["model"]
