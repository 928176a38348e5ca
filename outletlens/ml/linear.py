"""Least squares of all rows and of every cross-validation fold from one table of sums (M5, M9).

The normal equations need only the sums of products of two columns. One aggregate by fold
(map-side combined; ``folds x (k + 2)^2`` numbers for ``k`` features) holds them; the sums
of all rows but a fold's are the total less that fold's, so the model of the whole training set and
the models of all folds cost the same two scans. Columns are centred and scaled by the whole set's
mean and deviation before they are summed, so the sums stay of order n and the differences keep
their digits. The driver holds these sums alone and solves k equations a fold.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES

NAME = "Linear Regression"
# A pivot or eigenvalue below this share of the largest one counts as zero: the sums of n standardised
# products carry a rounding error of about 1e-13 of n
TOLERANCE = 1e-10


@dataclass
class LinearModel:
    """``intercept + sum(weight * (x - mean) / scale)``; all lists are in the order of ``features``."""
    name: str
    features: list
    means: list
    scales: list
    weights: list
    intercept: float

    def column(self):
        terms = [F.lit(float(w)) * ((F.col(f) - F.lit(float(m))) / F.lit(float(s)))
                 for f, m, s, w in zip(self.features, self.means, self.scales, self.weights)]
        return reduce(lambda a, b: a + b, terms, F.lit(float(self.intercept)))

    def predict(self, df: DataFrame, keep=None) -> DataFrame:
        """Add ``pred``; ``keep`` columns are carried through. One projection."""
        keep = list(keep) if keep is not None else [c for c in df.columns if c not in self.features]
        return df.select(*keep, self.column().alias("pred"))

    def thresholds(self) -> None:
        """Not made of steps."""
        return None


def column_stats(train: DataFrame, features=FEATURES) -> tuple:
    """(means, scales) of the features and, last, the label: population deviations, 1 for a constant column.
    Raises if a value is missing, infinite or NaN, naming the columns and their counts, or if there are no rows."""
    cols = [*features, "label"]
    # values in long form: three aggregates in generated code, whatever the number of columns
    rows = (train.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("i", "v")).groupBy("i")
            .agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"),
                 F.count_if(~F.coalesce(F.abs(F.col("v")) < F.lit(float("inf")), F.lit(False))).alias("bad"))
            .orderBy("i").collect())                # one row a column
    if not rows:
        raise ValueError("no rows to fit on")
    wrong = {cols[r["i"]]: r["bad"] for r in rows if r["bad"]}
    if wrong:
        raise ValueError(f"missing, infinite or NaN values in {wrong}; exclude these rows or columns before fitting")
    return [r["m"] for r in rows], [r["s"] or 1.0 for r in rows]


def fold_sums(train: DataFrame, features, means, scales, fold: str | None = "fold") -> dict:
    """fold -> symmetric matrix of the sums of products of (1, features, label), centred and scaled."""
    cols = [*features, "label"]
    z = train.select(*([F.col(fold).alias("_fold")] if fold else [F.lit(0).alias("_fold")]), F.lit(1.0).alias("z0"),
                     *[((F.col(c) - F.lit(float(m))) / F.lit(float(s))).alias(f"z{i + 1}")
                       for i, (c, m, s) in enumerate(zip(cols, means, scales))])
    names = [f"z{i}" for i in range(len(cols) + 1)]
    # a row meets itself once a column: k + 2 sums in generated code instead of some k^2 / 2 in none
    rows = (z.select("*", F.posexplode(F.array(*names)).alias("i", "v")).groupBy("_fold", "i")
            .agg(*[F.sum(F.col("v") * F.col(n)).alias(n) for n in names]))
    out = {}
    for row in rows.collect():                     # k + 2 rows a fold
        m = out.setdefault(row["_fold"], np.zeros((len(names), len(names))))
        m[row["i"]] = [row[n] for n in names]
    return out


def solve(sums: np.ndarray) -> tuple | None:
    """(weights, intercept) in scaled units from a matrix of :func:`fold_sums`; None without rows.

    By Cholesky factors; where columns depend on each other, the solution of least norm (as the
    reference's solver gives), whose predictions are the same as any other solution's on the rows fitted."""
    n = sums[0, 0]
    if n < 0.5:
        return None
    mean = sums[0, 1:] / n
    cov = sums[1:, 1:] / n - np.outer(mean, mean)
    a, b = cov[:-1, :-1], cov[:-1, -1]
    if not len(a):
        return np.zeros(0), mean[-1]
    w = None
    try:
        low = np.linalg.cholesky(a)
        pivots = np.diag(low) ** 2
        if pivots.min() > TOLERANCE * pivots.max():
            w = np.linalg.solve(low.T, np.linalg.solve(low, b))
    except np.linalg.LinAlgError:
        pass
    if w is None:
        values, vectors = np.linalg.eigh(a)
        used = values > TOLERANCE * max(values.max(), 0.0)
        w = vectors[:, used] @ ((vectors[:, used].T @ b) / values[used])
    return w, mean[-1] - w @ mean[:-1]


def fit_folds(train: DataFrame, features=FEATURES, fold: str | None = "fold") -> tuple:
    """(model of all rows, {fold: model of the rows outside it}) from two scans.

    ``fold=None`` fits the whole set only. A fold that holds all rows has no model (None)."""
    features = list(features)
    means, scales = column_stats(train, features)
    by_fold = fold_sums(train, features, means, scales, fold)
    total = sum(by_fold.values())

    def model(sums):
        solved = solve(sums)
        if solved is None:
            return None
        w, b = solved
        y_mean, y_scale = means[-1], scales[-1]
        return LinearModel(NAME, features, means[:-1], scales[:-1], [float(x) * y_scale for x in w], float(b) * y_scale + y_mean)
    return model(total), ({f: model(total - m) for f, m in by_fold.items()} if fold else {})


def held_out_predictions(train: DataFrame, fold_models: dict, keep=("label",), fold: str = "fold") -> DataFrame:
    """Every row's ``pred`` by the model that did not see its fold; one scan. NULL where there is none."""
    pred = F.lit(None).cast("double")
    for f, m in fold_models.items():
        if m is not None:
            pred = F.when(F.col(fold) == F.lit(f), m.column()).otherwise(pred)
    return train.select(*keep, fold, pred.alias("pred"))
