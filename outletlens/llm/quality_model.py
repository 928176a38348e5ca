"""Quality scores by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics. Each class has a Gaussian whose
covariance is shrunk towards the diagonal of the pooled one; a score is the difference
of the two log densities (Mahalanobis distances by the classes' Cholesky factors, made
once) plus the log odds of the classes, divided by the number of statistics and put
through a logistic curve, so that it ranks texts and is 0.5 on the boundary.

Training is one pass of sums over all labelled rows: nothing is sampled or collected
but the sums. Defined cases: null text is empty and is scored like any text; null
labels are left out; a doc_id labelled twice counts twice; a label without a document
is ignored; without any label every score is 0.5, with one class only 1 or 0. Repeated
rows get equal scores; extra columns are not looked at.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletlens.llm.common import lean, restored, schema_of, scratch, ship, whole
from outletlens.llm.hashing import chunks

SHRINK = 0.2
_RIDGE = 1e-4
_CHUNK = 1 << 20
STATISTICS = ("log words", "log word length", "log line words", "symbols", "marks", "shouts", "digits", "upper case",
              "letters", "distinct words", "echoed words", "repeated lines", "cells")


def statistics(texts: list) -> np.ndarray:
    """One row of transformed statistics for each text (null: empty)."""
    texts = ["" if t is None else t for t in texts]
    out = np.zeros((len(texts), len(STATISTICS)))
    for lo, hi in chunks([len(t) + 1 for t in texts], _CHUNK):
        part = texts[lo:hi]
        code = np.frombuffer(("\n".join(part) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        length = np.array([len(t) for t in part])
        first = np.cumsum(length + 1) - length - 1
        ascii_ = np.minimum(code, 127)

        def share(table, of, code=ascii_, first=first):
            return np.add.reduceat(table[code].astype(np.int64), first) / np.maximum(of, 1)
        is_ = {k: np.isin(np.arange(128), [ord(c) for c in v]) for k, v in
               {"symbols": "#*$%&<>@\\^~=+_", "marks": ".,;:?'\"-()", "shouts": "!", "digits": "0123456789",
                "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "cells": "|"}.items()}
        upper, lower = share(is_["upper"], 1), share(is_["lower"], 1)
        words = [t.split() for t in part]
        n = np.array([len(w) for w in words])
        lines = [t.split("\n") for t in part]
        n_lines = np.array([len(x) for x in lines])
        distinct = np.array([len(set(w)) for w in words])
        out[lo:hi] = np.column_stack([
            np.log1p(n), np.log1p(length / np.maximum(n, 1)), np.log1p(n / n_lines),
            np.sqrt(share(is_["symbols"], length)), np.sqrt(share(is_["marks"], length)), np.sqrt(share(is_["shouts"], length)),
            np.sqrt(share(is_["digits"], length)), np.sqrt(upper / np.maximum(upper + lower, 1)),
            (upper + lower) / np.maximum(length, 1), np.log1p(distinct) / np.maximum(np.log1p(n), 1e-9) * (n > 0),
            np.sqrt(np.array([sum(map(eq, w, w[1:])) for w in words]) / np.maximum(n, 1)),
            1 - np.array([len(set(x)) for x in lines]) / n_lines, np.sqrt(share(is_["cells"], length))])
    return out


def featured(docs: DataFrame, keep: list) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``stats``, the statistics of its text."""
    names = [c for c in keep if c != "stats"]

    def go(batches):
        for pdf in batches:
            yield pdf[names].assign(stats=list(statistics(pdf["_llm_text"].tolist())))
    rows = whole(docs.select(*names, F.col("text").cast("string").alias("_llm_text")), [*names, "_llm_text"])
    return restored(rows.mapInPandas(lean(go), f"{schema_of(docs, names)}, stats array<double>"), docs, names)


class Gaussians:
    """Means, inverse Cholesky factors and log determinants of both classes."""

    def __init__(self, counts, sums, products, shrink: float = SHRINK):
        self.counts = np.asarray(counts, float)
        if (self.counts <= 0).any():
            return
        n = self.counts
        self.means = [sums[k] / n[k] for k in (0, 1)]
        cov = [products[k] / n[k] - np.outer(self.means[k], self.means[k]) for k in (0, 1)]
        pooled = np.diag((n[0] * np.diag(cov[0]) + n[1] * np.diag(cov[1])) / n.sum())
        pooled += np.diag(np.full(len(pooled), _RIDGE))
        factors = [np.linalg.cholesky((1 - shrink) * c + shrink * pooled) for c in cov]
        self.inverse = [np.linalg.inv(f) for f in factors]
        self.logdet = [2 * np.log(np.diag(f)).sum() for f in factors]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.counts.sum() == 0:
            return np.full(len(x), 0.5)
        if (self.counts <= 0).any():
            return np.full(len(x), float(self.counts[1] > 0))
        log = [-0.5 * ((((x - m) @ f.T) ** 2).sum(axis=1) + d) for m, f, d in zip(self.means, self.inverse, self.logdet, strict=True)]
        z = (log[1] - log[0] + np.log(self.counts[1] / self.counts[0])) / x.shape[1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(stats: DataFrame, label: str, shrink: float = SHRINK) -> Gaussians:
    """Fit on the rows of ``stats`` whose ``label`` is 0 or 1: per class counts, sums and products."""
    d = len(STATISTICS)

    def sums(batches):
        for pdf in batches:
            for k in (0, 1):
                x = np.stack(pdf["stats"][pdf["label"] == k]) if (pdf["label"] == k).any() else np.zeros((0, d))
                yield pd.DataFrame({"label": k, "place": np.arange(1 + d + d * d),
                                    "value": np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))})
    rows = (stats.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("label"), "stats")
            .mapInPandas(lean(sums), "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).toPandas())
    total = np.zeros((2, 1 + d + d * d))
    total[rows["label"], rows["place"]] = rows["value"]
    return Gaussians(total[:, 0], total[:, 1:d + 1], total[:, d + 1:].reshape(2, d, d), shrink)


def score_quality(docs: DataFrame, labels: DataFrame, train, keep: list) -> DataFrame:
    """Columns ``keep`` of ``docs`` (doc_id among them) with score and predicted; learns
    from the labels of the rows where ``train`` (a boolean column of ``docs``) holds."""
    ship(docs.sparkSession)
    names = [c for c in keep if c not in ("score", "predicted")]
    stats = scratch(featured(docs.select(*names, "text", F.coalesce(train, F.lit(False)).alias("_llm_train")), [*names, "_llm_train"]), "quality-stats")
    known = labels.where("quality is not null and doc_id is not null").select(
        F.col("doc_id").alias("_llm_id"), F.col("quality").alias("_llm_label"))
    model = fit(stats.where("_llm_train").join(known, F.col("doc_id") == F.col("_llm_id")).select("stats", "_llm_label"), "_llm_label")

    def go(batches):
        for pdf in batches:
            s = model.score(np.stack(pdf["stats"])) if len(pdf) else np.zeros(0)
            yield pdf[names].assign(score=s, predicted=(s >= 0.5).astype("int32"))
    out = whole(stats, [*names, "stats"]).mapInPandas(lean(go), f"{schema_of(stats, names)}, score double, predicted int")
    return restored(out, stats, names)
