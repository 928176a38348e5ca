"""Model inputs: category codes (M1), design matrix (M2), split and folds
(M3, M9), and a population-std scaler fitted on the training rows (M4).

Scale notes: codes come from a distinct-then-rank over one category column
(a small domain) joined back by value; the planner/AQE broadcasts the code
table only when its measured size is small. Split and fold ids are hashes of
the row key, so they do not depend on partitioning or row order and survive
task re-execution unchanged. Scaler statistics are one aggregate row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compat import key_hash_bucket
from ..functions.ranking import with_global_rank
from ..schema import CATEGORY_COLS, FEATURES, KEY_COLS, LEAKY_FEATURES, TARGET
from ..session import broadcast_if_small

SPLIT_SEED = 42
TEST_PERCENT = 20
N_FOLDS = 5


def code_table(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values of ``col`` with 0-based codes (LabelEncoder order)."""
    d = df.where(F.col(col).isNotNull()).select(F.col(col).alias(col)).distinct()
    # distinct values are unique, so their global rank is the dense rank
    r = with_global_rank(d, [], [F.col(col).asc()], size_col=None)
    return r.select(col, F.col("_rank").cast("int").alias(col + "_enc"))


def code_tables_for(df: DataFrame, cols=CATEGORY_COLS) -> DataFrame:
    """Code tables of several category columns in one job, long form
    (category, value, code): one distinct over the unpivoted values and one
    global rank per category."""
    long = (df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("value"))
                                         for c in cols])))
            .where(F.col("value").isNotNull()).distinct())
    r = with_global_rank(long, ["category"], [F.col("value").asc()], size_col=None)
    return r.select("category", "value", F.col("_rank").cast("int").alias("code"))


def split_code_tables(long: DataFrame, cols=CATEGORY_COLS) -> dict:
    """Long code table -> {column: (column, column_enc)}."""
    return {c: long.where(F.col("category") == c).select(F.col("value").alias(c), F.col("code").alias(c + "_enc"))
            for c in cols}


def encode_categories(df: DataFrame, fit_on: DataFrame | None = None, cols=CATEGORY_COLS,
                      codes: dict | None = None) -> DataFrame:
    """M1: add ``<col>_enc`` codes learnt from ``fit_on`` (default: ``df`` itself),
    or taken from ready ``codes`` tables (category column -> code table)."""
    src = df if fit_on is None else fit_on
    out = df
    for c in cols:
        # one row per category value: broadcast behind a size check, so the rows are
        # not shuffled onto a handful of keys
        out = out.join(broadcast_if_small(codes[c] if codes else code_table(src, c)), c, "left")
    return out


def design_matrix(df: DataFrame, features=FEATURES, target: str = TARGET,
                  key_cols=KEY_COLS, carry=()) -> DataFrame:
    """M2: keys, the features with NULL -> 0, and ``label`` (NULL -> 0); ``carry`` columns
    come along unchanged (a group column that evaluators need)."""
    return df.select(*key_cols, *carry,
                     *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features],
                     F.coalesce(F.col(target).cast("double"), F.lit(0.0)).alias("label"))


def usable_features(features=FEATURES, exclude_leaky: bool = False) -> list:
    """The feature list; ``exclude_leaky`` leaves out the per-order values and revenue
    ratios, which are computed from the target's own revenue and profit."""
    return [f for f in features if not (exclude_leaky and f in LEAKY_FEATURES)]


def check_finite(df: DataFrame, features=FEATURES, label: str = "label") -> DataFrame:
    """``df``, after one aggregate that raises if a feature or the label is infinite or NaN,
    naming the columns and their counts (the learners would only fail in a task)."""
    cols = [*features, label]
    bad = df.agg(*[F.count_if(~(F.abs(F.col(c)) < F.lit(float("inf")))).alias(c) for c in cols]).first()
    wrong = {c: bad[c] for c in cols if bad[c]}
    if wrong:
        raise ValueError(f"infinite or NaN values in {wrong}; exclude these rows or columns before fitting")
    return df


def add_split(df: DataFrame, key_cols=KEY_COLS, seed: int = SPLIT_SEED,
              test_percent: int = TEST_PERCENT, folds: int = N_FOLDS) -> DataFrame:
    """M3 + fold ids: ``is_test`` (about ``test_percent`` %) and ``fold`` in [0, folds)."""
    bucket = key_hash_bucket(key_cols, seed, 100)
    fold = key_hash_bucket(key_cols, seed + 1, folds)
    return df.withColumns({"is_test": bucket < test_percent, "fold": fold})


@dataclass
class Scaler:
    """Per-feature mean and population std (0 -> 1), as a small dict."""
    means: dict
    scales: dict

    def columns(self, features=None):
        features = features or list(self.means)
        return [((F.col(f) - F.lit(self.means[f])) / F.lit(self.scales[f])).alias(f) for f in features]

    def transform(self, df: DataFrame, features=None) -> DataFrame:
        features = features or list(self.means)
        return df.withColumns({f: (F.col(f) - F.lit(self.means[f])) / F.lit(self.scales[f])
                               for f in features})


def scaler_stats(train: DataFrame, features=FEATURES) -> DataFrame:
    """M4 statistics as a long table (feature, mean, std_pop, scale)."""
    row = train.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
                    *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("feature_order"), F.lit(f).alias("feature"),
                 F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std_pop"),
                 F.when((F.col(f"s{i}") == 0) | F.col(f"s{i}").isNull(), F.lit(1.0))
                 .otherwise(F.col(f"s{i}")).alias("scale"))
        for i, f in enumerate(features)])))


def fit_scaler(train: DataFrame, features=FEATURES) -> Scaler:
    """M4: one aggregate; the result has one entry per feature (bounded)."""
    rows = scaler_stats(train, features).collect()
    return Scaler({r.feature: float(r["mean"] or 0.0) for r in rows},
                  {r.feature: float(r.scale) for r in rows})


def prepared(df: DataFrame, target: str = TARGET, exclude_outliers: bool = False,
             features=FEATURES, codes: dict | None = None) -> DataFrame:
    """Analysis table -> (keys, features, label, is_test, fold).

    Main target: codes fitted on all rows. Secondary targets: outliers are
    removed first and codes are fitted on the remaining rows.
    """
    src = df.where(~F.col("IsOutlier")) if exclude_outliers else df
    enc = encode_categories(src, codes=codes)
    return add_split(design_matrix(enc, features, target))
