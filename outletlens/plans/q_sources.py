"""Round trips through the sources and sinks (S1, S2, S4, S5), over the whole outlet table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.compat import round_even
from ..ml import linear
from ..ml.evaluate import regression_metrics
from ..ml.models import fit_model
from ..ml.quantile import fit_quantile_models
from ..ml.store import load_bundle, load_bundle_with_bands, save_bundle
from ..schema import KEY_COLS, OUTLET
from ..session import checkpoint_dir
from ..sources.io import read_outlets, write_csv
from .catalog import base_table, prepared_table, register, report
from .q_ml import _PREP_CTES, BAND_ON_SEGMENT_SQL, KEY, ROUNDS_ON_SEGMENT, band_on_segment
from .sqlbase import R6, RN, with_base

_OUTLET_SQL = ", ".join(f"{R6(f.name)} AS {f.name}" if f.dataType.typeName() == "double" else f.name for f in OUTLET.fields)


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("s1_s2_s4_csv_round_trip", sql=with_base(f"SELECT {_OUTLET_SQL} FROM t"))
def s1_s2_s4_csv_round_trip(spark, sf_dir):
    """The outlet table written as CSV (S4), found among candidate paths (S2), checked and read back."""
    path = _folder(spark, "outlets") + ".csv"
    write_csv(base_table(spark, sf_dir).select(*OUTLET.names), path)
    return report(read_outlets(spark, [path + ".missing", path], validate=True))


@register("s5_bundle_round_trip", sql=with_base(
    f"SELECT {KEY}, {RN('c.i + c.s * AOV', 4)} AS pred FROM sp, (SELECT regr_slope(label, AOV) AS s, regr_intercept(label, AOV) AS i "
    "FROM sp WHERE NOT is_test) c WHERE is_test", *_PREP_CTES))
def s5_bundle_round_trip(spark, sf_dir):
    """A fitted model saved, loaded and used on the test rows."""
    prep = prepared_table(spark, sf_dir)
    name = "Linear Regression"
    model = fit_model(name, prep.where(~F.col("is_test")), features=["AOV"])
    test = prep.where(F.col("is_test"))
    metrics = regression_metrics(model.predict(test, keep=["label"]).withColumn("model", F.lit(name)))
    path = _folder(spark, "bundle")
    save_bundle(spark, path, {name: model}, metrics)
    fitted, _ = load_bundle(spark, path)
    return fitted[name].predict(test, keep=KEY_COLS).select(*KEY_COLS, round_even("pred", 4).alias("pred"))


@register("s5_bundle_with_boosters", sql=with_base(BAND_ON_SEGMENT_SQL, *_PREP_CTES))
def s5_bundle_with_boosters(spark, sf_dir):
    """The three quantile boosters saved beside a linear model, loaded from the committed bundle and used on the test rows."""
    prep = prepared_table(spark, sf_dir)
    train = prep.where(~F.col("is_test"))
    model, _ = linear.fit_folds(train, ["AOV"], None)
    metrics = regression_metrics(model.predict(prep.where(F.col("is_test")), keep=["label"]).withColumn("model", F.lit(model.name)))
    path = _folder(spark, "bundle")
    save_bundle(spark, path, {model.name: model}, metrics,
                fit_quantile_models(train, rounds=ROUNDS_ON_SEGMENT, features=["Segment_enc"]))
    return band_on_segment(load_bundle_with_bands(spark, path)[2], prep)
