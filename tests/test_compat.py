import hashlib
import math

from pyspark.sql import functions as F

from outletlens.functions.compat import (key_hash_bucket, money, parse_money, pd_div, percent,
                                         ratio_or_zero, round_even, safe_corr)


def test_pd_div_and_ratio(spark):
    df = spark.createDataFrame([(5.0, 0.0), (-5.0, 0.0), (0.0, 0.0), (None, 2.0), (6.0, 3.0)], "n double, d double")
    rows = df.select(pd_div("n", "d").alias("q"), ratio_or_zero("n", "d").alias("r")).collect()
    assert rows[0].q == math.inf and rows[1].q == -math.inf
    assert rows[2].q is None and rows[3].q is None and rows[4].q == 2.0
    assert [r.r for r in rows] == [0.0, 0.0, 0.0, 0.0, 2.0]


def test_round_half_even_like_numpy(spark):
    df = spark.createDataFrame([(2.345,), (2.5,), (3.5,), (-2.5,), (0.125,)], "x double")
    got = [r.y for r in df.select(round_even("x", 2).alias("y")).collect()]
    assert got == [round(2.345, 2), 2.5, 3.5, -2.5, round(0.125, 2)]
    got0 = [r.y for r in df.select(round_even("x", 0).alias("y")).collect()]
    assert got0[1:4] == [2.0, 4.0, -2.0]


def test_money_percent_parse(spark):
    df = spark.createDataFrame([(1234.5, 0.305), (-1234.4, 0.2)], "m double, p double")
    r = df.select(money("m").alias("m"), percent("p", 1).alias("p"), percent("p").alias("p0"),
                  parse_money(money("m")).alias("back")).collect()
    assert r[0].m == "$1,234" and r[1].m == "$-1,234"
    assert r[0].p == "30.5%" and r[1].p0 == "20%"
    assert r[0].back == 1234.0 and r[1].back == -1234.0


def test_key_hash_matches_md5(spark):
    df = spark.createDataFrame([(7, 1998, 3)], "a long, b int, c int")
    got = df.select(key_hash_bucket(["a", "b", "c"], 42, 100).alias("h")).first().h
    want = int(hashlib.md5(b"7|1998|3|42").hexdigest()[:8], 16) % 100
    assert got == want


def test_safe_corr_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert df.agg(safe_corr("x", "y").alias("r")).first().r is None
    df2 = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (None, 1.0), (3.0, 6.5)], "x double, y double")
    r = df2.agg(safe_corr("x", "y").alias("r")).first().r
    import numpy as np
    assert abs(r - np.corrcoef([1.0, 2.0, 3.0], [2.0, 4.0, 6.5])[0, 1]) < 1e-12
    assert F is not None
