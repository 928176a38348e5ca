import math

import pytest
from pyspark.sql import functions as F

from outletlens.operators.distributions import nice_edges, nice_histogram, violin_density


def column(spark, values):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "v double")


def brute(values, bins):
    """Every nice width in turn, the narrowest with at most ``bins`` aligned bins."""
    lo, hi = min(values), max(values)
    for e in range(-12, 13):
        for f in (1.0, 2.0, 5.0):
            w = f * 10.0 ** e
            if w * bins * (1 + 1e-12) >= hi - lo and math.floor(hi / w) - math.floor(lo / w) + 1 <= bins:
                return w, math.floor(lo / w), math.floor(hi / w) - math.floor(lo / w) + 1


@pytest.mark.parametrize("values,bins", [
    ([0.3, 7.7, 99.2, 100.0], 50), ([-12.5, 3.0, 88.0], 50), ([1e-4, 2e-4, 9.7e-4], 10), ([0.9, 50.1], 50),
    ([-3e6, 4e6, 1.0], 7), ([-1.0, 1.0], 2)])
def test_nice_bins_equal_a_search_over_widths(spark, values, bins):
    r = nice_edges(column(spark, values), "v", bins).first()
    want = brute(values, bins)
    assert math.isclose(r.width, want[0]) and (r["first"], r.n) == want[1:]
    rows = nice_histogram(column(spark, values), "v", bins).orderBy("bin").collect()
    assert [x.bin for x in rows] == list(range(1, r.n + 1)) and r.n <= bins
    for x in rows:
        assert x["count"] == sum(x.lo <= v < x.hi for v in values)
    assert sum(x["count"] for x in rows) == len(values)


def test_nice_histogram_edges(spark):
    with pytest.raises(ValueError, match="bins"):
        nice_edges(column(spark, [1.0]), "v", 1)
    assert nice_histogram(column(spark, [None, float("inf"), float("nan")]), "v").collect() == []
    assert nice_histogram(column(spark, []), "v").collect() == []
    one = nice_histogram(column(spark, [4.5, 4.5, None, float("-inf")]), "v").collect()
    assert [(r.bin, r.lo, r.hi, r["count"]) for r in one] == [(1, 4.0, 5.0, 2)]


def test_soft_span_reaches_two_bandwidths_beyond_the_data(spark):
    df = spark.createDataFrame([("a", float(i % 17)) for i in range(200)] + [("b", 3.0)], "g string, v double")
    rows = violin_density(df, "v", "g", reach=2.0).orderBy("g", "gi").collect()
    a = [r for r in rows if r.g == "a"]
    assert math.isclose(a[0].x, -2 * a[0].bw) and math.isclose(a[-1].x, 16 + 2 * a[0].bw)
    step = a[1].x - a[0].x
    assert 0.93 < sum(r.density for r in a) * step < 1.0           # nearly all of the mass is inside the span
    b = [r for r in rows if r.g == "b"]
    assert all(r.x == 3.0 and r.density is None for r in b)
