"""Physical-plan regression tests: the shapes the design relies on."""

import io
from contextlib import redirect_stdout

from tests.helpers import SF_SMALL


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_flagship_is_top_k_with_pruned_scan(spark):
    import __spark_entry__ as e
    p = plan(e.queries()["t2_optimisation_score_top15"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p                      # no full sort of the table
    assert "SortMergeJoin" not in p
    scans = [ln for ln in p.splitlines() if ln.startswith("ReadSchema")]
    assert scans and all("OPEXRate" not in s for s in scans)  # only the needed columns are read


def test_group_means_use_partial_aggregation(spark):
    import __spark_entry__ as e
    p = plan(e.queries()["a3_revenue_by_cuisine"](spark, SF_SMALL))
    assert "partial_avg" in p and "SortAggregate" not in p


def test_bucket_filter_reaches_the_scan(spark):
    import __spark_entry__ as e
    p = plan(e.queries()["a18_bucket_profitable_pct"](spark, SF_SMALL))
    assert "GreaterThan(CommissionRate,0.26)" in p


def test_formula_optimiser_makes_no_candidates(spark):
    import __spark_entry__ as e
    p = plan(e.queries()["w10_optimise_unit_economics"](spark, SF_SMALL))
    assert "SortAggregate" not in p and "sequence(" not in p      # no candidate is ever made


def test_fixture_scan_reads_five_lineitem_columns(spark):
    from outletlens.sources.fixture import outlet_month
    p = plan(outlet_month(spark, SF_SMALL))
    li = [ln for ln in p.splitlines() if ln.startswith("ReadSchema") and "l_orderkey" in ln]
    assert li and li[0].count(":") == 1 + 5          # "ReadSchema:" + five typed fields


def test_all_trend_lines_share_one_scan(spark):
    import __spark_entry__ as e
    p = plan(e.queries()["b6_trend_lines"](spark, SF_SMALL))
    assert sum(1 for ln in p.splitlines() if ln.startswith("(") and "Scan parquet" in ln) == 1
    assert "Expand" in p
