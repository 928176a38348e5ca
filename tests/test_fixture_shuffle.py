"""Lines are shuffled once, in short rows, before the two levels of sums."""

from outletlens.sources.fixture import outlet_month
from tests.helpers import SF_SMALL
from tests.test_plans import plan


def test_lines_are_shuffled_once_by_month_and_not_by_order(spark):
    p = plan(outlet_month(spark, SF_SMALL))
    moved = [ln for ln in p.splitlines() if ln.startswith("Arguments: hashpartitioning(sk#") and "yr#" in ln]
    assert len(moved) == 1 and "ok#" not in moved[0]
