"""Scalar helpers that pin down pandas-style arithmetic on Spark columns.

Spark 4 runs in ANSI mode, where ``x / 0`` raises even for doubles; the
dashboard's pandas arithmetic yields ``±inf`` or NaN instead. These helpers
spell out the intended result with conditional expressions so everything
stays inside whole-stage codegen (no Python UDFs).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pd_div(num, den) -> Column:
    """pandas division: ``n/0`` is +inf, -inf, or NULL (for 0/0 and NULLs)."""
    n, d = col_(num), col_(den)
    return (F.when(d == 0, F.when(n > 0, F.lit(INF)).when(n < 0, F.lit(-INF)))
            .otherwise(n.cast("double") / d))


def ratio_or_zero(num, den) -> Column:
    """``num / den`` with a zero or missing denominator giving 0."""
    n, d = col_(num), col_(den)
    return F.coalesce(F.when(d != 0, n.cast("double") / d), F.lit(0.0))


def zero_to_one(c) -> Column:
    c = col_(c)
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


def null_nan(c) -> Column:
    """NaN -> NULL, so aggregates skip it like pandas does."""
    c = col_(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def round_even(c, digits: int = 0) -> Column:
    """numpy/pandas ``round``: half-even on the scaled binary value.

    A zero result is returned as +0.0 (never -0.0), so equal results print and
    hash the same whichever of two equal-valued inputs an engine picked.
    """
    scale = float(10 ** digits)
    r = F.rint(col_(c) * F.lit(scale)) / F.lit(scale)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def r6(c) -> Column:
    """Report precision for doubles (6 decimals, half-even)."""
    return round_even(c, 6)


def safe_corr(x, y) -> Column:
    """Pearson correlation over pairwise-complete rows; NULL (not an error)
    when either column is constant."""
    x, y = col_(x), col_(y)
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))


def key_hash_bucket(cols, seed: int, modulus: int) -> Column:
    """Deterministic bucket in [0, modulus) from md5 of the key and a seed.

    Independent of partitioning and row order, and reproducible in SQL
    (first 8 hex digits of md5 read as an unsigned integer).
    """
    text = F.concat_ws("|", *[col_(c).cast("string") for c in cols], F.lit(str(seed)))
    head = F.substring(F.md5(text), 1, 8)
    return (F.conv(head, 16, 10).cast("bigint") % F.lit(modulus)).cast("int")


def money(c, digits: int = 0) -> Column:
    """``$#,##0`` with half-even rounding; negatives as ``$-1,234``."""
    return F.concat(F.lit("$"), F.format_number(round_even(c, digits), digits))


def percent(c, digits: int = 0) -> Column:
    """``0%`` / ``0.0%`` format of a fraction."""
    return F.concat(F.format_number(round_even(col_(c) * 100.0, digits), digits), F.lit("%"))


def parse_money(c) -> Column:
    """Money text back to a number: strip ``$`` and ``,`` then cast."""
    return F.regexp_replace(col_(c), r"[$,]", "").try_cast("double")
