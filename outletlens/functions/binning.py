"""Bucketing: explicit right-closed buckets (B1) and equal-width bins (B2).

``Bucketizer`` is left-closed, so both are written as conditional
expressions. Equal-width edges need only the column's min and max: one
algebraic aggregate row, joined back as a fixed-size broadcast, so binning
costs one extra scan-side aggregate and no shuffle of the data.

Edge rule (pandas ``cut(x, bins=n)``): edges ``mn + i*(mx-mn)/n`` with the last
edge exactly ``mx`` and the first lowered by 0.1 % of the range; a constant
column is widened by 0.1 % of its value (0.001 around zero) on each side.
Labels follow the interval text ``(lo, hi]`` with edges rounded to the
smallest precision >= 3 that keeps them distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import COMMISSION_EDGES, COMMISSION_LABELS
from .compat import col_


def explicit_bucket(c, edges=COMMISSION_EDGES, labels=COMMISSION_LABELS):
    """(label, ordinal) of right-closed buckets; outside -> NULL."""
    c = col_(c)
    lab, idx = None, None
    for i in range(len(labels)):
        cond = (c > F.lit(edges[i])) & (c <= F.lit(edges[i + 1]))
        lab = F.when(cond, F.lit(labels[i])) if lab is None else lab.when(cond, F.lit(labels[i]))
        idx = F.when(cond, F.lit(i)) if idx is None else idx.when(cond, F.lit(i))
    return lab, idx


def commission_bucket(df: DataFrame, col: str = "CommissionRate", name: str = "CommBucket") -> DataFrame:
    lab, idx = explicit_bucket(col)
    return df.withColumns({name: lab, name + "_idx": idx})


def _round_frac(x: Column, precision) -> Column:
    precision = precision if isinstance(precision, Column) else F.lit(precision)
    whole_zero = (x > F.lit(-1.0)) & (x < F.lit(1.0))
    digits = F.when(whole_zero, -F.floor(F.log10(F.abs(x))) - 1 + precision).otherwise(precision)
    scale = F.pow(F.lit(10.0), digits.cast("double"))
    return F.when((x == 0) | F.isnan(x), x).otherwise(F.rint(x * scale) / scale)


def _finite(col) -> Column:
    """The column as double; infinite values and NaN become NULL (they have no bin)."""
    v = col_(col).cast("double")
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def edge_stats(df: DataFrame, col: str, bins: int, labels: bool = False) -> DataFrame:
    """One row: ``e0..e{bins}`` edges of the finite values, ``_s, _t, _step`` (and ``l1..l{bins}`` interval labels)."""
    v = _finite(col)
    mm = df.agg(F.min(v).alias("mn"), F.max(v).alias("mx"))
    mn, mx = F.col("mn"), F.col("mx")
    same = mn == mx
    widen_lo = F.when(mn != 0, F.lit(0.001) * F.abs(mn)).otherwise(F.lit(0.001))
    widen_hi = F.when(mx != 0, F.lit(0.001) * F.abs(mx)).otherwise(F.lit(0.001))
    start = F.when(same, mn - widen_lo).otherwise(mn)
    stop = F.when(same, mx + widen_hi).otherwise(mx)
    mm = mm.select(start.alias("_s"), stop.alias("_t"), same.alias("_same"))
    s, t = F.col("_s"), F.col("_t")
    step = (t - s) / F.lit(float(bins))
    edges = {}
    for i in range(bins + 1):
        e = t if i == bins else F.lit(float(i)) * step + s
        if i == 0:
            e = F.when(F.col("_same"), e).otherwise(e - (t - s) * F.lit(0.001))
        edges[f"e{i}"] = e
    out = mm.select(s, t, step.alias("_step"), *[e.alias(k) for k, e in edges.items()])
    if not labels:
        return out
    # label precision: smallest p in [3, 20) with all rounded edges distinct
    def distinct_at(p):
        r = [_round_frac(F.col(f"e{i}"), p) for i in range(bins + 1)]
        cond = F.lit(True)
        for a, b in zip(r, r[1:]):
            cond = cond & (a != b)
        return cond
    prec = F.coalesce(*[F.when(distinct_at(p), F.lit(p)) for p in range(3, 20)], F.lit(3))
    out = out.withColumn("_prec", prec)
    rounded = {i: _round_frac(F.col(f"e{i}"), F.col("_prec")) for i in range(bins + 1)}
    texts = {f"l{i + 1}": F.concat(F.lit("("), rounded[i].cast("string"), F.lit(", "),
                                     rounded[i + 1].cast("string"), F.lit("]"))
              for i in range(bins)}
    return out.withColumns(texts).drop("_prec")


def assign_bins(df: DataFrame, col: str, bins: int, name: str, labels: bool = False,
                stats: DataFrame | None = None) -> DataFrame:
    """Add ``{name}`` (1-based bin), ``{name}_lo``, ``{name}_hi`` (and ``{name}_label``).

    ``stats``: a ready :func:`edge_stats` row (so callers needing the edges
    twice aggregate min/max once)."""
    stats = stats if stats is not None else edge_stats(df, col, bins, labels)
    v = _finite(col)
    shown = [f"l{i}" for i in range(1, bins + 1)] if labels else []
    joined = df.join(F.broadcast(stats.select("_s", "_t", "_step", "e0", *shown)), F.lit(True), "left")  # one row
    s, t, step, n = F.col("_s"), F.col("_t"), F.col("_step"), F.lit(bins)

    def edge(i):         # the same arithmetic as edge_stats
        return F.when(i >= n, t).otherwise(i.cast("double") * step + s)
    # the bin by arithmetic, then at most one edge away from it
    guess = F.greatest(F.least(F.ceil(F.try_divide(v - s, step)), n), F.lit(1)).cast("int")
    idx = guess + F.when((guess < n) & (v > edge(guess)), 1).when((guess > 1) & (v <= edge(guess - 1)), -1).otherwise(0)
    joined = joined.withColumn(name, F.when(v.isNotNull(), idx).cast("int"))
    at = F.col(name)
    cols = {name + "_lo": F.when(at.isNull(), F.lit(None)).when(at == 1, F.col("e0")).otherwise(edge(at - 1)),
            name + "_hi": F.when(at.isNotNull(), edge(at))}
    if labels:
        cols[name + "_label"] = F.element_at(F.array(*[F.col(x) for x in shown]), at)
    return joined.withColumns(cols).drop("_s", "_t", "_step", "e0", *shown)
