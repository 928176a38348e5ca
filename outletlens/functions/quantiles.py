"""Exact, skew-proof quantiles (numpy's linear interpolation, or the
unit-weight inverted-CDF percentile) without sorting the data.

Spark's ``percentile``/``median`` aggregates keep every distinct value of a
group in one task's buffer, so a group holding a third of a 100 TB table
would sit in one executor. This operator only ever counts:

1. one aggregate gives each group's size, min and max, from which the wanted
   ranks ``floor/ceil((n-1)p)`` (or ``ceil(p n) - 1``) follow;
2. while a target's bracket [L, U] still holds more than ``refine_rows``
   rows, one pass counts the rows of every active bracket in ``bins``
   equal-width sub-buckets (a filter plus a map-side-combined aggregate:
   ``targets x bins`` rows reach the shuffle) and the bracket shrinks to the
   [min, max] of the sub-bucket holding the wanted rank; rows below it are
   added to the target's exact ``below`` count;
3. the last pass groups the bracket's rows by distinct value (ties collapse
   into one row with a count, so a value repeated a billion times costs one
   row) and a running count picks the value at the wanted rank;
4. linear interpolation ``lo + (hi - lo) * frac``.

Everything is a deterministic aggregate, so the result does not depend on
partitioning, row order or task re-execution; only the tiny bracket table
is checkpointed between passes. Smooth data needs ``log_bins(n / refine_rows)``
passes; a bracket also stops when it collapses to a single value. Infinite values
have sub-buckets of their own, so one pass leaves them behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize
from .compat import INF, null_nan

MAX = 1.7976931348623157e308


def _local(df: DataFrame) -> DataFrame:
    """A table of provably few rows (groups x targets) through the driver: no file, no lineage."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _half(c: str) -> Column:
    """Half of a value with its ends at the largest finite double (no overflow in differences)."""
    return F.greatest(F.least(F.col(c), F.lit(MAX)), F.lit(-MAX)) / 2.0


def _join_targets(base: DataFrame, targets: DataFrame, by, bounded: bool) -> DataFrame:
    if not by:
        return base.join(F.broadcast(targets), F.lit(True), "inner")      # global: 2 x |probs| rows
    t = F.broadcast(targets) if bounded else broadcast_if_small(targets)
    return base.join(t, list(by), "inner")


def exact_quantiles(df: DataFrame, value, probs: dict, by=(), *,
                    bounded_groups: bool = False, method: str = "linear",
                    bins: int = 1024, refine_rows: int = 200_000) -> DataFrame:
    """Per-group quantiles of ``value``; one output column per ``probs`` key.

    ``probs`` maps output column name -> probability in [0, 1]. ``method``:
    ``linear`` (numpy's default) or ``inverted_cdf`` (the unit-weight
    percentile used for gradient-boosting leaf values). NULL and NaN values
    are skipped (pandas semantics); groups with no values are absent.
    ``bounded_groups`` asserts the number of groups has a proven small bound
    (buckets, models, tree leaves), which allows broadcasting the per-target
    bracket table outright; otherwise it is broadcast only after a size
    check. Infinite values are ordinary values at the ends of the order.
    """
    by = list(by)
    vcol = F.col(value) if isinstance(value, str) else value
    base = (df.select(*[F.col(c) for c in by], null_nan(vcol.cast("double")).alias("_v"))
            .where(F.col("_v").isNotNull()))

    stats = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_mn"),
                                  F.max("_v").alias("_mx"))
    names = list(probs)
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(probs[k])).alias("p"))
                                 for k in names]))
    t = stats.select(*by, "_n", "_mn", "_mx", wanted.alias("_q"))
    n, p = F.col("_n"), F.col("_q.p")
    if method == "linear":
        h = (n - 1).cast("double") * p
        lo = F.floor(h).cast("bigint")
        hi = F.least(lo + 1, n - 1)
        frac = h - lo.cast("double")
    elif method == "inverted_cdf":
        lo = F.greatest(F.ceil(n.cast("double") * p).cast("bigint") - 1, F.lit(0).cast("bigint"))
        hi = lo
        frac = F.lit(0.0)
    else:
        raise ValueError(f"unknown quantile method {method!r}")
    targets = t.select(*by, F.col("_q.name").alias("_name"), frac.alias("_frac"),
                       F.explode(F.array(F.struct(F.lit(0).alias("w"), lo.alias("r")),
                                         F.struct(F.lit(1).alias("w"), hi.alias("r")))).alias("_t"),
                       F.col("_mn").alias("_L"), F.col("_mx").alias("_U"),
                       F.lit(0).cast("bigint").alias("_below"), n.alias("_cnt"))
    targets = targets.select(*by, "_name", "_frac", F.col("_t.w").alias("_which"),
                             F.col("_t.r").alias("_rank"), "_L", "_U", "_below", "_cnt")
    tkey = [*by, "_name", "_which"]
    # tiny; the full-scan statistics run once
    keep = _local if bounded_groups or not by else materialize
    targets = keep(targets)

    # 2. narrow the brackets while they are large (each pass: one filtered scan). Targets that
    # share a bracket are counted once. Both ends of a bracket are values of the data and
    # fall into different sub-buckets, so every pass takes rows away.
    bkey = [*by, "_L", "_U"]
    while True:
        active = targets.where((F.col("_cnt") > refine_rows) & (F.col("_L") < F.col("_U")))
        if active.isEmpty():
            break
        rows = _join_targets(base, active.select(*bkey).distinct(), by, bounded_groups)
        rows = rows.where((F.col("_v") >= F.col("_L")) & (F.col("_v") <= F.col("_U")))
        lo, hi = _half("_L"), _half("_U")
        b = F.least(F.floor((_half("_v") - lo) / (hi - lo) * float(bins)), F.lit(bins - 1)).cast("int")
        # an infinite end has a sub-bucket of its own
        b = F.when(F.col("_v") == F.lit(-INF), F.lit(-1)).when(F.col("_v") == F.lit(INF), F.lit(bins)).otherwise(b)
        hist = rows.groupBy(*bkey, b.alias("_b")).agg(F.count(F.lit(1)).alias("_c"),
                                                      F.min("_v").alias("_bmin"), F.max("_v").alias("_bmax"))
        w = Window.partitionBy(*bkey).orderBy("_b")          # <= bins + 2 rows per bracket
        hist = hist.withColumn("_before", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        hist = hist.withColumn("_before", F.coalesce(F.col("_before"), F.lit(0)).cast("bigint"))
        step = (active.select(*tkey, "_rank", "_below", "_L", "_U").join(hist, bkey)
                .where((F.col("_below") + F.col("_before") <= F.col("_rank"))
                       & (F.col("_rank") < F.col("_below") + F.col("_before") + F.col("_c")))
                .select(*tkey, F.col("_bmin").alias("_nL"), F.col("_bmax").alias("_nU"),
                        (F.col("_below") + F.col("_before")).alias("_nbelow"), F.col("_c").alias("_ncnt")))
        targets = (targets.join(step, tkey, "left")
                   .select(*by, "_name", "_frac", "_which", "_rank",
                           F.coalesce("_nL", "_L").alias("_L"), F.coalesce("_nU", "_U").alias("_U"),
                           F.coalesce("_nbelow", "_below").alias("_below"),
                           F.coalesce("_ncnt", "_cnt").alias("_cnt")))
        # tiny table (groups x targets rows); cut its lineage so the plan does
        # not grow with every pass
        targets = keep(targets)

    # 3. exact pick inside each bracket over distinct values
    rows = _join_targets(base, targets.select(*bkey).distinct(), by, bounded_groups)
    rows = rows.where((F.col("_v") >= F.col("_L")) & (F.col("_v") <= F.col("_U")))
    dist = rows.groupBy(*bkey, "_v").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*bkey).orderBy("_v")              # bracket: <= refine_rows rows or one value
    dist = dist.withColumn("_cum", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    picked = (targets.select(*tkey, "_frac", "_rank", "_below", "_L", "_U").join(dist, bkey)
              .where((F.col("_below") + F.col("_cum") - F.col("_c") <= F.col("_rank"))
                     & (F.col("_rank") < F.col("_below") + F.col("_cum"))))
    per_prob = picked.groupBy(*by, "_name").agg(
        F.max(F.when(F.col("_which") == 0, F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("_which") == 1, F.col("_v"))).alias("_hi"),
        F.max("_frac").alias("_frac"))
    qv = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
        F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac"))
    return per_prob.groupBy(*by).pivot("_name", names).agg(F.first(qv))
