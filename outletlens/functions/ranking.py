"""Global 0-based row ranks without a single-partition window.

``row_number()`` over a window with no (or a coarse) partition key pulls a
whole group into one task. This helper ranks rows the way ``zipWithIndex``
does: one range shuffle on ``(by, order)`` splits even a hot group across
many partitions, each partition is sorted locally, and a tiny block table
(at most ``partitions + groups`` rows) gives each partition's starting rank
within its group. ``order`` must make rows unique (add a key) so ranks are
deterministic when a task is re-run after an executor loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def with_global_rank(df: DataFrame, by, order, *, rank_col: str = "_rank",
                     size_col: str | None = "_n", num_partitions: int | None = None) -> DataFrame:
    by = list(by)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    spark = df.sparkSession
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in by] + order_cols
    part = (df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
            .withColumn("_pos", F.monotonically_increasing_id()))
    # both branches below must see identical positions: materialise once
    part = materialize(part)
    blocks = (part.groupBy(F.shiftright("_pos", 33).alias("_pid"), *by)
              .agg(F.min("_pos").alias("_p0"), F.count(F.lit(1)).alias("_c")))
    wg = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    blocks = blocks.withColumn(
        "_off", F.sum("_c").over(wg.orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"))
    sel = ["_pid", *by, "_p0", "_off"]
    if size_col:
        blocks = blocks.withColumn(size_col, F.sum("_c").over(wg))
        sel.append(size_col)
    # the block table is tiny (<= partitions + groups rows); AQE broadcasts it
    out = (part.withColumn("_pid", F.shiftright("_pos", 33))
           .join(blocks.select(*sel), ["_pid", *by])
           .withColumn(rank_col, F.col("_off") + F.col("_pos") - F.col("_p0"))
           .drop("_pid", "_p0", "_off", "_pos"))
    return out
