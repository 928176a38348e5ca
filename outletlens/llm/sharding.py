"""Proportional stratified interleaving into shards.

Rows are put in a seeded random order within each source; a row's fractional rank is
(rank - 1/2) / rows of the source. Sorting all rows by fractional rank interleaves the
sources in proportion, so each of the ``shards`` equal cuts matches the mixture. Shard
sizes differ by one row at most (law ``rows``).

Neither ranking meets in one task: rows are ranked within slices (of the source's hash
range, then of the fractional rank's range), whose counts are added up separately, so a
source with a third of all rows is as many slices as its size asks for. Only ids and
sizes are shuffled, never texts.

Defined cases: null text has size 8 and crc 0; a null source is a source of its own; a
null doc_id is ordered as the text 'null'; rows equal in all of doc_id, size and crc are
interchangeable. Extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outletlens.llm.common import scratch

LAW = "rows"
#: Rows that one slice should hold.
SLICE_ROWS = 20_000


def _ranked(df: DataFrame, group: list, slices: int, order: list, name: str) -> DataFrame:
    """``df`` with column ``name``: the row's place (from 0) in its group, by ``slice``, then ``order``."""
    counts = df.groupBy(*group, "slice").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*group, "_block").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # two levels, so that the running sum over slices is itself cut into blocks
    block = max(1, int(slices ** 0.5))
    counts = counts.withColumn("_block", F.floor(F.col("slice") / block))
    blocks = counts.groupBy(*group, "_block").agg(F.sum("_rows").alias("_rows"))
    over = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*group, "_block", F.coalesce(F.sum("_rows").over(over), F.lit(0)).alias("_offset"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")

    b = blocks.select(*[F.col(g).alias(f"_b_{g}") for g in group], F.col("_block").alias("_b_block"), "_offset")
    on = F.col("_block") == F.col("_b_block")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_b_{g}"))
    starts = counts.join(b, on).select(*[F.col(g).alias(f"_s_{g}") for g in group], F.col("slice").alias("_s_slice"),
                                       (F.col("_before") + F.col("_offset")).alias("_start"))
    inner = Window.partitionBy(*group, "slice").orderBy(*order)
    on = F.col("slice") == F.col("_s_slice")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_s_{g}"))
    df = df.withColumn("_in", F.row_number().over(inner) - 1).join(starts, on)
    return df.withColumn(name, F.col("_start") + F.col("_in")).drop("_in", "_start", "_s_slice", "slice", *[f"_s_{g}" for g in group])


def interleave(docs: DataFrame, shards: int = 24, seed: int = 1) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard, source."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")).alias("draw"))
    rows = scratch(rows, "shard-rows")
    total = rows.count()
    slices = max(1, -(-total // SLICE_ROWS))
    tie = ["draw", "doc_id", "text_crc32", "size"]
    # the draw's first 32 bits cut each source's random order into equal slices
    part = F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("double") * slices / float(1 << 32)).cast("long")
    ranked = _ranked(rows.withColumn("slice", part), ["source"], slices, tie, "rank")
    of = rows.groupBy(F.col("source").alias("_of")).agg(F.count("*").alias("_n"))
    ranked = ranked.join(of, F.col("source").eqNullSafe(F.col("_of"))).withColumn("at", (2 * F.col("rank") + 1) / (2 * F.col("_n")))
    ranked = ranked.drop("_of", "_n", "rank")
    ranked = scratch(ranked, "shard-ranked").withColumn("slice", F.floor(F.col("at") * slices).cast("long"))
    placed = _ranked(ranked, [], slices, ["at", "source", *tie], "place")
    shard = F.expr(f"int((place * {shards}) div {max(total, 1)})")
    # the first place of shard s is ceil(s * total / shards)
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (placed.withColumn("shard", shard).withColumn("slot", (F.col("place") - first).cast("long"))
            .select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "source"))


#: CRC-32 of a text's bytes, bit by bit in tables that SQL makes itself.
SQL = """
WITH crc_table AS (
    SELECT list(v ORDER BY b) AS t FROM (
        SELECT b, list_reduce(list_prepend(b::BIGINT, [0,0,0,0,0,0,0,0]::BIGINT[]),
            lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
        FROM range(256) r(b))),
hexed AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (
    SELECT doc_id, source, length(h) // 2 + 8 AS size,
        list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i:
            (instr('0123456789ABCDEF', h[(2 * i + 1)::BIGINT]) - 1) * 16 + instr('0123456789ABCDEF', h[(2 * i + 2)::BIGINT]) - 1)) AS b
    FROM hexed),
rows_ AS (
    SELECT doc_id, source, size, md5(concat('1:', coalesce(doc_id::VARCHAR, 'null'))) AS draw,
        xor(4294967295, list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS text_crc32
    FROM bytes, crc_table),
ranked AS (
    SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY draw, doc_id, text_crc32, size) - 1)::DOUBLE
        / (2 * count(*) OVER (PARTITION BY source)) AS frac
    FROM rows_),
placed AS (
    SELECT *, row_number() OVER (ORDER BY frac, source, draw, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS n
    FROM ranked)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, ((place * 24) // n)::INTEGER AS shard,
    (place - (((place * 24) // n) * n + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard, source
FROM placed
"""
