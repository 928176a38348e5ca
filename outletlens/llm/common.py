"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outletlens.session import ship, write_table  # noqa: F401 - ship is used from here

#: A broadcast of at most so many short rows (ids, keys, span lists).
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a small scratch table that go into one file.
FILE_ROWS = 10_000


def scratch(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written once to the cluster's shared checkpoint folder and reread:
    later steps neither recompute it nor lose it with an executor. ``rows``, where
    known, is about how many rows it has: few rows go into few files."""
    if rows is not None:
        files = rows // FILE_ROWS + 1
        if files < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(files)
    return write_table(df, f"llm-{name}")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over. It does so when the driver's JVM finds
    that nothing refers to them, which it looks for each half hour, or when asked. Python's own
    references go first."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda variable is bound once, while a column used several times inside a
    lambda may be inlined by the optimiser and evaluated for every element."""
    return F.transform(F.array(value), body)[0]


def give_back() -> None:
    """Return what a Python worker has freed to the machine: workers live on between tasks
    and would keep it from the next task's, or the executor's own, memory."""
    import ctypes

    import pyarrow
    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)       # only the GNU C library has it
    if trim is not None:
        trim(0)


def lean(run):
    """A function over batches that gives memory back when its task ends."""
    def go(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return go


def whole(df: DataFrame, names: list) -> DataFrame:
    """Columns ``names`` for a pandas function, whole numbers as text: pandas would turn a
    column of long values with a null into doubles, which lose the digits of large ids."""
    kinds = dict(df.dtypes)
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if kinds[c] == "bigint" else F.col(f"`{c}`") for c in names])


def schema_of(df: DataFrame, names: list) -> str:
    """The schema of ``whole(df, names)`` as a pandas function returns it."""
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {'string' if kinds[c] == 'bigint' else kinds[c]}" for c in names)


def restored(out: DataFrame, df: DataFrame, names: list) -> DataFrame:
    """``out`` with the columns ``names`` of ``df`` in their own types again."""
    kinds = dict(df.dtypes)
    return out.withColumns({c: F.col(f"`{c}`").cast("long") for c in names if kinds[c] == "bigint"})


def id_and_text(docs: DataFrame, *more) -> DataFrame:
    """doc_id (a whole number as text, see ``whole``), text and further columns for a pandas function."""
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def long_id(out: DataFrame) -> DataFrame:
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def text_key() -> Column:
    """16-byte md5 of the column text (null: of the empty text)."""
    return F.unhex(F.md5(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8"))).alias("text_key")


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array; null text has none."""
    one_space = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.array_remove(F.split(one_space, " "), "")


def small(df: DataFrame, of: DataFrame | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``of`` (a scratch table that ``df`` has no more rows than, by
    default ``df`` itself; the count reads only footers) has at most ``limit`` rows;
    otherwise the join stays a shuffle join."""
    return F.broadcast(df) if (df if of is None else of).count() <= limit else df


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id's text leaves ``part`` modulo ``parts`` (null id: false)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part, F.lit(False))
