"""Reading the outlet table (S1, S2) and writing exports.

The outlet table is read with an explicit schema (no inference pass over the
data), ``FAILFAST`` for malformed CSV rows, and a required-column check, so a
bad file fails at once with a clear message rather than deep inside a job.
Parquet is the preferred format at scale (column pruning and predicate
pushdown reach the scan); CSV is supported for parity.
"""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import OUTLET, REQUIRED_COLS


class OutletDataError(RuntimeError):
    """The outlet table is missing or unreadable (the user-facing error)."""


def _hadoop_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p))


def resolve_path(spark: SparkSession, candidates) -> str:
    """The first candidate path that exists (any Hadoop file system)."""
    candidates = [candidates] if isinstance(candidates, str) else list(candidates)
    for c in candidates:
        if _hadoop_exists(spark, c):
            return c
    raise OutletDataError(f"Data file not found. Expected one of: {', '.join(candidates)}")


def read_outlets(spark: SparkSession, path, fmt: str | None = None, validate: bool = False) -> DataFrame:
    """Outlet table from CSV (header) or parquet with the OUTLET schema.

    Extra columns are ignored; missing required columns raise OutletDataError. A malformed
    row is only met when rows are read: ``validate`` reads them all once (one aggregate, no
    shuffle of rows) and turns such a row into OutletDataError here.
    """
    path = resolve_path(spark, path)
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    try:
        if fmt == "csv":
            header = spark.read.option("header", True).csv(path).columns   # header only: no data pass
            missing = [c for c in REQUIRED_COLS if c not in header]
            if missing:
                raise OutletDataError(f"Error loading data file {path}: missing columns {missing}")
            schema = OUTLET.__class__([f for f in OUTLET.fields if f.name in header])
            df = (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
                  .option("enforceSchema", False).csv(path))
        else:
            df = spark.read.parquet(path)
            missing = [c for c in REQUIRED_COLS if c not in df.columns]
            if missing:
                raise OutletDataError(f"Error loading data file {path}: missing columns {missing}")
    except AnalysisException as e:
        raise OutletDataError(f"Error loading data file {path}: {e}") from e
    present = [f for f in OUTLET.fields if f.name in df.columns]
    df = df.select(*[F.col(f.name).cast(f.dataType) for f in present])
    if validate:
        try:
            df.agg(F.max(F.xxhash64(*df.columns))).first()
        except (PySparkException, Py4JError) as e:
            raise OutletDataError(f"Error loading data file {path}: {str(e).splitlines()[0]}") from e
    return df


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV export with a header. ``single_file`` only for small results
    (a one-partition write funnels everything through one task)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_exports(path: str, summary: DataFrame, breakdown: DataFrame, sweep: DataFrame) -> dict:
    """The three scenario exports (summary, channel breakdown, sensitivity
    sweep) as CSV folders with headers under ``path``; returns their paths.
    Each is written in parallel by its own tasks (no single-file funnel)."""
    out = {"scenario_summary": summary, "scenario_breakdown": breakdown,
           "scenario_sensitivity_sweep": sweep}
    paths = {}
    for name, df in out.items():
        paths[name] = f"{path.rstrip('/')}/{name}"
        write_csv(df, paths[name])
    return paths
