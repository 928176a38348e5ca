"""Session helpers: a configured SparkSession and the checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "outletlens") -> SparkSession:
    """Session used by tests and bench; on a cluster use the cluster's own."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be set by the cluster (a shared file
    system); only a local-mode session gets a private temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) before running iterative jobs on a cluster")
    path = tempfile.mkdtemp(prefix="outletlens-ckpt-")
    sc.setCheckpointDir(path)
    return path


def materialize(df):
    """Reliable checkpoint into the shared checkpoint folder.

    Used where one derived table is read by two branches that must see the
    same rows in the same places (positions from ``monotonically_increasing_id``):
    re-planning (AQE) or a task re-run after an executor loss could otherwise
    give each branch its own numbering. Also cuts lineage in iterative jobs.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df, name: str):
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Used for the derived tables that many queries read (analysis table,
    model input): unlike an RDD checkpoint, the parquet copy gives later
    scans column pruning, filter pushdown and real size statistics for the
    planner, and it survives executor loss like any file in shared storage.
    """
    import uuid
    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    # scratch data goes with the application, whatever file system the folder is in
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def delete_checkpoint(rdd, path: str) -> None:
    """Delete the files of a reliable checkpoint that nothing reads any more."""
    sc = rdd.context
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def delete_shuffle(shuffled) -> None:
    """Delete the files of the shuffle an RDD of ``partitionBy`` reads, without waiting for the driver's garbage collection.
    A later read writes them anew."""
    sc = shuffled.context
    cleaner, todo = sc._jsc.sc().cleaner(), [shuffled._jrdd.rdd()]
    while todo and cleaner.isDefined():
        of = todo.pop().dependencies()
        for i in range(of.size()):
            d = of.apply(i)
            if d.getClass().getSimpleName() == "ShuffleDependency":
                cleaner.get().doCleanupShuffle(d.shuffleId(), True)
            else:
                todo.append(d.rdd())


_shipped: set[str] = set()
_shipping = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, so that functions that
    run in Python workers can import it wherever the driver's copy lies."""
    with _shipping:                 # fits run side by side
        if spark.sparkContext.applicationId not in _shipped:
            _ship(spark.sparkContext)


def _ship(sc) -> None:
    top = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(top)
    folder = tempfile.mkdtemp()
    # executors that join later fetch the zip from here, so it stays until the driver ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder in ("", "functions", "llm", "ml"):
            there = os.path.join(top, folder)
            for f in sorted(os.listdir(there)) if os.path.isdir(there) else ():
                if f.endswith(".py"):
                    z.write(os.path.join(there, f), os.path.join(name, folder, f))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


BROADCAST_MAX_ROWS = 100_000


def broadcast_if_small(df, max_rows: int = BROADCAST_MAX_ROWS):
    """Broadcast hint behind a size check, for small derived tables (one row per
    category, group or fence).

    At most ``max_rows + 1`` rows are fetched, once: a table within the limit becomes
    a local one and is broadcast (and is not computed again by each join); beyond the
    limit the join stays a shuffle join of ``df`` itself."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
