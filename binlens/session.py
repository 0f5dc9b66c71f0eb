"""Spark session construction.

Cluster settings (checkpoint dir, shuffle partitions, executor memory) are
taken from the launcher; the helpers here only fill in what is unset so the
same code runs under spark-submit and in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "binlens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf["spark.driver.memory"] = os.environ.get("BINLENS_DRIVER_MEMORY", "12g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only when it is unset (local tests) a scratch folder is created.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="binlens-ckpt-",
                                    dir=os.environ.get("BINLENS_SCRATCH", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def bound_batches(spark: SparkSession, records: int = 2000, size: str = "8m") -> None:
    """Arrow batches of texts by rows and bytes, where the session leaves Spark's defaults (10,000 rows of any size)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session for the jobs that run inside."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: For tables whose records are large themselves. JVM and Python hold an Arrow batch several times over, and the default is 64 MB for
#: each task; what writes cached batches keeps the last hundred alive, which are 4 MB each by default: here each is one record.
LARGE_RECORDS = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.inMemoryColumnarStorage.batchSize": "1"}
#: For reading such a table from Parquet: the reader holds a batch of 4,096 records by default.
LARGE_STORED = {"spark.sql.parquet.columnarReaderBatchSize": "8"}
#: The shuffles of a job are deleted when it ends, not when the driver happens to collect its garbage.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def ship_package(spark: SparkSession) -> None:
    """Make ``binlens`` importable in the Python workers (Arrow UDFs, mapInPandas).

    On a cluster the package is normally shipped with ``--py-files``; here a zip of
    it is added to the context once (Spark distributes it to every executor).
    """
    sc = spark.sparkContext
    if getattr(sc, "_binlens_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="binlens-pkg-"), "binlens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for root, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    sc._binlens_shipped = True


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df, name: str, **options):
    """Write ``df`` once to the shared folder and return the reread table.

    Later uses read the same rows whatever is retried or lost, and Spark plans
    joins with the true size of the table. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_at(df, name: str, **options):
    """``materialise`` with the table's path, for owners that delete it with ``delete_path`` when nothing reads it any more."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete_path(spark: SparkSession, path: str | None) -> None:
    """Delete a folder of the shared store; None and missing folders are passed over."""
    if path:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
