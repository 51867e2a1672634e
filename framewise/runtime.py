"""Session helpers: the shared checkpoint folder and tables written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A folder of our own is used only in local mode with the setting unset."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if at is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="framewise-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def materialise(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder as Parquet and read it back: later jobs and retried tasks read files, not the plan behind them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def expire(spark: SparkSession, hours: float = 24.0) -> int:
    """Delete intermediate tables, scans, streams and pipeline runs of this library in the shared folder that are older than `hours`; their number. For a job that runs between others: what a running job still reads must be younger."""
    import time

    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    limit, gone = (time.time() - 3600 * hours) * 1000, 0
    for kind in ("tables", "scans", "streams", "pipeline"):
        at = jvm.org.apache.hadoop.fs.Path(root, kind)
        for s in fs.listStatus(at) if fs.exists(at) else ():
            if s.getModificationTime() < limit:
                gone += bool(fs.delete(s.getPath(), True))
    return gone
