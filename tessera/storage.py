"""Step results kept as Parquet in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def new_path(spark: SparkSession) -> str:
    """A path for a step's table below spark.checkpoint.dir.

    A local folder stands in only where the session names none and runs on this machine alone; on a
    cluster that is an error, since each executor would write to its own disk.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="ckpt")
        sc.setCheckpointDir(folder)
    _made.append(f"{sc.getCheckpointDir()}/table-{uuid.uuid4().hex}")
    return _made[-1]


def broadcast_by_measure(spark: SparkSession) -> None:
    """Let joins broadcast a side by the bytes of its rows, measured when they are shuffled, and no longer by the size of its files.

    Chains repeat, so a step table takes up to a hundred times its files' size as a hash table, which the driver
    would build. The session's threshold stays, as the one for measured sizes; F.broadcast stays as it is.
    """
    plain, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    threshold = spark.conf.get(plain)
    if threshold != "-1":
        spark.conf.set(measured, spark.conf.get(measured, None) or threshold)
        spark.conf.set(plain, "-1")


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back: lineage and plan are cut there, and columns can be pruned."""
    broadcast_by_measure(df.sparkSession)
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_steps(spark: SparkSession) -> None:
    """Delete the step tables written so far. DataFrames that come from them can't be read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
