"""Tables written between the stages of a run."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, name: str = "table") -> str:
    """A new path in the folder that spark.checkpoint.dir names, deleted when the application ends.

    Where the setting is absent, a new temporary folder is taken if all runs in one process; else that is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    path = f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder, and read it back.

    Later stages read the table instead of repeating the plan, and a lost executor costs no recomputation of what
    stands before it.  The table goes when the application ends.
    """
    path = shared(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, task_bytes: int = 32 << 20) -> DataFrame:
    """Rows dealt out over the cluster's cores before heavy work, where the input has too few bytes to fill them by its own splits.

    A file of one row group is else read, and worked on, by one task.  Larger inputs stay as they are and are not shuffled.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size < cores * task_bytes else df
