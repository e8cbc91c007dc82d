"""Materialised intermediate tables for iterative operators."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder in local mode where it is unset; an error on a cluster without it."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if getattr(context, "_strataloom_rounds", None) is None:
        context._strataloom_rounds = "file://" + tempfile.mkdtemp(prefix="strataloom-rounds-")
    return context._strataloom_rounds


def _filesystem(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def materialised(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and reread: cuts lineage, survives lost executors, goes with the session or by discard()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strataloom-rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, hadoop_path = _filesystem(spark, path)
    fs.deleteOnExit(hadoop_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strataloom_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes what materialised() wrote, once nothing reads it any more; other tables are left alone."""
    path = getattr(df, "_strataloom_path", None)
    if path:
        fs, hadoop_path = _filesystem(df.sparkSession, path)
        fs.delete(hadoop_path, True)


#: Rows that a task of a shuffle gets, and those it gets at most once there are as many tasks as Spark's plain shuffle writer serves.
TASK_ROWS, MOST_TASK_ROWS, PLAIN_TASKS = 400_000, 2_000_000, 200


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for a shuffle of so many rows: by default Spark packs 64 MB of compressed rows into one, of which sorts and sums take many times that."""
    even = min(spark.sparkContext.defaultParallelism, math.ceil(rows / 20_000))
    return max(1, even, min(PLAIN_TASKS, math.ceil(rows / TASK_ROWS)), math.ceil(rows / MOST_TASK_ROWS))
