"""Reading tables and cutting lineage through the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet into the shared folder and read again.

    Later stages depend on the files, not on the tasks that made them, so a lost executor costs one
    read. (DataFrame.checkpoint would compute df twice and keep it uncompressed.) The files go when
    the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strataloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    jvm_path = jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def sliced(batches, rows: int = 1_000):
    """Arrow batches in slices of few rows, so that Python objects are made of a small part of a batch at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
