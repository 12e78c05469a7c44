"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine, where it is unset, a folder in the warehouse. On a cluster it must be set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/millrace-kept"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder there, deleted when the driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def delete() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone before
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(delete)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df written and reread: evaluated once, whatever reads it, and safe from lost executors."""
    return measured(df, name)[0]


def measured(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(written(df), the bytes of its files)."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return spark.read.schema(df.schema).parquet(folder), size
