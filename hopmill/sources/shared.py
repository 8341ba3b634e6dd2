"""Tables written to the folder that driver and executors share, for steps whose rows must not change when they are read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; in a folder of our own only in local mode where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or f"file://{tempfile.mkdtemp(prefix='spark-hopmill-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and lost executors do not change its rows."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_as_dealt(df: DataFrame, name: str) -> DataFrame:
    """written(), where tables that are dealt by some of a join's keys (each by the same) are not shuffled for the others.

    For tables whose rows under those few keys are bounded; they meet in one task.
    """
    conf, key = df.sparkSession.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return written(df, name)
    finally:
        conf.set(key, before)
