"""Cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names. Where it is unset, only one machine has a folder to share with itself."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "vellumetry-checkpoints")
    return f"{root.rstrip('/')}/vellumetry/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again, so that later scans read the columns they need."""
    path = shared_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
