"""A fresh folder in the cluster's shared folder, for tables that a stream or several steps of a job read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, owner: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{owner}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, owner: str) -> DataFrame:
    """The table written once, for steps that would each derive it anew; a lost executor reads it again."""
    path = folder(df.sparkSession, owner)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
