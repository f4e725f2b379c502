"""Reading tables and keeping intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a local master without one, a fresh temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL[app]


class Scratch:
    """Intermediate tables of one operator, written once so that lost executors never replay what lies before.  With
    ``rows``, Python workers are sent at most so many rows at once while a table is written."""

    def __init__(self, spark: SparkSession, owner: str, rows: int | None = None):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{owner}-{uuid.uuid4().hex[:12]}"
        self.rows = rows

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(setting)
        if self.rows:
            self.spark.conf.set(setting, str(self.rows))
        try:
            df.write.mode("overwrite").option("compression", codec).parquet(path)
        finally:
            self.spark.conf.set(setting, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(conf).delete(path, True)


def free_name(names: list[str]) -> str:
    """A column name that isn't taken, whatever its case."""
    name = "_value"
    while name.lower() in {n.lower() for n in names}:
        name += "_"
    return name
