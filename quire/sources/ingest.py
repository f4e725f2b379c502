"""Document identity, page lists and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources import scratch

#: Folders of a table of volumes.
BUCKETS = 128


def content_ids(docs: DataFrame) -> DataFrame:
    """Content-addressed ids of documents (name, content): the same bytes again add nothing."""
    slug = F.left(F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(40))
    short = lambda c, n: F.left(F.sha2(c, 256), F.lit(n))
    name = F.encode("name", "utf-8")
    rows = docs.withColumn("sha", F.sha2("content", 256)).groupBy("sha").agg(F.min("name").alias("name"), F.min_by("content", "name").alias("content"))
    return rows.select("name", "sha", F.concat_ws("_", F.lit("user"), slug, short(name, 6), short(F.col("content"), 12)).alias("document_id"))


def page_list(rows: DataFrame, spec: str, total: Column) -> DataFrame:
    """Pages of a list such as ``5-10, 12``: ranges either way round, held to 1 and the total, distinct."""
    parts = rows.withColumn("_p", F.explode(F.split(F.regexp_replace(spec, r"\s", ""), ",")))
    a, b = F.regexp_extract("_p", r"^(\d+)", 1).cast("bigint"), F.regexp_extract("_p", r"(\d+)$", 1).cast("bigint")
    lo, hi = F.greatest(F.least(a, b), F.lit(1)), F.least(F.greatest(a, b), total)
    ranged = parts.filter(F.col("_p").rlike(r"^\d+(-\d+)?$")).filter(lo <= hi)
    return ranged.withColumn("page", F.explode(F.sequence(lo, hi))).drop("_p").distinct()


def load_volumes(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Manifest entries and discovered documents; a volume's tag is the last part of its work directory."""
    tag = F.regexp_extract("workdir", r"([^/]+)/*$", 1)
    known = manifest.select(tag.alias("tag"), F.coalesce("display", tag).alias("display"), "skip", F.lit(False).alias("user"))
    found = listing.select(F.col("document_id").alias("tag"), F.regexp_replace("name", r"(?i)\.pdf$", "").alias("display"), F.lit(False).alias("skip"), F.lit(True).alias("user"))
    return known.unionByName(found.join(known.select("tag"), "tag", "left_anti"))


def write_table(df: DataFrame, path: str) -> None:
    """Writes a table in BUCKETS folders of volumes; only the volumes that it holds are replaced.  A folder for each
    volume would be a file for a few rows, and there are as many volumes as a corpus has parts."""
    spark = df.sparkSession
    df = df.withColumn("tag_bucket", F.pmod(F.xxhash64("tag"), F.lit(BUCKETS)).cast("int"))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        df = scratch.keep(df, "volumes")
        held = [r.tag_bucket for r in df.select("tag_bucket").distinct().collect()]
        new = df.select(F.col("tag").alias("_new")).distinct()
        old = spark.read.parquet(path).filter(F.col("tag_bucket").isin(held)).join(new, F.col("tag").eqNullSafe(F.col("_new")), "left_anti")
        df = df.unionByName(old)
    df.repartition("tag_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tag_bucket").parquet(path)
