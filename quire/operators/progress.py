"""Progress of volumes, the library's roll-ups, and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stage_status(units: DataFrame, verify: DataFrame, pages: DataFrame, defects: DataFrame) -> DataFrame:
    """Stage and (done, total) of each volume.  ``units``, ``verify`` and ``pages`` have a row (tag, done) for each unit;
    ``defects`` a row for each page to be mended.  Later stages count only once the one before is complete."""
    counts = lambda df, p: df.groupBy("tag").agg(F.count_if("done").alias(f"{p}_done"), F.count("*").alias(f"{p}_total"))
    rows = counts(units, "t").join(counts(verify, "v"), "tag", "full_outer").join(counts(pages, "p"), "tag", "full_outer")
    rows = rows.join(defects.groupBy("tag").agg(F.count("*").alias("defects")), "tag", "left").fillna(0)
    told = (F.col("t_total") > 0) & (F.col("t_done") == F.col("t_total"))
    checked = told & (F.col("v_done") == F.col("v_total"))
    seen = checked & (F.col("p_done") == F.col("p_total"))
    rows = rows.withColumn("stage", F.when(~told, "translate").when(~checked, "verify").when(~seen, "vision").when(F.col("defects") > 0, "review").otherwise("done"))
    return rows.withColumn("v_done", F.when(told, F.col("v_done")).otherwise(0)).withColumn("p_done", F.when(told, F.col("p_done")).otherwise(0))


def overall_pct(status: DataFrame) -> DataFrame:
    """Percent done: 40 for translation, 30 for checking, 25 for layout, one after the other."""
    part = lambda p: F.when(F.col(f"{p}_total") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"{p}_done") / F.col(f"{p}_total")))).otherwise(0.0)
    s = F.col("stage")
    value = F.when(s == "done", 100.0).when(s == "review", 95.0).when(s == "vision", 70 + 25 * part("p")).when(s == "verify", 40 + 30 * part("v")).when(s == "translate", 40 * part("t")).otherwise(0.0)
    return status.select("tag", "stage", F.bround(value).cast("bigint").alias("pct"))


def effective_stage(stage: Column, review_on: Column) -> Column:
    return F.coalesce(F.when(~review_on & (stage == "vision"), "done").otherwise(stage), F.lit("translate"))


def volumes_todo(volumes: DataFrame, status: DataFrame) -> DataFrame:
    """Volumes that aren't skipped or done; one that hasn't begun is to be translated."""
    rows = volumes.join(status.select("tag", "stage"), "tag", "left").withColumn("stage", F.coalesce("stage", F.lit("translate")))
    return rows.filter(~F.col("skip") & (F.col("stage") != "done")).select("tag", "stage")


def library_rollup(volumes: DataFrame, status: DataFrame) -> DataFrame:
    """Volumes by state: done (or skipped), in work, and the pages of those done."""
    rows = volumes.join(status.select("tag", "stage", "p_total"), "tag", "left")
    done = F.col("stage") == "done"
    return rows.agg(F.count_if(F.coalesce(done, F.lit(False)) | F.col("skip")).alias("done"), F.count_if(~F.col("skip")).alias("real"), F.count("*").alias("total"), F.coalesce(F.sum(F.when(done & ~F.col("skip"), F.col("p_total"))), F.lit(0)).alias("pages"))


def queue_split(volumes: DataFrame, status: DataFrame, outcome: DataFrame) -> DataFrame:
    """The class of each volume: done, error, active, review or draft."""
    rows = volumes.join(status.select("tag", "stage"), "tag", "left").join(outcome.select("tag", "state"), "tag", "left")
    kind = F.when((F.col("stage") == "done") | F.col("skip"), "done").when(F.col("state") == "failed", "error").when(F.col("state") == "running", "active").when(F.col("stage") == "review", "review").otherwise("draft")
    return rows.select("tag", kind.alias("class"))


def apply_candidates(volumes: DataFrame, units: DataFrame, outcome: DataFrame) -> DataFrame:
    """Volumes that can be applied again: chunked, not skipped and not running."""
    rows = volumes.filter(~F.col("skip")).join(units.select("tag").distinct(), "tag", "left_semi")
    return rows.join(outcome.filter(F.col("state") == "running"), "tag", "left_anti").select("tag")


def page_count(source: DataFrame, cached: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of each volume: of its document, else as cached, else the highest index and one."""
    highest = pages.groupBy("tag").agg((F.max("page") + 1).alias("h"))
    return highest.join(source, "tag", "left").join(cached, "tag", "left").select("tag", F.coalesce("source_pages", "cached_pages", "h").alias("pages"))


def log_tail(log: DataFrame, n: int = 200) -> DataFrame:
    last = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("line_no")))
    return log.withColumn("_r", last).filter(F.col("_r") <= n).drop("_r")


HEADER = r"^===== RUN .*sid=(\S+)"


def log_runs(log: DataFrame) -> DataFrame:
    """The log cut into runs at its headers: id, lines, and the exit code if one is told."""
    sid = F.nullif(F.regexp_extract("line", HEADER, 1), F.lit(""))
    order = Window.partitionBy("tag").orderBy("line_no")
    rows = log.withColumn("sid", sid).withColumn("run", F.count("sid").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    code = F.nullif(F.regexp_extract("line", r"^exit rc=(-?\d+)", 1), F.lit("")).cast("bigint")
    return rows.groupBy("tag", "run").agg(F.max("sid").alias("sid"), F.count("*").alias("lines"), F.max_by(code, F.when(code.isNotNull(), F.col("line_no"))).alias("rc"), F.min("line_no").alias("first"))


def unit_attempts(log: DataFrame) -> DataFrame:
    """Attempts at each unit and whether one succeeded."""
    g = lambda i: F.regexp_extract("line", r"^unit (\S+) attempt (\d+) (\w+)", i)
    rows = log.select("tag", g(1).alias("unit"), F.nullif(g(2), F.lit("")).cast("bigint").alias("n"), g(3).alias("how")).filter("unit <> ''")
    return rows.groupBy("tag", "unit").agg(F.max("n").alias("attempts"), F.bool_or(F.col("how") == "ok").alias("ok"))


def run_outcome(runs: DataFrame) -> DataFrame:
    """The state of each volume by its last run: running, completed or failed."""
    last = runs.filter(F.col("sid").isNotNull()).groupBy("tag").agg(F.max_by(F.struct("sid", "rc"), "run").alias("r"))
    return last.select("tag", "r.sid", F.when(F.col("r.rc").isNull(), "running").when(F.col("r.rc") == 0, "completed").otherwise("failed").alias("state"))


def early_exits(runs: DataFrame, most: int = 3) -> DataFrame:
    """Clean exits in a row at the end of each volume's runs, and whether it may be resumed by itself."""
    order = Window.partitionBy("tag").orderBy("run")
    rows = runs.filter(F.col("rc").isNotNull()).withColumn("broken", F.sum((F.col("rc") != 0).cast("int")).over(order))
    islands = rows.groupBy("tag", "broken").agg(F.count_if(F.col("rc") == 0).alias("clean"))
    last = islands.groupBy("tag").agg(F.max_by("clean", "broken").alias("clean"))
    return last.select("tag", "clean", ((F.col("clean") > 0) & (F.col("clean") < most)).alias("resume"))
