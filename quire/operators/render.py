"""Render telemetry: scales that fit, the scale of a volume, and segments to review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The scales that are tried.
LADDER = [1.0, 0.97, 0.94, 0.91, 0.88, 0.85, 0.82, 0.79, 0.76, 0.73, 0.7, 0.67, 0.64, 0.6, 0.55]
# The least scale of each role that needs no review.
FLOORS = {"heading": 0.85, "title": 0.85, "caption": 0.72, "footnote": 0.80, "reference": 0.80}
FLOOR = 0.78


def ladder(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in LADDER], "scale double")


def fit_scale(measures: DataFrame) -> DataFrame:
    """The largest scale at which a segment's text fits its height; the least one if none does."""
    fits = ~F.col("more") & (F.col("filled") <= F.col("height") + 0.5)
    return measures.groupBy("tag", "id").agg(F.coalesce(F.max(F.when(fits, F.col("scale"))), F.lit(LADDER[-1])).alias("scale"))


def mode_scale(scales: DataFrame) -> DataFrame:
    """The most frequent scale of each volume by length of text, in steps of 0.03; of equal ones the larger."""
    steps = scales.withColumn("b", F.bround(F.col("scale") / 0.03).cast("bigint")).groupBy("tag", "b").agg(F.sum("weight").alias("w"))
    return steps.groupBy("tag").agg(F.round(F.least(F.lit(1.0), F.max_by("b", F.struct("w", "b")) * 0.03), 6).alias("mode"))


def scale_cap(modes: DataFrame) -> DataFrame:
    return modes.select("tag", F.when(F.col("mode") >= 0.94, 1.0).otherwise(F.greatest("mode", F.lit(0.85))).alias("cap"))


def review_flags(report: DataFrame) -> DataFrame:
    """The scale each segment really got and whether someone should look at it."""
    floor = F.lit(FLOOR)
    for role, least in FLOORS.items():
        floor = F.when(F.contains("type", F.lit(role)), least).otherwise(floor)
    actual = F.when(F.col("fallback").isNotNull(), F.col("renderer_scale")).otherwise(F.col("requested_scale") * F.col("renderer_scale"))
    rows = report.withColumn("actual_scale", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), actual)), 4))
    return rows.withColumn("review_required", (F.col("actual_scale") < floor) | F.col("fallback").isNotNull() | F.col("overflow"))


def report_totals(flagged: DataFrame, missing: DataFrame) -> DataFrame:
    a = flagged.groupBy("tag").agg(F.count("*").alias("applied"), F.count_if("review_required").alias("review"))
    m = missing.groupBy("tag").agg(F.count("*").alias("missing"))
    return a.join(m, "tag", "full_outer").select("tag", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("applied", "review", "missing")))


def merge_partial_report(report: DataFrame, part: DataFrame) -> DataFrame:
    """A page's rows replaced where the ids of both are the same; other pages stay."""
    ids = lambda df, n: df.groupBy("tag", "page").agg(F.array_sort(F.collect_set("id")).alias(n))
    same = ids(report, "a").join(ids(part, "b"), ["tag", "page"]).filter(F.col("a") == F.col("b")).select("tag", "page")
    return report.join(same, ["tag", "page"], "left_anti").unionByName(part.join(same, ["tag", "page"], "left_semi"))


def report_integrity(layout: DataFrame, report: DataFrame, missing: DataFrame, volumes: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """A row for each rule that a volume's report breaks.

    ``layout``: tag, id, x0, y0, x1, y1; ``report``: tag, id, the same box, source and translation; ``missing``: tag,
    id; ``volumes``: tag, source, layout_source, layout_generation, report_generation, output, report_output.  Ids must
    be given, once each, and be either applied or missing, all of them; the layout must be of the volume's own source
    and of the report's generation, the report of the current output; boxes may differ by ``tolerance`` at most."""
    rule = lambda df, name: df.select("tag").distinct().withColumn("rule", F.lit(name))
    empty = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    other = lambda a, b: empty(a) | empty(b) | ~F.coalesce(F.col(a) == F.col(b), F.lit(False))
    ids = [df.select("tag", "id") for df in (layout, report, missing)]
    both = ids[1].union(ids[2])
    twice = [df.groupBy("tag", "id").count().filter("count > 1").select("tag") for df in ids]
    box = ["x0", "y0", "x1", "y1"]
    pair = report.join(layout.select("tag", "id", *[F.col(c).alias(f"l{c}") for c in box]), ["tag", "id"])
    far = ~F.coalesce(F.greatest(*[F.abs(F.col(c) - F.col(f"l{c}")) for c in box]) <= tolerance, F.lit(False))
    broken = [
        rule(twice[0].union(twice[1]).union(twice[2]), "repeated id"), rule(both.union(ids[0]).filter(empty("id")), "lacking id"),
        rule(ids[1].intersect(ids[2]), "applied and missing"), rule(ids[0].exceptAll(both.distinct()), "not reported"),
        rule(both.distinct().join(ids[0], ["tag", "id"], "left_anti"), "unknown id"), rule(pair.filter(far), "other box"),
        rule(report.filter(empty("source")), "blank source"), rule(report.filter(empty("translation")), "blank translation"),
        rule(volumes.filter(other("layout_source", "source")), "other source"), rule(volumes.filter(other("layout_generation", "report_generation")), "other generation"),
        rule(volumes.filter(other("report_output", "output")), "other output"),
    ]
    out = broken[0]
    for b in broken[1:]:
        out = out.union(b)
    return out
