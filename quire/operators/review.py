"""Review issues: clusters of defects, pages to work on, accepted pages, golden snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import defects, documents

VERDICT = "array<struct<kind:string,severity:string,detail:string>>"


def enrich(issues: DataFrame) -> DataFrame:
    """Cluster and channel where an issue has none."""
    have = lambda c: F.nullif(F.col(c), F.lit("")) if c in issues.columns else F.lit(None)
    return issues.withColumn("cluster", F.coalesce(have("cluster"), defects.classify(F.col("detail"), 0))).withColumn("channel", F.coalesce(have("channel"), defects.classify(F.col("detail"), 1)))


def _open(issues: DataFrame, accepted: DataFrame, threshold: str) -> DataFrame:
    is_defect = F.coalesce(F.col("kind"), F.lit("defect")) != "fit"
    rows = issues.filter(is_defect & (defects.rank(F.col("severity")) >= defects.RANK.get(threshold, 1)))
    return rows.join(accepted.select("tag", "page"), ["tag", "page"], "left_anti")


def defect_pages(issues: DataFrame, accepted: DataFrame, threshold: str = "medium") -> DataFrame:
    return _open(issues, accepted, threshold).select("tag", "page").distinct()


def problems(issues: DataFrame, accepted: DataFrame, threshold: str = "medium", channel: str | None = None) -> DataFrame:
    """Pages that need work; the text channel includes mixed issues."""
    rows = enrich(_open(issues, accepted, threshold))
    if channel:
        rows = rows.filter(F.col("channel").isin(*(("text", "mixed") if channel == "text" else (channel,))))
    return rows.groupBy("tag", "page").agg(F.count("*").alias("issues"), F.max(defects.rank(F.col("severity"))).cast("bigint").alias("worst"))


def defect_report(issues: DataFrame, accepted: DataFrame, samples: int = 3) -> DataFrame:
    """For each volume and cluster: issues, sorted pages, the first samples, the channel of the first issue."""
    rows = enrich(_open(issues, accepted, "low"))
    nth = F.row_number().over(Window.partitionBy("tag", "cluster").orderBy("page", "seq"))
    first = rows.withColumn("_r", nth).filter(F.col("_r") <= samples)
    some = first.groupBy("tag", "cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.left("detail", F.lit(160)).alias("d")))), lambda x: x["d"]), " | ").alias("samples"))
    all_ = rows.groupBy("tag", "cluster").agg(F.count("*").alias("issues"), F.array_join(F.array_sort(F.collect_set("page")).cast("array<string>"), ",").alias("pages"), F.min_by("channel", F.struct("page", "seq")).alias("channel"))
    return all_.join(some, ["tag", "cluster"])


def accept_pages(accepted: DataFrame, more: DataFrame) -> DataFrame:
    return accepted.select("tag", "page").union(more.select("tag", "page")).distinct()


def accept_warnings(issues: DataFrame, more: DataFrame) -> DataFrame:
    """Defects of at least medium severity, not of policy, that accepting these pages would hide."""
    rows = enrich(issues).filter((F.coalesce("kind", F.lit("defect")) != "fit") & (defects.rank(F.col("severity")) >= 2) & (F.col("channel") != "policy"))
    return rows.join(more.select("tag", "page"), ["tag", "page"], "left_semi").groupBy("tag", "page").agg(F.count("*").alias("hidden"))


def reopen_pages(accepted: DataFrame, pages: DataFrame) -> DataFrame:
    """Accepted pages that are left once these are reopened."""
    return accepted.join(pages, ["tag", "page"], "left_anti").select("tag", "page")


def reopened(accepted: DataFrame, pages: DataFrame) -> DataFrame:
    return accepted.join(pages, ["tag", "page"], "left_semi").select("tag", "page")


def revision_pages(verdicts: DataFrame, issues: DataFrame, accepted: DataFrame) -> DataFrame:
    """Verdicts that stay when those of all problem pages are dropped."""
    return verdicts.join(defect_pages(issues, accepted), ["tag", "page"], "left_anti")


def review_summary(issues: DataFrame, accepted: DataFrame) -> DataFrame:
    """Blocking pages, pages with low defects only, fit issues, accepted pages, and whether nothing blocks."""
    a = accepted.select("tag", "page").distinct().withColumn("_a", F.lit(True))
    rows = issues.join(a, ["tag", "page"], "left").withColumn("_fit", F.coalesce("kind", F.lit("defect")) == "fit")
    page = rows.groupBy("tag", "page").agg(F.max(F.when(~F.col("_fit") & F.col("_a").isNull(), defects.rank(F.col("severity")))).alias("worst"), F.count_if("_fit").alias("fit"), F.bool_or(F.coalesce("_a", F.lit(False))).alias("acc"))
    out = page.groupBy("tag").agg(F.count_if(F.col("worst") >= 2).alias("blocking"), F.count_if(F.col("worst") == 1).alias("low_only"), F.sum("fit").alias("fit_issues"), F.count_if("acc").alias("accepted"))
    return out.withColumn("converged", F.col("blocking") == 0)


def merge_verdicts(verdicts: DataFrame) -> DataFrame:
    """Issue rows of all page verdicts that are whole lists, in order of pages."""
    good = verdicts.filter(documents.json_kind(F.col("raw")) == "list").withColumn("v", F.from_json("raw", VERDICT))
    return good.select("tag", "page", F.posexplode("v").alias("pos", "i")).select("tag", "page", F.col("pos").cast("bigint").alias("pos"), "i.*")


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """Files, bad files and high issues of each volume."""
    bad = verdicts.groupBy("tag").agg(F.count("*").alias("files"), F.count_if(F.coalesce(documents.json_kind(F.col("raw")) != "list", F.lit(True))).alias("bad"))
    high = merge_verdicts(verdicts).groupBy("tag").agg(F.count_if(F.col("severity") == "high").alias("high"))
    return bad.join(high, "tag", "left").select("tag", "files", "bad", F.coalesce("high", F.lit(0)).alias("high"))


def page_hashes(segments: DataFrame) -> DataFrame:
    """A digest of each page's texts in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return segments.groupBy("tag", "page").agg(F.md5(F.array_join(texts, "\n")).alias("hash"))


def golden_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """For each volume: pages compared, pages that changed (added and lost ones too), and whether none was."""
    rows = old.select("tag", "page", F.col("hash").alias("a")).join(new.select("tag", "page", F.col("hash").alias("b")), ["tag", "page"], "full_outer")
    changed = ~F.col("a").eqNullSafe(F.col("b"))
    out = rows.groupBy("tag").agg(F.count("*").alias("pages"), F.count_if(changed).alias("changed"), F.count("a").alias("_a"), F.count("b").alias("_b"))
    return out.select("tag", "pages", "changed", (F.col("_a") == F.col("_b")).alias("same_count"))


def attach_segments(issues: DataFrame, resolved: DataFrame) -> DataFrame:
    """Text and mixed issues that aren't about fit, with the number of segments of their page and the first id."""
    rows = enrich(issues).filter((F.coalesce("kind", F.lit("defect")) != "fit") & F.col("channel").isin("text", "mixed"))
    pages = rows.select("tag", "page").distinct()
    held = resolved.join(pages, ["tag", "page"], "left_semi").groupBy("tag", "page").agg(F.count("*").alias("segments"), F.min_by("id", "seq").alias("first_id"))
    return rows.join(held, ["tag", "page"], "left").select("tag", "page", "seq", "channel", F.coalesce("segments", F.lit(0)).alias("segments"), "first_id")


def clear_page_artifacts(table: DataFrame, edited: DataFrame) -> DataFrame:
    """What a table keyed by tag and page keeps after these pages were edited."""
    return table.join(edited.select("tag", "page"), ["tag", "page"], "left_anti")
