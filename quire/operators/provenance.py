"""What changed since artifacts were made: sources, contexts, snapshots, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import documents

# What each kind of change makes stale, and what a redo of a stage drops.
STALE = {"source": ["layout", "chunks", "memory", "report", "verdicts"], "translation": ["chunks", "report"]}
REDO = {"translate": ["out", "vout", "stamps", "verdicts"], "verify": ["vout", "stamps", "verdicts"], "vision": ["verdicts"]}

# What stands before a line of a unit's context.
BEFORE, AFTER = "Trước: ", "Sau: "


def invalidation(old: DataFrame, new: DataFrame) -> DataFrame:
    """What each volume loses: all that hangs on its source if that changed (or was never noted though artifacts are
    there), else what hangs on the translation's context if that did."""
    o = old.select("tag", F.col("sha").alias("osha"), F.col("context").alias("octx"), "legacy")
    rows = new.join(o, "tag", "left")
    source = (F.col("osha").isNotNull() & (F.col("osha") != F.col("sha"))) | (F.col("osha").isNull() & F.coalesce("legacy", F.lit(False)))
    other = F.col("octx").isNotNull() & F.col("context").isNotNull() & (F.col("octx") != F.col("context"))
    rows = rows.select("tag", F.when(source, "source").when(other, "translation").alias("kind")).filter("kind IS NOT NULL")
    lost = F.lit(None).cast("array<string>")
    for kind, names in STALE.items():
        lost = F.when(F.col("kind") == kind, F.array(*map(F.lit, names))).otherwise(lost)
    return rows.withColumn("artifact", F.explode(lost))


def redo_reset(artifacts: DataFrame, redo: DataFrame) -> DataFrame:
    """Artifacts (tag, name) that stay when stages (tag, stage) are done again."""
    lost = F.lit(None).cast("array<string>")
    for stage, names in REDO.items():
        lost = F.when(F.col("stage") == stage, F.array(*map(F.lit, names))).otherwise(lost)
    return artifacts.join(redo.select("tag", F.explode(lost).alias("name")), ["tag", "name"], "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """For each page that changed: texts before and after, how many went and how many came."""
    pages = lambda df, n: df.groupBy("tag", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias(n))
    rows = pages(old, "a").join(pages(new, "b"), ["tag", "page"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    none = F.array().cast("array<string>")
    a, b = F.coalesce(F.col("a.text"), none), F.coalesce(F.col("b.text"), none)
    return rows.select("tag", "page", F.size(a).cast("bigint").alias("before"), F.size(b).cast("bigint").alias("after"), F.size(F.array_except(a, b)).cast("bigint").alias("removed"), F.size(F.array_except(b, a)).cast("bigint").alias("added"))


def stale_reviews(outputs: DataFrame, pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pages to review again: no pair image, one older than the output, or no verdict that is a whole list."""
    good = verdicts.filter(documents.json_kind(F.col("raw")) == "list").select("tag", "page").distinct().withColumn("_v", F.lit(True))
    rows = outputs.join(pairs, ["tag", "page"], "left").join(good, ["tag", "page"], "left")
    why = F.when(F.col("pair_time").isNull(), "no image").when(F.col("pair_time") < F.col("output_time"), "old image").when(F.col("_v").isNull(), "no verdict")
    return rows.select("tag", "page", why.alias("why")).filter("why IS NOT NULL")


def same_slot(a: Column, b: Column) -> Column:
    """Whether two boxes are the same place: overlaps of the smaller, ratios of sizes, distance of centres."""
    cut = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    size = lambda r, lo, hi: F.greatest(r[hi] - r[lo], F.lit(0.01))
    ratio = lambda lo, hi: F.greatest(size(a, lo, hi), size(b, lo, hi)) / F.least(size(a, lo, hi), size(b, lo, hi))
    near = lambda lo, hi: F.abs(a[lo] + a[hi] - b[lo] - b[hi]) / 2
    x = cut("x0", "x1") / F.least(size(a, "x0", "x1"), size(b, "x0", "x1")) >= 0.9
    y = cut("y0", "y1") / F.least(size(a, "y0", "y1"), size(b, "y0", "y1")) >= 0.65
    return x & y & (ratio("x0", "x1") <= 1.35) & (ratio("y0", "y1") <= 1.6) & (near("x0", "x1") <= 3) & (near("y0", "y1") <= 20)


def raster_diff(samples: DataFrame, most: int = 200_000) -> DataFrame:
    """Mean difference of two rasters of 0 to 255, the share of samples that differ clearly, and their similarity; a
    stride keeps long ones to about ``most`` samples; null where sizes differ."""
    step = F.greatest(F.lit(1), F.floor(F.size("a") / most)).cast("int")
    at = F.sequence(F.lit(0), F.size("a") - 1, step)
    delta = F.transform(at, lambda i: F.abs(F.get("a", i) - F.get("b", i)))
    rows = samples.withColumn("d", F.when((F.size("a") == F.size("b")) & (F.size("a") > 0), delta))
    mean = F.aggregate("d", F.lit(0.0), lambda x, y: x + y) / F.size("d") / 255
    share = F.size(F.filter("d", lambda x: x > 8)) / F.size("d")
    return rows.select("page", F.round(mean, 6).alias("mean_delta"), F.round(share, 6).alias("changed"), F.round(1 - mean, 6).alias("similarity"))


def labeled_groups(lines: DataFrame) -> DataFrame:
    """Items of each block from lines (…, line, is_label, is_heading): a label opens one, a heading closes it, other
    lines continue it or open one."""
    w = Window.partitionBy("tag", "page", "block").orderBy("line")
    after = F.coalesce(F.lag("is_heading").over(w), F.lit(True))
    opens = ~F.col("is_heading") & (F.col("is_label") | after)
    rows = lines.withColumn("opens", opens.cast("int")).withColumn("item", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter(~F.col("is_heading")).groupBy("tag", "page", "block", "item").agg(F.min("line").alias("first"), F.count("*").alias("lines"))


def unit_context(units: DataFrame, most: int = 6) -> DataFrame:
    """For each chunk its source pages in order of appearance, and the first lines that stand before and after its
    units; a chunk's units are few, and meet in one row."""
    pages = units.groupBy("tag", "idx", "page").agg(F.min("pos").alias("at")).groupBy("tag", "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "page"))), lambda x: x["page"].cast("string")), ",").alias("pages"))
    said = lambda before, text: F.when(text != "", F.concat(F.lit(before), text))
    sides = F.transform(F.array_sort(F.collect_list(F.struct("pos", "previous_tail", "next_head"))), lambda x: F.array(said(BEFORE, x["previous_tail"]), said(AFTER, x["next_head"])))
    first = units.groupBy("tag", "idx").agg(F.slice(F.array_compact(F.flatten(sides)), 1, most).alias("sides"))
    return pages.join(first.select("tag", "idx", F.array_join("sides", "\n").alias("context")), ["tag", "idx"])


def repairs_valid(rows: DataFrame, kinds: tuple[str, ...], states: tuple[str, ...]) -> DataFrame:
    """Requests with a page, a known kind and state, and a note of at most 500 characters."""
    ok = (F.col("page") >= 1) & F.col("kind").isin(*kinds) & F.col("status").isin(*states) & (F.length(F.coalesce("note", F.lit(""))) <= 500)
    return rows.filter(F.coalesce(ok, F.lit(False)))


def repairs_list(valid: DataFrame, most: int = 20) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("created_at"), F.desc("id")))
    return valid.withColumn("place", nth.cast("bigint")).filter(F.col("place") <= most)
