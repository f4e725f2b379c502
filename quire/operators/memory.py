"""Translation memory: merging outputs, verification, and what each segment resolves to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import markers
from quire.operators import units

DROPS, CUT = 500, 160


def upsert(memory: DataFrame, fresh: DataFrame) -> DataFrame:
    """The memory with the fresh entries in place of older ones."""
    new = fresh.select("tag", "text", F.col("vi").alias("new"))
    return memory.join(new, ["tag", "text"], "full_outer").select("tag", "text", F.coalesce("new", "vi").alias("vi"))


def _checked(work: DataFrame, outputs: DataFrame) -> DataFrame:
    given = units.explode_outputs(outputs)
    return work.select("tag", "idx", "pos", "id", "text").join(given, ["tag", "idx", "id"]).withColumn("checked", markers.check("text", "vi"))


def fresh_translations(work: DataFrame, outputs: DataFrame) -> DataFrame:
    """(tag, text, vi) from the outputs; of several for a text the last by (chunk, position) counts."""
    rows = _checked(work, outputs).filter(F.col("checked").isNotNull())
    return rows.groupBy("tag", "text").agg(F.max_by("checked", F.struct("idx", "pos")).alias("vi"))


def merge_translations(work: DataFrame, outputs: DataFrame, memory: DataFrame) -> DataFrame:
    """The memory after all outputs are merged."""
    return upsert(memory, fresh_translations(work, outputs))


def marker_drops(work: DataFrame, outputs: DataFrame) -> DataFrame:
    """Outputs that were rejected, the last DROPS of each volume, cut to CUT characters."""
    rows = _checked(work, outputs).filter(F.col("checked").isNull())
    newest = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("idx"), F.desc("pos")))
    rows = rows.withColumn("_r", newest).filter(F.col("_r") <= DROPS)
    cut = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(CUT))
    return rows.select("tag", F.col("idx").alias("chunk"), "id", cut(F.col("text")).alias("en"), cut(F.col("vi")).alias("vi"))


def still_missing(segments: DataFrame, memory: DataFrame) -> DataFrame:
    return segments.join(memory.select("tag", "text"), ["tag", "text"], "left_anti").groupBy("tag").agg(F.count("*").alias("missing"))


def verify_targets(segments: DataFrame, memory: DataFrame, mode: str = "num") -> DataFrame:
    """Distinct segments with their translation; mode num takes those with a digit or left untranslated."""
    rows = segments.join(memory, ["tag", "text"], "left").withColumn("vi", F.coalesce("vi", F.lit("")))
    if mode == "num":
        rows = rows.filter(F.col("text").rlike("[0-9]") | markers.untranslated("vi"))
    first = F.row_number().over(Window.partitionBy("tag", "text").orderBy("seq"))
    rows = rows.withColumn("_r", first).filter("_r = 1").drop("_r")
    return units.make_chunks(rows, units.VERIFY_CHUNK, "v").select("tag", "idx", "pos", "id", F.col("text").alias("en"), "vi")


def merge_verify(targets: DataFrame, corrections: DataFrame, memory: DataFrame) -> DataFrame:
    """The memory with corrections by verify id; one that breaks markers leaves the old text."""
    rows = targets.join(corrections.select("tag", "idx", "id", F.col("vi").alias("new")), ["tag", "idx", "id"])
    rows = rows.withColumn("checked", markers.check("en", "new")).filter(F.col("checked").isNotNull())
    last = rows.groupBy("tag", F.col("en").alias("text")).agg(F.max_by("checked", F.struct("idx", "pos")).alias("vi"))
    return upsert(memory, last)


def resolve_translation(segments: DataFrame, memory: DataFrame, overrides: DataFrame) -> DataFrame:
    """An override by id while its text is still the segment's (or none is noted), else the memory, else empty."""
    o = overrides.select("tag", "id", F.col("en").alias("_en"), F.col("vi").alias("_o"))
    rows = segments.join(o, ["tag", "id"], "left").join(memory.select("tag", "text", F.col("vi").alias("_m")), ["tag", "text"], "left")
    fits = F.col("_en").isNull() | (F.col("_en") == F.col("text"))
    return rows.select("tag", "id", "page", F.coalesce(F.when(fits, F.col("_o")), F.col("_m"), F.lit("")).alias("vi"))


def merge_fixes(resolved: DataFrame, fixes: DataFrame) -> DataFrame:
    """Fixes that differ from the current text, keep its markers and still differ once repaired."""
    rows = resolved.join(fixes.select("tag", "id", F.col("vi").alias("new")), ["tag", "id"])
    rows = rows.filter(F.trim("new") != F.col("vi")).withColumn("checked", markers.check("text", "new"))
    return rows.filter(F.col("checked").isNotNull() & (F.col("checked") != F.col("vi"))).select("tag", "id", F.col("text").alias("en"), F.col("checked").alias("vi"))


def glossary_relevant(work: DataFrame, glossary: DataFrame, top: int = 20, size: int = 500) -> DataFrame:
    """The terms of the glossary that a unit's text contains, longest first; the glossary itself is held to ``size``."""
    order = Window.orderBy(F.desc(F.length("en")), "en")
    terms = glossary.orderBy(F.desc(F.length("en")), "en").limit(size).withColumn("o", F.row_number().over(order))
    # lower case is made once a unit and once a term, not once for each pair of them
    said = work.select("tag", "idx", "id", F.explode(F.array(F.lower("text"))).alias("_said"))
    rows = said.join(F.broadcast(terms.withColumn("_term", F.lower("en"))), F.contains("_said", "_term"))
    rows = rows.groupBy("tag", "idx", "id").agg(F.slice(F.array_sort(F.collect_list(F.struct("o", "en", F.col("vi").alias("v")))), 1, top).alias("t"))
    return rows.select("tag", "idx", "id", F.array_join(F.transform("t", lambda x: F.concat(x["en"], F.lit(" = "), x["v"])), "; ").alias("terms"))
