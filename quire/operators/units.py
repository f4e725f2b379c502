"""Work units: what is left to translate, in chunks, and which outputs can be used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import documents

CHUNK, VERIFY_CHUNK, CONTEXT = 40, 25, 240
MAP = "map<string,string>"


def todo_segments(segments: DataFrame, memory: DataFrame) -> DataFrame:
    """The first occurrence of each text of a volume that its memory lacks."""
    missing = segments.join(memory.select("tag", "text"), ["tag", "text"], "left_anti")
    first = F.row_number().over(Window.partitionBy("tag", "text").orderBy("seq"))
    return missing.withColumn("_r", first).filter("_r = 1").drop("_r")


def reading_context(segments: DataFrame, size: int = CONTEXT) -> DataFrame:
    """Each segment with the end of the one before and the start of the one after, over all segments of a volume."""
    w = Window.partitionBy("tag").orderBy("seq")
    tail, head = F.right(F.lag("text").over(w), F.lit(size)), F.left(F.lead("text").over(w), F.lit(size))
    return segments.withColumn("previous_tail", F.coalesce(tail, F.lit(""))).withColumn("next_head", F.coalesce(head, F.lit("")))


def chunk_name(number):  # noqa: ANN001, ANN201
    """Three digits, and more from 1000 on."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(3), F.length(text)), F.lit("0"))


def make_chunks(todo: DataFrame, size: int = CHUNK, prefix: str = "t") -> DataFrame:
    """Numbers the units of each volume in order and deals them out to chunks."""
    k = F.row_number().over(Window.partitionBy("tag").orderBy("seq")).cast("bigint") - 1
    rows = todo.withColumn("k", k)
    extra = [c for c in ("page", "previous_tail", "next_head", "vi") if c in todo.columns]
    name = chunk_name(F.floor(F.col("k") / size))
    return rows.select("tag", "k", name.alias("idx"), (F.col("k") % size).alias("pos"), F.concat(F.lit(prefix), F.col("k").cast("string")).alias("id"), "text", F.col("seq").alias("source_order"), *extra)


def chunk_gen(units: DataFrame) -> DataFrame:
    """A digest of all chunks of a volume in order of their names and items."""
    item = F.concat_ws("\u0001", "id", "text")
    chunks = units.groupBy("tag", "idx").agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))).alias("items"))
    content = F.array_join(F.transform("items", lambda x: x["item"]), "\u0002")
    chunks = chunks.select("tag", "idx", F.concat("idx", F.lit("\u0003"), content).alias("content"))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "content")))
    return chunks.groupBy("tag").agg(ordered.alias("c")).select("tag", F.md5(F.array_join(F.transform("c", lambda x: x["content"]), "")).alias("chunk_gen"))


def explode_outputs(outputs: DataFrame) -> DataFrame:
    """The entries of each output that is a JSON object; others give none."""
    read = outputs.filter(F.ltrim("raw").startswith("{")).withColumn("m", F.from_json("raw", MAP))
    return read.select("tag", "idx", F.explode("m").alias("id", "vi"))


def read_checkpoints(outputs: DataFrame) -> DataFrame:
    """Each output's shape: object, list, or bad when it can't be parsed, which queues it again."""
    kind = documents.json_kind(F.col("raw"))
    return outputs.select("tag", "idx", F.when(kind.isin("object", "list"), kind).otherwise("bad").alias("shape"))


def unit_valid(units: DataFrame, outputs: DataFrame) -> DataFrame:
    """A translation unit is done if its output gives a text that isn't blank for every id."""
    given = explode_outputs(outputs)
    filled = (F.trim(F.coalesce("vi", F.lit(""))) != "").alias("filled")
    rows = units.select("tag", "idx", "id").join(given.select("tag", "idx", "id", filled), ["tag", "idx", "id"], "left")
    return rows.groupBy("tag", "idx").agg(F.bool_and(F.coalesce("filled", F.lit(False))).alias("valid"), F.count("*").alias("ids"))


def pending_units(units: DataFrame, outputs: DataFrame) -> DataFrame:
    return unit_valid(units, outputs).filter(~F.col("valid")).select("tag", "idx")


def stage_gate(units: DataFrame, outputs: DataFrame, stage: str) -> DataFrame:
    """Whether the runner takes an output: lists for vision, objects for verify, full maps with the source's markers
    for translate."""
    shapes = read_checkpoints(outputs)
    if stage == "vision":
        return shapes.select("tag", "idx", (F.col("shape") == "list").alias("passes"))
    if stage == "verify":
        return shapes.select("tag", "idx", (F.col("shape") == "object").alias("passes"))
    from quire.functions import markers

    given = explode_outputs(outputs).select("tag", "idx", "id", "vi")
    rows = units.select("tag", "idx", "id", "text").join(given, ["tag", "idx", "id"], "left")
    ok = (F.trim(F.coalesce("vi", F.lit(""))) != "") & (markers.placeholders("text") == markers.placeholders("vi"))
    return rows.groupBy("tag", "idx").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("passes"))


def generation_ok(stamps: DataFrame, generations: DataFrame) -> DataFrame:
    """Artifacts belong to the current chunks: a stamp must be equal; without one their age decides."""
    rows = stamps.join(generations, "tag", "left")
    current = F.coalesce("chunk_gen", F.lit(""))
    return rows.select("tag", F.when(F.col("has_stamp"), F.coalesce("stamp", F.lit("")) == current).otherwise(F.col("artifact_time") >= F.col("chunk_time")).alias("ok"))
