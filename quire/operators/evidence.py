"""What extractions, reports and run records say about each other: matches, trusted segments, status rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import layout
from quire.operators import layout as layout_ops
from quire.operators.progress import effective_stage
from quire.operators.provenance import same_slot

PAGE = ["tag", "page"]
# Header band, step between its lines, equal neighbours of a doubled line, size by height, column jump.
HEADER, STEP, DOUBLED, HEIGHT, JUMP = 72, 6, 3, 0.82, 10


def legacy_stale(volumes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Volumes without a manifest (tag, source, source_time, layout_source, layout_time): stale if their layout names
    another source, or the source is newer than the layout and all chunks (tag, time); without either they aren't."""
    rows = volumes.join(chunks.groupBy("tag").agg(F.max("time").alias("_chunk")), "tag", "left")
    other = F.coalesce(F.col("layout_source") != F.col("source"), F.lit(False))
    newer = F.coalesce(F.col("source_time") > F.greatest("layout_time", "_chunk"), F.lit(False))
    return rows.select("tag", (other | newer).alias("stale"))


def layout_match(old: DataFrame, new: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Whether two extractions of a page (tag, page, pos, id, boxes: array<array<double>>) are the same, item by item:
    ids and numbers of boxes and coordinates alike, coordinates but for the tolerance."""
    rows = old.withColumn("a", F.struct("id", "boxes")).drop("id", "boxes").join(new.withColumn("b", F.struct("id", "boxes")).drop("id", "boxes"), [*PAGE, "pos"], "full_outer")
    near = lambda x, y: (F.size(x) == F.size(y)) & F.forall(F.zip_with(x, y, lambda u, v: F.coalesce(F.abs(u - v) <= tolerance, F.lit(False))), lambda ok: ok)
    boxes = (F.size("a.boxes") == F.size("b.boxes")) & F.forall(F.zip_with("a.boxes", "b.boxes", lambda x, y: F.coalesce(near(x, y), F.lit(False))), lambda ok: ok)
    same = F.coalesce((F.col("a.id") == F.col("b.id")) & boxes, F.lit(False))
    return rows.groupBy(*PAGE).agg(F.bool_and(same).alias("same"))


COUNTS = ["t_done", "t_total", "v_done", "v_total", "p_done", "p_total"]


def volume_row(volumes: DataFrame, status: DataFrame, runs: DataFrame, preferences: DataFrame, finished: DataFrame, live: DataFrame, review_on: bool = True) -> DataFrame:
    """One row a volume (tag, display, skip, user) for the status screen.

    ``status``: tag, stage, units done and in all of each stage (COUNTS), pct, defects, out_exists; ``runs``: tag,
    engine, sid, mode, rc of the last one; ``finished`` and ``live``: tags with a finished signal and with a running
    process.  A volume without status is to be translated; without page review its stage is done; a finished signal
    makes a volume done unless it is in review; pages are known once they were counted."""
    rows = volumes
    for table in (status, runs, preferences, finished.select("tag", F.lit(True).alias("_done")).distinct(), live.select("tag", F.lit(True).alias("_live")).distinct()):
        rows = rows.join(table, "tag", "left")
    stage = effective_stage(F.col("stage"), F.lit(review_on))
    stage = F.when(F.col("_done").isNotNull() & (stage != "review"), "done").otherwise(stage)
    pages = F.when(F.col("p_total") > 0, F.col("p_total"))
    return rows.select(
        "tag", "display", stage.alias("stage"), F.col("_live").isNotNull().alias("running"), "skip", "user", *COUNTS, F.col("pct").alias("overall_pct"), F.coalesce("out_exists", F.lit(False)).alias("out_exists"),
        "engine", "sid", "mode", "rc", "defects", "pref_engine", pages.alias("pages"),
    )


def page_segments(wanted: DataFrame, local: DataFrame, report: DataFrame, saved: DataFrame, overrides: DataFrame, memory: DataFrame) -> DataFrame:
    """Trusted segments (tag, page, id, en, vi) of the pages wanted (tag, page).

    ``local`` (tag, page, pos, id, en, box) is a fresh extraction.  If the volume's last report (tag, page, pos, id,
    source, translation, box) has whole rows for all pages wanted, a page is trusted if each item stands where the
    report has it and says the same; its ids are the report's.  Otherwise a page is trusted if it agrees with the
    saved layout (tag, page, pos, id, box).  A page that doesn't agree gives nothing.  The translation is an
    override's, else the memory's, else the report's for the same id and text; segments without one are left out."""
    wanted = wanted.select(*PAGE).distinct()
    told = report.groupBy(*PAGE).agg(F.bool_and(F.col("id").isNotNull() & F.col("source").isNotNull()).alias("_whole"))
    usable = wanted.join(told, PAGE, "left").groupBy("tag").agg(F.bool_and(F.coalesce("_whole", F.lit(False))).alias("_usable"))

    def agreed(pages: DataFrame, other: DataFrame, ok: Column, id_: Column) -> DataFrame:
        """Items (tag, page, id, en) of the pages on which all agree; what the test needs isn't sent beyond the join."""
        mine = local.join(pages, PAGE, "left_semi").select(*PAGE, "pos", F.struct("id", "en", "box").alias("l"))
        pairs = mine.join(other.join(pages, PAGE, "left_semi"), [*PAGE, "pos"], "full_outer")
        good = F.coalesce(same_slot(F.col("l.box"), F.col("o.box")) & ok, F.lit(False))
        pairs = pairs.select(*PAGE, id_.alias("id"), F.col("l.en").alias("en"), good.alias("_good"))
        trusted = pairs.groupBy(*PAGE).agg(F.bool_and("_good").alias("_ok")).filter("_ok").select(*PAGE)
        return pairs.join(trusted, PAGE, "left_semi").select(*PAGE, "id", "en")

    # a volume goes one way only, so its items meet the report or the saved layout, not both
    of = lambda test: wanted.join(usable.filter(test), "tag", "left_semi")
    theirs = report.select(*PAGE, "pos", F.struct("id", "source", "box").alias("o"))
    kept = saved.select(*PAGE, "pos", F.struct("id", "box").alias("o"))
    rows = agreed(of("_usable"), theirs, F.col("l.en") == F.col("o.source"), F.col("o.id"))
    rows = rows.union(agreed(of("NOT _usable"), kept, F.col("l.id").isNotNull() & F.col("o.id").isNotNull(), F.col("l.id")))
    o = overrides.select("tag", "id", F.col("en").alias("_oen"), F.col("vi").alias("_ovi"))
    m = memory.select("tag", F.col("text").alias("en"), F.col("vi").alias("_mvi"))
    r = report.groupBy("tag", "id", F.col("source").alias("en")).agg(F.min("translation").alias("_rvi"))
    rows = rows.join(o, ["tag", "id"], "left").join(m, ["tag", "en"], "left").join(r, ["tag", "id", "en"], "left")
    own = F.when(F.col("_oen").isNull() | (F.col("_oen") == F.col("en")), F.nullif("_ovi", F.lit("")))
    vi = F.coalesce(own, F.nullif("_mvi", F.lit("")), "_rvi")
    return rows.select(*PAGE, "id", "en", vi.alias("vi")).filter((F.col("en") != "") & (F.col("vi") != ""))


def shave_redacts(redacts: DataFrame, kept: DataFrame) -> DataFrame:
    """Redact rectangles (tag, page, id, box) cut back where they reach a little into a kept line (tag, page, seq, box)
    that stands out beyond their edge: by at most 3, or 30 % of their height if that is less, leaving a margin of 1.
    A cut that would turn a rectangle over is left out.  Reach is measured on rectangles as they came; equal ones stay
    as many as they were."""

    def cut(k: Column) -> Column:
        ox = F.least("x1", k["x1"]) - F.greatest("x0", k["x0"])
        oy = F.least("y1", k["y1"]) - F.greatest("y0", k["y0"])
        deep = oy > F.least(F.lit(3.0), 0.3 * F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0)))
        below = (F.col("y0") < k["y0"]) & (k["y0"] < F.col("y1")) & (k["y1"] >= F.col("y1"))
        above = (F.col("y0") < k["y1"]) & (k["y1"] < F.col("y1")) & (k["y0"] <= F.col("y0"))
        return F.when((ox > 0) & (oy > 0) & ~deep & (below | above), F.struct(k["seq"].alias("seq"), below.alias("below"), F.when(below, k["y0"] - 1).otherwise(k["y1"] + 1).alias("y")))

    rows = redacts.join(layout_ops.of_page(kept, "seq", "x0", "y0", "x1", "y1"), PAGE, "left")
    rows = rows.withColumn("cuts", F.coalesce(F.array_sort(F.filter(F.transform("_near", cut), lambda c: c.isNotNull())), F.array()))
    edges = F.struct(F.col("y0").alias("top"), F.col("y1").alias("bottom"))

    def step(e: Column, c: Column) -> Column:
        bottom = F.when(c["below"] & (c["y"] > e["top"]), F.least(e["bottom"], c["y"])).otherwise(e["bottom"])
        top = F.when(~c["below"] & (c["y"] < e["bottom"]), F.greatest(e["top"], c["y"])).otherwise(e["top"])
        return F.struct(top.alias("top"), bottom.alias("bottom"))

    done = F.aggregate("cuts", edges, step)
    rows = rows.withColumn("e", done)
    return rows.select(*PAGE, "id", "x0", F.col("e.top").alias("y0"), "x1", F.col("e.bottom").alias("y1"))


def header_dups(words: DataFrame) -> DataFrame:
    """Copyright lines in a page's header whose words are printed twice: their text with each run of equal words said
    once, their box and about their size.  ``words``: (tag, page, seq, text, box)."""
    top = Window.partitionBy(*PAGE).orderBy("y0", "seq")
    rows = words.filter(F.col("y1") <= HEADER).withColumn("_new", F.coalesce(F.col("y0") - F.lag("y0").over(top) >= STEP, F.lit(True)).cast("int"))
    rows = rows.withColumn("line", F.sum("_new").over(top.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy(*PAGE, "line").orderBy("x0", "y0", "seq")
    rows = rows.withColumn("_same", F.coalesce(F.col("text") == F.lag("text").over(along), F.lit(False))).withColumn("_nth", F.row_number().over(along))
    said = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("_nth", "text")))), lambda x: x["text"]), " ")
    lines = rows.groupBy(*PAGE, "line").agg(said(F.lit(True)).alias("whole"), said(~F.col("_same")).alias("text"), F.count_if("_same").alias("dup"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max((F.col("y1") - F.col("y0")) * HEIGHT).alias("size"))
    return lines.filter(layout.is_copyright(F.col("whole")) & (F.col("dup") >= DOUBLED)).select(*PAGE, "line", "text", "x0", "y0", "x1", "y1", "size")


def column_text(lines: DataFrame) -> DataFrame:
    """Lines (tag, page, block, line, text, x0, y0) of each block put into columns, which begin where left edges jump
    by JUMP or more; texts of a column from top to bottom, joined by line feeds."""
    left = Window.partitionBy(*PAGE, "block").orderBy("x0", "y0", "line")
    jump = F.coalesce(F.col("x0") - F.lag("x0").over(left) >= JUMP, F.lit(False)).cast("int")
    rows = lines.withColumn("_j", jump).withColumn("column", F.sum("_j").over(left.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "line", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy(*PAGE, "block", "column").agg(text.alias("text"))


def same_y_lines(lines: DataFrame, band: float = 2.0) -> DataFrame:
    """Lines (tag, page, block, line, text, box) of a block, from top to bottom, that stand beside each other: a line
    whose middle lies in the band around the joined line before it becomes part of it, and the band grows with it.

    The fold runs inside each block; it can't be told from neighbours alone, as the band grows."""
    item = F.struct("y0", "x0", "line", "y1", "x1", "text")
    rows = lines.groupBy(*PAGE, "block").agg(F.array_sort(F.collect_list(item)).alias("items"))
    part = lambda x: F.struct(x["x0"].alias("x0"), x["line"].alias("line"), x["text"].alias("text"))
    fresh = lambda x: F.struct(x["y0"].alias("y0"), x["y1"].alias("y1"), F.array(part(x)).alias("parts"))

    def step(done: Column, x: Column) -> Column:
        last, middle = F.element_at(done, -1), (x["y0"] + x["y1"]) / 2
        beside = (F.size(done) > 0) & (middle >= last["y0"] - band) & (middle <= last["y1"] + band)
        grown = F.struct(F.least(last["y0"], x["y0"]).alias("y0"), F.greatest(last["y1"], x["y1"]).alias("y1"), F.concat(last["parts"], F.array(part(x))).alias("parts"))
        return F.when(beside, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(fresh(x))))

    empty = F.array().cast("array<struct<y0:double,y1:double,parts:array<struct<x0:double,line:bigint,text:string>>>>")
    joined = rows.select(*PAGE, "block", F.posexplode(F.aggregate("items", empty, step)).alias("row", "r"))
    text = F.array_join(F.transform(F.array_sort("r.parts"), lambda x: x["text"]), "")
    return joined.select(*PAGE, "block", F.col("row").cast("bigint").alias("row"), "r.y0", "r.y1", F.size("r.parts").cast("bigint").alias("lines"), text.alias("text"))
