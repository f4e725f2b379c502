"""Queries over extractions, reports and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import evidence, layout
from quire.plans.layout import LINES
from quire.plans.registry import add
from quire.sources import scratch, views

tags = lambda s, d: views.segments(s, d).select("tag").distinct().withColumn("h", views.digit("tag"))
lines = lambda s, d: layout.line_places(views.span_lines(s, d, "text", *layout.BOX)).select("tag", "page", "block", "line", "text", "x0", "y0", "x1", "y1")
two = lambda: F.substring(F.md5("text"), 1, 2)


def old_volumes(s: SparkSession, d: str) -> DataFrame:
    """Layouts of the own source, of another one, or none, older or newer than the source."""
    h = F.col("h")
    return tags(s, d).select("tag", F.col("tag").alias("source"), F.lit(5).alias("source_time"), F.when(h >= "5", F.col("tag")).when(h >= "3", "other").alias("layout_source"), F.when(h >= "3", F.when(h < "9", 4).otherwise(6)).alias("layout_time"))


add(
    "legacy_stale",
    lambda s, d: evidence.legacy_stale(old_volumes(s, d), views.work_units(s, d).select("tag", "idx").distinct().select("tag", F.when(views.digit("tag", "idx") < "8", 3).otherwise(7).alias("time"))),
    """+ t AS (SELECT DISTINCT tag, substr(md5(tag), 1, 1) AS h FROM v_segments), c AS (SELECT tag, max(CASE WHEN substr(md5(tag || idx), 1, 1) < '8' THEN 3 ELSE 7 END) AS m FROM v_units GROUP BY tag)
SELECT tag, h BETWEEN '3' AND '4' OR coalesce(5 > greatest(CASE WHEN h >= '3' THEN CASE WHEN h < '9' THEN 4 ELSE 6 END END, m), false) AS stale FROM t LEFT JOIN c USING (tag)""",
)


def extractions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Items of all lines, and the same again: some moved by less or more than the tolerance, some lost, some with a
    further box."""
    own = lambda by: F.array(F.col("x0") + by, F.col("y0"), F.col("x1") + by, F.col("y1"))
    rows = lines(s, d).withColumn("pos", F.col("line")).withColumn("id", F.concat(F.lit("s"), F.col("line").cast("string"))).withColumn("h", two())
    old = rows.select("tag", "page", "pos", "id", F.array(own(F.lit(0.0))).alias("boxes"))
    by = F.when(F.col("h") == "00", 0.06).when(F.col("h") < "40", 0.04).otherwise(0.0)
    new = rows.filter("h <> '41'").select("tag", "page", "pos", "id", F.when(F.col("h") == "42", F.array(own(F.lit(0.0)), own(F.lit(0.0)))).otherwise(F.array(own(by))).alias("boxes"))
    return old, new


add("layout_match", lambda s, d: evidence.layout_match(*extractions(s, d)), f"{LINES} SELECT tag, page, bool_and(substr(md5(text), 1, 2) NOT IN ('00', '41', '42')) AS same FROM v_line GROUP BY tag, page")


def screen(s: SparkSession, d: str) -> DataFrame:
    """Volumes in each stage, without page review: some running, some exited, some with a finished signal or no status."""
    t, h, n = tags(s, d), F.col("h"), F.length("tag").cast("bigint")
    stage = F.when(h < "4", "translate").when(h < "8", "vision").when(h < "c", "review").otherwise("done")
    counts = {"t_done": n - 2, "t_total": n, "v_done": n - 3, "v_total": n - 1, "p_done": F.lit(1).cast("bigint"), "p_total": F.when(h > "5", n).otherwise(0)}
    status = t.filter(h != "3").select("tag", stage.alias("stage"), *[v.alias(c) for c, v in counts.items()], n.alias("pct"), (n % 3).alias("defects"), (h > "a").alias("out_exists"))
    runs = t.filter(h.isin("1", "5", "9", "d")).select("tag", F.lit("e1").alias("engine"), F.concat(F.lit("s"), h).alias("sid"), F.when(h == "5", "exited").otherwise("running").alias("mode"), F.when(h == "5", 0).cast("bigint").alias("rc"))
    volumes = t.select("tag", F.upper("tag").alias("display"), (h == "2").alias("skip"), (h == "7").alias("user"))
    return evidence.volume_row(volumes, status, runs, t.filter(h < "2").select("tag", F.lit("e2").alias("pref_engine")), t.filter(h.isin("3", "6", "9")).select("tag"), t.filter(h.isin("1", "d")).select("tag"), review_on=False)


add(
    "volume_row",
    screen,
    """+ t AS (SELECT DISTINCT tag, substr(md5(tag), 1, 1) AS h FROM v_segments),
s AS (SELECT tag, CASE WHEN h < '4' THEN 'translate' WHEN h < '8' THEN 'vision' WHEN h < 'c' THEN 'review' ELSE 'done' END AS stage, length(tag) AS n, CASE WHEN h > '5' THEN length(tag) ELSE 0 END AS total FROM t WHERE h <> '3'),
e AS (SELECT t.*, s.n, s.total, CASE coalesce(stage, 'translate') WHEN 'vision' THEN 'done' ELSE coalesce(stage, 'translate') END AS stage FROM t LEFT JOIN s USING (tag))
SELECT tag, upper(tag) AS display, CASE WHEN h IN ('3', '6', '9') AND stage <> 'review' THEN 'done' ELSE stage END AS stage, h IN ('1', 'd') AS running, h = '2' AS skip, h = '7' AS "user",
  n - 2 AS t_done, n AS t_total, n - 3 AS v_done, n - 1 AS v_total, CASE WHEN n IS NOT NULL THEN 1::BIGINT END AS p_done, total AS p_total, n AS overall_pct, n IS NOT NULL AND h > 'a' AS out_exists,
  CASE WHEN h IN ('1', '5', '9', 'd') THEN 'e1' END AS engine, CASE WHEN h IN ('1', '5', '9', 'd') THEN 's' || h END AS sid, CASE WHEN h = '5' THEN 'exited' WHEN h IN ('1', '9', 'd') THEN 'running' END AS mode, CASE WHEN h = '5' THEN 0::BIGINT END AS rc,
  n % 3 AS defects, CASE WHEN h < '2' THEN 'e2' END AS pref_engine, CASE WHEN total > 0 THEN total END AS pages FROM e""",
)


def trusted(s: SparkSession, d: str) -> DataFrame:
    """Lines as a fresh extraction; reports of some volumes that lack a page, say something else or stand elsewhere,
    and saved layouts of which some items moved."""
    rows = scratch.keep(lines(s, d), "segment_lines").withColumn("id", F.concat_ws("-", F.lit("s"), "page", "line")).withColumn("pos", F.col("line")).withColumn("h", two()).withColumn("g", views.digit("tag"))
    moved = lambda by: F.struct("x0", (F.col("y0") + by).alias("y0"), "x1", (F.col("y1") + by).alias("y1"))
    local = rows.select("tag", "page", "pos", "id", F.col("text").alias("en"), F.struct("x0", "y0", "x1", "y1").alias("box"))
    report = rows.filter("g >= '4' AND NOT (g < '6' AND page = 2)").select(
        "tag", "page", "pos", F.concat(F.lit("r"), "id").alias("id"), F.when(F.col("h") == "00", F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("source"),
        F.when(F.col("h") < "80", F.concat(F.lit("r "), "text")).alias("translation"), moved(F.when(F.col("h") == "01", 25.0).otherwise(2.0)).alias("box"),
    )
    saved = rows.filter("h <> '02'").select("tag", "page", "pos", "id", moved(F.when(F.col("h") == "03", 25.0).otherwise(3.0)).alias("box"))
    overrides = rows.filter(views.digit("tag", "id") < "2").select("tag", F.concat(F.when(F.col("g") >= "4", F.lit("r")).otherwise(F.lit("")), "id").alias("id"), F.when(views.digit("tag", "id") == "0", F.col("text")).otherwise(F.concat("text", F.lit("x"))).alias("en"), F.lit("đè").alias("vi"))
    memory = rows.filter("h < '30'").select("tag", "text", F.concat(F.lit("m "), "text").alias("vi")).distinct()
    return evidence.page_segments(local.filter("page < 5"), local, report, saved, overrides, memory)


add(
    "page_segments",
    trusted,
    f"""{LINES}, a AS (SELECT tag, page, line, text, 's-' || page || '-' || line AS id, substr(md5(text), 1, 2) AS h, substr(md5(tag), 1, 1) AS g FROM v_line WHERE page < 5),
u AS (SELECT tag, bool_and(g >= '6' OR g >= '4' AND page <> 2) AS usable FROM a GROUP BY tag),
o AS (SELECT tag, page, CASE WHEN any_value(usable) THEN bool_and(h NOT IN ('00', '01')) ELSE bool_and(h NOT IN ('02', '03')) END AS ok FROM a JOIN u USING (tag) GROUP BY tag, page),
s AS (SELECT tag, page, CASE WHEN usable THEN 'r' || id ELSE id END AS id, text AS en, CASE WHEN substr(md5(tag || id), 1, 1) = '0' AND (usable OR g < '4') THEN 'đè' WHEN h < '30' THEN 'm ' || text WHEN usable AND h < '80' THEN 'r ' || text END AS vi
  FROM a JOIN u USING (tag) JOIN o USING (tag, page) WHERE ok) SELECT * FROM s WHERE en <> '' AND vi IS NOT NULL""",
)


def redacts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Blocks let down by 6 or raised by 6 reach 2 into the lines beside them, by 9 further than may be cut; some
    lines are kept: blocks, and the lines in them, are derived once."""
    kept = F.when(views.digit("text") < "8", F.struct(F.col("line").alias("seq"), *layout.BOX))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    edges = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    rows = scratch.keep(lines(s, d).groupBy(*layout.BLOCK).agg(*edges, views.digit(text).alias("h"), F.collect_list(kept).alias("kept")), "redact_blocks")
    down = F.when(F.col("h") < "6", 6.0).when(F.col("h") < "8", 9.0).otherwise(0.0)
    up = F.when(F.col("h") > "b", 6.0).otherwise(0.0)
    return rows.select("tag", "page", F.col("block").alias("id"), "x0", (F.col("y0") - up).alias("y0"), "x1", (F.col("y1") + down).alias("y1")), rows.select("tag", "page", F.inline("kept"))


BLOCK = f"""{LINES}, b AS (SELECT tag, page, block AS id, min(x0) AS x0, min(y0) - CASE WHEN h > 'b' THEN 6 ELSE 0 END AS y0, max(x1) AS x1, max(y1) + CASE WHEN h < '6' THEN 6 WHEN h < '8' THEN 9 ELSE 0 END AS y1
  FROM (SELECT *, substr(md5(string_agg(text, chr(10) ORDER BY line) OVER (PARTITION BY tag, page, block ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 1, 1) AS h FROM v_line) GROUP BY tag, page, block, h)"""
add(
    "shave_redacts",
    lambda s, d: evidence.shave_redacts(*redacts(s, d)),
    f"""{BLOCK}, k AS (SELECT * FROM v_line WHERE substr(md5(text), 1, 1) < '8'),
p AS (SELECT b.*, CASE WHEN k.y0 > b.y0 AND k.y0 < b.y1 AND k.y1 >= b.y1 THEN k.y0 - 1 END AS lo, CASE WHEN k.y1 > b.y0 AND k.y1 < b.y1 AND k.y0 <= b.y0 AND NOT (k.y0 > b.y0 AND k.y0 < b.y1 AND k.y1 >= b.y1) THEN k.y1 + 1 END AS hi
  FROM b LEFT JOIN k ON k.tag = b.tag AND k.page = b.page AND least(k.x1, b.x1) > greatest(k.x0, b.x0) AND least(k.y1, b.y1) > greatest(k.y0, b.y0) AND least(k.y1, b.y1) - greatest(k.y0, b.y0) <= least(3.0, 0.3 * greatest(b.y1 - b.y0, 1)))
SELECT tag, page, id, x0, greatest(y0, coalesce(max(hi) FILTER (hi < y1), y0)) AS y0, x1, least(y1, coalesce(min(lo) FILTER (lo > y0), y1)) AS y1 FROM p GROUP BY tag, page, id, x0, y0, x1, y1""",
)


def header(s: SparkSession, d: str) -> DataFrame:
    """The words of lines at the top of a page after a copyright mark, in most volumes printed twice."""
    words = views.spans(s, d).filter("line % 50 = 0").select("tag", "page", "line", "span", F.trim("text").alias("text"), "x0", "y0", "x1", "y1")
    first = words.filter("span = 0").select("tag", "page", "line", F.lit(-1).cast("bigint").alias("span"), F.lit("©2020").alias("text"), F.lit(30.0).alias("x0"), "y0", F.lit(60.0).alias("x1"), "y1")
    twice = words.union(first).withColumn("copy", F.explode(F.when(views.digit("tag") < "c", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return twice.withColumn("seq", F.col("line") * 100_000 + F.col("span") * 2 + F.col("copy"))


add(
    "header_dups",
    lambda s, d: evidence.header_dups(header(s, d)).select("tag", "page", "text", "x0", "y0", "x1", "y1", "size"),
    """+ w AS (SELECT tag, page, line, span, trim(text, ' ') AS text, x0, y0, x1, y1 FROM v_spans WHERE line % 50 = 0), f AS (SELECT * FROM w UNION ALL SELECT tag, page, line, -1, '©2020', 30.0, y0, 60.0, y1 FROM w WHERE span = 0),
t AS (SELECT f.*, line * 100000 + span * 2 + c AS seq FROM f, (VALUES (0), (1)) v(c) WHERE c = 0 OR substr(md5(tag), 1, 1) < 'c'),
n AS (SELECT *, coalesce(text = lag(text) OVER (PARTITION BY tag, page ORDER BY x0, y0, seq), false) AS same, row_number() OVER (PARTITION BY tag, page ORDER BY x0, y0, seq) AS nth FROM t)
SELECT tag, page, string_agg(text, ' ' ORDER BY nth) FILTER (NOT same) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max((y1 - y0) * 0.82) AS size FROM n GROUP BY tag, page
HAVING count(*) FILTER (same) >= 3 AND regexp_matches(string_agg(text, ' ' ORDER BY nth), '(?i)For candidate use only|©\\s*CFA|©\\s*\\d{4}|All rights reserved|\\bISBN\\b')""",
)
shifted = lambda s, d: lines(s, d).withColumn("x0", F.col("x0") + 40 * (F.col("line") % 3) + F.col("line") % 2)
add("column_text", lambda s, d: evidence.column_text(shifted(s, d)), f"{LINES} SELECT tag, page, block, dense_rank() OVER (PARTITION BY tag, page, block ORDER BY c) - 1 AS \"column\", text FROM (SELECT tag, page, block, line % 3 AS c, string_agg(text, chr(10) ORDER BY y0, line) AS text FROM v_line GROUP BY tag, page, block, line % 3)")


def beside(s: SparkSession, d: str) -> DataFrame:
    """Lines of which every other stands to the right of the one before."""
    odd = F.col("line") % 2 == 1
    up = F.when(odd, 14.0).otherwise(0.0)
    return lines(s, d).select("tag", "page", "block", "line", "text", (F.col("x0") + F.when(odd, 900.0).otherwise(0.0)).alias("x0"), (F.col("y0") - up + 3 * odd.cast("int")).alias("y0"), "x1", (F.col("y1") - up + 3 * odd.cast("int")).alias("y1"))


add(
    "same_y_lines",
    lambda s, d: evidence.same_y_lines(beside(s, d).filter("line % 50 <> 0")),
    f"""{LINES}, p AS (SELECT tag, page, block, line // 2 AS pair, min(y0) AS y0, count(*) AS lines, string_agg(text, '' ORDER BY line) AS text, bool_and(line % 2 = 1) AS lone FROM v_line WHERE line % 50 <> 0 GROUP BY tag, page, block, line // 2)
SELECT tag, page, block, row_number() OVER (PARTITION BY tag, page, block ORDER BY CASE WHEN lone THEN y0 - 14 + 3 ELSE y0 END) - 1 AS row, CASE WHEN lone THEN y0 - 11 ELSE y0 END AS y0, CASE WHEN lone THEN y0 - 1 WHEN lines = 2 THEN y0 + 13 ELSE y0 + 10 END AS y1, lines, text FROM p""",
)
