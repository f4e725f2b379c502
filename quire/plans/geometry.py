"""Queries over boxes of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import defects
from quire.operators import agents, geometry, layout, memory
from quire.operators import review as review_ops
from quire.plans.layout import BLOCKS, LINES
from quire.plans.registry import add
from quire.plans.work import RESOLVED, overrides
from quire.sources import scratch, views


def marked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Spans of some words as marks, of which every other is moved half a line down or out of the page, and the lines'
    boxes: both from lines whose spans are derived once."""
    h = lambda w: views.digit(w["text"])
    chosen = F.transform(F.filter("items", lambda w: h(w).isin("3", "4", "5")), lambda w: F.struct("line", w["span"].alias("span"), h(w).alias("h"), *[w[c].alias(c) for c in layout.BOX]))
    rows = scratch.keep(views.span_lines(s, d).select("tag", "page", F.col("line").alias("segment"), *[c.alias(n) for n, c in layout.box(F.col("items")).items()], chosen.alias("marks")), "marked_lines")
    by = F.when(F.col("m.h") == "4", 6.0).when(F.col("m.h") == "5", 900.0).otherwise(0.0)
    marks = rows.select("tag", "page", F.explode("marks").alias("m"))
    return marks.select("tag", "page", F.concat_ws("-", "m.line", "m.span").alias("id"), "m.x0", (F.col("m.y0") + by).alias("y0"), "m.x1", (F.col("m.y1") + by).alias("y1")), rows.drop("marks")


add(
    "highlight_match",
    lambda s, d: geometry.highlight_match(*marked(s, d)),
    f"""{LINES}, a AS (SELECT tag, page, line || '-' || span AS id, x0, x1, y0 + m AS y0, y1 + m AS y1 FROM (SELECT *, CASE substr(md5(text), 1, 1) WHEN '4' THEN 6 WHEN '5' THEN 900 ELSE 0 END AS m FROM v_spans WHERE substr(md5(text), 1, 1) IN ('3', '4', '5'))),
c AS (SELECT a.tag, a.page, a.id, l.line, greatest(least(a.x1, l.x1) - greatest(a.x0, l.x0), 0) * greatest(least(a.y1, l.y1) - greatest(a.y0, l.y0), 0) / ((a.x1 - a.x0) * (a.y1 - a.y0)) AS share FROM a JOIN v_line l ON a.tag = l.tag AND a.page = l.page),
b AS (SELECT tag, page, id, max(share) AS share, arg_min(line, (-share, line)) AS segment FROM c GROUP BY tag, page, id)
SELECT tag, page, id, CASE WHEN share >= 0.6 THEN 'moves' WHEN share > 0 THEN 'removed' ELSE 'kept' END AS fate, CASE WHEN share >= 0.6 THEN segment ELSE -1 END AS segment FROM b""",
)


def hashed(s: SparkSession, d: str) -> DataFrame:
    """Boxes of blocks (id, box) with the digit of their text."""
    return layout.block_features(views.span_lines(s, d)).select("tag", "page", F.col("block").alias("id"), *layout.BOX, views.digit("text").alias("h"))


def paths(rows: DataFrame) -> DataFrame:
    """Boxes of blocks as vector paths: some flattened to rules, some stroked."""
    return rows.select("tag", "page", "id", (F.col("h") > "7").alias("stroked"), "x0", "y0", F.when(F.col("h").isin("3", "c", "d"), "c").when(F.col("h").isin("2", "4"), "l").otherwise("re").alias("shape"), F.when(F.col("h").isin("1", "9"), F.col("x0") + 2).when(F.col("h").isin("3", "a", "c"), F.col("x0") + 8).otherwise(F.col("x1")).alias("x1"), F.when(F.col("h").isin("0", "2", "8"), F.col("y0") + 1).otherwise(F.col("y1")).alias("y1"))


RULES = f"""{BLOCKS}, v_path AS (SELECT tag, page, block AS id, h > '7' AS stroked, x0, y0, CASE WHEN h IN ('3', 'c', 'd') THEN 'c' WHEN h IN ('2', '4') THEN 'l' ELSE 're' END AS shape, CASE WHEN h IN ('1', '9') THEN x0 + 2 WHEN h IN ('3', 'a', 'c') THEN x0 + 8 ELSE x1 END AS x1, CASE WHEN h IN ('0', '2', '8') THEN y0 + 1 ELSE y1 END AS y1 FROM (SELECT *, substr(md5(text), 1, 1) AS h FROM v_block)),
v_form AS (SELECT *, x1 - x0 AS w, y1 - y0 AS hh, shape = 'l' OR shape = 're' AND (y1 - y0 <= 2.5 OR x1 - x0 <= 2.5) AS plain FROM v_path),
v_rules AS (SELECT tag, page, id, CASE WHEN hh <= 2.5 THEN 'h' ELSE 'v' END AS kind, x0, y0, x1, y1 FROM v_form WHERE plain AND (hh <= 2.5 AND w >= 30 OR hh > 2.5 AND w <= 2.5 AND hh >= 30)
  UNION ALL SELECT tag, page, id, 'h', x0, unnest([y0, y1]) AS y, x1, y FROM v_form WHERE shape = 're' AND NOT plain AND stroked AND w >= 30
  UNION ALL SELECT tag, page, id, 'v', unnest([x0, x1]) AS x, y0, x, y1 FROM v_form WHERE shape = 're' AND NOT plain AND stroked AND hh >= 30
  UNION ALL SELECT tag, page, id, 'v', x0, y0, x0 + 1, y1 FROM v_form WHERE stroked AND w <= 12 AND hh >= 30)"""
add("drawing_rules", lambda s, d: geometry.drawing_rules(paths(hashed(s, d))), f"{RULES} SELECT * FROM v_rules")


def clamped(s: SparkSession, d: str) -> DataFrame:
    """Boxes of blocks held by the rules of their page, both from blocks derived once."""
    rows = scratch.keep(hashed(s, d), "clamp_blocks")
    return geometry.clamp_rules(rows, geometry.drawing_rules(paths(rows))).fillna({"bottom": -1.0, "right": -1.0})


add(
    "clamp_rules",
    clamped,
    f"""{RULES} SELECT a.tag, a.page, a.block AS id, coalesce(min(r.y0) FILTER (kind = 'h' AND greatest(least(a.x1, r.x1) - greatest(a.x0, r.x0), 0) >= 0.6 * (a.x1 - a.x0) AND r.y0 >= a.y1), -1) AS bottom,
  coalesce(min(r.x0 - 3) FILTER (kind = 'v' AND least(a.y1, r.y1) - greatest(a.y0, r.y0) > 0 AND r.x0 >= a.x1), -1) AS "right" FROM v_block a LEFT JOIN v_rules r ON a.tag = r.tag AND a.page = r.page GROUP BY a.tag, a.page, a.block""",
)


def noted(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Points in spans of two characters, and the boxes of lines and of their blocks: all from lines whose spans are
    derived once."""
    middle = lambda w: F.struct("line", w["span"].alias("span"), ((w["x0"] + w["x1"]) / 2).alias("x"), (w["y0"] + 5).alias("y"))
    held = F.transform(F.filter("items", lambda w: F.length(w["text"]) == 2), middle)
    lines = scratch.keep(views.span_lines(s, d).select(*layout.LINE, *[c.alias(n) for n, c in layout.box(F.col("items")).items()], held.alias("points")), "noted_lines")
    points = lines.select("tag", (F.col("page") + 1).alias("page"), F.explode("points").alias("p")).select("tag", "page", F.concat_ws("-", "page", "p.line", "p.span").alias("id"), "p.x", "p.y")
    blocks = lines.groupBy(*layout.BLOCK).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return points, lines.select("tag", "page", F.col("line").alias("id"), *layout.BOX).union(blocks.select("tag", "page", F.col("block") + 10_000, *layout.BOX))


add(
    "annotation_segment",
    lambda s, d: agents.annotation_segment(*noted(s, d)),
    f"""{BLOCKS}, b AS (SELECT tag, page, line AS segment, x0, y0, x1, y1 FROM v_line UNION ALL SELECT tag, page, block + 10000, x0, y0, x1, y1 FROM v_block)
SELECT s.tag, (s.page + 1) || '-' || s.line || '-' || s.span AS id, arg_min(b.segment, ((b.x1 - b.x0) * (b.y1 - b.y0), b.segment)) AS segment FROM v_spans s JOIN b ON s.tag = b.tag AND s.page = b.page AND (s.x0 + s.x1) / 2 BETWEEN b.x0 AND b.x1 AND s.y0 + 5 BETWEEN b.y0 AND b.y1 WHERE length(s.text) = 2 GROUP BY s.tag, s.page, s.line, s.span""",
)
renamed = lambda df: df.withColumn("tag", F.concat(F.lit("u"), F.substring_index("tag", "/", -1)))


def payload(s: SparkSession, d: str) -> DataFrame:
    segs = views.segments(s, d)
    now = memory.resolve_translation(segs, views.memory(s, d), overrides(s, d)).join(segs.select("tag", "id", "seq", "doc_id", "text"), ["tag", "id"])
    return geometry.fix_payload(renamed(now).withColumn("seq", F.col("doc_id") * 100_000 + F.col("seq")), review_ops.enrich(views.issues(s, d)))


add(
    "fix_payload",
    payload,
    f"""{RESOLVED}, i AS (SELECT tag, page, string_agg(detail, '; ' ORDER BY seq) AS issues FROM v_issues WHERE coalesce(kind, 'defect') <> 'fit' AND {defects.sql('detail', 1)} IN ('text', 'mixed', 'unknown') GROUP BY tag, page),
g AS (SELECT 'u' || split_part(r.tag, '/', 2) AS tag, r.page, r.id, r.text, r.vi, s.doc_id * 100000 + s.seq AS o FROM v_resolved r JOIN v_segments s ON r.tag = s.tag AND r.id = s.id)
SELECT i.tag, i.page, i.issues, count(*) AS segments, string_agg(to_json({{'id': g.id, 'en': g.text, 'vi': g.vi}})::VARCHAR, chr(10) ORDER BY g.o) AS current FROM i JOIN g ON i.tag = g.tag AND i.page = g.page GROUP BY i.tag, i.page, i.issues""",
)
