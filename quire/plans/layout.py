"""Queries over page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import layout
from quire.plans.registry import add
from quire.sources import scratch, views

M, STRONG = r"[=+\-−×÷/^()\[\]{}0-9.,%$≤≥≠≈∑∫√·•]", "[∑∫√≤≥≠≈×÷⁄·∞±→∂∏σµ]"
COUNT = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"
PLAIN = lambda x: f"(regexp_matches({x}, '^[$()–—−\\-\\d.,%\\s]+$') AND regexp_matches({x}, '\\d'))"
BARE = lambda x: f"regexp_replace(regexp_replace({x}, '^[A-Z]{{2,4}}([\\d(.])', '\\1'), '([^A-Za-z])[A-Z]{{2,4}}([\\d(.])', '\\1\\2', 'g')"
NUM = lambda x: f"({PLAIN(x)} OR ({BARE(x)} <> {x} AND {PLAIN(BARE(x))}))"
FEATURES = {
    "is_copyright": "regexp_matches(text, '(?i)For candidate use only|©\\s*CFA|©\\s*\\d{4}|All rights reserved|\\bISBN\\b')",
    "is_heading_font": "regexp_matches(lower(font), 'bold|black|cond|italic')",
    "is_code_font": "regexp_matches(lower(font), 'courier|mono|consol')",
    "is_bold": "regexp_matches(lower(font), 'bold|black') OR flags & 16 <> 0",
    "is_italic": "regexp_matches(lower(font), 'italic|oblique') OR flags & 2 <> 0",
    "is_superscript": "flags & 1 <> 0",
    "num_cell": NUM("text"),
    "mathish_span": f"text <> '' AND (flags & 1 <> 0 OR abs(size - 10) > 2.5 OR (regexp_matches(text, '[∑∫√≤≥≠≈×÷⁄·∞±→∂∏σµ\\x{{0370}}-\\x{{03FF}}\\x{{0300}}-\\x{{036F}}]') AND {COUNT('text', '[A-Za-z]')} <= 2 AND length(text) <= 12))",
    "attachable_span": "length(text) <= 4 AND NOT regexp_matches(text, '[A-Za-z]{2,}')",
    "bullet_span": "length(text) <= 2 AND regexp_matches(text, '^[□❑▪■◾◼●◦‣•◻☐∙‚]')",
    "label_span": "regexp_matches(text, '^[A-Za-z0-9]{1,2}[.)]$')",
}
for _name, _sql in FEATURES.items():
    add(_name, lambda s, d, f=_name: layout.page_counts(views.spans(s, d), f), f"SELECT tag, page, count(*) FILTER ({_sql}) AS spans FROM (SELECT * REPLACE (trim(text, ' ') AS text) FROM v_spans) GROUP BY tag, page")

FORMULA = lambda t: (
    f"({t} <> '' AND ((length({t}) <= 50 AND ((regexp_matches({t}, '^[A-Za-z][A-Za-z0-9]{{0,4}}\\s*=') AND {COUNT(t, M)} >= greatest(2.0, {COUNT(t, '[\\p{L}]')} * 0.4)) OR ({COUNT(t, '[A-Za-z]{2,}')} <= 1 AND {COUNT(t, M)} / greatest(length({t}), 1) > 0.55)))"
    f" OR ((regexp_matches({t}, '{STRONG}') OR contains({t}, '=')) AND {COUNT(t, M)} >= 3 AND {COUNT(t, '[A-Za-z]{4,}')} <= 2) OR ({COUNT(t, '[A-Za-z]{4,}')} = 0 AND {COUNT(t, M)} >= 3 AND {COUNT(t, '[A-Za-z]{2,}')} <= 3)))"
)
BODY = "v_body AS (SELECT tag, page, median(size) AS body FROM (SELECT tag, page, size, unnest(range(length(trim(text, ' ')))) FROM v_spans) GROUP BY tag, page)"
LINES = f"""+ {BODY}, v_line AS (SELECT tag, page, block, line, string_agg(text, '' ORDER BY span) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
  coalesce(sum(length(trim(text, ' '))) FILTER (regexp_matches(lower(font), 'bold|black|cond|italic') OR size > body * 1.12), 0) / greatest(sum(length(trim(text, ' '))), 1) AS heading_share,
  arg_max({{'font': font, 'size': size}}, (length(text), -span)) AS dominant FROM v_spans JOIN v_body USING (tag, page) GROUP BY tag, page, block, line)"""
add("line_text", lambda s, d: layout.line_places(views.span_lines(s, d)).select("tag", "page", "line", "text"), f"{LINES} SELECT tag, page, line, text FROM v_line")
add("dominant_span", lambda s, d: layout.line_features(views.span_lines(s, d)).select("tag", "page", "line", "dominant.font", "dominant.size"), f"{LINES} SELECT tag, page, line, dominant.font AS font, dominant.size AS size FROM v_line")
add("heading_line", lambda s, d: layout.line_features(views.span_lines(s, d)).select("tag", "page", "line", "heading_line"), f"{LINES} SELECT tag, page, line, heading_share >= 0.8 AS heading_line FROM v_line")
add("formula_like", lambda s, d: layout.line_features(views.span_lines(s, d)).select("tag", "page", "line", "is_formula"), f"{LINES} SELECT tag, page, line, {FORMULA('text')} AS is_formula FROM v_line")
BLOCKS = f"""{LINES}, l2 AS (SELECT *, min(x0) OVER b AS l, max(x1) OVER b AS r FROM v_line WINDOW b AS (PARTITION BY tag, page, block)),
j AS (SELECT tag, page, block, bool_or(jump) AS jump, arg_max({{'font': font, 'size': size}}, (length(text), -line, -span)) AS dominant FROM (SELECT *, coalesce(x0 - lag(x1) OVER (PARTITION BY tag, page, block, line ORDER BY span) > 24, false) AND {NUM("trim(text, ' ')")} AS jump FROM v_spans) GROUP BY tag, page, block),
v_block AS (SELECT *, n >= 6 AND x1 - x0 >= 200 AND page_numbers >= 3 AS toc_block, far OR jump OR numbers >= 2 AS table_row_block FROM (
  SELECT tag, page, block, string_agg(text, chr(10) ORDER BY line) AS text, count(*) AS n, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1,
    count(*) FILTER (regexp_matches(text, '(?i)^[ivxlcdm0-9]{{1,4}}$') AND x0 > l + 0.72 * (r - l)) AS page_numbers, count(*) FILTER ({NUM('text')}) AS numbers, bool_or({NUM('text')} AND x0 > l + 60) AS far
  FROM l2 GROUP BY tag, page, block) JOIN j USING (tag, page, block))"""
blocks = lambda s, d: layout.block_features(views.span_lines(s, d))
add("block_text", lambda s, d: blocks(s, d).select("tag", "page", "block", "text", "lines"), f"{BLOCKS} SELECT tag, page, block, text, n AS lines FROM v_block")
add("toc_block", lambda s, d: blocks(s, d).select("tag", "page", "block", "toc_block"), f"{BLOCKS} SELECT tag, page, block, toc_block FROM v_block")
add("table_row_block", lambda s, d: blocks(s, d).select("tag", "page", "block", "table_row_block"), f"{BLOCKS} SELECT tag, page, block, table_row_block FROM v_block")
add("body_size", lambda s, d: layout.body_size(views.span_lines(s, d)), f"+ {BODY} SELECT tag, page, body FROM v_body")
PROSE = f"""length(text) >= 25 AND NOT {FEATURES['is_copyright']} AND NOT {FORMULA('text')} AND NOT toc_block AND NOT table_row_block
  AND NOT regexp_matches(lower(dominant.font), 'bold|black|cond|italic|courier|mono|consol') AND dominant.size >= 8.5 AND dominant.size <= body * 1.12
  AND {COUNT('text', '[\\p{L}]')} / greatest(length(text), 1) >= 0.55 AND {COUNT('text', '[A-Za-z]{2,}')} >= 5"""
add("prose_block", lambda s, d: layout.prose_blocks(views.span_lines(s, d)), f"{BLOCKS} SELECT tag, page, block, {PROSE} AS prose FROM v_block JOIN v_body USING (tag, page)")
add("reading_order", lambda s, d: layout.reading_order(views.span_lines(s, d)).select("tag", "page", "line", "place"), f"{LINES} SELECT tag, page, line, row_number() OVER (PARTITION BY tag, page ORDER BY round_even(y0, 0), round_even(x0, 0), block, line) AS place FROM v_line")
add(
    "line_height_ratio",
    lambda s, d: layout.line_height_ratio(views.span_lines(s, d)),
    f"{BLOCKS}, s AS (SELECT l.tag, l.page, l.block, b.dominant.size AS size, l.y0 - lag(l.y0) OVER (PARTITION BY l.tag, l.page, l.block ORDER BY l.y0, l.line) AS step FROM v_line l JOIN v_block b USING (tag, page, block)) SELECT tag, page, block, CASE WHEN count(*) FILTER (step > 2 AND step < 3 * size) > 0 THEN greatest(1.02, least(1.6, median(step) FILTER (step > 2 AND step < 3 * size) / max(size))) END AS ratio FROM s GROUP BY tag, page, block",
)
add(
    "justify_flag",
    lambda s, d: layout.justify_flag(views.span_lines(s, d)),
    f"{LINES}, o AS (SELECT *, max(x1) OVER b AS r, count(*) OVER b AS n, row_number() OVER (PARTITION BY tag, page, block ORDER BY line) AS i FROM v_line WINDOW b AS (PARTITION BY tag, page, block)) SELECT tag, page, block, count(*) FILTER (r - x1 <= 2.5) >= greatest(2, floor(count(*) * 0.7)) AS justified FROM o WHERE i < n GROUP BY tag, page, block HAVING count(*) >= 2",
)


def dims(s: SparkSession, d: str) -> DataFrame:
    return views.segments(s, d).select("tag", "page").distinct().withColumn("width", F.lit(612.0)).withColumn("height", F.lit(792.0))


add("area_ratio", lambda s, d: layout.area_ratio(views.spans(s, d), dims(s, d)), "SELECT tag, page, least(1.0, sum(greatest(least(x1, 612) - greatest(x0, 0), 0) * greatest(least(y1, 792) - greatest(y0, 0), 0)) / (612.0 * 792)) AS ratio FROM v_spans GROUP BY tag, page")
add("page_text_stats", lambda s, d: layout.page_text_stats(views.spans(s, d)), "SELECT tag, page, sum(length(regexp_replace(text, '\\s', '', 'g')))::BIGINT AS chars, sum(length(text) - length(replace(text, chr(65533), '')))::BIGINT AS lost, sum(length(text) - length(replace(text, chr(65533), ''))) / greatest(sum(length(regexp_replace(text, '\\s', '', 'g'))), 1) AS lost_ratio FROM v_spans GROUP BY tag, page")


def triage(s: SparkSession, d: str) -> DataFrame:
    """Text of each page with a coverage by images, a share of lost characters and a probe, chosen by digits."""
    pages = views.segments(s, d).groupBy("tag", "page").agg(F.sum(F.length("text")).alias("chars"), F.min("doc_id").alias("doc_id"))
    pick = lambda n: (F.conv(F.substring(F.md5(F.concat("tag", F.col("page").cast("string"))), n, 1), 16, 10).cast("bigint"))
    return pages.select("tag", "page", F.when(pick(1) < 6, F.col("chars") % 25).otherwise(F.col("chars")).alias("text_chars"), (pick(2) / 64).alias("text_coverage"), (pick(3) / 16).alias("image_coverage"), F.when(pick(4) == 0, 0.2).otherwise(0.0).alias("lost_ratio"), F.when(pick(5) < 8, 0.001).alias("probe_delta"))


HEX = lambda n: f"(strpos('0123456789abcdef', substr(md5(tag || page), {n}, 1)) - 1)"
CLASSES = f"""+ v_triage AS (SELECT tag, page, CASE WHEN {HEX(1)} < 6 THEN chars % 25 ELSE chars END AS text_chars, {HEX(2)} / 64 AS text_coverage, {HEX(3)} / 16 AS image_coverage, CASE WHEN {HEX(4)} = 0 THEN 0.2 ELSE 0 END AS lost_ratio,
  CASE WHEN {HEX(5)} < 8 THEN 0.001 END AS probe_delta FROM (SELECT tag, page, sum(length(text))::BIGINT AS chars FROM v_segments GROUP BY tag, page)),
v_named AS (SELECT *, CASE WHEN lost_ratio >= 0.15 AND text_chars >= 20 THEN 'unsupported_text_encoding' WHEN text_chars < 20 AND image_coverage >= 0.5 THEN 'scanned'
  WHEN text_chars >= 20 AND image_coverage >= 0.55 AND coalesce(probe_delta < 0.002, false) THEN 'scanned_with_text_layer' WHEN text_chars >= 20 AND image_coverage >= 0.55 AND text_coverage < 0.08 THEN 'mixed'
  WHEN text_chars >= 20 THEN 'native_text' WHEN image_coverage > 0.05 THEN 'image_or_figure' ELSE 'empty_or_vector' END AS classification FROM v_triage),
v_class AS (SELECT tag, page, classification, round(CASE classification WHEN 'unsupported_text_encoding' THEN 0.9 WHEN 'scanned' THEN least(0.99, 0.7 + image_coverage * 0.25) WHEN 'scanned_with_text_layer' THEN 0.9 WHEN 'mixed' THEN 0.75
  WHEN 'native_text' THEN CASE WHEN text_chars >= 80 THEN 0.95 ELSE 0.8 END WHEN 'image_or_figure' THEN 0.65 ELSE 0.6 END::DOUBLE, 3) AS confidence,
  classification IN ('scanned', 'scanned_with_text_layer') AS requires_ocr, classification IN ('unsupported_text_encoding', 'mixed', 'image_or_figure', 'empty_or_vector') AS manual_review FROM v_named)"""
add("page_class", lambda s, d: layout.page_class(triage(s, d)), f"{CLASSES} SELECT * FROM v_class")
add("document_mode", lambda s, d: layout.document_mode(layout.page_class(triage(s, d))), f"{CLASSES} SELECT tag, count(*) AS pages, count(*) FILTER (requires_ocr) AS ocr, CASE WHEN count(*) FILTER (requires_ocr) / count(*) >= 0.8 THEN 'scanned' WHEN count(*) FILTER (requires_ocr) > 0 THEN 'mixed' ELSE 'native' END AS mode FROM v_class GROUP BY tag")
add(
    "ocr_gate",
    lambda s, d: layout.ocr_gate(layout.page_class(triage(s, d)), 3),
    f"{CLASSES}, r AS (SELECT tag, page, row_number() OVER (PARTITION BY tag ORDER BY page) AS n FROM v_class WHERE requires_ocr) SELECT tag, string_agg((page + 1)::VARCHAR, ',' ORDER BY page) FILTER (n <= 3) || CASE WHEN count(*) > 3 THEN '…' ELSE '' END AS pages FROM r GROUP BY tag",
)


def lone(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Spans that stand for lone bullets, single characters, and the lines' boxes: both from lines whose spans are
    derived once."""
    held = F.transform(F.filter("items", lambda w: F.length(F.trim(w["text"])) == 1), lambda w: F.struct("line", w["span"].alias("span"), w["x0"].alias("x0"), (w["y0"] + 3).alias("y0"), (w["y1"] + 3).alias("y1")))
    rows = scratch.keep(views.span_lines(s, d).select("tag", "page", "line", *[c.alias(n) for n, c in layout.box(F.col("items")).items()], held.alias("lone")), "lone_lines")
    bullets = rows.select("tag", "page", F.explode("lone").alias("b")).select("tag", "page", F.concat_ws("-", "b.line", "b.span").alias("id"), "b.x0", "b.y0", "b.y1")
    return bullets, rows.drop("lone")


add(
    "orphan_bullets",
    lambda s, d: layout.orphan_bullets(*lone(s, d)).fillna({"line": -1}),
    f"""{LINES}, b AS (SELECT tag, page, line || '-' || span AS bullet, x0, (y0 + y1) / 2 + 3 AS y FROM v_spans WHERE length(trim(text, ' ')) = 1),
c AS (SELECT b.tag, b.page, b.bullet, l.line, row_number() OVER (PARTITION BY b.tag, b.page, b.bullet ORDER BY abs(b.y - (l.y0 + l.y1) / 2), l.line) AS r FROM b JOIN v_line l ON b.tag = l.tag AND b.page = l.page AND abs(b.y - (l.y0 + l.y1) / 2) <= 8 AND l.x0 >= b.x0 - 2)
SELECT b.tag, b.page, b.bullet, coalesce(c.line, -1) AS line FROM b LEFT JOIN c ON b.tag = c.tag AND b.page = c.page AND b.bullet = c.bullet AND c.r = 1""",
)
def held_blocks(s: SparkSession, d: str) -> DataFrame:
    """Boxes of blocks below which each other block is an obstacle: both from blocks derived once."""
    rows = scratch.keep(blocks(s, d).select("tag", "page", F.col("block").alias("id"), *layout.BOX), "limit_blocks")
    return layout.bottom_limit(rows, rows, dims(s, d))


add(
    "bottom_limit",
    held_blocks,
    f"""{BLOCKS}, o AS (SELECT a.tag, a.page, a.block AS id, min(b.y0) - 2 AS o FROM v_block a JOIN v_block b ON a.tag = b.tag AND a.page = b.page AND b.y0 > a.y1 + 1 AND b.x0 < a.x1 AND b.x1 > a.x0 GROUP BY ALL),
f AS (SELECT a.tag, a.page, a.block AS id, a.x0, a.x1, a.y0, greatest(a.y1, least(coalesce(o.o, 742), 742))::DOUBLE AS first FROM v_block a LEFT JOIN o ON a.tag = o.tag AND a.page = o.page AND a.block = o.id),
i AS (SELECT f.tag, f.page, f.id, list(b.y0 ORDER BY b.block) AS tops FROM f JOIN v_block b ON f.tag = b.tag AND f.page = b.page AND b.y0 > f.y0 + 2 AND b.y0 < f.first AND b.x0 < f.x1 - 2 AND b.x1 > f.x0 + 2 GROUP BY ALL)
SELECT f.tag, f.page, f.id, coalesce(list_reduce(i.tops, lambda low, y: CASE WHEN y < low THEN y - 2 ELSE low END, f.first), f.first) AS "limit" FROM f LEFT JOIN i ON f.tag = i.tag AND f.page = i.page AND f.id = i.id""",
)
