"""Queries over work units and translation memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import markers
from quire.operators import memory, units
from quire.plans.registry import add
from quire.sources import scratch, views


def marked(s: SparkSession, d: str) -> DataFrame:
    """Pairs with markers: kept, bent, lost or doubled in the translation."""
    one, two = views.digit("text"), F.substring(F.md5("text"), 2, 1)
    first = F.element_at(F.split("text", " "), 1)
    rest = F.expr("substring(text, length(first) + 1)")
    rows = views.segments(s, d).withColumn("first", first)
    en = F.when(one < "8", F.concat("first", F.lit(" {v1}"), rest)).otherwise(F.concat(F.lit("<b>"), "first", F.lit("</b>"), rest))
    rows = rows.withColumn("en", en)
    bent = F.replace(F.replace("en", F.lit("{v1}"), F.lit("( v1 )")), F.lit("<b>"), F.lit("&lt;b&gt;"))
    lost = F.replace(F.replace("en", F.lit("{v1}"), F.lit("")), F.lit("</b>"), F.lit(""))
    vi = F.when(two < "4", F.col("en")).when(two < "8", bent).when(two < "c", lost).otherwise(F.replace("en", F.lit("{v1}"), F.lit("{v1} {v1}")))
    return rows.select("tag", "id", "seq", "page", "en", vi.alias("vi"))


MARKED = """+ v_marked AS (
  SELECT tag, id, seq, page, en, CASE WHEN two < '4' THEN en WHEN two < '8' THEN replace(replace(en, '{v1}', '( v1 )'), '<b>', '&lt;b&gt;')
    WHEN two < 'c' THEN replace(replace(en, '{v1}', ''), '</b>', '') ELSE replace(en, '{v1}', '{v1} {v1}') END AS vi
  FROM (SELECT *, substr(md5(text), 2, 1) AS two, CASE WHEN substr(md5(text), 1, 1) < '8' THEN split_part(text, ' ', 1) || ' {v1}' || substr(text, length(split_part(text, ' ', 1)) + 1)
    ELSE '<b>' || split_part(text, ' ', 1) || '</b>' || substr(text, length(split_part(text, ' ', 1)) + 1) END AS en FROM v_segments)
)"""
SQUEEZE = lambda x: f"trim(regexp_replace({x}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), ' ')"
STRIP = lambda x: SQUEEZE(f"regexp_replace(regexp_replace({x}, '</?(?:b|i|sup)>', '', 'g'), '\\{{v(\\d+)\\}}', ' ', 'g')")
HOLD = lambda x: f"list_sort(regexp_extract_all({x}, '\\{{v(\\d+)\\}}', 1))"
UNTRANSLATED = lambda x: f"(length({STRIP(x)}) = 0 OR length(regexp_replace({STRIP(x)}, '[\\x{{0000}}-\\x{{0100}}]', '', 'g')) < greatest(3.0, length({STRIP(x)}) * 0.02))"
CHECK = f"""c0 AS (SELECT *, regexp_replace(vi, '&lt;(/?(?:b|i|sup))&gt;', '<\\1>', 'g') AS v0, {HOLD('en')} AS held FROM v_marked),
c1 AS (SELECT *, CASE WHEN len(held) > 0 THEN regexp_replace(v0, '[{{(\\[（【]\\s*[vV]\\s*(\\d+)\\s*[}})\\]）】]', '{{v\\1}}', 'g')
  ELSE regexp_replace(v0, '\\{{v(\\d+)\\}}', '', 'g') END AS v1 FROM c0),
c2 AS (SELECT *, CASE WHEN len(string_split(v1, '<b>')) <> len(string_split(v1, '</b>')) OR contains(v1, '<b>') AND NOT contains(en, '<b>')
  THEN regexp_replace(v1, '</?b>', '', 'g') ELSE v1 END AS v2 FROM c1),
v_checked AS (SELECT *, CASE WHEN len(held) > 0 AND {HOLD('v1')} <> held THEN NULL ELSE nullif({SQUEEZE('v2')}, '') END AS checked FROM c2)"""

add("strip_markers", lambda s, d: marked(s, d).select("tag", "id", markers.strip("vi").alias("bare")), f"{MARKED} SELECT tag, id, {STRIP('vi')} AS bare FROM v_marked")
add("check_markers", lambda s, d: marked(s, d).select("tag", "id", markers.check("en", "vi").alias("checked")), f"{MARKED}, {CHECK} SELECT tag, id, checked FROM v_checked")
add(
    "marker_gate",
    lambda s, d: marked(s, d).groupBy("tag", "page").agg(F.bool_and(markers.placeholders("en") == markers.placeholders("vi")).alias("passes")),
    f"{MARKED} SELECT tag, page, bool_and({HOLD('en')} = {HOLD('vi')}) AS passes FROM v_marked GROUP BY tag, page",
)
add("untranslated", lambda s, d: views.memory(s, d).groupBy("tag").agg(F.count_if(markers.untranslated("vi")).alias("untranslated"), F.count("*").alias("texts")), f"SELECT tag, count(*) FILTER ({UNTRANSLATED('vi')}) AS untranslated, count(*) AS texts FROM v_memory GROUP BY tag")
add("emit_segments", lambda s, d: views.segments(s, d).select("tag", "id", "seq", "page", "text"), "SELECT tag, id, seq, page, text FROM v_segments")
add("todo_segments", lambda s, d: units.todo_segments(views.segments(s, d), views.memory(s, d)).select("tag", "id", "seq", "page"), "SELECT tag, id, seq, page FROM v_todo")
add("reading_context", lambda s, d: units.reading_context(views.segments(s, d)).select("tag", "seq", "previous_tail", "next_head"), "SELECT tag, seq, previous_tail, next_head FROM v_context")
add("make_chunks", lambda s, d: views.work_units(s, d).select("tag", "idx", "pos", "id", "source_order"), "SELECT tag, idx, pos, id, source_order FROM v_units")
add(
    "chunk_gen",
    lambda s, d: units.chunk_gen(views.work_units(s, d)),
    "+ c AS (SELECT tag, idx, idx || chr(3) || string_agg(id || chr(1) || text, chr(2) ORDER BY pos) AS content FROM v_units GROUP BY tag, idx) SELECT tag, md5(string_agg(content, '' ORDER BY idx)) AS chunk_gen FROM c GROUP BY tag",
)
GIVEN = """+ v_given AS (
  SELECT tag, idx, e.key AS id, e.value ->> '$' AS vi FROM (SELECT tag, idx, unnest(json_entries) AS e FROM (
    SELECT tag, idx, list_transform(json_keys(raw), lambda k: {'key': k, 'value': json_extract(raw, '$."' || k || '"')}) AS json_entries
    FROM v_outputs WHERE raw LIKE '{%' AND json_valid(raw)))
)"""
add("src_explode_outputs", lambda s, d: units.explode_outputs(views.outputs(s, d)), f"{GIVEN} SELECT tag, idx, id, vi FROM v_given")
add("src_tolerant_json", lambda s, d: units.read_checkpoints(views.outputs(s, d)), "SELECT tag, idx, CASE WHEN NOT json_valid(raw) THEN 'bad' WHEN raw LIKE '{%' THEN 'object' WHEN raw LIKE '[%' THEN 'list' ELSE 'bad' END AS shape FROM v_outputs")
VALID = f"{GIVEN}, v_valid AS (SELECT u.tag, u.idx, bool_and(trim(coalesce(g.vi, ''), ' ') <> '') AS valid, count(*) AS ids FROM v_units u LEFT JOIN v_given g USING (tag, idx, id) GROUP BY u.tag, u.idx)"
add("unit_valid", lambda s, d: units.unit_valid(views.work_units(s, d), views.outputs(s, d)), f"{VALID} SELECT tag, idx, valid, ids FROM v_valid")
add("pending_units", lambda s, d: units.pending_units(views.work_units(s, d), views.outputs(s, d)), f"{VALID} SELECT tag, idx FROM v_valid WHERE NOT valid")
add(
    "stage_gate",
    lambda s, d: units.stage_gate(views.work_units(s, d), views.outputs(s, d), "translate"),
    f"{GIVEN} SELECT u.tag, u.idx, bool_and(trim(coalesce(g.vi, ''), ' ') <> '' AND coalesce({HOLD('u.text')} = {HOLD('g.vi')}, false)) AS passes FROM v_units u LEFT JOIN v_given g USING (tag, idx, id) GROUP BY u.tag, u.idx",
)
add("stage_gate_vision", lambda s, d: units.stage_gate(views.work_units(s, d), views.outputs(s, d), "vision"), "SELECT tag, idx, json_valid(raw) AND raw LIKE '[%' AS passes FROM v_outputs")
def merged(s, d):  # noqa: ANN001, ANN201
    work = scratch.keep(views.work_units(s, d), "units")
    return memory.merge_translations(work, views.outputs(s, d, work), views.memory(s, d))


add(
    "merge_translations",
    merged,
    f"{GIVEN}, g AS (SELECT u.tag, u.text, {SQUEEZE('g.vi')} AS vi FROM v_units u JOIN v_given g USING (tag, idx, id) WHERE trim(g.vi, ' ') <> '') SELECT coalesce(g.tag, m.tag) AS tag, coalesce(g.text, m.text) AS text, coalesce(g.vi, m.vi) AS vi FROM v_memory m FULL JOIN g ON m.tag = g.tag AND m.text = g.text",
)
add(
    "marker_drops",
    lambda s, d: memory.marker_drops(views.work_units(s, d), views.outputs(s, d)),
    f"{GIVEN} SELECT u.tag, u.idx AS chunk, u.id, left(u.text, 160) AS en, left(g.vi, 160) AS vi FROM v_units u JOIN v_given g USING (tag, idx, id) WHERE trim(g.vi, ' ') = ''",
)
add("still_missing", lambda s, d: memory.still_missing(views.segments(s, d), views.memory(s, d)), "SELECT s.tag, count(*) AS missing FROM v_segments s LEFT JOIN v_memory m ON s.tag = m.tag AND s.text = m.text WHERE m.tag IS NULL GROUP BY s.tag")
TARGETS = f"""+ t0 AS (SELECT s.tag, s.seq, s.text AS en, coalesce(m.vi, '') AS vi FROM v_segments s LEFT JOIN v_memory m ON s.tag = m.tag AND s.text = m.text),
t1 AS (SELECT *, row_number() OVER (PARTITION BY tag, en ORDER BY seq) AS r FROM t0 WHERE regexp_matches(en, '[0-9]') OR {UNTRANSLATED('vi')}),
t2 AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY seq) - 1 AS k FROM t1 WHERE r = 1),
v_targets AS (SELECT tag, CASE WHEN k // 25 < 1000 THEN lpad((k // 25)::VARCHAR, 3, '0') ELSE (k // 25)::VARCHAR END AS idx, k % 25 AS pos, 'v' || k AS id, en, vi FROM t2)"""
add("verify_targets", lambda s, d: memory.verify_targets(views.segments(s, d), views.memory(s, d)), f"{TARGETS} SELECT * FROM v_targets")


def corrections(s: SparkSession, d: str) -> DataFrame:
    t = memory.verify_targets(views.segments(s, d), views.memory(s, d))
    return t.filter(views.digit("en") < "6").select("tag", "idx", "id", F.concat(F.lit("đúng "), F.when(views.digit("en") == "5", F.lit("{v9} ")).otherwise(""), "en").alias("vi"))


add(
    "merge_verify",
    lambda s, d: memory.merge_verify(memory.verify_targets(views.segments(s, d), views.memory(s, d)), corrections(s, d), views.memory(s, d)),
    f"{TARGETS}, g AS (SELECT tag, en AS text, {SQUEEZE(chr(39) + 'đúng ' + chr(39) + ' || en')} AS vi FROM v_targets WHERE substr(md5(en), 1, 1) < '6') SELECT coalesce(g.tag, m.tag) AS tag, coalesce(g.text, m.text) AS text, coalesce(g.vi, m.vi) AS vi FROM v_memory m FULL JOIN g ON m.tag = g.tag AND m.text = g.text",
)


def overrides(s: SparkSession, d: str) -> DataFrame:
    """Overrides of some segments: with their text, with an outdated text, and old ones that note none."""
    h = views.digit("tag", "id")
    en = F.when(h == "0", F.col("text")).when(h == "1", F.concat("text", F.lit("x")))
    return views.segments(s, d).filter(h < "3").select("tag", "id", en.alias("en"), F.concat(F.lit("đè "), "id").alias("vi"))


RESOLVED = """+ v_overrides AS (SELECT tag, id, CASE substr(md5(tag || id), 1, 1) WHEN '0' THEN text WHEN '1' THEN text || 'x' END AS en, 'đè ' || id AS vi FROM v_segments WHERE substr(md5(tag || id), 1, 1) < '3'),
v_resolved AS (SELECT s.tag, s.id, s.seq, s.page, s.text, coalesce(CASE WHEN o.en IS NULL OR o.en = s.text THEN o.vi END, m.vi, '') AS vi FROM v_segments s
  LEFT JOIN v_overrides o ON s.tag = o.tag AND s.id = o.id LEFT JOIN v_memory m ON m.tag = s.tag AND m.text = s.text)"""
resolved = lambda s, d: memory.resolve_translation(views.segments(s, d), views.memory(s, d), overrides(s, d))
add("resolve_translation", resolved, f"{RESOLVED} SELECT tag, id, page, vi FROM v_resolved")


def fixes(s: SparkSession, d: str) -> DataFrame:
    h = views.digit("id", "tag")
    vi = F.when(h == "0", F.col("vi")).when(h == "1", F.concat(F.lit("  "), "vi", F.lit(" "))).otherwise(F.concat(F.lit("sửa  "), "id"))
    return resolved(s, d).filter(h < "4").select("tag", "id", vi.alias("vi"))


add(
    "merge_fixes",
    lambda s, d: memory.merge_fixes(resolved(s, d).join(views.segments(s, d).select("tag", "id", "text"), ["tag", "id"]), fixes(s, d)),
    f"{RESOLVED}, f AS (SELECT *, CASE substr(md5(id || tag), 1, 1) WHEN '0' THEN vi WHEN '1' THEN '  ' || vi || ' ' ELSE 'sửa  ' || id END AS new FROM v_resolved WHERE substr(md5(id || tag), 1, 1) < '4') SELECT tag, id, text AS en, {SQUEEZE('new')} AS vi FROM f WHERE trim(new, ' ') <> vi AND {SQUEEZE('new')} <> vi AND {SQUEEZE('new')} <> ''",
)


def glossary(s: SparkSession, d: str) -> DataFrame:
    words = views.table(s, d, "benchmark").select(F.explode(F.split("text", " ")).alias("en")).filter(F.col("en").rlike("^[a-z]{6,}$")).distinct()
    return words.select("en", F.concat(F.lit("đ"), "en").alias("vi"))


add(
    "glossary_relevant",
    lambda s, d: memory.glossary_relevant(views.work_units(s, d), glossary(s, d)),
    """+ g AS (SELECT en, row_number() OVER (ORDER BY length(en) DESC, en) AS o FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS en FROM benchmark) WHERE regexp_matches(en, '^[a-z]{6,}$') QUALIFY o <= 500),
r AS (SELECT u.tag, u.idx, u.id, g.en, g.o, row_number() OVER (PARTITION BY u.tag, u.id ORDER BY g.o) AS n FROM v_units u JOIN g ON contains(lower(u.text), lower(g.en)))
SELECT tag, idx, id, string_agg(en || ' = đ' || en, '; ' ORDER BY o) AS terms FROM r WHERE n <= 20 GROUP BY tag, idx, id""",
)
