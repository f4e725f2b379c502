"""Volumes, segments, units and their outputs, derived from the given tables.

A volume is 64 consecutive documents of one source, so that no volume grows with the corpus; each document is a page
and each of its lines a segment.  ``SQL`` holds the same views for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.layout import once
from quire.operators import units


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digit(*columns: Column | str) -> Column:
    """A hexadecimal digit that serves as a shared pseudo-random selector."""
    return F.substring(F.md5(F.concat(*columns) if len(columns) > 1 else columns[0]), 1, 1)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    tag = F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 64).cast("string"))
    return docs.select(tag.alias("tag"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "text")).withColumn("n", F.col("n").cast("bigint"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines(spark, sf_dir).withColumn("text", F.trim("text")).filter(F.length("text") >= 3)
    seq = F.row_number().over(Window.partitionBy("tag").orderBy("doc_id", "n")).cast("bigint") - 1
    page = F.dense_rank().over(Window.partitionBy("tag").orderBy("doc_id")).cast("bigint") - 1
    found = found.withColumn("seq", seq).withColumn("page", page)
    return found.select("tag", "doc_id", F.concat(F.lit("s"), F.col("seq").cast("string")).alias("id"), "seq", "page", "n", "text")


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translation memory: some texts translated, some left as they are, most absent."""
    d = digit("text")
    texts = segments(spark, sf_dir).select("tag", "text").distinct().filter(d.isin("0", "1", "2", "3"))
    mark = F.repeat(F.lit("đ"), 3 + F.floor(F.length("text") / 25).cast("int"))
    return texts.select("tag", "text", F.when(d == "3", F.col("text")).otherwise(F.concat(mark, F.lit(" "), "text")).alias("vi"))


def work_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = segments(spark, sf_dir)
    todo = units.todo_segments(all_, memory(spark, sf_dir))
    return units.make_chunks(todo.join(units.reading_context(all_).select("tag", "seq", "previous_tail", "next_head"), ["tag", "seq"]))


def outputs(spark: SparkSession, sf_dir: str, work: DataFrame | None = None) -> DataFrame:
    """Unit outputs as JSON: whole, lacking an id, with a blank value, empty, cut off, a list, or absent.  ``work``: the
    volumes' units, where they have been derived before."""
    d = digit("tag", "idx")
    chunks = (work or work_units(spark, sf_dir)).groupBy("tag", "idx").agg(F.array_sort(F.collect_list(F.struct("k", "id", "text"))).alias("items"))
    chunks = chunks.withColumn("d", d).filter("d <> 'f'")
    value = lambda x, i: F.when((F.col("d") == "b") & (i == 0), F.lit(" ")).otherwise(F.concat(F.lit("đ"), F.md5(x["text"])))
    entry = F.transform("items", lambda x, i: F.concat(F.lit('"'), x["id"], F.lit('":"'), value(x, i), F.lit('"')))
    entry = F.when(F.col("d") == "a", F.slice(entry, 1, F.size("items") - 1)).otherwise(entry)
    whole = F.concat(F.lit("{"), F.array_join(entry, ","), F.lit("}"))
    raw = F.when(F.col("d") == "c", F.lit("{}")).when(F.col("d") == "e", F.lit("[]"))
    raw = raw.when(F.col("d") == "d", F.expr("left({0}, length({0}) - 3)".format("whole"))).otherwise(F.col("whole"))
    return chunks.withColumn("whole", whole).select("tag", "idx", raw.alias("raw"))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review issues from events: a volume for each 16 users, a page for each of 50 event ids."""
    ev = table(spark, sf_dir, "events")
    detail = {"click": "Tràn hộp văn bản ở cuối trang", "view": "Công thức bị dịch sai", "signup": "Đè lên hình minh họa", "purchase": "Bảng bị lệch, tràn hộp"}
    pick = F.lit("Lỗi lạ")
    for kind, text in detail.items():
        pick = F.when(F.col("event_type") == kind, F.lit(text)).otherwise(pick)
    return ev.select(
        F.concat(F.lit("u"), F.floor(F.col("user_id") / 16).cast("string")).alias("tag"), (F.col("event_id") % 50).alias("page"),
        F.when(F.col("event_id") % 10 == 0, "fit").when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise("defect").alias("kind"),
        F.when(F.col("value") >= 60, "high").when(F.col("value") >= 20, "medium").when(F.col("event_id") % 3 == 0, "odd").otherwise("low").alias("severity"),
        pick.alias("detail"), F.col("event_id").alias("seq"),
    )


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(spark, sf_dir).filter(F.col("page") % 9 == 0).select("tag", "page").distinct()


SQL = """
v_lines AS (
  SELECT source || '/' || (doc_id // 64) AS tag, doc_id, i - 1 AS n, parts[i] AS text
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))
),
v_segments AS (
  SELECT tag, doc_id, 's' || seq AS id, seq, page, n, text FROM (
    SELECT tag, doc_id, n, trim(text, ' ') AS text, row_number() OVER (PARTITION BY tag ORDER BY doc_id, n) - 1 AS seq,
      dense_rank() OVER (PARTITION BY tag ORDER BY doc_id) - 1 AS page
    FROM v_lines WHERE length(trim(text, ' ')) >= 3)
),
v_memory AS (
  SELECT tag, text, CASE WHEN d = '3' THEN text ELSE repeat('đ', 3 + length(text) // 25) || ' ' || text END AS vi
  FROM (SELECT DISTINCT tag, text, substr(md5(text), 1, 1) AS d FROM v_segments) WHERE d IN ('0', '1', '2', '3')
),
v_todo AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tag, text ORDER BY seq) AS r FROM v_segments s
    WHERE NOT EXISTS (SELECT 1 FROM v_memory m WHERE m.tag = s.tag AND m.text = s.text)) WHERE r = 1
),
v_context AS (
  SELECT tag, seq, coalesce(right(lag(text) OVER w, 240), '') AS previous_tail, coalesce(left(lead(text) OVER w, 240), '') AS next_head
  FROM v_segments WINDOW w AS (PARTITION BY tag ORDER BY seq)
),
v_units AS (
  SELECT tag, k, CASE WHEN k // 40 < 1000 THEN lpad((k // 40)::VARCHAR, 3, '0') ELSE (k // 40)::VARCHAR END AS idx, k % 40 AS pos,
    't' || k AS id, text, page, seq AS source_order, previous_tail, next_head
  FROM (SELECT t.*, c.previous_tail, c.next_head, row_number() OVER (PARTITION BY t.tag ORDER BY t.seq) - 1 AS k FROM v_todo t JOIN v_context c USING (tag, seq))
),
v_chunks AS (
  SELECT tag, idx, substr(md5(tag || idx), 1, 1) AS d, list({'k': k, 'id': id, 'text': text} ORDER BY k) AS items FROM v_units GROUP BY tag, idx
),
v_whole AS (
  SELECT c.tag, c.idx, c.d, '{' || coalesce(string_agg('"' || u.id || '":"' || CASE WHEN c.d = 'b' AND u.pos = 0 THEN ' ' ELSE 'đ' || md5(u.text) END || '"', ',' ORDER BY u.k)
    FILTER (NOT (c.d = 'a' AND u.pos = len(c.items) - 1)), '') || '}' AS whole
  FROM v_chunks c JOIN v_units u USING (tag, idx) WHERE c.d <> 'f' GROUP BY c.tag, c.idx, c.d, c.items
),
v_outputs AS (
  SELECT tag, idx, CASE d WHEN 'c' THEN '{}' WHEN 'e' THEN '[]' WHEN 'd' THEN left(whole, length(whole) - 3) ELSE whole END AS raw FROM v_whole
),
v_issues AS (
  SELECT 'u' || (user_id // 16) AS tag, event_id % 50 AS page,
    CASE WHEN event_id % 10 = 0 THEN 'fit' WHEN event_id % 7 = 0 THEN NULL ELSE 'defect' END AS kind,
    CASE WHEN value >= 60 THEN 'high' WHEN value >= 20 THEN 'medium' WHEN event_id % 3 = 0 THEN 'odd' ELSE 'low' END AS severity,
    CASE event_type WHEN 'click' THEN 'Tràn hộp văn bản ở cuối trang' WHEN 'view' THEN 'Công thức bị dịch sai' WHEN 'signup' THEN 'Đè lên hình minh họa'
      WHEN 'purchase' THEN 'Bảng bị lệch, tràn hộp' ELSE 'Lỗi lạ' END AS detail, event_id AS seq
  FROM events
),
v_accepted AS (SELECT DISTINCT tag, page FROM v_issues WHERE page % 9 = 0)
"""


def _words(spark: SparkSession, sf_dir: str, digits: bool = True) -> DataFrame:
    """Segments as lines of words (word, its place ``at`` among the line's characters, with ``digits`` its digit): one
    row a line, as a row for each word would have to be sorted and sent to find its line again."""
    rows = segments(spark, sf_dir).select("tag", "page", F.floor(F.col("n") / 4).alias("block"), F.col("n").alias("line"), "text", F.split("text", " ").alias("words"))
    blanks = F.filter(F.transform(F.split("text", ""), lambda c, i: F.when(c == " ", i + 1)), lambda i: i.isNotNull())
    word = lambda w, i, begins: F.struct(w.alias("word"), i.alias("i"), F.get(begins, i).alias("at"), (i < F.size(begins) - 1).alias("more"), *[digit(w).alias("h")] * digits)
    words = once(F.concat(F.array(F.lit(0)), blanks), lambda b: F.filter(F.transform("words", lambda w, i: word(w, i, b)), lambda w: w["word"] != ""))
    return rows.select("tag", "page", "block", "line", words.alias("words"))


def _laid(rows: DataFrame, *more: str, fields: tuple[str, ...] = ()) -> DataFrame:
    """Words as spans in a fixed pitch, in order (items), of all fields or only those named; ``more`` of the word's
    fields are kept with them."""
    top = 60.0 + 14.0 * (F.col("line") % 50)

    def span(w: Column) -> Column:
        size = F.when(F.right(w["word"], F.lit(1)).between("0", "9"), 7.0).when(F.col("line") == 0, 13.0).otherwise(10.0)
        said = F.when(w["more"], F.rpad(w["word"], F.length(w["word"]) + 1, F.lit(" "))).otherwise(w["word"])
        font = F.when(w["h"] == "0", "Body-Bold").when(w["h"] == "1", "Mono").otherwise("Body")
        made = {
            "span": w["i"].cast("bigint"), "text": said, "x0": 72.0 + 5.0 * w["at"], "y0": F.col("top"), "x1": 72.0 + 5.0 * (w["at"] + F.length(w["word"])), "y1": F.col("top") + 10.0,
            "size": size, "font": font, "flags": F.when(w["h"] == "2", 1).when(w["h"] == "3", 16).otherwise(0).cast("bigint"), **{c: w[c] for c in more},
        }
        return F.struct(*[c.alias(n) for n, c in made.items() if not fields or n in fields or n in more])

    # a list of one is opened so that filters on what is made from the items don't make the items again
    return rows.withColumn("top", top).select("tag", "page", "block", "line", F.explode_outer(F.array(F.transform("words", span))).alias("items"))


def span_lines(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """One row a line with its spans in order: one for each word of a segment with the blank after it, laid out in a
    fixed pitch; four lines make a block.  Where ``fields`` of the spans are named, only these are made: a span is a
    value in a list, of which nothing that isn't asked for is left out by itself."""
    return _laid(_words(spark, sf_dir, not fields or "font" in fields or "flags" in fields), fields=fields)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of ``span_lines``, a row each."""
    return span_lines(spark, sf_dir).select("tag", "page", "block", "line", F.inline("items"))


SQL = SQL.rstrip() + """,
v_words AS (SELECT tag, seq, page, n, i - 1 AS span, parts[i] AS text, CASE WHEN i < len(parts) THEN ' ' ELSE '' END AS blank FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, string_split(text, ' ') AS parts FROM v_segments))),
v_placed AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY tag, seq ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift FROM v_words),
v_spans AS (
  SELECT tag, page, n // 4 AS block, n AS line, span, text || blank AS text, 72.0::DOUBLE + 5 * shift AS x0, 60.0::DOUBLE + 14 * (n % 50) AS y0, 72.0::DOUBLE + 5 * (shift + length(text)) AS x1,
    70.0::DOUBLE + 14 * (n % 50) AS y1, CASE WHEN regexp_matches(text, '[0-9]$') THEN 7.0 WHEN n = 0 THEN 13.0 ELSE 10.0 END::DOUBLE AS size,
    CASE substr(md5(text), 1, 1) WHEN '0' THEN 'Body-Bold' WHEN '1' THEN 'Mono' ELSE 'Body' END AS font,
    CASE substr(md5(text), 1, 1) WHEN '2' THEN 1 WHEN '3' THEN 16 ELSE 0 END::BIGINT AS flags
  FROM v_placed WHERE text <> ''
)
"""

#: Pages as they are printed, from ``v_spans``: pages of bullets and labels, pages of tables, whose cells are lines of
#: their own, and pages of text with label rows, split first lines, formulas and maths between words.  Both engines
#: read these expressions.
_HEX = "substr(md5(concat({})), 1, 1)"
_NAMED = {
    "ph": _HEX.format("tag, '/', cast(page AS string)"), "lh": _HEX.format("tag, '/', cast(page AS string), '/', cast(line AS string)"),
    "bh": _HEX.format("tag, '/', cast(page AS string), '#', cast(block AS string)"), "sh": _HEX.format("trim(text)"),
}
_KINDS = {"kind": "CASE WHEN ph < '6' THEN 'b' WHEN ph IN ('8', '9') THEN 't' ELSE 'p' END", "step": "ph >= '6' AND ph NOT IN ('8', '9') AND bh < '2'", "split": "ph >= '6' AND ph NOT IN ('8', '9') AND bh IN ('2', '3', '4')"}
_KEPT = "CASE WHEN kind = 't' THEN span < CASE WHEN lh < '2' THEN 2 ELSE 3 END WHEN step AND line % 2 = 0 THEN span = 0 WHEN split THEN line % 4 = 0 AND span < 2 WHEN lh = 'e' THEN span = 0 ELSE true END"
_SHIFT = "CASE WHEN step AND line % 2 = 1 THEN 120.0 ELSE 0.0 END"
_TOP = "CASE WHEN step AND line % 2 = 1 THEN y0 - 12.0 WHEN split THEN 61.0 + 14.0 * ((line + 4) % 50) ELSE y0 END"
_MARKED = {
    "tag": "tag", "page": "page", "block": "block", "line": "CASE WHEN kind = 't' THEN line * 16 + span ELSE line END", "span": "CASE WHEN kind = 't' THEN 0 ELSE span END",
    "text": "CASE WHEN kind = 't' THEN text WHEN step AND line % 2 = 0 THEN concat('Step ', cast(line AS string)) WHEN split THEN text WHEN lh = 'e' THEN 'PV = 3 + 4' WHEN kind = 'b' AND span = 0 AND lh < '6' THEN '■ ' WHEN span = 0 AND lh = '6' THEN 'A. ' WHEN sh = '2' THEN '12' WHEN sh = '4' THEN 'σ² ' WHEN sh = '5' THEN 'x ' ELSE text END",
    "x0": f"CASE WHEN kind = 't' THEN 72.0 + 150.0 * span ELSE x0 + {_SHIFT} END", "y0": _TOP,
    "x1": f"CASE WHEN kind = 't' THEN 112.0 + 150.0 * span WHEN step AND line % 2 = 0 THEN 97.0 ELSE x1 + {_SHIFT} END", "y1": f"{_TOP} + 10.0", "size": "size",
    "font": "CASE WHEN kind <> 't' AND (lh = 'd' OR (span = 0 AND lh = '6') OR (step AND line % 2 = 0) OR split) THEN 'Body-Bold' WHEN lh = '6' THEN 'Body' ELSE font END", "flags": "flags",
}
PLACE = ("tag", "page", "block", "line")
_CASTS = dict.fromkeys(("line", "span"), "bigint") | dict.fromkeys(("x0", "y0", "x1", "y1"), "double")


def _of_span(e: str) -> str:
    """The expression with a span's fields read from ``s``."""
    return re.sub(r"\b(span|text|x0|y0|x1|y1|size|font|flags)\b", r"s.\1", re.sub(r"\bsh\b", "s.h", e))


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line of the printed pages, with its spans in order."""
    rows = _laid(_words(spark, sf_dir), "h")
    for columns in ({n: e for n, e in _NAMED.items() if n != "sh"}, _KINDS):
        rows = rows.withColumns({name: F.expr(e) for name, e in columns.items()})
    rows = rows.withColumn("items", F.expr(f"filter(items, s -> {_of_span(_KEPT)})"))
    rows = rows.withColumn("items", F.explode_outer(F.expr("CASE WHEN kind = 't' THEN transform(items, s -> array(s)) ELSE array(items) END"))).filter(F.size("items") > 0)
    fields = ", ".join(f"'{n}', " + (f"cast({_of_span(e)} AS {_CASTS[n]})" if n in _CASTS else _of_span(e)) for n, e in _MARKED.items() if n not in PLACE)
    place = F.expr(f"cast({_MARKED['line'].replace('span', 'items[0].span')} AS bigint)")
    return rows.select("tag", "page", "block", place.alias("line"), F.expr(f"transform(items, s -> named_struct({fields}))").alias("items"))


def marked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of ``marked_lines``, a row each."""
    return marked_lines(spark, sf_dir).select(*PLACE, F.inline("items"))


#: For queries that read ``v_marked``, behind the other views.
MARKED_SQL = f"""
v_named AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _KINDS.items())} FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _NAMED.items())} FROM v_spans)),
v_marked AS (SELECT {', '.join((f'cast({e} AS {_CASTS[n]})' if n in _CASTS else e) + f' AS {n}' for n, e in _MARKED.items())} FROM v_named WHERE {_KEPT})
"""
