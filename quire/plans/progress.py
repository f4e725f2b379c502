"""Queries over progress, run logs, render telemetry and ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import memory, progress, render, units
from quire.plans.registry import add
from quire.plans.work import TARGETS, VALID
from quire.sources import ingest, views


def status(s: SparkSession, d: str) -> DataFrame:
    """A volume's units as their outputs say; checks and pages by digits, most of them done."""
    done = units.unit_valid(views.work_units(s, d), views.outputs(s, d)).select("tag", (F.col("valid") | (views.digit("tag") < "8")).alias("done"))
    checks = memory.verify_targets(views.segments(s, d), views.memory(s, d)).select("tag", "idx").distinct().select("tag", (views.digit("idx", "tag") < "e").alias("done"))
    pages = views.segments(s, d).select("tag", "page").distinct().withColumn("h", views.digit("tag", F.col("page").cast("string")))
    return progress.stage_status(done, checks, pages.select("tag", (F.col("h") < "f").alias("done")), pages.filter("h = '7'"))


STATUS = VALID + "," + TARGETS.removeprefix("+") + """,
v_pages AS (SELECT tag, substr(md5(tag || page), 1, 1) AS h FROM (SELECT DISTINCT tag, page FROM v_segments)),
q0 AS (SELECT tag, count(*) FILTER (valid OR substr(md5(tag), 1, 1) < '8') AS t_done, count(*) AS t_total FROM v_valid GROUP BY tag),
q1 AS (SELECT tag, count(*) FILTER (substr(md5(idx || tag), 1, 1) < 'e') AS v_done, count(*) AS v_total FROM (SELECT DISTINCT tag, idx FROM v_targets) GROUP BY tag),
q2 AS (SELECT tag, count(*) FILTER (h < 'f') AS p_done, count(*) AS p_total, count(*) FILTER (h = '7') AS defects FROM v_pages GROUP BY tag),
q3 AS (SELECT tag, coalesce(t_done, 0) AS t_done, coalesce(t_total, 0) AS t_total, coalesce(v_done, 0) AS v_done, coalesce(v_total, 0) AS v_total, p_done, p_total, defects, coalesce(t_total, 0) > 0 AND t_done = t_total AS told FROM q2 LEFT JOIN q0 USING (tag) LEFT JOIN q1 USING (tag)),
v_status AS (SELECT tag, t_done, t_total, CASE WHEN told THEN v_done ELSE 0 END AS v_done, v_total, CASE WHEN told THEN p_done ELSE 0 END AS p_done, p_total, defects,
  CASE WHEN NOT told THEN 'translate' WHEN v_done < v_total THEN 'verify' WHEN p_done < p_total THEN 'vision' WHEN defects > 0 THEN 'review' ELSE 'done' END AS stage FROM q3)"""
add("stage_status", status, f"{STATUS} SELECT * FROM v_status")
add("overall_pct", lambda s, d: progress.overall_pct(status(s, d)), f"{STATUS} SELECT tag, stage, CASE stage WHEN 'done' THEN 100 WHEN 'review' THEN 95 WHEN 'vision' THEN round_even(70 + 25 * p_done / p_total, 0) WHEN 'verify' THEN round_even(40 + 30 * v_done / v_total, 0) ELSE CASE WHEN t_total = 0 THEN 0 ELSE round_even(40 * t_done / t_total, 0) END END::BIGINT AS pct FROM v_status")
volumes = lambda s, d: views.segments(s, d).select("tag").distinct().withColumn("skip", views.digit("tag") == "c")
VOLUMES = "v_volumes AS (SELECT tag, substr(md5(tag), 1, 1) = 'c' AS skip FROM (SELECT DISTINCT tag FROM v_segments))"
add("volumes_todo", lambda s, d: progress.volumes_todo(volumes(s, d), status(s, d)), f"{STATUS}, {VOLUMES} SELECT tag, stage FROM v_status JOIN v_volumes USING (tag) WHERE NOT skip AND stage <> 'done'")
add("library_rollup", lambda s, d: progress.library_rollup(volumes(s, d), status(s, d)), f"{STATUS}, {VOLUMES} SELECT count(*) FILTER (stage = 'done' OR skip) AS done, count(*) FILTER (NOT skip) AS real, count(*) AS total, coalesce(sum(p_total) FILTER (stage = 'done' AND NOT skip), 0)::BIGINT AS pages FROM v_status JOIN v_volumes USING (tag)")
add("effective_stage", lambda s, d: status(s, d).select("tag", progress.effective_stage(F.col("stage"), views.digit("tag") > "4").alias("stage")), f"{STATUS} SELECT tag, CASE WHEN stage = 'vision' AND substr(md5(tag), 1, 1) <= '4' THEN 'done' ELSE stage END AS stage FROM v_status")
add("batch_status", lambda s, d: status(s, d).groupBy("stage").agg(F.count("*").alias("volumes"), F.sum("p_total").alias("pages")), f"{STATUS} SELECT stage, count(*) AS volumes, sum(p_total)::BIGINT AS pages FROM v_status GROUP BY stage")
add(
    "page_count",
    lambda s, d: progress.page_count(volumes(s, d).filter(views.digit("tag") < "4").select("tag", F.lit(99).cast("bigint").alias("source_pages")), volumes(s, d).filter(views.digit("tag") < "8").select("tag", F.lit(77).cast("bigint").alias("cached_pages")), views.segments(s, d)),
    "SELECT tag, CASE WHEN substr(md5(tag), 1, 1) < '4' THEN 99 WHEN substr(md5(tag), 1, 1) < '8' THEN 77 ELSE max(page) + 1 END AS pages FROM v_segments GROUP BY tag",
)


def run_log(s: SparkSession, d: str) -> DataFrame:
    """A log for each user: sign-ups begin a run, clicks and views tell of units, the rest of exits."""
    e, unit = F.col("event_type"), F.concat(F.lit("unit c_"), (F.col("event_id") % 7).cast("string"))
    line = F.when(e == "signup", F.concat(F.lit("===== RUN engine=a sid=r"), F.col("event_id").cast("string"), F.lit(" ====="))).when(e == "click", F.concat(unit, F.lit(" attempt 1 ok"))).when(e == "view", F.concat(unit, F.lit(" attempt 2 missing")))
    return views.table(s, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("tag"), F.col("event_id").alias("line_no"), line.when(e == "error", "exit rc=1").otherwise("exit rc=0").alias("line"))


LOG = """
WITH v_log AS (SELECT 'u' || user_id AS tag, event_id AS line_no, event_type AS e, event_id % 7 AS u FROM events),
n AS (SELECT *, count(*) FILTER (e = 'signup') OVER (PARTITION BY tag ORDER BY line_no) AS run FROM v_log),
v_runs AS (SELECT tag, run, max(CASE WHEN e = 'signup' THEN 'r' || line_no END) AS sid, count(*) AS lines, arg_max((e = 'error')::BIGINT, line_no) FILTER (e NOT IN ('signup', 'click', 'view')) AS rc, min(line_no) AS first FROM n GROUP BY tag, run),
v_outcome AS (SELECT tag, arg_max(sid, run) AS sid, CASE arg_max(coalesce(rc, -1), run) WHEN -1 THEN 'running' WHEN 0 THEN 'completed' ELSE 'failed' END AS state FROM v_runs WHERE sid IS NOT NULL GROUP BY tag)
"""
runs = lambda s, d: progress.log_runs(run_log(s, d))
add("src_run_log_tail", lambda s, d: progress.log_tail(run_log(s, d), 20).select("tag", "line_no"), f"{LOG} SELECT tag, line_no FROM v_log QUALIFY row_number() OVER (PARTITION BY tag ORDER BY line_no DESC) <= 20", plain=True)
add("log_runs", lambda s, d: runs(s, d).fillna({"rc": -1}), f"{LOG} SELECT tag, run, sid, lines, coalesce(rc, -1) AS rc, first FROM v_runs", plain=True)
add("unit_attempts", lambda s, d: progress.unit_attempts(run_log(s, d)), f"{LOG} SELECT tag, 'c_' || u AS unit, max(CASE e WHEN 'view' THEN 2 ELSE 1 END)::BIGINT AS attempts, bool_or(e = 'click') AS ok FROM v_log WHERE e IN ('click', 'view') GROUP BY tag, u", plain=True)
add("run_outcome", lambda s, d: progress.run_outcome(runs(s, d)), f"{LOG} SELECT * FROM v_outcome", plain=True)
add("early_exits", lambda s, d: progress.early_exits(runs(s, d)), f"{LOG}, b AS (SELECT *, sum((rc <> 0)::INT) OVER (PARTITION BY tag ORDER BY run) AS broken FROM v_runs WHERE rc IS NOT NULL), i AS (SELECT tag, broken, count(*) FILTER (rc = 0) AS clean FROM b GROUP BY tag, broken) SELECT tag, arg_max(clean, broken) AS clean, arg_max(clean, broken) BETWEEN 1 AND 2 AS resume FROM i GROUP BY tag", plain=True)


def users(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = run_log(s, d).select("tag").distinct().withColumn("skip", views.digit("tag") == "c")
    return v, v.select("tag", F.when(views.digit("tag") < "4", "done").when(views.digit("tag") < "8", "review").otherwise("verify").alias("stage"))


H = "substr(md5(tag), 1, 1)"
add("queue_split", lambda s, d: progress.queue_split(*users(s, d), progress.run_outcome(runs(s, d))), f"{LOG} SELECT v.tag, CASE WHEN {H.replace('tag', 'v.tag')} < '4' OR {H.replace('tag', 'v.tag')} = 'c' THEN 'done' WHEN o.state = 'failed' THEN 'error' WHEN o.state = 'running' THEN 'active' WHEN {H.replace('tag', 'v.tag')} < '8' THEN 'review' ELSE 'draft' END AS class FROM (SELECT DISTINCT tag FROM v_log) v LEFT JOIN v_outcome o ON v.tag = o.tag", plain=True)
add("apply_candidates", lambda s, d: progress.apply_candidates(users(s, d)[0], run_log(s, d).filter("line_no % 2 = 0"), progress.run_outcome(runs(s, d))), f"{LOG} SELECT DISTINCT tag FROM v_log l WHERE {H} <> 'c' AND line_no % 2 = 0 AND NOT EXISTS (SELECT 1 FROM v_outcome o WHERE o.tag = l.tag AND state = 'running')", plain=True)


def measures(s: SparkSession, d: str) -> DataFrame:
    rows = views.segments(s, d).crossJoin(F.broadcast(render.ladder(s)))
    return rows.select("tag", "id", "scale", F.lit(36.0).alias("height"), (F.ceil(F.length("text") * F.col("scale") / 90) * 12).cast("double").alias("filled"), (views.digit("id") == "0").alias("more"))


FIT = "v_fit AS (SELECT tag, id, text, coalesce(max(scale) FILTER (substr(md5(id), 1, 1) <> '0' AND ceil(length(text) * scale / 90) * 12 <= 36.5), 0.55) AS scale FROM v_segments, (SELECT unnest([1.0, 0.97, 0.94, 0.91, 0.88, 0.85, 0.82, 0.79, 0.76, 0.73, 0.7, 0.67, 0.64, 0.6, 0.55]::DOUBLE[]) AS scale) GROUP BY tag, id, text)"
add("fit_scale", lambda s, d: render.fit_scale(measures(s, d)), f"+ {FIT} SELECT tag, id, scale FROM v_fit")
scales = lambda s, d: render.fit_scale(measures(s, d)).join(views.segments(s, d).select("tag", "id", F.length("text").alias("weight")), ["tag", "id"])
MODE = f"{FIT}, m0 AS (SELECT tag, round_even(scale / 0.03, 0)::BIGINT AS b, sum(length(text)) AS w FROM v_fit GROUP BY tag, b), v_mode AS (SELECT tag, round(least(1.0, arg_max(b, (w, b)) * 0.03::DOUBLE), 6) AS mode FROM m0 GROUP BY tag)"
add("mode_scale", lambda s, d: render.mode_scale(scales(s, d)), f"+ {MODE} SELECT * FROM v_mode")
add("scale_cap", lambda s, d: render.scale_cap(render.mode_scale(scales(s, d))), f"+ {MODE} SELECT tag, CASE WHEN mode >= 0.94 THEN 1.0 ELSE greatest(mode, 0.85) END AS cap FROM v_mode")


def report(s: SparkSession, d: str) -> DataFrame:
    pick = lambda n: F.conv(F.substring(F.md5(F.concat("tag", "id")), n, 1), 16, 10).cast("bigint")
    rows = views.segments(s, d).filter("seq % 11 <> 5")
    return rows.select(
        "tag", "id", "page", F.when(pick(1) == 0, "heading").when(pick(1) == 1, "caption").when(pick(1) == 2, "footnote").otherwise("body").alias("type"), (1 - pick(2) / 50).alias("requested_scale"), (1 - pick(3) / 60).alias("renderer_scale"),
        F.when(pick(4) == 0, "plain").alias("fallback"), (pick(5) == 0).alias("overflow"), F.when(pick(6) == 0, " ").otherwise("ok").alias("translation"),
    )


D = lambda n: f"(strpos('0123456789abcdef', substr(md5(tag || id), {n}, 1)) - 1)"
REPORT = f"""+ v_report AS (SELECT tag, id, page, seq, {D(1)} AS kind, round(greatest(0, least(1, CASE WHEN {D(4)} = 0 THEN 1 - {D(3)} / 60 ELSE (1 - {D(2)} / 50) * (1 - {D(3)} / 60) END)), 4) AS actual_scale, {D(4)} = 0 AS fallback, {D(5)} = 0 AS overflow, {D(6)} = 0 AS blank FROM v_segments WHERE seq % 11 <> 5),
v_flags AS (SELECT *, actual_scale < CASE kind WHEN 0 THEN 0.85 WHEN 1 THEN 0.72 WHEN 2 THEN 0.80 ELSE 0.78 END OR fallback OR overflow AS review_required FROM v_report)"""
missing = lambda s, d: views.segments(s, d).filter("seq % 11 = 5 AND seq % 2 = 1").select("tag", "id")
add("review_flags", lambda s, d: render.review_flags(report(s, d)).select("tag", "id", "actual_scale", "review_required"), f"{REPORT} SELECT tag, id, actual_scale, review_required FROM v_flags")
add("report_totals", lambda s, d: render.report_totals(render.review_flags(report(s, d)), missing(s, d)), f"{REPORT}, m AS (SELECT tag, count(*) AS missing FROM v_segments WHERE seq % 11 = 5 AND seq % 2 = 1 GROUP BY tag), a AS (SELECT tag, count(*) AS applied, count(*) FILTER (review_required) AS review FROM v_flags GROUP BY tag) SELECT tag, coalesce(applied, 0) AS applied, coalesce(review, 0) AS review, coalesce(missing, 0) AS missing FROM a FULL JOIN m USING (tag)")
add("report_page", lambda s, d: report(s, d).filter("page = 3").select("tag", "id", "type"), f"{REPORT} SELECT tag, id, CASE kind WHEN 0 THEN 'heading' WHEN 1 THEN 'caption' WHEN 2 THEN 'footnote' ELSE 'body' END AS type FROM v_report WHERE page = 3")


def placed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Segments with a box, and their report with boxes moved by less or more than the tolerance and some sources lost."""
    rows = views.segments(s, d)
    box = lambda by: [(F.col("seq") + by + k).cast("double").alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]
    moved = rows.select("tag", "id", *box(F.when(F.col("seq") % 97 == 0, 0.06).otherwise(0.04)), F.when(F.col("seq") % 89 == 3, " ").otherwise(F.col("text")).alias("source"))
    return rows.select("tag", "id", *box(F.lit(0.0))), report(s, d).select("tag", "id", "translation").join(moved, ["tag", "id"])


def rendered(s: SparkSession, d: str) -> DataFrame:
    """Volumes whose layout, report or output is another's in some."""
    h = F.col("h")
    rows = views.segments(s, d).select("tag").distinct().withColumn("h", views.digit("tag"))
    return rows.select(
        "tag", F.col("tag").alias("source"), F.when(h < "2", "other").otherwise(F.col("tag")).alias("layout_source"), F.when(h == "2", "").when(h != "3", F.concat(F.lit("g"), h)).alias("layout_generation"),
        F.when(h == "4", "g0").otherwise(F.concat(F.lit("g"), h)).alias("report_generation"), F.concat(F.lit("o"), "tag").alias("output"), F.when(h == "6", "x").when(h != "5", F.concat(F.lit("o"), "tag")).alias("report_output"),
    )


def integrity(s: SparkSession, d: str) -> DataFrame:
    layout, found = placed(s, d)
    return render.report_integrity(layout, found, missing(s, d), rendered(s, d))


add(
    "report_integrity",
    integrity,
    f"""{REPORT}, p AS (SELECT tag, id, CASE WHEN seq % 89 = 3 THEN ' ' ELSE text END AS source, seq AS lx, seq + CASE WHEN seq % 97 = 0 THEN 0.06 ELSE 0.04 END AS rx FROM v_segments JOIN (SELECT tag, id FROM v_report) USING (tag, id)),
t AS (SELECT DISTINCT tag, substr(md5(tag), 1, 1) AS h FROM v_segments),
m AS (SELECT tag, id FROM v_segments WHERE seq % 11 = 5 AND seq % 2 = 1),
r AS (SELECT tag, tag AS source, CASE WHEN h < '2' THEN 'other' ELSE tag END AS ls, CASE WHEN h = '2' THEN '' WHEN h <> '3' THEN 'g' || h END AS lg, CASE WHEN h = '4' THEN 'g0' ELSE 'g' || h END AS rg, 'o' || tag AS o, CASE WHEN h = '6' THEN 'x' WHEN h <> '5' THEN 'o' || tag END AS ro FROM t)
SELECT DISTINCT tag, 'blank translation' AS rule FROM v_report WHERE blank UNION SELECT DISTINCT tag, 'blank source' FROM p WHERE trim(source) = '' UNION SELECT DISTINCT tag, 'other box' FROM p WHERE abs(rx - lx) > 0.05
UNION SELECT tag, 'not reported' FROM v_segments s WHERE NOT EXISTS (SELECT 1 FROM v_report r WHERE r.tag = s.tag AND r.id = s.id) AND NOT EXISTS (SELECT 1 FROM m WHERE m.tag = s.tag AND m.id = s.id)
UNION SELECT tag, 'other source' FROM r WHERE ls IS DISTINCT FROM source UNION SELECT tag, 'other generation' FROM r WHERE coalesce(lg, '') = '' OR lg <> rg UNION SELECT tag, 'other output' FROM r WHERE ro IS DISTINCT FROM o""",
)
part = lambda s, d: report(s, d).filter("page % 3 = 1 AND NOT (page % 2 = 0 AND id LIKE '%7')").withColumn("translation", F.lit("new")).select("tag", "id", "page", "translation")
add("merge_partial_report", lambda s, d: render.merge_partial_report(report(s, d).select("tag", "id", "page", "translation"), part(s, d)), f"{REPORT}, g AS (SELECT tag, page, page % 3 = 1 AND NOT bool_or(page % 2 = 0 AND id LIKE '%7') AS swap FROM v_report GROUP BY tag, page) SELECT tag, id, page, CASE WHEN swap THEN 'new' WHEN blank THEN ' ' ELSE 'ok' END AS translation FROM v_report JOIN g USING (tag, page)")

files = lambda s, d: views.table(s, d, "documents").select(F.concat_ws(" ", "source", F.col("doc_id").cast("string"), F.lit("Việt.pdf")).alias("name"), F.encode("text", "utf-8").alias("content"))
add("src_content_ids", lambda s, d: ingest.content_ids(files(s, d)), "SELECT min(name) AS name, sha, 'user_' || left(trim(regexp_replace(lower(min(name)), '[^a-z0-9]+', '-', 'g'), '-'), 40) || '_' || left(sha256(min(name)), 6) || '_' || left(sha, 12) AS document_id FROM (SELECT source || ' ' || doc_id || ' Việt.pdf' AS name, sha256(text) AS sha FROM documents WHERE text IS NOT NULL) GROUP BY sha", plain=True)
specs = lambda s, d: views.table(s, d, "events").select("event_id", F.concat(F.lit(" "), (F.col("event_id") % 9 + 4).cast("string"), F.lit("-"), (F.col("event_id") % 5).cast("string"), F.lit(" , 3,x,"), (F.col("event_id") % 20).cast("string")).alias("spec"))
add("src_page_list", lambda s, d: ingest.page_list(specs(s, d), "spec", F.lit(12).cast("bigint")).select("event_id", "page"), "SELECT DISTINCT event_id, page FROM (SELECT event_id, unnest(list_concat(range(greatest(event_id % 5, 1), least(event_id % 9 + 4, 12) + 1), [3], CASE WHEN event_id % 20 BETWEEN 1 AND 12 THEN [event_id % 20] ELSE [] END)) AS page FROM events)", plain=True)
manifest = lambda s, d: views.table(s, d, "documents").filter("doc_id % 3 = 0").select(F.concat(F.lit("/w/vol"), F.col("doc_id").cast("string"), F.lit("/")).alias("workdir"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("display"), (F.col("doc_id") % 5 == 0).alias("skip"))
listing = lambda s, d: views.table(s, d, "documents").filter("doc_id % 4 = 0").select(F.concat(F.lit("vol"), F.col("doc_id").cast("string")).alias("document_id"), F.concat("source", F.lit(".PDF")).alias("name"))
add("src_manifest", lambda s, d: ingest.load_volumes(manifest(s, d), listing(s, d)), "SELECT 'vol' || doc_id AS tag, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'vol' || doc_id END AS display, doc_id % 5 = 0 AS skip, false AS \"user\" FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'vol' || doc_id, source, false, true FROM documents WHERE doc_id % 4 = 0 AND doc_id % 3 <> 0", plain=True)
