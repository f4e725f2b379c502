"""Queries over review issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import defects
from quire.operators import review
from quire.plans.registry import add
from quire.sources import views

RANK = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
RICH = f"""+ v_rich AS (SELECT *, {defects.sql('detail', 0)} AS cluster, {defects.sql('detail', 1)} AS channel, {RANK} AS rank, coalesce(kind, 'defect') <> 'fit' AS is_defect FROM v_issues),
v_open AS (SELECT * FROM v_rich r WHERE is_defect AND NOT EXISTS (SELECT 1 FROM v_accepted a WHERE a.tag = r.tag AND a.page = r.page))"""

add("defect_cluster", lambda s, d: review.enrich(views.issues(s, d)).groupBy("cluster", "channel").agg(F.count("*").alias("issues")), f"{RICH} SELECT cluster, channel, count(*) AS issues FROM v_rich GROUP BY ALL")


def half_filled(s: SparkSession, d: str) -> DataFrame:
    keep = F.col("seq") % 4 == 0
    return views.issues(s, d).withColumn("cluster", F.when(keep, "own").otherwise("")).withColumn("channel", F.when(keep, "policy"))


add("enrich_issues", lambda s, d: review.enrich(half_filled(s, d)).select("seq", "cluster", "channel"), f"{RICH} SELECT seq, CASE WHEN seq % 4 = 0 THEN 'own' ELSE cluster END AS cluster, CASE WHEN seq % 4 = 0 THEN 'policy' ELSE channel END AS channel FROM v_rich")
add("defect_pages", lambda s, d: review.defect_pages(views.issues(s, d), views.accepted(s, d)), f"{RICH} SELECT DISTINCT tag, page FROM v_open WHERE rank >= 2")
add("problems", lambda s, d: review.problems(views.issues(s, d), views.accepted(s, d), channel="text"), f"{RICH} SELECT tag, page, count(*) AS issues, max(rank)::BIGINT AS worst FROM v_open WHERE rank >= 2 AND channel IN ('text', 'mixed') GROUP BY tag, page")
add(
    "defect_report",
    lambda s, d: review.defect_report(views.issues(s, d), views.accepted(s, d)),
    f"""{RICH}, n AS (SELECT *, row_number() OVER (PARTITION BY tag, cluster ORDER BY page, seq) AS r FROM v_open)
SELECT tag, cluster, count(*) AS issues, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages, arg_min(channel, r) AS channel, string_agg(left(detail, 160), ' | ' ORDER BY r) FILTER (r <= 3) AS samples FROM n GROUP BY tag, cluster""",
)
more = lambda s, d: views.issues(s, d).filter("page % 5 = 0").select("tag", "page").distinct()
MORE = "v_more AS (SELECT DISTINCT tag, page FROM v_issues WHERE page % 5 = 0)"
add("accept_pages", lambda s, d: review.accept_pages(views.accepted(s, d), more(s, d)), f"+ {MORE} SELECT * FROM v_accepted UNION SELECT * FROM v_more")
add("accept_warnings", lambda s, d: review.accept_warnings(views.issues(s, d), more(s, d)), f"{RICH}, {MORE} SELECT tag, page, count(*) AS hidden FROM v_rich JOIN v_more USING (tag, page) WHERE is_defect AND rank >= 2 AND channel <> 'policy' GROUP BY tag, page")
add("reopen_pages", lambda s, d: review.reopen_pages(views.accepted(s, d), more(s, d)), f"+ {MORE} SELECT * FROM v_accepted EXCEPT SELECT * FROM v_more")
add("reopened_pages", lambda s, d: review.reopened(views.accepted(s, d), more(s, d)), f"+ {MORE} SELECT * FROM v_accepted INTERSECT SELECT * FROM v_more")


def verdicts(s: SparkSession, d: str) -> DataFrame:
    """A verdict file for each page: a list of its issues; of eleven pages one has an object and one a list cut off."""
    item = F.concat(F.lit('{"kind":"'), F.coalesce("kind", F.lit("defect")), F.lit('","severity":"'), "severity", F.lit('","detail":"'), "detail", F.lit('"}'))
    rows = views.issues(s, d).groupBy("tag", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("i")))), lambda x: x["i"]), ",").alias("items"))
    return rows.select("tag", "page", F.when(F.col("page") % 11 == 3, F.lit("{}")).when(F.col("page") % 11 == 4, F.concat(F.lit("["), F.expr("left(items, length(items) - 3)"))).otherwise(F.concat(F.lit("["), "items", F.lit("]"))).alias("raw"))


add("revision_pages", lambda s, d: review.revision_pages(verdicts(s, d), views.issues(s, d), views.accepted(s, d)).select("tag", "page"), f"{RICH} SELECT DISTINCT tag, page FROM v_issues EXCEPT SELECT tag, page FROM v_open WHERE rank >= 2")
add("merge_verdicts", lambda s, d: review.merge_verdicts(verdicts(s, d)), "SELECT tag, page, row_number() OVER (PARTITION BY tag, page ORDER BY seq) - 1 AS pos, coalesce(kind, 'defect') AS kind, severity, detail FROM v_issues WHERE page % 11 NOT IN (3, 4)")
add("verdict_counts", lambda s, d: review.verdict_counts(verdicts(s, d)), "SELECT tag, count(DISTINCT page) AS files, count(DISTINCT page) FILTER (page % 11 IN (3, 4)) AS bad, count(*) FILTER (severity = 'high' AND page % 11 NOT IN (3, 4)) AS high FROM v_issues GROUP BY tag")
add(
    "review_summary",
    lambda s, d: review.review_summary(views.issues(s, d), views.accepted(s, d)),
    f"""{RICH}, p AS (SELECT r.tag, r.page, max(rank) FILTER (is_defect AND a.tag IS NULL) AS worst, count(*) FILTER (NOT is_defect) AS fit, bool_or(a.tag IS NOT NULL) AS acc
  FROM v_rich r LEFT JOIN v_accepted a ON r.tag = a.tag AND r.page = a.page GROUP BY r.tag, r.page)
SELECT tag, count(*) FILTER (worst >= 2) AS blocking, count(*) FILTER (worst = 1) AS low_only, sum(fit)::BIGINT AS fit_issues, count(*) FILTER (acc) AS accepted, count(*) FILTER (worst >= 2) = 0 AS converged FROM p GROUP BY tag""",
)
HASHES = "v_hashes AS (SELECT tag, page, md5(string_agg(text, chr(10) ORDER BY seq)) AS hash FROM v_segments GROUP BY tag, page)"
add("page_hashes", lambda s, d: review.page_hashes(views.segments(s, d)), f"+ {HASHES} SELECT * FROM v_hashes")


def newer(s: SparkSession, d: str) -> DataFrame:
    """The same pages later: page 40 is lost, some are altered."""
    return review.page_hashes(views.segments(s, d)).filter("page <> 40").withColumn("hash", F.when(F.col("page") % 7 == 0, F.md5("hash")).otherwise(F.col("hash")))


add(
    "golden_diff",
    lambda s, d: review.golden_diff(review.page_hashes(views.segments(s, d)), newer(s, d)),
    f"+ {HASHES} SELECT tag, count(*) AS pages, count(*) FILTER (page = 40 OR page % 7 = 0) AS changed, count(*) FILTER (page = 40) = 0 AS same_count FROM v_hashes GROUP BY tag",
)
segs = lambda s, d: views.segments(s, d).withColumn("tag", F.concat(F.lit("u"), F.substring_index("tag", "/", -1)))
add(
    "attach_segments",
    lambda s, d: review.attach_segments(views.issues(s, d), segs(s, d)),
    f"{RICH}, g AS (SELECT 'u' || split_part(tag, '/', 2) AS tag, page, id, seq FROM v_segments), h AS (SELECT tag, page, count(*) AS segments, arg_min(id, seq) AS first_id FROM g GROUP BY tag, page) SELECT r.tag, r.page, r.seq, r.channel, coalesce(h.segments, 0) AS segments, h.first_id FROM v_rich r LEFT JOIN h ON r.tag = h.tag AND r.page = h.page WHERE is_defect AND channel IN ('text', 'mixed')",
)
add("clear_page_artifacts", lambda s, d: review.clear_page_artifacts(views.issues(s, d), more(s, d)).select("tag", "page", "seq"), "SELECT tag, page, seq FROM v_issues WHERE page % 5 <> 0")
