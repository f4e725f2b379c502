"""Streams over the derived tables, held against the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import units
from quire.plans.registry import SQL, add
from quire.plans.work import VALID
from quire.sources import ingest, scratch, views
from quire.streaming import jobs


def arrived(s: SparkSession, df: DataFrame, name: str, by: str | None = None) -> tuple[DataFrame, str]:
    """The rows as a stream of a few files, and the folder beside them."""
    root = scratch.folder(s, name)
    (df.repartition(3, by) if by else df.repartition(3)).write.parquet(f"{root}/in")
    return jobs.read_outputs(s, f"{root}/in", df.schema), root


def outputs_to_memory(s: SparkSession, d: str) -> DataFrame:
    work = scratch.keep(views.work_units(s, d).select("tag", "idx", "pos", "k", "id", "text"), "units")
    stream, root = arrived(s, views.outputs(s, d, work), "outputs")
    jobs.outputs_to_memory(stream, work, f"{root}/out", f"{root}/checkpoint")
    return jobs.current_memory(s, f"{root}/out", views.memory(s, d))


def stamped(s: SparkSession, d: str) -> DataFrame:
    gen = units.chunk_gen(views.work_units(s, d))
    return views.outputs(s, d).join(gen, "tag").select("tag", "idx", F.when(views.digit("idx", "tag") < "c", F.col("chunk_gen")).otherwise("old").alias("stamp"))


def fresh_outputs(s: SparkSession, d: str) -> DataFrame:
    stream, root = arrived(s, stamped(s, d), "stamped")
    kept = jobs.generation_filter(stream, units.chunk_gen(views.work_units(s, d)))
    return jobs.to_table(kept.select("tag", "idx"), f"{root}/out", f"{root}/checkpoint")


def rejected_outputs(s: SparkSession, d: str) -> DataFrame:
    stream, root = arrived(s, stamped(s, d), "stamped")
    _, rejected = jobs.split_by_generation(stream, scratch.keep(units.chunk_gen(views.work_units(s, d)), "generations"), f"{root}/out", f"{root}/checkpoint")
    return rejected.select("tag", "idx", "stamp")


def repair_events(s: SparkSession, d: str) -> DataFrame:
    """Requests of 50 users each hundred events, a second for each event id."""
    kinds = {"signup": "running", "view": "attached", "click": "completed", "purchase": "failed", "error": "superseded"}
    event = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()])
    e = F.col("event_id")
    return views.table(s, d, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("tag"), F.floor(e / 1000).alias("id"), e.alias("seq"), F.timestamp_seconds(e).alias("at"), event.alias("event"), F.when(event == "attached", F.concat(F.lit("r"), e.cast("string"))).alias("run_sid"), F.when(event == "failed", "broken").alias("error"))


def live_repairs(s: SparkSession, d: str) -> DataFrame:
    rows = repair_events(s, d)
    root = scratch.folder(s, "repairs")
    rows.coalesce(1).write.parquet(f"{root}/in")
    changes = jobs.repair_states(jobs.read_outputs(s, f"{root}/in", rows.schema), 60_000, "3650 days")
    return jobs.latest_repairs(jobs.to_table(changes, f"{root}/out", f"{root}/checkpoint"))


def exit_events(s: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    return views.table(s, d, "events").select(
        F.concat(F.lit("u"), F.floor(F.col("user_id") / 4).cast("string")).alias("tag"), F.col("event_id").alias("seq"), F.when(t == "signup", "start").when((t == "purchase") & (F.col("event_id") % 5 == 0), "stop").otherwise("exit").alias("event"),
        F.when(t == "error", 1).otherwise(0).cast("bigint").alias("rc"), (F.col("event_id") % 7 == 0).alias("over"),
    )


def live_exits(s: SparkSession, d: str) -> DataFrame:
    rows = exit_events(s, d)
    root = scratch.folder(s, "exits")
    rows.coalesce(1).write.parquet(f"{root}/in")
    return jobs.to_table(jobs.early_exits(jobs.read_outputs(s, f"{root}/in", rows.schema)), f"{root}/out", f"{root}/checkpoint")


def live_progress(s: SparkSession, d: str) -> DataFrame:
    done = units.unit_valid(views.work_units(s, d), views.outputs(s, d)).select("tag", F.col("valid").alias("done"))
    stream, root = arrived(s, done, "progress")
    return jobs.last_totals(stream, ["tag"], f"{root}/out", f"{root}/checkpoint")


def event_rows(s: SparkSession, d: str) -> DataFrame:
    rows = views.table(s, d, "conversations")
    k = F.col("turn") % 4
    kind = F.when(k == 1, "final").when(k == 2, "error").when((k == 3) & (F.col("conv_id") % 2 == 0), "text_delta").otherwise("error")
    return rows.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("line_no"), F.lit(0).cast("bigint").alias("pos"), kind.alias("type"), F.when(kind != "error", F.md5("text")).alias("text"), F.when(kind == "error", F.substring(F.md5(F.concat(F.col("conv_id").cast("string"), F.floor(F.col("turn") / 3).cast("string"))), 1, 1)).alias("error"))


def live_dedupe(s: SparkSession, d: str) -> DataFrame:
    stream, root = arrived(s, event_rows(s, d), "events", "run_id")
    return jobs.to_table(jobs.event_dedupe(stream), f"{root}/out", f"{root}/checkpoint").select("run_id", "line_no", "type", "text", "error")


def stored(s: SparkSession, d: str) -> DataFrame:
    """The memory written in folders of volumes and read again."""
    path = f"{scratch.folder(s, 'memory')}/table"
    ingest.write_table(views.memory(s, d), path)
    return s.read.parquet(path).select("tag", "text", "vi")


add("sink_tm", stored, "SELECT tag, text, vi FROM v_memory")
add("stream_outputs_to_tm", outputs_to_memory, SQL["merge_translations"], plain=True)
add("stream_generation_filter", fresh_outputs, "SELECT tag, idx FROM v_outputs WHERE substr(md5(idx || tag), 1, 1) < 'c'")
add("stream_generation_rejects", rejected_outputs, "SELECT tag, idx, 'old' AS stamp FROM v_outputs WHERE substr(md5(idx || tag), 1, 1) >= 'c'")
add(
    "stream_repair_state",
    live_repairs,
    """WITH e AS (SELECT 'u' || (user_id % 50) AS tag, event_id // 1000 AS id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'running' WHEN 'view' THEN 'attached' WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'failed' WHEN 'error' THEN 'superseded' END AS event FROM events),
o AS (SELECT * FROM e JOIN (SELECT tag, id, min(seq) AS begun FROM e WHERE event = 'running' GROUP BY ALL) USING (tag, id) WHERE seq >= begun),
g AS (SELECT *, coalesce(bool_or(event = 'attached') OVER (PARTITION BY tag, id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS held, coalesce(seq - lag(seq) OVER (PARTITION BY tag, id ORDER BY seq) > 60, false) AS idle FROM o),
f AS (SELECT *, CASE WHEN idle AND NOT held THEN 'idle' WHEN event IN ('completed', 'failed') THEN event WHEN event = 'superseded' AND NOT held THEN event END AS how FROM g),
h AS (SELECT tag, id, arg_min(how, seq) FILTER (how IS NOT NULL) AS how, arg_max('r' || seq, seq) FILTER (event = 'attached') AS run_sid FROM f GROUP BY ALL)
SELECT tag, id, CASE WHEN how IS NULL THEN 'running' WHEN how = 'completed' THEN how ELSE 'failed' END AS status, run_sid,
  CASE how WHEN 'failed' THEN 'broken' WHEN 'completed' THEN NULL ELSE how END AS error FROM h""",
    plain=True,
)
add(
    "stream_early_exit",
    live_exits,
    """WITH e AS (SELECT 'u' || (user_id // 4) AS tag, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'start' WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'stop' ELSE 'exit' END AS event, event_type = 'error' AS failed, event_id % 7 = 0 AS over_ FROM events),
i AS (SELECT *, count(*) FILTER (event <> 'exit') OVER (PARTITION BY tag ORDER BY seq) AS island FROM e),
s AS (SELECT *, bool_or(event = 'stop') OVER (PARTITION BY tag, island) AS stopped FROM i),
c AS (SELECT *, row_number() OVER (PARTITION BY tag, island ORDER BY seq) AS k FROM s WHERE event = 'exit' AND NOT failed AND NOT over_)
SELECT tag, seq, CASE WHEN stopped THEN 3 ELSE least(k, 3) END AS clean, NOT stopped AND k <= 3 AS resume FROM c""",
    plain=True,
)
add("stream_progress", live_progress, f"{VALID} SELECT tag, count(*) FILTER (valid) AS done, count(*) AS total FROM v_valid GROUP BY tag")
add(
    "stream_event_dedupe",
    live_dedupe,
    """WITH e AS (SELECT conv_id AS run_id, turn AS line_no, CASE WHEN turn % 4 = 1 THEN 'final' WHEN turn % 4 = 3 AND conv_id % 2 = 0 THEN 'text_delta' ELSE 'error' END AS type, md5(text) AS h, substr(md5(conv_id || '' || (turn // 3)), 1, 1) AS er FROM conversations),
p AS (SELECT *, coalesce(max((type <> 'error')::INT) OVER (PARTITION BY run_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS told, lag(er) OVER (PARTITION BY run_id, type = 'error' ORDER BY line_no) AS before FROM e)
SELECT run_id, line_no, CASE type WHEN 'final' THEN 'text_delta' ELSE type END AS type, CASE WHEN type <> 'error' THEN h END AS text, CASE WHEN type = 'error' THEN er END AS error
FROM p WHERE NOT (type = 'final' AND told = 1) AND NOT (type = 'error' AND er IS NOT DISTINCT FROM before)""",
    plain=True,
)
