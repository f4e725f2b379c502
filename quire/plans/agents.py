"""Queries over agent logs, conversations and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import agents
from quire.plans.registry import add
from quire.sources import views


def log(s: SparkSession, d: str) -> DataFrame:
    """A log line for each turn, in the dialect that the conversation's number picks."""
    rows = views.table(s, d, "conversations").withColumn("h", F.md5("text")).withColumn("k", F.col("turn") % 4)
    lit = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    h, run = F.col("h"), F.col("conv_id").cast("string")
    one = F.when(F.col("turn") == 0, lit('{"type":"system","subtype":"init","session_id":"s', run, '"}')).when(F.col("k") == 1, lit('{"type":"stream_event","event":{"type":"content_block_delta","delta":{"type":"text_delta","text":"', h, '"}}}'))
    one = one.when(F.col("k") == 2, lit('{"type":"assistant","message":{"content":[{"type":"text","text":"', h, '"},{"type":"tool_use","name":"read","id":"x"}]}}'))
    one = one.when(F.col("k") == 3, lit('{"type":"result","session_id":"r', run, '","is_error":true,"num_turns":0,"duration_api_ms":0,"result":"', h, '"}')).otherwise(lit("{oops ", h))
    two = F.when(F.col("turn") == 0, lit('{"type":"thread.started","thread_id":"t', run, '"}')).when(F.col("k") == 1, lit('{"type":"item.completed","item":{"type":"agent_message","text":"', h, '"}}'))
    two = two.when(F.col("k") == 2, lit('{"type":"error","message":"{\\"error\\":{\\"message\\":\\"thread ', run, ' not found\\"}}"}')).when(F.col("k") == 3, lit('{"type":"turn.failed","error":{"message":" thread ', run, ' not found "},"message":"x"}'))
    two = two.otherwise(lit('{"type":"item.completed","item":{"type":"command_execution","command":"ls"}}'))
    three = F.when(F.col("k") == 0, lit('{"type":"text","data":"', h, '"}')).when(F.col("k") == 1, lit('{"type":"tool_use","name":"grep"}')).when(F.col("k") == 2, lit('{"type":"end","sessionId":"g', run, '"}')).otherwise(lit('{"type":"thought","data":"hm"}'))
    pick = F.col("conv_id") % 3
    return rows.select(F.col("conv_id").alias("run_id"), F.when(pick == 0, "claude").when(pick == 1, "codex").otherwise("grok").alias("engine"), F.col("turn").alias("line_no"), F.when(pick == 0, one).when(pick == 1, two).otherwise(three).alias("line"))


EVENTS = """
WITH c AS (SELECT conv_id AS run_id, turn AS line_no, turn % 4 AS k, conv_id % 3 AS e, md5(text) AS h FROM conversations),
r AS (
  SELECT run_id, e, line_no, 0 AS pos, 'session' AS type, NULL AS text, NULL AS name, CASE e WHEN 0 THEN 's' ELSE 't' END || run_id AS session_id, NULL AS error, NULL AS code FROM c WHERE line_no = 0 AND e < 2
  UNION ALL SELECT run_id, e, line_no, 0, 'text_delta', h, NULL, NULL, NULL, NULL FROM c WHERE (k = 1 AND e < 2) OR (k = 0 AND e = 2)
  UNION ALL SELECT run_id, e, line_no, 0, 'final', h, NULL, NULL, NULL, NULL FROM c WHERE k = 2 AND e = 0
  UNION ALL SELECT run_id, e, line_no, 1, 'tool_call', NULL, 'read', NULL, NULL, NULL FROM c WHERE k = 2 AND e = 0
  UNION ALL SELECT run_id, e, line_no, 0, 'session', NULL, NULL, 'r' || run_id, NULL, NULL FROM c WHERE k = 3 AND e = 0
  UNION ALL SELECT run_id, e, line_no, 1, 'error', NULL, NULL, NULL, h, 'resume_failed' FROM c WHERE k = 3 AND e = 0
  UNION ALL SELECT run_id, e, line_no, 0, 'error', NULL, NULL, NULL, 'thread ' || run_id || ' not found', 'resume_failed' FROM c WHERE k IN (2, 3) AND e = 1
  UNION ALL SELECT run_id, e, line_no, 0, 'tool_call', NULL, CASE e WHEN 1 THEN 'ls' ELSE 'grep' END, NULL, NULL, NULL FROM c WHERE (k = 0 AND line_no > 0 AND e = 1) OR (k = 1 AND e = 2)
  UNION ALL SELECT run_id, e, line_no, 0, 'session', NULL, NULL, 'g' || run_id, NULL, NULL FROM c WHERE k = 2 AND e = 2
),
p AS (SELECT *, coalesce(max((type IN ('text_delta', 'final'))::INT) OVER (PARTITION BY run_id ORDER BY line_no, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS told,
  e = 1 AND type = 'error' AND error IS NOT DISTINCT FROM lag(error) OVER (PARTITION BY run_id, type ORDER BY line_no, pos) AS again FROM r),
v_events AS (SELECT run_id, line_no, pos, CASE type WHEN 'final' THEN 'text_delta' ELSE type END AS type, text, name, session_id, error, code FROM p WHERE (type <> 'final' OR told = 0) AND NOT again)
"""
events = lambda s, d: agents.agent_events(log(s, d))
add("agent_events", events, f"{EVENTS} SELECT * FROM v_events", plain=True)
add("partial_text_dedupe", lambda s, d: events(s, d).groupBy("run_id").agg(F.count_if(F.col("type") == "text_delta").alias("texts"), F.count("*").alias("events")), f"{EVENTS} SELECT run_id, count(*) FILTER (type = 'text_delta') AS texts, count(*) AS events FROM v_events GROUP BY run_id", plain=True)
add("error_dedupe", lambda s, d: events(s, d).filter("type = 'error'").select("run_id", "line_no", "error", "code"), f"{EVENTS} SELECT run_id, line_no, error, code FROM v_events WHERE type = 'error'", plain=True)
add("unwrap_error", lambda s, d: log(s, d).filter("engine = 'codex' AND line_no % 4 = 2").select("run_id", "line_no", agents.unwrap_error(F.get_json_object("line", "$.message")).alias("error")), "SELECT conv_id AS run_id, turn AS line_no, 'thread ' || conv_id || ' not found' AS error FROM conversations WHERE conv_id % 3 = 1 AND turn % 4 = 2", plain=True)
add("resume_failure", lambda s, d: events(s, d).groupBy("run_id").agg(F.bool_or(F.coalesce(F.col("code") == "resume_failed", F.lit(False))).alias("failed")), f"{EVENTS} SELECT run_id, bool_or(coalesce(code = 'resume_failed', false)) AS failed FROM v_events GROUP BY run_id", plain=True)
add("chat_projection", lambda s, d: agents.chat_projection(events(s, d)), f"{EVENTS} SELECT run_id, line_no, pos, CASE type WHEN 'text_delta' THEN 'delta' ELSE 'tool' END AS kind, CASE type WHEN 'text_delta' THEN text ELSE '🔧 ' || name END AS shown FROM v_events WHERE type IN ('text_delta', 'tool_call')", plain=True)
add("transcript", lambda s, d: agents.transcript(events(s, d)), f"{EVENTS} SELECT run_id, coalesce(string_agg(text, '' ORDER BY line_no, pos) FILTER (type = 'text_delta'), '') AS text, arg_max(session_id, (line_no, pos)) FILTER (type = 'session') AS session_id FROM v_events GROUP BY run_id", plain=True)


def runs(s: SparkSession, d: str) -> DataFrame:
    """Runs that ended in all ways, some in several: cancelled by a signal, late with a code."""
    r = F.col("run_id")
    signal = F.when(r % 11 == 1, "SIGKILL").when(r % 12 == 2, "SIGTERM")
    return log(s, d).select("run_id").distinct().select(
        "run_id", F.when(signal.isNull(), F.when(r % 5 == 0, 1).otherwise(0)).alias("rc"), signal.alias("signal"), (r % 7 == 3).alias("timeout"), (r % 6 == 2).alias("cancelled"),
        F.when(r % 29 == 4, "no such program").alias("spawn_error"), F.when(r % 22 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("stderr of session "), r.cast("string"), F.when(r % 10 == 0, F.lit(" not found")).otherwise(""))).alias("stderr"),
    )


add(
    "exit_event",
    lambda s, d: agents.exit_event(runs(s, d), events(s, d)),
    f"""{EVENTS}, f AS (SELECT run_id, bool_or(type = 'error') AS e FROM v_events GROUP BY run_id), k AS (SELECT DISTINCT run_id, CASE WHEN run_id % 11 = 1 THEN 'SIGKILL' WHEN run_id % 12 = 2 THEN 'SIGTERM' END AS sig FROM c),
u AS (SELECT run_id, sig, sig IS NULL AND run_id % 5 = 0 AS bad, run_id % 7 = 3 AS late, run_id % 6 = 2 AS off, run_id % 29 = 4 AS lost, run_id % 10 = 0 AS gone, CASE WHEN run_id % 22 <> 1 THEN 'stderr of session ' || run_id END AS told FROM k)
SELECT u.run_id, CASE WHEN lost OR late THEN 'error' WHEN off THEN 'cancelled' WHEN sig IS NOT NULL OR bad THEN 'error' ELSE 'completed' END AS reason,
  CASE WHEN lost THEN 'no such program' WHEN late THEN 'timeout' WHEN off THEN NULL WHEN sig IS NOT NULL THEN coalesce(told || CASE WHEN gone THEN ' not found' ELSE '' END, 'signal ' || sig)
    WHEN bad AND gone AND told IS NOT NULL THEN 'resume failed' WHEN bad AND NOT coalesce(f.e, false) THEN coalesce(told, 'code 1') END AS error,
  CASE WHEN lost THEN 'spawn_failed' WHEN late THEN 'timeout' WHEN off OR sig IS NOT NULL THEN NULL WHEN bad AND gone AND told IS NOT NULL THEN 'resume_failed' END AS code FROM u LEFT JOIN f USING (run_id)""",
    plain=True,
)


def conversations(s: SparkSession, d: str) -> DataFrame:
    return views.table(s, d, "conversations").groupBy(F.col("conv_id").alias("conversation_id")).agg(F.max("turn").alias("updated_at")).withColumn("tag", F.concat(F.lit("c"), F.floor(F.col("conversation_id") / 20).cast("string")))


def messages(s: SparkSession, d: str) -> DataFrame:
    return views.table(s, d, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("position"), "role", "text")


add("conversation_list", lambda s, d: agents.conversation_list(conversations(s, d), messages(s, d)), "SELECT 'c' || (conv_id // 20) AS tag, conv_id AS conversation_id, count(*) AS messages, row_number() OVER (PARTITION BY conv_id // 20 ORDER BY max(turn) DESC, conv_id DESC) AS place FROM conversations GROUP BY conv_id", plain=True)
add("conversation_detail", lambda s, d: agents.conversation_detail(messages(s, d)), "SELECT conv_id AS conversation_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS thread FROM conversations GROUP BY conv_id", plain=True)
add(
    "sink_snapshot_replace",
    lambda s, d: agents.replace_children(messages(s, d), messages(s, d).filter("conversation_id % 4 = 0 AND position < 2").withColumn("text", F.md5("text"))),
    "SELECT conv_id AS conversation_id, turn AS position, role, CASE WHEN conv_id % 4 = 0 THEN md5(text) ELSE text END AS text FROM conversations WHERE conv_id % 4 <> 0 OR turn < 2 OR NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = conversations.conv_id AND c.turn < 2)",
    plain=True,
)


def annotations(s: SparkSession, d: str) -> DataFrame:
    """Annotations from events: every value gives a rectangle, some out of the page, some notes without text."""
    ev = views.table(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    rect = F.struct((k / 100).alias("x"), (F.col("event_id") % 90 / 100).alias("y"), F.lit(0.05).alias("width"), F.lit(0.02).alias("height"))
    return ev.select(
        F.concat(F.lit("u"), F.floor(F.col("user_id") / 16).cast("string")).alias("tag"), F.concat(F.lit("a"), (F.col("event_id") % 700).cast("string"), F.lit("-"), F.col("user_id").cast("string")).alias("id"), "event_id", (F.col("event_id") % 40).alias("page"),
        F.when(F.col("event_id") % 13 == 5, "margin").when(F.col("event_id") % 2 == 0, "source").otherwise("translation").alias("side"), F.when(F.col("event_id") % 3 == 0, "note").otherwise("highlight").alias("kind"),
        F.when(F.col("event_id") % 17 == 0, "  ").otherwise(F.col("event_type")).alias("text"), F.when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("note"), F.array(rect).alias("rects"), F.col("event_id").alias("created_at"),
    )


ANNOTATIONS = """
WITH a AS (SELECT 'u' || (user_id // 16) AS tag, 'a' || (event_id % 700) || '-' || user_id AS id, event_id, event_id % 40 AS page, event_id % 13 = 5 AS margin, event_id % 3 = 0 AS is_note, event_id % 17 = 0 AS blank, event_id % 5 = 0 AS no_note,
  json_extract_string(props, '$.k')::DOUBLE / 100 AS x, event_id % 90 / 100 AS y FROM events),
v_valid AS (SELECT * FROM a WHERE page >= 1 AND NOT margin AND NOT blank AND x + 0.05 <= 1 AND y + 0.02 <= 1 AND (NOT is_note OR NOT no_note))
"""
add("annotations_valid", lambda s, d: agents.annotations_valid(annotations(s, d)).select("tag", "id", "event_id", "page"), f"{ANNOTATIONS} SELECT tag, id, event_id, page FROM v_valid", plain=True)


def halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = agents.annotations_valid(annotations(s, d))
    half = rows.agg(F.max("event_id")).select((F.col("max(event_id)") / 2).alias("half"))
    newest = rows.crossJoin(F.broadcast(half))
    last = lambda x: x.groupBy("tag", "id").agg(F.max("event_id").alias("created_at"))
    return last(newest.filter("event_id <= half")), last(newest.filter("event_id > half"))


add("annotations_upsert", lambda s, d: agents.annotations_upsert(*halves(s, d), most=20), f"{ANNOTATIONS}, n AS (SELECT tag, id, max(event_id) AS created_at FROM v_valid GROUP BY tag, id) SELECT tag, id, created_at FROM n QUALIFY row_number() OVER (PARTITION BY tag ORDER BY created_at DESC, id DESC) <= 20", plain=True)
marks = lambda s, d: annotations(s, d).select("tag", "page", F.col("event_id").alias("at"), F.col("event_id").alias("seq"))
lengths = lambda s, d: annotations(s, d).groupBy("tag").agg((F.max("page") - 10).alias("pages"))
add("bookmarks_latest", lambda s, d: agents.bookmarks_latest(marks(s, d), lengths(s, d)).fillna({"page": -1}), f"{ANNOTATIONS} SELECT tag, CASE WHEN arg_max(page, event_id) FILTER (page >= 1) <= max(page) - 10 THEN arg_max(page, event_id) FILTER (page >= 1) ELSE -1 END AS page FROM a GROUP BY tag HAVING count(*) FILTER (page >= 1) > 0", plain=True)
