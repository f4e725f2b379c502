"""Agent event logs, conversations and what readers leave: one job over all runs or volumes each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.layout import of_page

CONTENT = "struct<message:struct<content:array<struct<type:string,text:string,name:string,id:string>>>>"
RESUME = r"(?i)no conversation found|session .*not found|resume failed|no rollout found|thread .*not found"


def unwrap_error(text: Column, depth: int = 3) -> Column:
    """The message inside nested JSON error texts, at most ``depth`` levels down."""
    out = F.trim(text)
    for _ in range(depth):
        inner = F.coalesce(F.get_json_object(out, "$.error.message"), F.get_json_object(out, "$.message"))
        out = F.when(out.startswith("{") & (F.trim(inner) != ""), F.trim(inner)).otherwise(out)
    return out


def _event(kind: str, test: Column, **fields: Column) -> Column:
    names = ("text", "name", "session_id", "error", "code")
    return F.when(test, F.array(F.struct(F.lit(kind).alias("type"), *(fields.get(n, F.lit(None).cast("string")).alias(n) for n in names))))


def agent_events(log: DataFrame) -> DataFrame:
    """(run_id, line_no, pos, type, text, name, session_id, error, code) from logs (run_id, engine, line_no, line) in
    three dialects.  Lines that aren't JSON and unknown types give nothing; text that was streamed isn't taken again
    from the final message, and an error that repeats the last one is dropped."""
    g = lambda path: F.get_json_object("line", path)
    rows = log.withColumn("t", g("$.type"))
    a, b, c = (F.col("engine") == e for e in ("claude", "codex", "grok"))
    whole = F.array_size(F.from_json("line", CONTENT)["message"]["content"])
    some = lambda x: x.isNotNull() & (x != "")
    delta, result = g("$.event.delta.text"), g("$.result")
    parts = F.transform(
        F.from_json("line", CONTENT)["message"]["content"],
        lambda x: F.struct(F.when(x["type"] == "tool_use", "tool_call").when((x["type"] == "text") & (x["text"] != ""), "final").alias("type"), x["text"].alias("text"), F.when(x["type"] == "tool_use", F.coalesce(x["name"], F.lit("tool"))).alias("name"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("code")),
    )
    dead = (g("$.is_error") == "true") & (g("$.num_turns") == "0") & (g("$.duration_api_ms") == "0")
    fault = unwrap_error(F.coalesce(F.nullif(F.trim(g("$.error.message")), F.lit("")), g("$.message")))
    branches = [
        _event("text_delta", a & (F.col("t") == "stream_event") & (g("$.event.type") == "content_block_delta") & some(delta), text=delta),
        F.when(a & (F.col("t") == "assistant") & (whole > 0), F.filter(parts, lambda x: x["type"].isNotNull())),
        _event("session", ((a & F.col("t").isin("result", "system")) & some(g("$.session_id"))), session_id=g("$.session_id")),
        _event("error", a & (F.col("t") == "result") & (g("$.is_error") == "true"), error=F.coalesce(F.nullif(result, F.lit("")), F.lit("failed")), code=F.when(dead, "resume_failed")),
        _event("session", b & (F.col("t") == "thread.started") & some(g("$.thread_id")), session_id=g("$.thread_id")),
        _event("text_delta", b & (F.col("t") == "item.completed") & (g("$.item.type") == "agent_message") & some(g("$.item.text")), text=g("$.item.text")),
        _event("tool_call", b & (F.col("t") == "item.completed") & g("$.item.type").isin("command_execution", "mcp_tool_call", "file_change"), name=F.coalesce(g("$.item.command"), g("$.item.tool"), g("$.item.type"))),
        _event("error", b & F.col("t").isin("error", "turn.failed") & some(fault), error=fault, code=F.when(fault.rlike(RESUME), "resume_failed")),
        _event("text_delta", c & (F.col("t") == "text") & some(g("$.data")), text=g("$.data")),
        _event("tool_call", c & F.contains("t", F.lit("tool")), name=F.coalesce(g("$.name"), g("$.data"), F.col("t"))),
        _event("session", c & (F.col("t") == "end") & some(g("$.sessionId")), session_id=g("$.sessionId")),
    ]
    events = F.flatten(F.array_compact(F.array(*branches)))
    rows = rows.select("run_id", "engine", "line_no", F.posexplode(events).alias("pos", "e")).select("run_id", "engine", "line_no", F.col("pos").cast("bigint").alias("pos"), "e.*")
    return error_dedupe(partial_text_dedupe(rows)).drop("engine")


def partial_text_dedupe(events: DataFrame) -> DataFrame:
    """A final text stays only where its run gave no text before it; it then counts as streamed."""
    before = Window.partitionBy("run_id").orderBy("line_no", "pos").rowsBetween(Window.unboundedPreceding, -1)
    told = F.coalesce(F.max(F.col("type").isin("text_delta", "final").cast("int")).over(before), F.lit(0))
    rows = events.withColumn("_told", told).filter((F.col("type") != "final") | (F.col("_told") == 0)).drop("_told")
    return rows.withColumn("type", F.when(F.col("type") == "final", "text_delta").otherwise(F.col("type")))


def error_dedupe(events: DataFrame) -> DataFrame:
    """An error that equals the last one of its run goes, where the dialect repeats itself."""
    errors = Window.partitionBy("run_id", "type").orderBy("line_no", "pos")
    again = (F.col("type") == "error") & (F.col("engine") == "codex") & F.col("error").eqNullSafe(F.lag("error").over(errors))
    return events.withColumn("_again", again).filter(~F.col("_again")).drop("_again")


def chat_projection(events: DataFrame) -> DataFrame:
    """What a chat shows of each event; sessions and failed resumptions stay hidden."""
    kind = F.when(F.col("type") == "text_delta", "delta").when(F.col("type") == "tool_call", "tool").when((F.col("type") == "error") & F.coalesce(F.col("code") != "resume_failed", F.lit(True)), "error")
    text = F.when(F.col("type") == "tool_call", F.concat(F.lit("🔧 "), "name")).otherwise(F.coalesce("text", "error"))
    return events.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("run_id", "line_no", "pos", "kind", text.alias("shown"))


def transcript(events: DataFrame) -> DataFrame:
    """The whole text of each run and its last session."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "text_delta", F.struct("line_no", "pos", "text")))), lambda x: x["text"]), "")
    return events.groupBy("run_id").agg(texts.alias("text"), F.max_by("session_id", F.when(F.col("type") == "session", F.struct("line_no", "pos"))).alias("session_id"))


def exit_event(runs: DataFrame, events: DataFrame) -> DataFrame:
    """How each run (run_id, rc, signal, timeout, cancelled, spawn_error, stderr) ended, by the first cause that holds:
    it never began, ran out of time, was cancelled (whatever signal ended it), died by a signal, or gave a code that isn't 0.
    A run that died by a signal has no code.  An error that the log told already isn't told again."""
    failed = events.groupBy("run_id").agg(F.bool_or(F.col("type") == "error").alias("_e"))
    rows = runs.join(failed, "run_id", "left").withColumn("_e", F.coalesce("_e", F.lit(False)))
    tail = F.nullif(F.right(F.trim("stderr"), F.lit(600)), F.lit(""))
    lost, late, off = F.col("spawn_error").isNotNull(), F.col("timeout"), F.col("cancelled")
    killed, bad = F.col("signal").isNotNull() & F.col("rc").isNull(), F.coalesce(F.col("rc") != 0, F.lit(False))
    resume = F.coalesce(F.col("stderr").rlike(RESUME), F.lit(False))
    reason = F.when(lost | late, "error").when(off, "cancelled").when(killed | bad, "error").otherwise("completed")
    error = F.when(lost, F.col("spawn_error")).when(late, "timeout").when(off, None)
    error = error.when(killed, F.coalesce(tail, F.concat(F.lit("signal "), "signal"))).when(bad & resume, "resume failed").when(bad & ~F.col("_e"), F.coalesce(tail, F.concat(F.lit("code "), F.col("rc").cast("string"))))
    code = F.when(lost, "spawn_failed").when(late, "timeout").when(off | killed, None).when(bad & resume, "resume_failed")
    return rows.select("run_id", reason.alias("reason"), error.alias("error"), code.alias("code"))


def conversation_list(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations of each volume with their number of messages, newest first."""
    counts = messages.groupBy("conversation_id").agg(F.count("*").alias("messages"))
    order = Window.partitionBy("tag").orderBy(F.desc("updated_at"), F.desc("conversation_id"))
    rows = conversations.join(counts, "conversation_id", "left").withColumn("messages", F.coalesce("messages", F.lit(0)))
    return rows.withColumn("place", F.row_number().over(order).cast("bigint")).select("tag", "conversation_id", "messages", "place")


def conversation_detail(messages: DataFrame) -> DataFrame:
    """Roles and texts of each conversation in order."""
    rows = F.array_sort(F.collect_list(F.struct("position", F.concat_ws(": ", "role", "text").alias("m"))))
    return messages.groupBy("conversation_id").agg(F.array_join(F.transform(rows, lambda x: x["m"]), "\n").alias("thread"))


def replace_children(parent: DataFrame, incoming: DataFrame) -> DataFrame:
    """All rows of the keys that come in replaced by theirs."""
    return parent.join(incoming.select("conversation_id").distinct(), "conversation_id", "left_anti").unionByName(incoming)


def annotations_valid(rows: DataFrame) -> DataFrame:
    """Annotations whose page, side, kind, text and rectangles are in order."""
    inside = F.forall("rects", lambda r: (r["x"] >= 0) & (r["y"] >= 0) & (r["width"] > 0) & (r["height"] > 0) & (r["x"] + r["width"] <= 1) & (r["y"] + r["height"] <= 1))
    ok = (F.col("page") >= 1) & F.col("side").isin("source", "translation") & F.col("kind").isin("highlight", "note") & (F.trim("text") != "")
    ok &= F.size("rects").between(1, 256) & inside & ((F.col("kind") != "note") | (F.trim(F.coalesce("note", F.lit(""))) != ""))
    return rows.filter(F.coalesce(ok, F.lit(False)))


def annotations_upsert(old: DataFrame, new: DataFrame, most: int = 2000) -> DataFrame:
    """Old annotations with the new ones in place of those of the same id, the newest of each volume."""
    rows = old.join(new.select("tag", "id"), ["tag", "id"], "left_anti").unionByName(new)
    nth = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("created_at"), F.desc("id")))
    return rows.withColumn("_r", nth).filter(F.col("_r") <= most).drop("_r")


def annotation_segment(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """The smallest segment box that holds each point; points count pages from 1, boxes from 0."""
    holds = lambda b: F.col("x").between(b["x0"], b["x1"]) & F.col("y").between(b["y0"], b["y1"])
    area = lambda b: (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
    best = F.array_min(F.transform(F.filter("_near", holds), lambda b: F.struct(area(b).alias("area"), b["id"].alias("segment"))))
    near = of_page(boxes, "id", "x0", "y0", "x1", "y1").withColumn("page", F.col("page") + 1)
    hit = points.join(near, ["tag", "page"]).select("tag", "id", best.alias("best")).filter("best is not null")
    return hit.groupBy("tag", "id").agg(F.min("best").alias("best")).select("tag", "id", "best.segment")


def bookmarks_latest(marks: DataFrame, pages: DataFrame) -> DataFrame:
    """The last page noted for each volume, null beyond its last page."""
    last = marks.filter(F.col("page") >= 1).groupBy("tag").agg(F.max_by("page", F.struct("at", "seq")).alias("page"))
    return last.join(pages, "tag", "left").select("tag", F.when(F.col("pages").isNull() | (F.col("page") <= F.col("pages")), F.col("page")).alias("page"))
