"""States of streams over batches that arrive one after the other."""

import datetime
import os

from pyspark.sql import functions as F

from quire.streaming import jobs


def arrive(spark, tmp_path, batches, schema):
    """A stream that reads one batch after the other."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        newest = max((tmp_path / "in").glob("part-*"), key=lambda f: f.stat().st_mtime_ns)
        os.utime(newest, (1_000_000 + n, 1_000_000 + n))
    return jobs.read_outputs(spark, f"file://{tmp_path}/in", spark.createDataFrame([], schema).schema)


REQUESTS = "tag string, id bigint, seq bigint, at timestamp, event string, run_sid string, error string"


def at(second):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=second)


def test_requests_end_once(spark, tmp_path):
    event = lambda id_, seq, second, kind, run=None, error=None: ("a", id_, seq, at(second), kind, run, error)
    batches = [
        [event(1, 1, 0, "running"), event(1, 2, 1, "attached", "sid-1"), event(2, 3, 0, "running"), event(3, 4, 0, "running"), event(4, 5, 0, "completed")],
        [event(1, 6, 5, "completed"), event(3, 7, 20, "superseded"), event(5, 8, 20, "running")],
        [event(1, 9, 6, "failed", error="late duplicate event"), event(3, 10, 21, "completed"), event(6, 11, 1000, "running")],
        [event(6, 12, 1001, "attached", "sid-6")],
        [event(6, 13, 5000, "failed", error="broken")],
    ]
    changes = jobs.repair_states(arrive(spark, tmp_path, batches, REQUESTS))
    table = jobs.to_table(changes, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    got = {r.id: (r.status, r.run_sid, r.error) for r in jobs.latest_repairs(table).collect()}
    # 2 and 5 never hear of a run: the watermark ends them
    assert got == {1: ("completed", "sid-1", None), 2: ("failed", None, "idle"), 3: ("failed", None, "superseded"), 5: ("failed", None, "idle"), 6: ("failed", "sid-6", "broken")}


def test_resumes_are_counted_over_batches(spark, tmp_path):
    row = lambda seq, event="exit", rc=0, over=False: ("a", seq, event, rc, over)
    batches = [[row(1), row(2, rc=1), row(3)], [row(4), row(5)], [row(6, "start"), row(7), row(8, over=True)], [row(9, "stop"), row(10)]]
    stream = jobs.early_exits(arrive(spark, tmp_path, batches, "tag string, seq bigint, event string, rc bigint, over boolean"))
    rows = jobs.to_table(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").orderBy("seq").collect()
    assert [(r.seq, r.clean, r.resume) for r in rows] == [(1, 1, True), (3, 2, True), (4, 3, True), (5, 3, False), (7, 1, True), (10, 3, False)]


def test_a_run_is_forgotten_at_its_exit(spark, tmp_path):
    row = lambda n, kind, error=None: (1, n, 0, kind, None, error)
    batches = [[row(1, "error", "x"), row(2, "final")], [row(3, "error", "x"), row(4, "final"), row(5, "exit")], [row(6, "error", "x"), row(7, "final")]]
    rows = jobs.to_table(jobs.event_dedupe(arrive(spark, tmp_path, batches, jobs.EVENT)), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").collect()
    assert sorted(r.line_no for r in rows) == [1, 2, 5, 6, 7]


def test_rejected_outputs_are_kept_beside(spark, tmp_path):
    batches = [[("a", "0", "g1"), ("a", "1", "old")], [("b", "0", "g1"), ("a", "2", None)]]
    generations = spark.createDataFrame([("a", "g1")], "tag string, chunk_gen string")
    kept, rejected = jobs.split_by_generation(arrive(spark, tmp_path, batches, "tag string, idx string, stamp string"), generations, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    assert [tuple(r) for r in kept.select("tag", "idx").collect()] == [("a", "0")]
    assert sorted(tuple(r) for r in rejected.select("tag", "idx", F.coalesce("chunk_gen", F.lit("-"))).collect()) == [("a", "1", "g1"), ("a", "2", "g1"), ("b", "0", "-")]


def test_batches_write_what_they_add_to_the_memory(spark, tmp_path):
    """A later batch counts, also for a text that the memory had; no batch writes the memory again."""
    work = spark.createDataFrame([("a", "000", i, f"t{i}", f"text {i}") for i in range(3)], "tag string, idx string, pos bigint, id string, text string")
    start = spark.createDataFrame([("a", "text 0", "old"), ("a", "other", "kept"), ("b", "text 1", "kept")], "tag string, text string, vi string")
    batches = [[("a", "000", '{"t0": "first", "t1": "first"}')], [("a", "000", '{"t1": "second", "t2": "second"}')], [("a", "000", "[]"), ("c", "000", '{"t0": "none"}')]]
    out = f"file://{tmp_path}/out"
    assert jobs.current_memory(spark, out, start).count() == 3
    jobs.outputs_to_memory(arrive(spark, tmp_path, batches, "tag string, idx string, raw string"), work, out, f"file://{tmp_path}/checkpoint")
    got = {(r.tag, r.text): r.vi for r in jobs.current_memory(spark, out, start).collect()}
    assert got == {("a", "text 0"): "first", ("a", "text 1"): "second", ("a", "text 2"): "second", ("a", "other"): "kept", ("b", "text 1"): "kept"}
    assert spark.read.parquet(out).count() == 4
