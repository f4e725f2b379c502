"""Live outputs as streams: each job gives what its batch twin gives over the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators import memory


def read_outputs(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of the files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def outputs_to_memory(stream: DataFrame, work: DataFrame, out: str, checkpoint: str) -> None:
    """Writes what each batch of arriving outputs adds to the memory, and nothing that is in it: a batch that is run again
    after a failure writes the same folder.  ``current_memory`` lays the batches over the memory."""

    def merge(batch: DataFrame, number: int) -> None:
        memory.fresh_translations(work, batch).write.mode("overwrite").parquet(f"{out}/n={number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_memory(spark: SparkSession, out: str, start: DataFrame) -> DataFrame:
    """The memory that was there at the start with what the batches added; the last batch with a text counts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return start
    added = spark.read.schema("tag string, text string, vi string, n bigint").parquet(out)
    return memory.upsert(start, added.groupBy("tag", "text").agg(F.max_by("vi", "n").alias("vi")))


def generation_filter(stream: DataFrame, generations: DataFrame) -> DataFrame:
    """Outputs whose stamp is that of the current chunks; others are dropped, however late they come."""
    return stream.join(generations, ["tag"]).filter(F.col("stamp") == F.col("chunk_gen")).drop("chunk_gen")


def split_by_generation(stream: DataFrame, generations: DataFrame, out: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) outputs, each a table: what is stamped otherwise than the current chunks, or of a volume without
    any, is kept beside with the generation that it should have.  A batch that runs again writes the same folders."""
    fresh = F.coalesce(F.col("stamp") == F.col("chunk_gen"), F.lit(False))
    schema = stream.join(generations, ["tag"], "left").withColumn("batch", F.lit(0).cast("bigint")).schema

    def put(batch: DataFrame, number: int) -> None:
        marked = batch.join(generations, ["tag"], "left").withColumn("batch", F.lit(number).cast("bigint")).withColumn("fresh", fresh)
        for name, test in (("kept", "fresh"), ("rejected", "not fresh")):
            marked.filter(test).drop("fresh").write.mode("overwrite").parquet(f"{out}/{name}/n={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    read = lambda name: stream.sparkSession.read.schema(schema).parquet(f"{out}/{name}/*").drop("batch")
    return read("kept").drop("chunk_gen"), read("rejected")


def progress(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Units done and seen for each key."""
    return stream.groupBy(*keys).agg(F.count_if("done").alias("done"), F.count("*").alias("total"))


DAY = 24 * 3600 * 1000
STATE = "told boolean, last string"
EVENT = "run_id bigint, line_no bigint, pos bigint, type string, text string, error string"


def event_dedupe(stream: DataFrame, expires: bool = False) -> DataFrame:
    """Final texts after any text of their run, and errors that repeat the last, are dropped; the state of a run is
    whether it gave text and its last error.  Rows of a run must arrive in order of lines from batch to batch.  A run's
    state goes with its ``exit`` row and, where a state ``expires``, a day after its last row; that is for streams that
    run on, as the engine goes on looking for states to expire."""

    def one(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        told, last = state.get if state.exists else (False, None)
        rows = pd.concat(list(parts)).sort_values(["line_no", "pos"])
        keep = []
        for kind, error in zip(rows["type"], rows["error"]):
            if kind == "final" and told or kind == "error" and error == last:
                keep.append(False)
                continue
            keep.append(True)
            told = told or kind in ("final", "text_delta")
            last = error if kind == "error" else last
        if "exit" in set(rows["type"]):
            if state.exists:
                state.remove()
        else:
            state.update((told, last))
            if expires:
                state.setTimeoutDuration(DAY)
        rows = rows[keep].copy()
        rows["type"] = rows["type"].replace("final", "text_delta")
        yield rows

    return stream.groupBy("run_id").applyInPandasWithState(one, EVENT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if expires else GroupStateTimeout.NoTimeout)


REPAIR = "tag string, id bigint, version bigint, status string, run_sid string, error string"
REPAIR_STATE = "version bigint, status string, run_sid string, error string, at bigint"
#: A request without a run fails when nothing has come for so long.
IDLE = 30_000


def repair_states(stream: DataFrame, idle: int = IDLE, late: str = "10 seconds") -> DataFrame:
    """States of repair requests from their events: tag, id, seq, at (a time), event, run_sid, error.

    ``running`` opens a request, ``attached`` gives it a run, ``completed`` and ``failed`` end it once and for all,
    ``superseded`` fails one that has no run.  A request that has no run for longer than ``idle`` milliseconds of event
    time fails, whether its next event or the watermark shows it.  Each batch gives a request that changed one row;
    the highest version counts."""

    def one(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, status, sid, error, at = state.get if state.exists else (0, None, None, None, 0)
        before = (status, sid, error)
        waits = lambda: status == "running" and sid is None
        if state.hasTimedOut:
            if waits():
                status, error = "failed", "idle"
        else:
            rows = pd.concat(list(parts)).sort_values("seq")
            times = rows["at"].astype("datetime64[ms]").astype("int64")
            for event, now, run, why in zip(rows["event"], times, rows["run_sid"], rows["error"]):
                if waits() and now - at > idle:
                    status, error = "failed", "idle"
                if status is None:
                    status = "running" if event == "running" else None
                elif event == "attached":
                    sid = run
                elif status == "running" and event in ("completed", "failed"):
                    status, error = event, why if event == "failed" else None
                elif waits() and event == "superseded":
                    status, error = "failed", "superseded"
                at = max(at, int(now))
        changed = (status, sid, error) != before
        state.update((version + changed, status, sid, error, at))
        if waits():
            state.setTimeoutTimestamp(max(at + idle, state.getCurrentWatermarkMs() + 1))
        if changed:
            yield pd.DataFrame([(*key, version + 1, status, sid, error)], columns=["tag", "id", "version", "status", "run_sid", "error"])

    timed = stream.withWatermark("at", late)
    return timed.groupBy("tag", "id").applyInPandasWithState(one, REPAIR, REPAIR_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def latest_repairs(changes: DataFrame) -> DataFrame:
    """The last state of each request."""
    last = changes.groupBy("tag", "id").agg(F.max_by(F.struct("status", "run_sid", "error"), "version").alias("s"))
    return last.select("tag", "id", "s.*")


RESUMES = 3
EXIT = "tag string, seq bigint, clean bigint, resume boolean"


def early_exits(stream: DataFrame, most: int = RESUMES) -> DataFrame:
    """For each clean exit at a stage that isn't the last, how often its volume has been resumed and whether it may be
    again: ``tag, seq, event`` (start, stop or exit), ``rc``, ``over`` (the stage is the last).  A start by hand counts
    anew, a stop by hand uses all resumes up; other exits neither resume nor count.  A volume's state is one number;
    it goes where it is 0 and the work is over."""

    def one(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, out, done = state.get[0] if state.exists else 0, [], False
        for _, row in pd.concat(list(parts)).sort_values("seq").iterrows():
            done = False
            if row["event"] != "exit":
                count = 0 if row["event"] == "start" else most
            elif row["rc"] == 0 and row["over"]:
                done = True
            elif row["rc"] == 0:
                resume = count < most
                count += resume
                out.append((key[0], row["seq"], count, resume))
        if done and count == 0:
            if state.exists:
                state.remove()
        else:
            state.update((count,))
        yield pd.DataFrame(out, columns=["tag", "seq", "clean", "resume"])

    return stream.groupBy("tag").applyInPandasWithState(one, EXIT, "count bigint", "append", GroupStateTimeout.NoTimeout)


def to_table(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it appended."""
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def last_totals(stream: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """Runs running totals over all that is there; each batch rewrites the table."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    progress(stream, keys).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(out)


__all__ = ["current_memory", "early_exits", "event_dedupe", "generation_filter", "last_totals", "latest_repairs", "outputs_to_memory", "progress", "read_outputs", "repair_states", "split_by_generation", "to_table"]
