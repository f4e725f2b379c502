"""Mixture-controlled packing: deficit round-robin over source queues fills every window to the target proportions."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import common, tokens

WINDOW = 2048
#: Windows of one block: within it deficits pass from window to window, between blocks by closed form.
BLOCK = 512
#: Queues that are told apart; smaller sources share the last one.
QUEUES = 1024
END = 1
#: Rows of the table of queue offsets that are sent to all tasks at most; a larger one is joined by shuffle.
SENT = 500_000


class Mixture:
    """Which tokens of each queue every window takes.

    Queue q holds ``totals[q]`` tokens and is drained in proportion to ``weights[q]``; when it is empty the others
    share its place.  ``served(t)`` says in closed form what each queue has given once t tokens are placed, so that
    any block of windows can be laid out on its own and agrees with its neighbours."""

    def __init__(self, totals: list[int], weights: list[float] | None = None, window: int = WINDOW, block: int = BLOCK):
        self.totals = np.array(totals, dtype=np.int64)
        self.weights = np.array(totals if weights is None else weights, dtype=np.float64)
        if np.any(self.weights[self.totals > 0] <= 0):
            raise ValueError("a source with tokens needs a weight above 0")
        self.window, self.block, self.total = window, block, int(self.totals.sum())
        self.served = functools.lru_cache(4096)(self._served)
        self.laid = functools.lru_cache(256)(self._laid)

    def _given(self, time: float) -> np.ndarray:
        return np.floor(np.minimum(self.totals, self.weights * time) + 0.5).astype(np.int64)

    def _served(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens given by each queue when t are placed, and each queue's deficit then."""
        full = self.totals > 0
        lo, hi = 0.0, float(np.max(self.totals[full] / self.weights[full])) * 2 + 1 if full.any() else 1.0
        if t >= self.total:
            return self.totals.copy(), np.zeros(len(self.totals))
        while np.nextafter(lo, hi) < hi:
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if self._given(mid).sum() <= t else (lo, mid)
        given, more = self._given(lo), self._given(hi)
        spare = t - int(given.sum())
        for q in np.flatnonzero(more > given):
            step = min(spare, int(more[q] - given[q]))
            given[q] += step
            spare -= step
        return given, np.minimum(self.totals, self.weights * lo) - given

    def _laid(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """For the windows of block b: where each starts in every queue (one row more than windows), and the offset
        in the window at which each queue's part stands."""
        size = self.window * self.block
        (begin, deficit), (finish, _) = self.served(b * size), self.served(min((b + 1) * size, self.total))
        placed, left = b * size, finish - begin
        n = -(-int(left.sum()) // self.window)
        quantum, deficit = left / max(1, int(left.sum())) * self.window, deficit.copy()
        starts, offsets = np.zeros((n + 1, len(begin)), np.int64), np.zeros((n, len(begin)), np.int64)
        starts[0] = begin
        for j in range(n):
            room = min(self.window, int(left.sum()))
            deficit += quantum * (room / self.window)
            take = np.clip(np.floor(deficit), 0, left).astype(np.int64) if j < n - 1 else left.copy()
            spare = room - int(take.sum())
            while spare > 0:  # the largest deficits take a token each
                open_ = np.flatnonzero(left > take)
                order = open_[np.argsort(take[open_] - deficit[open_], kind="stable")][:spare]
                take[order] += 1
                spare -= len(order)
            while spare < 0:
                order = np.flatnonzero(take > 0)
                order = order[np.argsort(deficit[order] - take[order], kind="stable")][:-spare]
                take[order] -= 1
                spare += len(order)
            turn = (placed // self.window + j) % max(1, len(take))  # whose turn is first goes round
            offsets[j] = np.roll(np.cumsum(np.roll(take, -turn)) - np.roll(take, -turn), turn)
            deficit -= take
            left = left - take
            starts[j + 1] = starts[j] + take
        return starts, offsets

    def windows(self, queue: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, window, offset there) of the queue's parts that cover tokens begin to end."""
        size = self.window * self.block
        lo, hi = 0, max(0, (self.total - 1) // size)
        while lo < hi:  # the last block that starts at or before ``begin``
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.served(mid * size)[0][queue] <= begin else (lo, mid - 1)
        out = []
        while True:
            starts, offsets = self.laid(lo)
            some = starts[1:, queue] > starts[:-1, queue]
            out.append((starts[:-1, queue][some], lo * self.block + np.flatnonzero(some), offsets[some, queue]))
            if starts[-1, queue] >= end or (lo + 1) * size >= self.total:
                return tuple(np.concatenate(x) for x in zip(*out))
            lo += 1


def id_kind(ids: int) -> str:
    """The least kind of integer that holds so many ids."""
    return "<u2" if ids <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, path: str, end: int) -> DataFrame:
    """One row for each document: its part of the input, its source, its ids and the tokens of its source before it
    in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, row = TaskContext.get().partitionId(), {}, 0
        enc = tokens.encoder(path)
        kind = id_kind(max(enc.tokenizer.get_vocab_size(True), end + 1))
        for batch in batches:
            sources = batch.column("source").to_pylist()
            for first, ids, sizes in enc.encode(batch.column("text"), end):
                n = len(sizes)
                before = []
                for s, size in zip(sources[first : first + n], sizes.tolist()):
                    before.append(seen.get(s, 0))
                    seen[s] = before[-1] + size
                short = ids.astype(kind)
                offsets = pa.py_buffer(np.concatenate(([0], np.cumsum(short.itemsize * sizes))).astype(np.int32))
                data = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(short)])
                rows = slice(first, first + n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), batch.column("doc_id")[rows], batch.column("source")[rows], pa.array(before, pa.int64()), pa.array(sizes), data],
                    ["part", "row", "doc_id", "source", "before", "n_tokens", "ids"],
                )
                row += n

    schema = "part int, row bigint, doc_id bigint, source string, before bigint, n_tokens bigint, ids binary"
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return docs.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, weights: dict[str, float] | None = None, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """Packs all documents (``doc_id``, ``text``, ``source``; other columns are ignored) into sequences of ``window``
    tokens; only the last may be shorter.  Each source is a queue of tokens.  Deficit round-robin gives every window
    the target share of each queue (``weights``, or each source's share of all tokens), and what a queue is owed
    passes to the next window; a block of windows starts from the deficits that a closed form gives for its place,
    so blocks are laid out independently and no token stream passes through one task.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source (and with
    ``with_ids`` the ids as little-endian 32-bit binary).  A null or empty text is its end id alone; a null source is
    a queue of its own; null or repeated doc_ids are packed like any others, row by row; an empty table gives no
    rows.  Past QUEUES sources, the smaller ones share a queue."""
    spark, path = docs.sparkSession, path or tokens.default_path()
    scratch = common.Scratch(spark, "packing")
    held = scratch.keep(tokenised(docs, path, end), "tokens")
    sums = held.groupBy("part", "source").agg(F.sum("n_tokens").alias("n"))
    sums = scratch.keep(sums, "sums")
    ranked = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("source"))
    named = [(r["source"], int(r["n"])) for r in ranked.limit(QUEUES - 1).collect()]
    rest = int(sums.agg(F.sum("n")).first()[0] or 0) - sum(n for _, n in named)
    queue_of = {s: q for q, (s, _) in enumerate(named)}
    totals = [n for _, n in named] + ([rest] if rest else [])
    share = [weights.get(s, 0.0) for s, _ in named] + ([weights.get(None, 1.0)] if rest else []) if weights else None
    mixture = Mixture(totals, share, window)
    queues = spark.createDataFrame([(s, q) for s, q in queue_of.items()], "source string, queue int") if named else spark.createDataFrame([], "source string, queue int")
    placed = sums.join(F.broadcast(queues), sums["source"].eqNullSafe(queues["source"]), "left").select("part", sums["source"].alias("source"), F.coalesce("queue", F.lit(len(named))).alias("queue"), "n")
    order = Window.partitionBy("queue").orderBy("part", F.asc_nulls_first("source")).rowsBetween(Window.unboundedPreceding, -1)
    base = placed.select("part", F.col("source").alias("_source"), "queue", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    if base.limit(SENT + 1).count() <= SENT:  # a row for each source of each part of the input
        base = F.broadcast(base)
    held = held.join(base, (held["part"] == base["part"]) & held["source"].eqNullSafe(base["_source"])).select(held["part"], "queue", "doc_id", "source", (F.col("base") + F.col("before")).alias("first"), "n_tokens", "ids")
    total, (totals_, weights_) = mixture.total, (mixture.totals.tolist(), mixture.weights.tolist())
    del mixture

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = Mixture(totals_, weights_, window)
        for batch in batches:
            firsts, sizes, queue = (batch.column(c).to_numpy() for c in ("first", "n_tokens", "queue"))
            ids = batch.column("ids")
            for q in np.unique(queue):
                rows = np.flatnonzero(queue == q)
                rows = rows[np.argsort(firsts[rows], kind="stable")]
                gaps = np.flatnonzero(firsts[rows][1:] != firsts[rows][:-1] + sizes[rows][:-1]) + 1
                for run in np.split(rows, gaps):
                    begin, stop = int(firsts[run[0]]), int(firsts[run[-1]] + sizes[run[-1]])
                    edge, seq, at = mix.windows(int(q), begin, stop)
                    points = np.unique(np.concatenate([firsts[run], edge[(edge > begin) & (edge < stop)]]))
                    doc = np.searchsorted(firsts[run], points, "right") - 1
                    win = np.searchsorted(edge, points, "right") - 1
                    start, length = points - firsts[run][doc], np.diff(np.append(points, stop))
                    held_ids = [memoryview(np.frombuffer(ids[int(r)].as_buffer(), f"<u{len(ids[int(r)].as_buffer()) // sizes[r]}").astype("<u4")).cast("B") for r in run]
                    parts = [held_ids[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
                    which = pa.array(run[doc])
                    cols = [batch.column("doc_id").take(which), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array(sizes[run][doc]), pa.array(seq[win]), pa.array(at[win] + points - edge[win]), batch.column("source").take(which)]
                    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
                    if with_ids:
                        cols, names = [*cols, pa.array([bytes(x) for x in parts], pa.binary())], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string"
    return held.mapInArrow(cut, schema + (", ids binary" if with_ids else "")) if total else spark.createDataFrame([], schema + (", ids binary" if with_ids else ""))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
