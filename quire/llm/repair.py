"""Token-id files compressed by Re-Pair grammars, with random access by expansion lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import common, tokens

END = 2
#: Ids of one grammar; a document is never divided, so a longer one has a grammar of its own.
BLOCK_IDS = 1_000_000
#: Uses that a pair needs for a rule of its own: a rule takes 12 bytes of a file, each use saves 2 before compression.
LEAST = 12


def frequent(seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(those of the places ``at`` whose pair of neighbours stands at LEAST of them without overlap, rank of each pair,
    0 for the most frequent)."""
    left, right = seq[at], seq[at + 1]
    twin = np.flatnonzero(left == right)  # of a run of one symbol every other place counts
    if len(twin):
        row = np.flatnonzero(np.diff(at[twin], prepend=-2) != 1)
        odd = (np.arange(len(twin)) - np.repeat(row, np.diff(np.append(row, len(twin))))) % 2 == 1
        keep = np.ones(len(at), bool)
        keep[twin[odd]] = False
        at, left, right = at[keep], left[keep], right[keep]
    if len(at) > SORTED:  # a table of hashes rules most rare pairs out before the rest are sorted
        slot = ((left * np.uint32(2654435761) ^ right * np.uint32(2246822519)) * np.uint32(3266489917)) >> np.uint32(12)
        keep = (np.bincount(slot, minlength=1 << 20) >= LEAST)[slot]
        at, left, right = at[keep], left[keep], right[keep]
    pair = left.astype(np.uint64) << np.uint64(32) | right
    order = np.argsort(pair)
    pair = pair[order]
    head = np.flatnonzero(np.insert(pair[1:] != pair[:-1], 0, True)) if len(pair) else np.zeros(0, np.int64)
    counts = np.diff(np.append(head, len(pair)))
    rank = np.empty(len(head), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(head))
    some = np.repeat(counts >= LEAST, counts)
    at, rank = at[order[some]], np.repeat(rank, counts)[some]
    order = np.argsort(at)
    return at[order], rank[order]


#: Places from which on pairs are counted by hash first.
SORTED = 100_000


def compress(ids: np.ndarray, first_free: int) -> tuple[np.ndarray, np.ndarray]:
    """(rules, sequence): rule i stands for a pair of symbols and is written as first_free + i.  Goes on until no pair
    stands at LEAST places.

    Every pass replaces all frequent pairs at once; where two overlap, the more frequent one.  A pair can only become
    frequent next to a new symbol, so a pass looks at those places and at what the last one left over."""
    seq, rules = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)]
    n_rules, active = 0, np.arange(max(0, len(seq) - 1))
    while len(active):
        at, rank = frequent(seq, active)
        if not len(at):
            break
        beside = np.diff(at) == 1
        wins = np.ones(len(at), bool)
        wins[1:] &= ~beside | (rank[1:] < rank[:-1])
        wins[:-1] &= ~beside | (rank[:-1] < rank[1:])
        uses = np.bincount(rank[wins], minlength=int(rank.max()) + 1)
        wins &= uses[rank] >= LEAST  # the most frequent pair of all keeps all its places
        take = at[wins]
        used, one = uses >= LEAST, np.zeros(len(uses), np.int64)
        one[rank[wins]] = take
        one = one[used]
        rules.append(np.stack([seq[one], seq[one + 1]], 1))
        seq[take] = (first_free + n_rules - 1 + np.cumsum(used)[rank[wins]]).astype(np.uint32)
        n_rules += len(one)
        keep = np.ones(len(seq), bool)
        keep[take + 1] = False
        seq = seq[keep]
        spared = at[~wins]
        before = np.searchsorted(take, spared)
        edge = np.concatenate((take, [-9]))
        spared = (spared - before)[(edge[before - 1] + 1 != spared) & (edge[before] - 1 != spared)]
        new = take - np.arange(len(take))
        live = np.zeros(len(seq) + 1, bool)  # the last one for what stands before the first place
        live[spared] = live[new] = live[new - 1] = True
        active = np.flatnonzero(live[: len(seq) - 1])
    return np.concatenate(rules), seq


def expansion_lengths(rules: np.ndarray, first_free: int) -> np.ndarray:
    """Rules only name earlier ones; each round takes those whose parts are known."""
    parts = np.where(rules < first_free, 0, rules.astype(np.int64) - first_free + 1)
    lengths = np.concatenate(([1], np.zeros(len(rules), np.int64)))
    while (open_ := np.flatnonzero(lengths == 0)).size:
        both = lengths[parts[open_ - 1]]
        lengths[open_] = np.where((both > 0).all(1), both.sum(1), 0)
    return lengths[1:]


def expand(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_free: int) -> np.ndarray:
    """The ids that a run of symbols stands for; each round replaces every rule by its pair."""
    out = seq.astype(np.uint32)
    while len(at := np.flatnonzero(out >= first_free)):
        pair = rules[out[at] - np.uint32(first_free)]
        wide = np.repeat(out, 1 + (out >= first_free))
        to = at + np.arange(len(at))
        wide[to], wide[to + 1] = pair[:, 0], pair[:, 1]
        out = wide
    return out


def between(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_free: int, begin: int, end: int) -> np.ndarray:
    """Ids begin to end of a block: only the symbols that cover them are expanded."""
    rule = seq >= first_free
    sizes = np.ones(len(seq), np.int64)
    sizes[rule] = lengths[seq[rule].astype(np.int64) - first_free]
    ends = np.cumsum(sizes)
    a, b = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end, "left") + 1
    skip = begin - (ends[a - 1] if a else 0)
    return expand(seq[a:b], rules, lengths, first_free)[skip : skip + end - begin]


FILE = "shard int, block int, n_ids bigint, first_free bigint, rules binary, lengths binary, width int, symbols binary, doc_ids array<bigint>, doc_sizes array<bigint>"


def _rows(doc_ids: list, sizes: list, ids: list, shard: int, block: int, first_free: int) -> pa.RecordBatch:
    whole = np.concatenate(ids)
    rules, seq = compress(whole, first_free)
    width = 2 if first_free + len(rules) <= 1 << 16 else 4
    row = {"shard": shard, "block": block, "n_ids": len(whole), "first_free": first_free, "rules": rules.astype("<u4").tobytes(), "lengths": expansion_lengths(rules, first_free).astype("<u4").tobytes(), "width": width, "symbols": seq.astype(f"<u{width}").tobytes(), "doc_ids": doc_ids, "doc_sizes": sizes}
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds)], list(row))


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end: int = END, shards: int | None = None) -> None:
    """Encodes ``text`` of each document and writes the ids to ``folder``, in ascending order of ``doc_id``.

    A file is Parquet; each row is a block of whole documents: the grammar's rules, the length that each rule expands
    to, the symbols left, and the documents' ids and sizes.  A shard is a range of doc_ids, so a hot source or long
    documents only make more blocks.  Null and empty texts are written as their end id alone, null doc_ids come
    first, rows that share a doc_id stand in the order of their texts, an empty table gives no blocks, and other
    columns are ignored."""
    path = path or tokens.default_path()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = shards or max(1, docs.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, enc = TaskContext.get().partitionId(), 0, tokens.encoder(path)
        first_free = enc.tokenizer.get_vocab_size(True)
        first_free = max(first_free, end + 1)
        held: tuple[list, list, list] = ([], [], [])
        n = 0
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, ids, sizes in enc.encode(batch.column("text"), end):
                held[0].extend(doc_ids[first : first + len(sizes)])
                held[1].extend(sizes.tolist())
                held[2].append(ids)
                n += len(ids)
                if n >= BLOCK_IDS:
                    yield _rows(*held, shard, block, first_free)
                    held, n, block = ([], [], []), 0, block + 1
        if n:
            yield _rows(*held, shard, block, first_free)

    ordered = docs.repartitionByRange(shards, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    ordered.mapInArrow(run, FILE).write.mode("overwrite").option("compression", "zstd").parquet(folder)


def _grammar(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    return np.frombuffer(row["symbols"], f"<u{row['width']}").astype(np.uint32), rules, np.frombuffer(row["lengths"], "<u4").astype(np.int64), row["first_free"]


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """A row for each document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and
    with ``with_ids`` the ids as little-endian 32-bit binary."""
    files = spark.read.schema(FILE).parquet(folder)
    sizes = files.select("shard", "block", "n_ids")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("shard_base", before(Window.orderBy("shard"))).drop("n")
    blocks = sizes.withColumnRenamed("n_ids", "n").withColumn("block_base", before(Window.partitionBy("shard").orderBy("block"))).drop("n")
    base = blocks.join(shards, "shard").select("shard", "block", (F.col("shard_base") + F.col("block_base")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = expand(*_grammar(row)).astype("<u4")
                n = np.array(row["doc_sizes"], np.int64)
                ends = np.cumsum(n)
                view = memoryview(ids).cast("B")
                parts = [view[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist())]
                cols = [pa.array([row["shard"]] * len(n), pa.int32()), pa.array([row["block"]] * len(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - n), pa.array(n), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                names = ["shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([bytes(x) for x in parts], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    docs = files.mapInArrow(run, "shard int, block int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else ""))
    out = docs.join(base, ["shard", "block"]).withColumn("start", F.col("base") + F.col("inside"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def fetch_ids(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this id; only their blocks are read and only their symbols expanded."""
    out = []
    for r in spark.read.schema(FILE).parquet(folder).filter(F.array_contains("doc_ids", doc_id)).toLocalIterator():
        row = r.asDict()
        ends = np.cumsum(row["doc_sizes"])
        for i, d in enumerate(row["doc_ids"]):
            if d == doc_id:
                out.append(between(*_grammar(row), int(ends[i] - row["doc_sizes"][i]), int(ends[i])).tolist())
    return out


def op10_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.Scratch(spark, 'repair').root}/ids"
    write_ids(common.table(spark, sf_dir, "documents"), folder)
    return read_ids(spark, folder)
