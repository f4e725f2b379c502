"""Near-duplicate documents by a chosen-path set similarity join over word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common
from quire.llm.components import components

#: Minwise values of a document, 8 bits of each; how many two documents must share to be compared in full: at
#: similarity 0.8 a pair shares 205 on average and fewer than 176 once in 300,000.
VALUES, SHARED = 256, 176
#: Independent trees, children that each document enters at a node, documents that the nodes of the first counted level
#: hold on average at most, and documents of a node that are compared one by one.
TREES, BRANCHES, USUAL, SMALL = 4, 2, 2, 96
#: Nodes of the first counted level from which on all documents are compared with the PIVOTS central ones, and the minwise
#: values that say which are central; documents outside a node's largest component that are compared with all of it, so many
#: at once; levels after which large nodes are compared in blocks.
HUB, PIVOTS, CENTRAL, FEW, BLOCK, DEPTH = 256, 4, 32, 1024, 384, 6
#: The last minwise values travel with the documents of small nodes.  Rounds of comparison: of these, values that a
#: pair must share (at similarity 0.8 it shares 51 on average and fewer than 36 once in 300,000), and partners that a
#: document is tied to in a node.
SHORT, ROUNDS = 64, ((50, 2), (43, 16), (36, None))
#: Numbers that are sent to all tasks at most; more are joined by shuffle.
SENT = 1_000_000
#: Rows that a Python worker is sent at once, as texts and sets may be long; rows of small nodes that are compared at once.
SENT_ROWS, COMPARED = 1024, 10_000
#: Bytes of full sets that are sent to all tasks at most.
SENT_BYTES = 24_000_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


_FACTORS = mix(np.arange(1, VALUES + 1, dtype=_U)) | _U(1)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles of ``size`` words; A-Z are lower-cased.  Fewer words make
    one shingle of them all, none an empty set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=_U)
    if not len(h):
        return h
    size = min(size, len(h))
    total = np.full(len(h) - size + 1, size, dtype=_U)
    for i in range(size):
        total = mix(total + h[i : len(h) - size + 1 + i])
    return np.unique(total)


def minwise(hashes: np.ndarray) -> np.ndarray:
    """8 bits of the least value under each of VALUES permutations."""
    least = np.full(VALUES, ~_U(0))
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[None, at : at + 1024] * _FACTORS[:, None]).min(1))
    return (mix(least) >> _U(56)).astype(np.uint8)


def binary(rows: np.ndarray) -> pa.Array:
    """A matrix as one binary value a row."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def values(column: pa.Array, width: int = VALUES) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document: its set's size, a fingerprint and minwise values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py(), size)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                sigs.append(minwise(s))
            sig = binary(np.array(sigs, np.uint8).reshape(-1, VALUES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), sig], ["doc_id", "text_hash", "n", "key", "sig"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id bigint, text_hash bigint, n bigint, key bigint, sig binary")


def children(node: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """(rows, BRANCHES): at each node the same few minwise positions are chosen; a document enters the child of its
    value there."""
    first, step = mix(node) % _U(VALUES), (mix(node + _U(1)) | _U(1)) % _U(VALUES)
    rows = np.arange(len(node))
    out = [mix(mix(node + place + _U(7)) + sig[rows, place].astype(_U)) for place in ((first + _U(j) * step) % _U(VALUES) for j in range(BRANCHES))]
    return np.stack(out, 1)


def enter(rows: DataFrame, trees: int | None, levels: int, extra: str = "") -> DataFrame:
    """(node, id, and ``extra`` columns) of the nodes so many levels below each row's node, or with ``trees`` below so
    many roots."""
    kinds = {"n": "bigint", "comp": "bigint", "sig": "binary"}
    more = extra.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, at = values(batch.column("sig")), np.arange(batch.num_rows)
            if trees:
                at = np.repeat(at, trees)
                node = np.tile(mix(np.arange(1, trees + 1, dtype=_U)), batch.num_rows)
            else:
                node = batch.column("node").to_numpy().astype(_U)
            for _ in range(levels):
                node, at = children(node, sig[at]).ravel(), np.repeat(at, BRANCHES)
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), *(batch.column(c).take(rows) for c in ("id", *more))], ["node", "id", *more])

    return rows.mapInArrow(run, ", ".join(["node bigint", "id bigint", *(f"{c} {kinds[c]}" for c in more)]))


def near_pairs(rows: DataFrame, percent: int, shared: int, partners: int | None) -> DataFrame:
    """Pairs (a, b) of one node that differ in component and share so many of their short values; and (null, null,
    node) of nodes that hold more pairs for the last round.  Rows of a node come one after the other; they are compared
    at distance 1, 2, ... for all nodes of a batch at once.  With ``partners``, a pair whose ids both have so many is
    left out, so that no id with a partner is left without one."""
    least = ROUNDS[-1][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < COMPARED:
                continue
            node = pa.Table.from_batches(held)["node"].to_numpy()
            last = int(np.searchsorted(node, node[-1])) if len(node) else 0
            if not last:
                continue
            both = pa.Table.from_batches(held).combine_chunks()
            yield from compare(both.slice(0, last))
            held = both.slice(last).to_batches()
        if held:
            yield from compare(pa.Table.from_batches(held))

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        node, ids, comp, n = (t[c].to_numpy() for c in ("node", "id", "comp", "n"))
        sig = values(t["short"].combine_chunks() if t["short"].num_chunks != 1 else t["short"].chunk(0), SHORT)
        at, lag, given, more = np.arange(len(node)), 0, np.zeros(len(node), np.int64), []
        while True:
            lag += 1
            at = at[at + lag < len(node)]
            at = at[node[at] == node[at + lag]]
            if not len(at):
                break
            for i in (at[k : k + 20_000] for k in range(0, len(at), 20_000)):
                j = i + lag
                ok = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
                i, j = i[ok], j[ok]
                same = np.count_nonzero(sig[i] == sig[j], axis=1)
                ok = same >= shared
                if partners is not None:
                    ok &= (given[i] < partners) | (given[j] < partners)
                    more.append(np.unique(node[i[(same >= least) & ~ok]]))
                i, j = i[ok], j[ok]
                given[i] += 1
                given[j] += 1
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j])), pa.nulls(len(i), pa.int64())], ["a", "b", "node"])
        nodes = np.unique(np.concatenate([np.zeros(0, np.int64), *more]))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(nodes), pa.int64()), pa.nulls(len(nodes), pa.int64()), pa.array(nodes)], ["a", "b", "node"])

    ordered = rows.select("node", "id", "n", "comp", "short").repartition("node").sortWithinPartitions("node", "id")
    return ordered.mapInArrow(run, "a bigint, b bigint, node bigint").distinct()


def pivot_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of each row of a large node with those of its pivots that it may be similar to.  The pivots are central:
    they share the most frequent minwise values of the node, so of a group of copies of one text it is those nearest
    to that text."""
    lead = [F.hex(F.substring("sig", i + 1, 1)) for i in range(CENTRAL)]
    usual = rows.groupBy("node").agg(*(F.mode(x).alias(f"m{i}") for i, x in enumerate(lead)))
    off = sum(((x != F.col(f"m{i}")).cast("int") for i, x in enumerate(lead)), F.lit(0))
    as_pivot = F.struct("id", "n", "comp", "sig")
    pick = [F.min_by(as_pivot, F.struct((F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(PIVOTS)) != i).cast("int"), off, "id")).alias(f"p{i}") for i in range(PIVOTS)]
    chosen = narrowed(rows, usual, "node", "inner", CENTRAL).groupBy("node").agg(*pick)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, comp = (batch.column(c).to_numpy() for c in ("id", "n", "comp"))
            sig = values(batch.column("sig"))
            for i in range(PIVOTS):
                p = batch.column(f"p{i}")
                pid, pn, pcomp = (p.field(k).to_numpy() for k in (0, 1, 2))
                ok = (comp != pcomp) & (100 * np.minimum(n, pn) >= percent * np.maximum(n, pn))
                ok &= np.count_nonzero(sig == values(p.field(3)), axis=1) >= SHARED
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids, pid)[ok]), pa.array(np.maximum(ids, pid)[ok])], ["a", "b"])

    return narrowed(rows, chosen, "node", "inner", PIVOTS * VALUES // 4).mapInArrow(run, "a bigint, b bigint").distinct()


def narrowed(rows: DataFrame, ids: DataFrame, key: str, how: str, width: int = 2) -> DataFrame:
    """A join with a table of so many numbers a row, which is sent to all tasks if it has few."""
    most = SENT // width
    return rows.join(F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids, key, how)


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that share enough of all their minwise values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.count_nonzero(values(batch.column("sa")) == values(batch.column("sb")), axis=1) >= SHARED
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    few = ids.limit(SENT_BYTES // VALUES + 1).count() <= SENT_BYTES // VALUES  # of a hot group come few values and many pairs
    held = F.broadcast(classes.join(F.broadcast(ids), "id", "left_semi")) if few else classes
    side = lambda c: held.select(F.col("id").alias(c), F.col("sig").alias(f"s{c}"))
    side = (lambda c, whole=side: F.broadcast(whole(c))) if few else side
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a bigint, b bigint")


def shorter(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, by which two sets are compared: among a million shingles two differing ones are
    taken for equal once in 500."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def restored(data: pa.Buffer) -> np.ndarray:
    short = np.frombuffer(data, np.uint8).reshape(-1, 6)
    whole = np.zeros((len(short), 8), np.uint8)
    whole[:, 2:] = short
    return whole.view("<u8").ravel()


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, hashes) of the classes in ``wanted`` (id, doc_id, text_hash): the whole set of one of their documents."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shorter(shingles(t.as_py(), size)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["id", "hashes"])

    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    return narrowed(hashed, wanted, ["doc_id", "text_hash"], "inner", 6).select("id", "text").dropDuplicates(["id"]).mapInArrow(sets, "id bigint, hashes binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("ha"), batch.column("hb")):
                x, y = restored(a.as_buffer()), restored(b.as_buffer())
                both = np.sort(np.concatenate([x, y]))
                both = np.count_nonzero(both[1:] == both[:-1])
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    size = sets.agg(F.sum(F.length("hashes") + 16)).first()[0] or 0
    sent = (lambda x: F.broadcast(x)) if size <= SENT_BYTES else lambda x: x  # a hot group has few sets and many pairs
    side = lambda c: sent(sets.select(F.col("id").alias(c), F.col("hashes").alias(f"h{c}")))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(check, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for each row of ``docs`` (``doc_id``, ``text``; others are ignored).

    Two documents are linked if their sets of word shingles have 100 * intersection >= percent * union.  Documents
    with equal sets form a class.  Classes descend TREES random trees: at each node they are dealt out by their
    minwise values at BRANCHES chosen positions, until a node is small and its documents are compared with each
    other; the levels at which no node can be small yet are passed in one step.  First, all documents of a large node of one tree are compared with its central ones.  A node whose documents
    are one component needs no more; where only a few are not, these are compared with all the others, so that large
    groups of near copies descend no further.  Comparisons go in rounds: the most similar few partners of each document,
    then more, then all that are still in another component.  Candidate pairs are
    confirmed on full sets.  A pair of similarity 0.8 is missed by all trees less than once in 10,000.

    Null and empty texts, and texts without words, have an empty set and are linked with nothing.  A null doc_id is
    returned as its own component (null) and kept.  Repeated rows are returned as often as they stand there, all
    kept if their id is the least; rows of one id with different texts are linked through that id only in
    ``component_id``'s order, not as documents.  An empty table gives no rows."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "near", SENT_ROWS)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_ = scratch.keep(sketches(docs, size), "sketches")
    held = all_.filter("n > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "text_hash"))
    classes = held.groupBy(F.col("key").alias("id")).agg(first.alias("f"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = scratch.keep(classes.select("id", F.col("f.doc_id").alias("least"), F.col("f.text_hash").alias("text_hash"), "n", "sig"), "classes")
    comps = spark.createDataFrame([], "id bigint, component bigint")
    sets = tried = None
    rounds, levels = 0, 2
    while classes.count() > USUAL << (8 * levels):  # levels that no node of a usual size ends at
        levels += 1

    def known(rows: DataFrame) -> DataFrame:
        return rows.join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")

    def confirm(pairs: DataFrame) -> None:
        nonlocal comps, rounds, sets, tried
        rounds += 1
        pairs = scratch.keep(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), f"pairs-{rounds}")
        if pairs.isEmpty():
            return
        tried = pairs if tried is None else tried.union(pairs)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = wanted if sets is None else wanted.join(sets.select("id"), "id", "left_anti")
        wanted = scratch.keep(classes.select("id", F.col("least").alias("doc_id"), "text_hash").join(wanted, "id", "left_semi"), f"wanted-{rounds}")
        if not wanted.isEmpty():
            more = scratch.keep(full_sets(docs, wanted, size), f"sets-{rounds}")
            sets = more if sets is None else sets.union(more)
        found = confirmed(pairs, sets, percent)
        comps = components(found.union(comps.toDF("a", "b")), scratch, f"comp-{rounds}")

    hubs = enter(classes, 1, levels).groupBy("node").count().filter(F.col("count") > HUB).select("node")
    hubs = scratch.keep(hubs, "hubs")
    if not hubs.isEmpty():
        confirm(pivot_pairs(narrowed(enter(classes.withColumn("comp", F.col("id")), 1, levels, "n comp sig"), hubs, "node", "inner"), percent))
    entries, leaves, level = enter(known(classes), TREES, levels, "comp"), [], 0
    while True:
        mixed = entries.groupBy("node").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("c > 1 AND lo < hi").select("node", "c")
        live = scratch.keep(narrowed(entries, scratch.keep(mixed, f"mixed-{level}"), "node", "inner"), f"live-{level}")
        scratch.drop(f"mixed-{level}")
        leaves.append(live.filter(F.col("c") <= SMALL).select("node", "id"))
        large = live.filter(F.col("c") > SMALL)
        if large.isEmpty():
            break
        level += 1
        if level >= DEPTH:  # what no value divides is compared in blocks of the same size
            blocks = F.ceil(F.col("c") / SMALL)
            cells = large.withColumn("own", F.pmod(F.xxhash64(F.lit(5), "id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            leaves.append(cells.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "id"))
            break
        sizes = large.groupBy("node", "comp").count()
        main = sizes.groupBy("node").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), (F.sum("count") - F.max("count")).alias("others"), F.sum("count").alias("all"))
        large = scratch.keep(narrowed(large, scratch.keep(main, f"main-{level}"), "node", "inner"), f"split-{level}")
        # one component and few others: each of the others meets all of it, a block at a time
        few = large.filter(F.col("others") <= FEW).withColumn("blocks", F.ceil(F.col("all") / BLOCK))
        own = F.array(F.pmod(F.xxhash64(F.lit(9), "id"), F.col("blocks")))
        met = few.withColumn("b", F.explode(F.when(F.col("comp") == F.col("main"), own).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
        leaves.append(met.select(F.xxhash64("node", F.lit(level), "b").alias("node"), "id"))
        below = large.filter(F.col("others") > FEW).select("node", "id", "comp")
        entries = scratch.keep(enter(below.join(classes.select("id", "sig"), "id"), None, 1, "comp"), f"below-{level}")
    small = leaves[0]
    for more in leaves[1:]:
        small = small.union(more)
    short = classes.select("id", "n", F.substring("sig", VALUES - SHORT + 1, SHORT).alias("short"))
    for number, (shared, partners) in enumerate(ROUNDS):
        near = scratch.keep(near_pairs(known(small.join(short, "id")), percent, shared, partners), f"near-{number}")
        confirm(likely(near.filter("node IS NULL").select("a", "b"), classes))
        small = scratch.keep(narrowed(small, near.filter("node IS NOT NULL").select("node"), "node", "left_semi"), f"small-{number}")
    named = known(classes.select("id", "least"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    placed = named.join(least, "comp").select(F.col("id").alias("key"), "component_id")
    out = all_.withColumn("join_key", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("key"))).join(placed.withColumnRenamed("key", "join_key"), "join_key", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash")


def first_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with all their columns; of rows that repeat a doc_id and text one
    stays."""
    kept = near_duplicates(docs, size, percent).filter("kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    whole = whole.dropDuplicates(["doc_id", "text_hash"])
    return whole.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left_semi").select("row.*")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), size=2, percent=80)
