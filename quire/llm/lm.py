"""Language-model scoring with a hierarchical Pitman-Yor model whose seating is sampled by Gibbs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common, words

#: Predictions of words that make up at least one in so many training tokens are sent to every task, so that their
#: pairs can be dealt out evenly; there cannot be more of them than this.  The model doesn't depend on it.
SHARE = 1 << 18
#: Discount and strength of the context restaurants and of their common parent.
DISCOUNT, STRENGTH = 0.75, 1.0
#: Gibbs sweeps before samples are taken, and samples whose predictions are averaged.
BURN_IN, SAMPLES = 2, 3
#: Bytes of text and tokens that a task handles together.
TEXT, TOKENS = 8_000_000, 1_000_000
#: Characters of training text for each part of the tables that are dealt out by hash.
PART = 12_000_000
_U = np.uint64
#: The word after each text, and the context of its first word.
END = _U(0)


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows whose texts make up about TEXT bytes."""
    ends = np.cumsum([(len(t.as_buffer()) if t.is_valid else 0) for t in batch.column("text")])
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the row of each."""
    found = list(words.scan(batch.column("text")))
    if not found:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate([w.hashes for w in found]), np.concatenate([w.text for w in found])


def stream(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, word before it, row) of each token: the hashes of the words of every text and its end."""
    hashes, row = hashed(batch)
    ends = np.searchsorted(row, np.arange(batch.num_rows), "right")
    word = np.insert(hashes, ends, END)
    return word, np.concatenate(([END], word[:-1])), np.insert(row, ends, np.arange(batch.num_rows))


def place(keys: np.ndarray, parts: int) -> np.ndarray:
    return (words.mix(keys) % _U(parts)).astype(np.int64)


def pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One hash for a context and the word after it."""
    return words.mix(u * _U(0x9E3779B97F4A7C15) + words.mix(w))


def dealt(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs, and where."""
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(bounds[1:] > bounds[:-1]):
        yield int(p), order[bounds[p] : bounds[p + 1]]


def batch_of(schema: str, *values) -> pa.RecordBatch:  # noqa: ANN002
    """A batch of one row."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, names, strict=True)], [n for n, _ in names])


def table_of(schema: str, batches: Iterator[pa.RecordBatch] | list[pa.RecordBatch]) -> pa.Table:
    batches = list(batches)
    return pa.Table.from_batches(batches, None if batches else batch_of(schema, *[None] * len(schema.split(", "))).schema)


def heads(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.insert(x[1:] != x[:-1], 0, True)) if len(x) else np.zeros(0, np.int64)


def joined(rows: list[dict], column: str, kind: str) -> np.ndarray:
    return np.concatenate([unpack(r[column], kind) for r in rows]) if rows else np.zeros(0, kind)


Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]
PAIRED = "part int, u binary, runs binary, w binary, counts binary"


def _sum(u: np.ndarray, w: np.ndarray, counts: np.ndarray) -> Pairs:
    order = np.lexsort((w, u))
    u, w, counts = u[order], w[order], counts[order]
    first = np.flatnonzero(np.insert((u[1:] != u[:-1]) | (w[1:] != w[:-1]), 0, True)) if len(u) else np.zeros(0, np.int64)
    return u[first], w[first], np.add.reduceat(counts, first) if len(first) else counts


def _pack_pairs(part: int, u: np.ndarray, w: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    first = heads(u)
    return batch_of(PAIRED, part, pack(u[first]), pack(np.diff(np.append(first, len(u))).astype("<u4")), pack(w), pack(counts))


def _unpack_pairs(row: dict) -> Pairs:
    return np.repeat(unpack(row["u"], "<u8"), unpack(row["runs"], "<u4")), unpack(row["w"], "<u8"), unpack(row["counts"], "<i8")


def counted(learn: DataFrame, parts: int) -> DataFrame:
    """Counts of (context, word): a row for each part of the contexts, in ascending order.  Tasks add up before they
    send."""

    def send(pairs: Pairs) -> Iterator[pa.RecordBatch]:
        for p, at in dealt(place(pairs[0], parts), parts):
            yield _pack_pairs(p, *(x[at] for x in pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Pairs] = []
        for batch in batches:
            for piece in slices(batch):
                word, before, _ = stream(piece)
                held.append(_sum(before, word, np.ones(len(word), np.int64)))
                if sum(len(x[0]) for x in held) > 2 * TOKENS:
                    held = [_sum(*(np.concatenate(x) for x in zip(*held)))]
                    if len(held[0][0]) > 2 * TOKENS:
                        yield from send(held.pop())
        if held:
            yield from send(_sum(*(np.concatenate(x) for x in zip(*held))))

    def merge(rows: pa.Table) -> pa.Table:
        found = [_unpack_pairs(r) for r in rows.to_pylist()]
        return table_of(PAIRED, [_pack_pairs(rows["part"][0].as_py(), *_sum(*(np.concatenate(x) for x in zip(*found))))])

    return learn.select("text").mapInArrow(run, PAIRED).groupBy("part").applyInArrow(merge, PAIRED)


def seat(counts: np.ndarray, base: np.ndarray, total: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers are seated one after the other in their restaurants.

    The first customer opens a table; a later one opens another with the weight (strength + discount * tables of the
    restaurant) * base against the customers that sit there, less a discount for each table.  Customers are seated
    one at a time up to the 32nd, then in runs that double, within which the odds are held."""
    tables, seated = np.ones(len(counts), np.int64), 1
    weight = (strength + discount * total) * base
    open_ = np.flatnonzero(counts > 1)
    while len(open_):
        run = 1 if seated < 32 else seated
        size = np.minimum(counts[open_] - seated, run)
        odds = weight[open_] / (weight[open_] + np.maximum(seated - discount * tables[open_], 1e-9))
        tables[open_] += rng.binomial(size, odds)
        seated += run
        open_ = open_[counts[open_] > seated]
    return tables


DISHES = "part int, w binary, n binary, singles binary"


def dishes_of(pairs: DataFrame, parts: int) -> DataFrame:
    """Each word with its count and the number of contexts that it follows once, by its own hash."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, w, counts = _unpack_pairs(row)
                names, at = np.unique(w, return_inverse=True)
                n, singles = (np.bincount(at, x, len(names)).astype(np.int64) for x in (counts, counts == 1))
                for p, b in dealt(place(names, parts), parts):
                    yield batch_of(DISHES, p, pack(names[b]), pack(n[b]), pack(singles[b]))

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        w, at = np.unique(joined(rows, "w", "<u8"), return_inverse=True)
        n, singles = (np.bincount(at, joined(rows, c, "<i8"), len(w)).astype(np.int64) for c in ("n", "singles"))
        return table_of(DISHES, [batch_of(DISHES, rows[0]["part"], pack(w), pack(n), pack(singles))])

    return pairs.mapInArrow(send, DISHES).groupBy("part").applyInArrow(merge, DISHES)


#: Of the pairs that occur more than once: the place of the context in its part, word, count, tables, and tables summed
#: over samples; and for each context the number of its other pairs, which have one table each at any time.
STATE = "part int, owner binary, singles binary, w binary, counts binary, tables binary, summed binary"


def seated(pairs: DataFrame) -> DataFrame:
    """One table for each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                u, w, counts = _unpack_pairs(row)
                owner, many = np.cumsum(np.insert(u[1:] != u[:-1], 0, False)), counts > 1
                singles = np.bincount(owner, ~many).astype("<u4")
                n = int(many.sum())
                yield batch_of(STATE, row["part"], pack(owner[many].astype("<u4")), pack(singles), pack(w[many]), pack(counts[many]), pack(np.ones(n, np.int64)), pack(np.zeros(n, np.int64)))

    return pairs.mapInArrow(run, STATE)


@dataclass
class Base:
    """What the parent draws words from: a never seen word takes the share that words seen once suggest, the seen ones
    share the rest alike."""

    types: int
    tokens: int
    unseen: float

    @property
    def seen(self) -> float:
        return (1 - self.unseen) / max(1, self.types)


@dataclass
class Totals:
    """Customers and tables of the parent."""

    customers: float
    tables: float

    def prediction(self, own: np.ndarray | float, base: float) -> np.ndarray | float:
        """Of a word whose customers less discounts are ``own``."""
        return (own + base * (STRENGTH + DISCOUNT * self.tables)) / (STRENGTH + self.customers)


#: ``src`` is the part of the words that a row is from, or -1 for all words of the row's own part.
PARENT = "part int, src int, number int, x binary, c bigint, t bigint"


def parent_of(state: DataFrame, dishes: DataFrame, base: Base, parts: int, number: int, tables: float) -> DataFrame:
    """The parent's customers, which are the tables of all contexts, are seated anew.  Each part of the contexts is
    told, for its words in order of their parts, how many customers less discounts they have."""
    asked = "part int, src int, w binary, t binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, at = np.unique(unpack(row["w"], "<u8"), return_inverse=True)
                t = np.bincount(at, unpack(row["tables"], "<i8"), len(names)).astype(np.int64)
                for p, b in dealt(place(names, parts), parts):
                    yield batch_of(asked, p, row["part"], pack(names[b]), pack(t[b]))

    def answer(rows: pa.Table, own: pa.Table) -> pa.Table:
        own, rows = own.to_pylist()[0], rows.to_pylist()
        w, c = unpack(own["w"], "<u8"), unpack(own["singles"], "<i8").copy()
        places = [np.searchsorted(w, unpack(r["w"], "<u8")) for r in rows]
        for r, at in zip(rows, places):
            c[at] += unpack(r["t"], "<i8")
        t = seat(c, np.full(len(c), base.seen), np.full(len(c), tables), DISCOUNT, STRENGTH, np.random.default_rng([99, number, own["part"]]))
        x = c - DISCOUNT * t
        out = [batch_of(PARENT, own["part"], -1, number, pack(x), int(c.sum()), int(t.sum()))]
        return table_of(PARENT, out + [batch_of(PARENT, r["src"], own["part"], number, pack(x[at]), 0, 0) for r, at in zip(rows, places)])

    return state.mapInArrow(ask, asked).groupBy("part").cogroup(dishes.groupBy("part")).applyInArrow(answer, PARENT)


def sweep(state: DataFrame, parent: DataFrame, base: Base, totals: Totals, parts: int, number: int, keep: bool) -> DataFrame:
    """One Gibbs sweep over all context restaurants, given their parent's predictions."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        out, told = [], told.to_pylist()
        for row in rows.to_pylist():
            counts, tables, summed = (unpack(row[c], "<i8") for c in ("counts", "tables", "summed"))
            owner, singles = unpack(row["owner"], "<u4").astype(np.int64), unpack(row["singles"], "<u4")
            names, at = np.unique(unpack(row["w"], "<u8"), return_inverse=True)
            where, own = dict(dealt(place(names, parts), parts)), np.zeros(len(names))
            for r in told:
                own[where[r["src"]]] = unpack(r["x"], "<f8")
            total = singles + np.bincount(owner, tables, len(singles))
            tables = seat(counts, totals.prediction(own, base.seen)[at], total[owner], DISCOUNT, STRENGTH, np.random.default_rng([number, row["part"]]))
            out.append(batch_of(STATE, row["part"], row["owner"], row["singles"], row["w"], row["counts"], pack(tables), pack(summed + tables) if keep else row["summed"]))
        return table_of(STATE, out)

    return state.groupBy("part").cogroup(parent.filter("src >= 0").groupBy("part")).applyInArrow(run, STATE)


def score(docs: DataFrame, learn: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs`` (``doc_id``,
    ``text``), by a model of the texts of ``learn``.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, and an end after each text.  A restaurant for
    each preceding word seats the words that follow; all share one parent.  Every word of the training texts is a
    context and can be predicted in each, however rare it is.  A word never seen counts as one further type, drawn from
    the parent's base; after it the parent predicts.  Seatings are sampled by Gibbs, sweep by sweep; predictions are
    averaged over SAMPLES sweeps, those of a context and those of the parent each.  Restaurants lie in parts by the
    hash of their context, the parent's customers by the hash of their word; no task or driver holds all words.

    Null and empty texts are an end alone.  Repeated rows are scored as they stand.  Without training texts every
    token has the probability of an unknown one.  An empty table gives no rows."""
    scratch = common.Scratch(docs.sparkSession, "lm")
    learn = learn.select(F.col("text").cast("string").alias("text"))
    parts = max(4, docs.rdd.getNumPartitions(), -(-(learn.agg(F.sum(F.length("text"))).first()[0] or 0) // PART))
    pairs = scratch.keep(counted(learn, parts), "pairs-0", "none")
    dishes = scratch.keep(dishes_of(pairs, parts), "dishes", "none")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column("n").to_pylist():
                n = unpack(n, "<i8")
                yield batch_of("types bigint, tokens bigint, once bigint", len(n), int(n.sum()), int((n == 1).sum()))

    facts = dishes.mapInArrow(sums, "types bigint, tokens bigint, once bigint").agg(F.sum("types"), F.sum("tokens"), F.sum("once")).first()
    types, tokens, once = (int(x or 0) for x in facts)
    base = Base(types, tokens, min(0.9, max(1 / (types + 1), once / (DISCOUNT * types))) if types else 1.0)
    state = scratch.keep(seated(pairs), "state-0", "none")
    tables, samples, totals_of = float(types), None, {}
    for number in range(BURN_IN + SAMPLES + 1):
        parent = scratch.keep(parent_of(state, dishes, base, parts, number, tables), f"parent-{number}", "none")
        c, t = parent.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
        totals_of[number], tables = Totals(float(c), float(t)), float(t)
        if number > BURN_IN:
            own = parent.filter("src < 0")
            samples = own if samples is None else samples.union(own)
        if number < BURN_IN + SAMPLES:
            state = scratch.keep(sweep(state, parent, base, totals_of[number], parts, number + 1, number >= BURN_IN), f"state-{number + 1}", "none")
            scratch.drop(f"state-{number}")
    totals_of = {n: x for n, x in totals_of.items() if n > BURN_IN}
    unknown = sum(x.prediction(0.0, base.unseen) for x in totals_of.values()) / SAMPLES
    return _scored(docs, scratch, pairs, state, dishes, samples, base, totals_of, unknown, parts)


ASKED = "part int, chunk bigint, kind int, a binary, b binary, c binary, d binary"
#: Of words: hash, count, logarithm of the parent's prediction.  Of contexts: hash, nothing, logarithm of the weight left
#: to the parent.  Of pairs: hash, the word's hash or nothing, and the context's own prediction against what it leaves to
#: the parent, or, with nothing, against the parent's part too.
MODEL = "part int, kind int, keys binary, more binary, value binary"
DOCS, PAIRS, WORDS, CONTEXTS = 0, 1, 2, 3


def _known(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the keys, whether it is one)."""
    at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
    return at, keys[at] == asked if len(keys) else np.zeros(len(asked), bool)


def _scored(docs: DataFrame, scratch: common.Scratch, pairs: DataFrame, state: DataFrame, dishes: DataFrame, samples: DataFrame, base: Base, totals_of: dict[int, Totals], unknown: float, parts: int) -> DataFrame:
    """A text's score is a sum of what its words have by themselves (the parent's prediction of the word, and the
    weight that it leaves to the parent as a context) and of what each pair that was seen adds to that."""
    spark = docs.sparkSession
    every = math.log10(base.tokens + base.types + 1)
    least = max(2, -(-base.tokens // SHARE))

    def predicted(own: pa.Table, rows: pa.Table) -> pa.Table:
        own = own.to_pylist()[0]
        p = sum(totals_of[r["number"]].prediction(unpack(r["x"], "<f8"), base.seen) for r in sorted(rows.to_pylist(), key=lambda r: r["number"])) / SAMPLES
        return table_of(MODEL, [batch_of(MODEL, own["part"], WORDS, own["w"], own["n"], pack(np.log10(p)))])

    words_ = scratch.keep(dishes.groupBy("part").cogroup(samples.groupBy("part")).applyInArrow(predicted, MODEL), "words", "none")

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hot = unpack(row["more"], "<i8") >= least
                yield pa.RecordBatch.from_arrays([pa.array(unpack(row["keys"], "<u8")[hot].astype(np.int64)), pa.array(unpack(row["value"], "<f8")[hot])], ["key", "p"])

    hot = words_.mapInArrow(frequent, "key bigint, p double").toArrow()
    hot_keys = hot["key"].to_numpy().astype(_U)
    order = np.argsort(hot_keys)
    hot_sent = spark.sparkContext.broadcast((hot_keys[order], hot["p"].to_numpy()[order]))

    def home(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, part, place among frequent words, whether it is one) of pairs: those of a frequent word are dealt out
        by the pair, others lie where the word's prediction is."""
        key = pair(u, w)
        at, is_hot = _known(hot_sent.value[0], w)
        return key, place(np.where(is_hot, key, w), parts), at, is_hot

    def deal(rows: pa.Table, seats: pa.Table) -> pa.Table:
        out = []
        for row, last in zip(rows.to_pylist(), seats.to_pylist(), strict=True):
            u, w, counts = _unpack_pairs(row)
            first, owner = heads(u), np.cumsum(np.insert(u[1:] != u[:-1], 0, False))
            tables = np.ones(len(u))
            tables[counts > 1] = unpack(last["summed"], "<i8") / SAMPLES
            customers, total = np.add.reduceat(counts, first), np.add.reduceat(tables, first)
            left = (STRENGTH + DISCOUNT * total) / (STRENGTH + customers)
            out.append(batch_of(MODEL, row["part"], CONTEXTS, pack(u[first]), b"", pack(np.log10(left))))
            own = ((counts - DISCOUNT * tables) / ((STRENGTH + customers) * left)[owner]).astype("<f4")
            key, part, at, is_hot = home(u, w)
            if is_hot.any():
                own[is_hot] /= 10 ** hot_sent.value[1][at[is_hot]]
            for warm in (True, False):
                some = np.flatnonzero(is_hot == warm)
                for p, b in dealt(part[some], parts):
                    b = some[b]
                    out.append(batch_of(MODEL, p, PAIRS, pack(key[b]), b"" if warm else pack(w[b]), pack(own[b])))
        return table_of(MODEL, out)

    chances = pairs.groupBy("part").cogroup(state.groupBy("part")).applyInArrow(deal, MODEL)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        for batch in batches:
            for piece in slices(batch):
                word, before, row = stream(piece)
                n = piece.num_rows
                ids = piece.column("doc_id").to_numpy(zero_copy_only=False)
                valid = np.array([x.is_valid for x in piece.column("doc_id")], bool)
                ids = np.where(valid, ids, 0).astype(np.int64)
                yield batch_of(ASKED, chunk % parts, chunk, DOCS, pack(ids), pack(valid), pack(np.bincount(row, minlength=n)), b"")
                key, part, _, _ = home(before, word)
                yield from dealt_out(chunk, PAIRS, key, part, row)
                yield from dealt_out(chunk, WORDS, word, place(word, parts), row)
                chunk += 1

    def dealt_out(chunk: int, kind: int, keys: np.ndarray, part: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(keys, kind="stable")
        keys, part, row = keys[order], part[order], row[order]
        first = heads(keys)
        sizes = np.diff(np.append(first, len(keys)))
        for p, b in dealt(part[first], parts):
            reach = np.repeat(first[b] - (np.cumsum(sizes[b]) - sizes[b]), sizes[b]) + np.arange(sizes[b].sum())
            steps = np.diff(keys[first[b]], prepend=_U(0))
            yield batch_of(ASKED, p, chunk, kind, pack(steps), pack(sizes[b].astype("<u4")), pack(row[reach].astype("<u4")), b"")

    def answer(key: tuple, rows: pa.Table, table: pa.Table) -> pa.Table:
        table, out = table.to_pylist(), []
        of = lambda kind: [r for r in table if r["kind"] == kind]
        names, counts, chance = (joined(of(WORDS), c, k) for c, k in (("keys", "<u8"), ("more", "<i8"), ("value", "<f8")))
        contexts, left = joined(of(CONTEXTS), "keys", "<u8"), joined(of(CONTEXTS), "value", "<f8")
        alone = chance.copy()
        at, found = _known(contexts, names)
        alone[found] += left[at[found]]
        keys, own = [np.zeros(0, _U)], [np.zeros(0, "<f4")]
        for r in of(PAIRS):
            keys.append(unpack(r["keys"], "<u8"))
            x = unpack(r["value"], "<f4")
            own.append(x / 10 ** chance[np.searchsorted(names, unpack(r["more"], "<u8"))] if r["more"] else x)
        keys, own = np.concatenate(keys), np.concatenate(own)
        order = np.argsort(keys)
        keys, adds = keys[order], np.log10(1 + own[order].astype(np.float64))
        for r in rows.to_pylist():
            if r["kind"] == DOCS:
                out.append(r)
                continue
            asked, sizes, doc = np.cumsum(unpack(r["a"], "<u8"), dtype=_U), unpack(r["b"], "<u4").astype(np.int64), unpack(r["c"], "<u4").astype(np.int64)
            docs_, local = np.unique(doc, return_inverse=True)
            summed = lambda x: np.bincount(local, np.repeat(x, sizes), len(docs_))  # noqa: B023, E731
            at, found = _known(keys if r["kind"] == PAIRS else names, asked)
            total, facts = np.zeros(len(asked)), np.zeros((3, len(docs_)))
            if r["kind"] == PAIRS:
                total[found] = adds[at[found]]
            else:
                total[:] = math.log10(unknown)
                total[found] = alone[at[found]]
                n = np.zeros(len(asked))
                n[found] = counts[at[found]]
                facts[0], facts[1] = summed(np.log10(n + 1.0) - every), summed(found)
            facts[2] = summed(total)
            out.append({"part": r["part"], "chunk": r["chunk"], "kind": r["kind"], "a": pack(docs_.astype("<u4")), "b": b"", "c": pack(facts), "d": b""})
        return pa.Table.from_pylist(out, schema)

    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), *((x, pa.binary()) for x in "abcd")])
    answers = docs.mapInArrow(ask, ASKED).groupBy("part").cogroup(chances.union(words_).groupBy("part")).applyInArrow(answer, ASKED)

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        own = next(r for r in rows if r["kind"] == DOCS)
        ids, valid, tokens = unpack(own["a"], "<i8"), unpack(own["b"], "?"), unpack(own["c"], "<i8")
        n = len(ids)
        facts = np.zeros((3, n))
        for r in sorted((r for r in rows if r["kind"] != DOCS), key=lambda r: (r["kind"], r["part"])):
            facts[:, unpack(r["a"], "<u4")] += unpack(r["c"], "<f8").reshape(3, -1)
        whole = lambda x: pa.array(np.round(x).astype(np.int64))
        return pa.table({"doc_id": pa.array(ids, mask=~valid), "n_tokens": whole(tokens), "n_known": whole(facts[1]), "train_tokens": pa.array(np.full(n, base.tokens, np.int64)), "base_score": pa.array(facts[0]), "score": pa.array(facts[2])})

    return answers.groupBy("chunk").applyInArrow(add, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def held_out() -> Column:
    """True for the fold that isn't learned from: crc32 of the id as text leaves 2 on division by 7.  Documents without
    an id aren't learned from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(True))


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity a token of the model and of the base, over all rows."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, docs.filter(~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
