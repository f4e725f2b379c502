"""Alignment of two tokenizers: where tokens of both end together, and how often their ids are linked in the corpus."""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quire.llm import common, tokens, words

#: Bytes of text that are aligned together, and parts of texts that a worker remembers before it starts afresh.
CHUNK, PARTS = 1_000_000, 600_000
#: Id pairs whose counts are sent to all executors (16 bytes each); more are joined by shuffle.
SENT = 2_000_000
SPACE = "▁"
#: Links of a group above which equal pairs are counted before they are formed.
WIDE = 4096


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """The bytes of each id, end to end."""

    def __init__(self, decoded: list[bytes]):
        self.sizes = np.fromiter(map(len, decoded), np.int64, len(decoded))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(decoded), np.uint8)

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[tokens.spread(self.starts[ids], self.sizes[ids])]

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.sizes[ids])


@dataclass
class Ragged:
    """Lists of numbers, one after the other."""

    flat: np.ndarray
    sizes: np.ndarray

    @classmethod
    def none(cls) -> Ragged:
        return cls(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def take(self, rows: np.ndarray) -> Ragged:
        starts = np.cumsum(self.sizes) - self.sizes
        return Ragged(self.flat[tokens.spread(starts[rows], self.sizes[rows])], self.sizes[rows])

    def __add__(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.flat, other.flat]), np.concatenate([self.sizes, other.sizes]))

    def sums(self, owner: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(owner, self.sizes, n).astype(np.int64)


@dataclass
class Parts:
    """Alignments of parts of texts: ids of both sides, tokens of each in each group, linked id pairs (a * size of B's
    vocabulary + b) with how often they are linked, and whether the tokens' bytes are the part's."""

    a: Ragged
    b: Ragged
    groups: Ragged  # tokens of A * 2**32 + tokens of B
    pairs: Ragged
    times: np.ndarray  # beside pairs.flat
    same: np.ndarray
    texts: list[bytes]  # a1,a2|b1;...

    @classmethod
    def none(cls) -> Parts:
        return cls(Ragged.none(), Ragged.none(), Ragged.none(), Ragged.none(), np.zeros(0, np.int64), np.zeros(0, bool), [])

    def __add__(self, o: Parts) -> Parts:
        return Parts(self.a + o.a, self.b + o.b, self.groups + o.groups, self.pairs + o.pairs, np.concatenate([self.times, o.times]), np.concatenate([self.same, o.same]), self.texts + o.texts)


def solid_ends(data: np.ndarray) -> np.ndarray:
    """True at each byte behind which a space begins a new part: a character that surely is no white space ends there."""
    byte = data.astype(np.int16)
    before, third = np.zeros(len(byte), np.int16), np.zeros(len(byte), np.int16)
    before[1:], third[2:] = byte[:-1], byte[:-2]
    tail = (byte >= 0x80) & (byte < 0xC0)
    odd = (before == 0xC2) & ((byte == 0x85) | (byte == 0xA0))
    odd |= (third >= 0xE1) & (third <= 0xE3) & (before >= 0x80) & (before < 0xC0)
    return (byte > 0x20) & (byte < 0x7F) | tail & ~odd


class Aligner:
    """Both tokenizers and the alignments of the parts that they have met."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = {letter: byte for byte, letter in tokens.byte_letters().items()}
        decode = lambda t: bytes(of[c] for c in t) if t and all(c in of for c in t) else (t or "").encode()
        self.a_words = Vocabulary([decode(self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())])
        size = self.b.vocab_size()
        fallback = [self.b.is_byte(i) for i in range(size)]
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if fallback[i] else self.b.id_to_piece(i).replace(SPACE, " ").encode()
        self.b_words, self.fallback = Vocabulary([piece(i) for i in range(size)]), np.array(fallback)
        self.blank = self.b.piece_to_id(SPACE)
        self.names = [str(i) for i in range(max(size, self.a.get_vocab_size()))]
        self.clear()

    def clear(self) -> None:
        self.keys, self.rank, self.parts = np.zeros(0, np.uint64), np.zeros(0, np.int64), Parts.none()

    def a_tokens(self, text: str, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, byte behind each).  The library's offsets count characters; a token that ends inside of one, so that
        the next begins before this one's end, ends where its decoded bytes do."""
        found = self.a.encode(text, add_special_tokens=False)
        ids, spans = np.array(found.ids, np.int64), np.array(found.offsets, np.int64).reshape(-1, 2)
        byte_of = np.append(np.flatnonzero((data < 0x80) | (data >= 0xC0)), len(data))
        split = np.append(spans[1:, 0] < spans[:-1, 1], False)
        return ids, np.where(split, self.a_words.ends(ids), byte_of[spans[:, 1]])

    def b_tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, byte behind each) of a text that begins with the space which this library adds.  Its spans count bytes
        without that space; the pieces of a character spelt in bytes share one span and end where their bytes do."""
        if text == " ":
            return np.array([self.blank]), np.array([1])
        found = self.b.encode(text[1:], return_type="proto").pieces
        ids = np.fromiter((p.id for p in found), np.int64, len(found))
        ends = np.fromiter((p.end for p in found), np.int64, len(found)) + 1
        spelt = self.fallback[ids]
        return ids, np.where(spelt, self.b_words.ends(ids), ends) if spelt.any() else ends

    def linked(self, a: Ragged, b: Ragged) -> tuple[Ragged, np.ndarray]:
        """Links of groups: all pairs of a group's ids, and how often each."""
        size = len(self.b_words.sizes)
        product = a.sizes * b.sizes
        wide = product > WIDE
        narrow = np.where(wide, 0, product)
        at = np.arange(narrow.sum()) - np.repeat(np.cumsum(narrow) - narrow, narrow)
        width = np.repeat(b.sizes, narrow)
        first_a, first_b = (np.repeat(np.cumsum(x.sizes) - x.sizes, narrow) for x in (a, b))
        pairs = a.flat[first_a + at // width] * size + b.flat[first_b + at % width]
        times = np.ones(len(pairs), np.int64)
        if not wide.any():
            return Ragged(pairs, narrow), times
        lists, counts, done = [], [], np.cumsum(narrow)
        for g, n in enumerate(narrow):
            if not wide[g]:
                lists.append(pairs[done[g] - n : done[g]])
                counts.append(times[done[g] - n : done[g]])
                continue
            (ia, na), (ib, nb) = (np.unique(x.take(np.array([g])).flat, return_counts=True) for x in (a, b))
            lists.append((ia[:, None] * size + ib).ravel())
            counts.append((na[:, None] * nb).ravel())
        return Ragged(np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists))), np.concatenate(counts)

    def aligned(self, data: np.ndarray, ends: np.ndarray) -> Parts | None:
        """Parts that stand end to end in ``data``, or None where tokens don't cut them apart or don't spell them."""
        text = data.tobytes().decode()
        (a_ids, a_end), (b_ids, b_end) = self.a_tokens(text, data), self.b_tokens(text)
        for ids, vocabulary in ((a_ids, self.a_words), (b_ids, self.b_words)):
            if not np.array_equal(vocabulary.decoded(ids), data):
                return None
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        if not np.isin(ends, cuts).all():
            return None
        count = lambda end: np.bincount(np.searchsorted(cuts, end), minlength=len(cuts))
        in_a, in_b = count(a_end), count(b_end)
        inside = lambda at: np.diff(np.searchsorted(at, ends, "right"), prepend=0)
        n_groups = inside(cuts)
        links, times = self.linked(Ragged(a_ids, in_a), Ragged(b_ids, in_b))
        of_part = np.repeat(np.arange(len(ends)), n_groups)
        pairs = Ragged(links.flat, np.bincount(of_part, links.sizes, len(ends)).astype(np.int64))
        return Parts(Ragged(a_ids, inside(a_end)), Ragged(b_ids, inside(b_end)), Ragged((in_a << 32) + in_b, n_groups), pairs, times, np.ones(len(ends), bool), self.spelt(a_ids, b_ids, in_a, in_b, n_groups))

    def spelt(self, a_ids: np.ndarray, b_ids: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, n_groups: np.ndarray) -> list[bytes]:
        name = self.names
        a, b = [name[i] for i in a_ids.tolist()], [name[i] for i in b_ids.tolist()]
        at_a, at_b, groups = 0, 0, []
        for p, q in zip(in_a.tolist(), in_b.tolist()):
            groups.append(f"{a[at_a] if p == 1 else ','.join(a[at_a : at_a + p])}|{b[at_b] if q == 1 else ','.join(b[at_b : at_b + q])}")
            at_a, at_b = at_a + p, at_b + q
        out, at = [], 0
        for n in n_groups.tolist():
            out.append(";".join(groups[at : at + n]).encode())
            at += n
        return out

    def unlike(self) -> Parts:
        """A part that a tokenizer doesn't spell as it is."""
        empty = Ragged(np.zeros(0, np.int64), np.zeros(1, np.int64))
        return Parts(empty, empty, empty, empty, np.zeros(0, np.int64), np.zeros(1, bool), [b""])

    def learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> None:
        """New parts, in ascending order of their keys; ``plain`` ones can be put end to end."""
        sizes, order = ends - starts, np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n = int(plain.sum())
        joined = data[tokens.spread(starts[order[:n]], sizes[order[:n]])]
        found = self.aligned(joined, np.cumsum(sizes[order[:n]])) if n else Parts.none()
        alone = order[n:]
        if found is None:
            found, alone = Parts.none(), order
        for i in alone:
            own = data[starts[i] : ends[i]]
            found += self.aligned(own, np.array([len(own)])) or self.unlike()
        at = len(self.parts.same)
        self.parts += found
        places = np.empty(len(keys), np.int64)
        places[order] = at + np.arange(len(keys))
        where = np.searchsorted(self.keys, keys)
        self.keys, self.rank = np.insert(self.keys, where, keys), np.insert(self.rank, where, places)

    def met(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``parts``, text) of each part of texts that begin at these bytes, each with the added space."""
        solid = solid_ends(data)
        new = np.zeros(len(data), bool)
        new[1:] = (data[1:] == 32) & solid[:-1]
        new[begins[begins < len(data)]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(data))
        keys = words._hash(data, starts, ends, words._SAME)
        key, first, which = np.unique(keys, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        unmet = self.keys[place] != key if len(self.keys) else np.ones(len(key), bool)
        if len(self.keys) + int(unmet.sum()) > PARTS:
            self.clear()
            unmet[:] = True
        if unmet.any():
            s, e = starts[first[unmet]], ends[first[unmet]]
            bars = np.zeros(len(data) + 1, np.int64)
            bars[3:] = np.cumsum((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else 0
            self.learn(key[unmet], data, s, e, solid[e - 1] & (bars[e] == bars[s]))
        owner = np.searchsorted(begins, starts, "right") - 1
        return self.rank[np.searchsorted(self.keys, key)][which], owner


@functools.lru_cache(1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker, so that later tasks know earlier parts."""
    return Aligner(a_path, b_path)


@dataclass
class Piece:
    """Some texts in a row, or a piece of a long one: for each of their parts a row of ``parts`` and a text."""

    first: int
    texts: int
    rows: np.ndarray
    owner: np.ndarray
    unfinished: bool


def pieces(known: Aligner, column: pa.Array, chunk: int = CHUNK) -> Iterator[Piece]:
    """The texts in order; null and empty ones have no parts.  A long text is cut where a part ends."""
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8) if n else np.zeros(0, np.uint8)
    text = 0
    while text < n:
        last = max(text + 1, int(np.searchsorted(offsets, offsets[text] + chunk, "right")) - 1)
        at, stop = int(offsets[text]), int(offsets[last])
        if last > text + 1 or stop - at <= chunk:
            sizes = np.diff(offsets[text : last + 1])
            filled = offsets[text:last][sizes > 0] - at
            data = np.insert(whole[at:stop], filled, 32)
            begins = np.cumsum(np.where(sizes > 0, sizes + 1, 0)) - np.where(sizes > 0, sizes + 1, 0)
            some = np.flatnonzero(sizes > 0)
            rows, owner = known.met(data, begins[some])
            yield Piece(text, last - text, rows, some[owner], False)
        else:
            begun = at
            while at < stop:
                end, size = stop, chunk
                while at + size < stop:  # to the last place where a part ends, in a longer stretch if there is none
                    stretch = whole[at : at + size]
                    breaks = np.flatnonzero((stretch[1:] == 32) & solid_ends(stretch)[:-1])
                    if len(breaks):
                        end = at + int(breaks[-1]) + 1
                        break
                    size *= 2
                data = whole[at:end] if at > begun else np.insert(whole[at:end], 0, 32)
                rows, owner = known.met(data, np.zeros(1, np.int64))
                yield Piece(text, 1, rows, owner, end < stop)
                at = end
        text = last


def _listed(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), kind))


def _split(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(sizes)[:-1])


@dataclass
class Text:
    """What has been gathered of a text."""

    a: list[np.ndarray]
    b: list[np.ndarray]
    groups: list[np.ndarray]
    pairs: list[np.ndarray]
    times: list[np.ndarray]
    same: bool
    hash: object


def gathered(known: Aligner, column: pa.Array, chunk: int = CHUNK) -> Iterator[Text]:
    """One alignment for each text in order; texts that a tokenizer doesn't spell as they are have none."""
    held: Text | None = None
    for piece in pieces(known, column, chunk):
        parts, counts = known.parts, np.bincount(piece.owner, minlength=piece.texts)
        taken = [x.take(piece.rows) for x in (parts.a, parts.b, parts.groups, parts.pairs)]
        lists = [_split(x.flat, x.sums(piece.owner, piece.texts)) for x in taken]
        sizes = parts.pairs.sizes
        times = parts.times[tokens.spread((np.cumsum(sizes) - sizes)[piece.rows], sizes[piece.rows])]
        lists.append(_split(times, np.bincount(piece.owner, sizes[piece.rows], piece.texts).astype(np.int64)))
        same = np.bincount(piece.owner, ~parts.same[piece.rows], piece.texts) == 0
        rows, at = piece.rows.tolist(), 0
        for i, n in enumerate(counts.tolist()):
            text = held or Text([], [], [], [], [], True, hashlib.sha256())
            if n:
                spelt = b";".join([parts.texts[r] for r in rows[at : at + n]])
                text.hash.update(b";" + spelt if text.a else spelt)
            for kept, found in zip((text.a, text.b, text.groups, text.pairs, text.times), lists):
                kept.append(found[i])
            text.same &= bool(same[i])
            at += n
            held = text if piece.unfinished else None
            if not held:
                yield text


def alignments(docs: DataFrame, text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """All columns of ``docs`` with ``alignment``: struct of a_ids, b_ids (ids of both tokenizers) and groups, the
    tokens of A and of B in each stretch between bytes where tokens of both end.

    Texts that are null or empty, or that a tokenizer doesn't spell byte by byte as a space and the text, have empty
    lists.  Rows stay as they are, repeated or not, whatever their other columns are called; a very long text is
    aligned piece by piece; an empty table gives no rows."""
    paths = (a_path, b_path) if a_path and b_path else default_paths()
    place = common.free_name(docs.columns)
    schema = StructType([*docs.schema, StructField(place, StructType.fromDDL("a_ids array<int>, b_ids array<int>, groups array<struct<n_a:int,n_b:int>>"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(*paths)
        for batch in batches:
            found = [(np.concatenate(t.a), np.concatenate(t.b), np.concatenate(t.groups)) if t.same else (np.zeros(0, np.int64),) * 3 for t in gathered(known, batch.column(text))]
            a, b, groups = (list(x) for x in zip(*found)) if found else ([], [], [])
            flat = np.concatenate(groups) if groups else np.zeros(0, np.int64)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(g) for g in groups]))).astype(np.int32))
            both = pa.StructArray.from_arrays([pa.array(flat >> 32, pa.int32()), pa.array(flat & 0xFFFFFFFF, pa.int32())], names=["n_a", "n_b"])
            value = pa.StructArray.from_arrays([_listed(a, pa.int32()), _listed(b, pa.int32()), pa.ListArray.from_arrays(offsets, both)], names=["a_ids", "b_ids", "groups"])
            yield pa.RecordBatch.from_arrays([*batch.columns, value], [*batch.schema.names, place])

    return docs.mapInArrow(run, schema).withColumnRenamed(place, "alignment") if "alignment" not in docs.columns else docs.mapInArrow(run, schema)


def digested(docs: DataFrame, key: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """For each row its key, n_a, n_b, n_groups, n_links, groups_sha256 and its distinct id pairs with how often each
    is linked; a pair is A's id times the size of B's vocabulary plus B's id.  Odd texts as in ``alignments``."""
    paths = (a_path, b_path) if a_path and b_path else default_paths()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(*paths)
        for batch in batches:
            numbers, hashes, pairs, times = [], [], [], []
            for t in gathered(known, batch.column("text")):
                n_a = sum(map(len, t.a)) if t.same else 0
                pair, which = np.unique(np.concatenate(t.pairs) if n_a else np.zeros(0, np.int64), return_inverse=True)
                often = np.bincount(which, np.concatenate(t.times)).astype(np.int64) if n_a else pair
                numbers.append((n_a, sum(map(len, t.b)) if n_a else 0, sum(map(len, t.groups)) if n_a else 0, int(often.sum())))
                hashes.append(t.hash.hexdigest() if n_a else "")
                pairs.append(pair)
                times.append(often)
            columns = [pa.array(x, pa.int64()) for x in np.array(numbers, np.int64).reshape(-1, 4).T]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns, pa.array(hashes), _listed(pairs, pa.int64()), _listed(times, pa.int64())], ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return rows.mapInArrow(run, schema)


def _summed_by_sent(digests: DataFrame, counts: DataFrame, columns: list[str]) -> DataFrame:
    """The counts go to all executors as sorted arrays; their number has been checked."""
    table = counts.select("pair", "n", "best").toArrow().sort_by("pair")
    sent = digests.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "n", "best")))
    kept = digests.select(*columns, "pairs", "times")
    schema = StructType([*kept.schema[:-2], *StructType.fromDDL("n_best bigint, count_sum bigint")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            listed = batch.column("pairs")
            sizes = np.diff(listed.offsets.to_numpy())
            times = batch.column("times").flatten().to_numpy()
            at = np.searchsorted(pair, listed.flatten().to_numpy())
            sums = []
            for value in (best, n):
                total = np.concatenate(([0], np.cumsum(times * value[at].astype(np.int64))))
                ends = np.cumsum(sizes)
                sums.append(pa.array(total[ends] - total[ends - sizes], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *sums], [*batch.schema.names[:-2], "n_best", "count_sum"])

    return kept.mapInArrow(run, schema)


def _summed_by_join(digests: DataFrame, counts: DataFrame, columns: list[str]) -> DataFrame:
    links = digests.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    times = lambda value: F.sum(F.col("times") * F.col(value).cast("bigint"))
    sums = links.join(counts, "pair").groupBy("row").agg(times("best").alias("n_best"), times("n").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return digests.select("row", *columns).join(sums, "row", "left").select(*columns, zero("n_best"), zero("count_sum"))


def counted(digests: DataFrame, b_size: int, sent: int = SENT) -> DataFrame:
    """Adds n_best and count_sum to ``digested`` rows with a unique ``row``: how many of a document's links have their
    A id's highest document count in the whole table, and the sum of the document counts of all its links."""
    scratch = common.Scratch(digests.sparkSession, "pair_counts")
    pairs = scratch.keep(digests.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    a: Column = F.floor(F.col("pair") / F.lit(b_size))
    # one row for each id of A's vocabulary at most
    most = F.broadcast(pairs.groupBy(a.alias("a")).agg(F.max("n").alias("most")))
    counts = scratch.keep(pairs.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")
    columns = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    few = counts.limit(sent + 1).count() <= sent
    return (_summed_by_sent if few else _summed_by_join)(digests, counts, columns)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "alignment", rows=1024)
    docs = common.table(spark, sf_dir, "documents")
    digests = scratch.keep(digested(docs).withColumn("row", F.monotonically_increasing_id()), "digests")
    return counted(digests, len(aligner(*default_paths()).b_words.sizes)).withColumnRenamed("key", "doc_id")
