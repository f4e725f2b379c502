"""Quality classifier: ordinal regression with cumulative links over hashed text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import common, words

#: Bits of a word's hash that name its feature, and values that describe the look of a text.
BITS, LOOKS = 32, 8
#: Labelled documents of each grade that the model is fitted on at most, the distinct words of these documents at which
#: no further one is taken, and the passes over them.
SAMPLE, HELD, EPOCHS = 6000, 12_000_000, 25
#: Deviations at which a word's log ratio is believed in full, the power at which nearer ones count for less, and the
#: steps that a pass takes at least.
DEVIATIONS, POWER, STEPS = 5.0, 3, 32
#: A document is selected if it reaches the top grade at least this probably.
LEAST_TAIL = 0.5
_U = np.uint64


def grade(quality: Column, toxic: Column) -> Column:
    """0 for toxic, 1 for poor, 2 for good documents."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


@dataclass
class Features:
    """Of some texts: the distinct words' hashes in order of texts, where each text begins among them, and the looks:
    shares of letters, capitals, digits, marks and other bytes, of words said again, and length."""

    words: np.ndarray
    begins: np.ndarray
    looks: np.ndarray

    def __len__(self) -> int:
        return len(self.looks)


def features(column: pa.Array) -> Features:
    n = len(column)
    keys = [np.zeros(0, _U)]
    total, looks = np.zeros(n), np.zeros((n, LOOKS))
    for w in words.scan(column):
        key = np.unique(w.text.astype(_U) << _U(BITS) | w.hashes >> _U(64 - BITS))
        last = keys[-1]
        if len(last) and len(key) and last[-1] >> _U(BITS) == key[0] >> _U(BITS):  # a long text goes on
            keys[-1] = last[: np.searchsorted(last, key[0] >> _U(BITS) << _U(BITS))]
            key = np.union1d(key, last[len(keys[-1]) :])
        total += np.bincount(w.text, minlength=n)
        keys.append(key)
    key = np.concatenate(keys)
    row = (key >> _U(BITS)).astype(np.int64)
    distinct = np.bincount(row, minlength=n)
    looks[:, 0], looks[:, 5], looks[:, 6] = 1.0, 1 - distinct / np.maximum(total, 1), np.log1p(total) / 10
    for i, text in enumerate(column):
        data = np.frombuffer(text.as_buffer() or b"", np.uint8) if text.is_valid else np.zeros(0, np.uint8)
        if len(data):
            shares = sum(np.bincount(_KIND[data[at : at + words.CHUNK]], minlength=6) for at in range(0, len(data), words.CHUNK)) / len(data)
            looks[i, [1, 2, 3, 4, 7]] = shares[[1, 2, 3, 4, 5]]
        else:
            looks[i, 1:] = 0
    return Features((key & _U((1 << BITS) - 1)).astype(np.uint32), np.searchsorted(row, np.arange(n + 1)), looks)


_KIND = np.full(256, 4, np.int64)  # other marks
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5
_KIND[[*range(9, 14), 32]] = 0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Ordinal:
    """P(grade >= g) = sigmoid(weights . words + looks . look - thresholds[g - 1]); one weight for each word of the
    sample, in order of their hashes, and thresholds in ascending order."""

    names: np.ndarray
    weights: np.ndarray
    looks: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: Features) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.names, x.words), max(0, len(self.names) - 1))
        value = np.where(self.names[at] == x.words, self.weights[at], 0.0) if len(self.names) else np.zeros(len(x.words))
        score = np.bincount(np.repeat(np.arange(len(x)), np.diff(x.begins)), value, len(x)) + x.looks @ self.looks
        return sigmoid(score[:, None] - self.thresholds[None, :])


def scales(words_: np.ndarray, begins: np.ndarray, grades: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names and scales of all words of the sample, and the place of each among the names.  A scale is the logarithm
    of how much more often the grades from a threshold on hold the word than those below, at the threshold that it tells apart
    best; no word is left out, but the fewer deviations from chance its ratio is, the smaller its scale."""
    names = np.sort(words_)
    names = names[np.insert(names[1:] != names[:-1], 0, True)] if len(names) else names
    at = np.searchsorted(names, words_).astype(np.int32)
    held = np.zeros((levels, len(names)), np.int32)
    owner = np.repeat(grades.astype(np.int8), np.diff(begins))
    for g in range(levels):
        held[g] = np.bincount(at[owner == g], minlength=len(names))
    size, support, best = np.bincount(grades, minlength=levels), held.sum(0), np.zeros(len(names))
    for g in range(1, levels):
        n1, n0, above = max(1, int(size[g:].sum())), max(1, int(size[:g].sum())), held[g:].sum(0)
        below, p = support - above, support / (n1 + n0)
        far = np.abs(above / n1 - below / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        scale = np.log((above + 0.5) / (n1 + 1)) - np.log((below + 0.5) / (n0 + 1))
        scale = np.clip(scale, -4, 4) * np.minimum(1, far / DEVIATIONS) ** POWER
        best = np.where(np.abs(scale) > np.abs(best), scale, best)
    return names, best, at


def fit(x: Features, grades: np.ndarray, weight: np.ndarray, levels: int, epochs: int = EPOCHS, rate: float = 0.2) -> Ordinal:
    """Passes of Adagrad to the maximum of the likelihood times a normal prior of variance 1 on each scaled weight; the
    gaps between thresholds stay positive.

    With the cumulative link, a grade has the probability sigmoid(s - t[g-1]) - sigmoid(s - t[g])."""
    names, scale_of, place = scales(x.words, x.begins, grades, levels)
    l2 = 1 / len(grades)
    n = len(names)  # the looks' weights stand after the words'
    weights, first, gaps = np.zeros(n + LOOKS), np.array([-0.5]), np.zeros(max(0, levels - 2))
    memory_w, memory_t = np.full(len(weights), 1e-8), np.full(levels - 1, 1e-8)
    begin = x.begins
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(grades)), min(len(grades), max(STEPS, len(grades) // 512))):
            at = place[np.concatenate([np.arange(begin[i], begin[i + 1]) for i in batch])] if len(batch) else np.zeros(0, np.int32)
            local = np.repeat(np.arange(len(batch)), begin[batch + 1] - begin[batch])
            look, scaled = x.looks[batch], scale_of[at]
            t = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
            s = np.bincount(local, weights[at] * scaled, len(batch)) + look @ weights[n:]
            edge = sigmoid(s[:, None] - t[None, :])
            upper = np.concatenate([np.ones((len(batch), 1)), edge], 1)[np.arange(len(batch)), grades[batch]]
            lower = np.concatenate([edge, np.zeros((len(batch), 1))], 1)[np.arange(len(batch)), grades[batch]]
            p = np.maximum(upper - lower, 1e-9)
            up, low = upper * (1 - upper), lower * (1 - lower)
            scale = weight[batch] / len(batch)
            g_s = (up - low) / p * scale
            g_t = np.zeros(levels + 1)
            np.add.at(g_t, grades[batch], -up / p * scale)
            np.add.at(g_t, grades[batch] + 1, low / p * scale)
            g_t = g_t[1:levels]
            g_w = np.bincount(at, g_s[local] * scaled, len(weights)) - l2 * weights
            g_w[n:] += g_s @ look
            g_p = np.concatenate([[g_t.sum()], np.cumsum(g_t[:0:-1])[::-1] * np.exp(gaps)])
            memory_w += g_w**2
            memory_t += g_p**2
            weights += rate * g_w / np.sqrt(memory_w)
            step = 0.1 * g_p / np.sqrt(memory_t)
            first, gaps = first + step[:1], np.clip(gaps + step[1:], -3, 5)
    return Ordinal(names, weights[:n] * scale_of, weights[n:], np.concatenate([first, first + np.cumsum(np.exp(gaps))]))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column("text"))
        found = [x.words[a:b].astype("<u4").tobytes() for a, b in zip(x.begins[:-1], x.begins[1:])]
        cols = [batch.column("doc_id"), batch.column("grade"), batch.column("text_hash"), pa.array(found, pa.binary()), pa.array([r.astype("<f8").tobytes() for r in x.looks], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "grade", "text_hash", "words", "looks"])


def train(docs: DataFrame, graded: DataFrame, levels: int = 3, sample: int = SAMPLE, held: int = HELD) -> Ordinal:
    """Fits on at most ``sample`` documents of each grade, those whose id hashes lowest, and of these no more than it
    takes to reach ``held`` distinct words, counted for each document; a document that is taken is read whole.
    ``graded`` has ``doc_id`` and ``grade``.  Features are made on the executors; the bounded sample is fitted on the
    driver, 4 bytes a word.  Grades outside the scale, null grades and labels without a document are ignored; the lowest
    of several grades of a document counts, and of several texts of one doc_id the one whose hash is least.
    With fewer than two grades every document is expected to have the top grade."""
    graded = graded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("grade").cast("int").alias("grade")).filter(F.col("doc_id").isNotNull() & F.col("grade").between(0, levels - 1))
    graded = graded.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    size_of = {r[0]: r[1] for r in graded.groupBy("grade").count().collect()}
    # hashes are uniform: a fifth more than needed passes, so that no task ranks all ids of a grade
    pass_ = F.lit(False)
    for g, n in size_of.items():
        most = (1 << 63) - 1 if n <= 2 * sample else int(-(2.0**63) + 2.0**64 * 1.2 * sample / n)
        pass_ |= (F.col("grade") == g) & (F.xxhash64("doc_id") <= F.lit(most))
    order = Window.partitionBy("grade").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = graded.filter(pass_).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample).select("doc_id", "grade")
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).join(F.broadcast(chosen), "doc_id")
    rows = texts.select("doc_id", "grade", "text_hash", "text").mapInArrow(_featured, "doc_id bigint, grade int, text_hash bigint, words binary, looks binary")
    rows = rows.groupBy("doc_id", "grade").agg(F.min_by(F.struct("words", "looks"), "text_hash").alias("x")).select("doc_id", "grade", "x.words", "x.looks")
    before = Window.partitionBy("grade").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.octet_length("words") / 4).over(before), F.lit(0))).filter(F.col("before") < held).drop("before")
    rows = rows.toArrow().combine_chunks()
    ids, grades = rows["doc_id"].to_numpy(), rows["grade"].to_numpy().astype(np.int64)
    if len(np.unique(grades)) < 2:
        return Ordinal(np.zeros(0, np.uint32), np.zeros(0), np.zeros(LOOKS), np.linspace(-30, -20, levels - 1))
    order = np.argsort(ids)  # the same order on every run
    grades = grades[order]
    found = [np.frombuffer(rows["words"][i].as_buffer(), "<u4") for i in order.tolist()]
    looks = np.stack([np.frombuffer(rows["looks"][i].as_buffer(), "<f8") for i in order.tolist()])
    x = Features(np.concatenate(found), np.concatenate(([0], np.cumsum([len(f) for f in found]))), looks)
    del rows, found
    counts = np.bincount(grades, minlength=levels)
    true = np.array([size_of.get(g, 0) for g in range(levels)])
    weight = (true / np.maximum(counts, 1))[grades]  # each grade counts as often as among all labels
    weight = weight / weight.mean()
    return fit(x, grades, weight, levels)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """``docs`` with ``expected_grade`` and ``p_tail``, the probability of the top grade, in place of columns of these
    names.  A null or empty text has
    only the features of its looks."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("expected_grade", "p_tail")]
    hidden = docs.select(*(F.col(f"`{c}`") for c in names), F.col("text").cast("string").alias(common.free_name(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = sent.value.tails(features(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(tails.sum(1)), pa.array(tails[:, -1])], [*names, "expected_grade", "p_tail"])

    fields = hidden.schema.fields[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", expected_grade double, p_tail double"
    return hidden.mapInArrow(run, schema)


def select_good(docs: DataFrame, labels: DataFrame, least: float = LEAST_TAIL) -> DataFrame:
    """The documents that a model fitted on the labelled ones (``doc_id``, ``quality``, ``toxic``) expects to be good,
    with all their columns, whatever their names.  Rows are judged one by one by their whole texts: repeated rows and
    equal texts fare alike, a null or empty text has only a look of its own, a null doc_id isn't learned from but is
    judged.  An empty table, or one that the labels don't meet, gives its rows back."""
    model = train(docs, grades_of(labels))
    whole = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return score(whole, model).filter(F.col("p_tail") >= least).select("row.*")


def grades_of(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, p_tail and selected of every document."""
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, grades_of(common.table(spark, sf_dir, "labels")))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "expected_grade", "p_tail", (F.col("p_tail") >= LEAST_TAIL).alias("selected"))
