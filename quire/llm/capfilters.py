"""Embedding near-duplicates: spherical-cap filters from structured random product codes, a join on filters, and exact
verification of what shares one."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import ann, common, components, grid

#: The least cosine for which codes and signs are laid out.
LEAST = 0.95
#: Independent codes, and the filters of one code that a vector passes on average.  Of 20,000 pairs of 64 axes whose
#: cosine is 0.95 exactly, every one shared a filter.
TABLES, PASSED = 16, 6
#: Axes to which shorter vectors are filled up, and directions of half a code.
LEAST_AXES, LEAST_HALF, MOST_HALF = 64, 256, 4096
#: Vectors in a filter from which a dense group is looked for, and entries that meet in one cell of a filter.
HOT, CELL = 64, 2048
#: Signs of random projections that travel with an entry.  At cosine 0.95 13 of 128 differ, give or take 3.4; pairs of
#: single vectors of which more than 38 differ aren't verified.
SIGNS, DIFFER = 128, 38
#: Room for rounding where a pair counts as linked without being compared.
MARGIN = 1e-9


def axes_for(dim: int) -> int:
    return max(LEAST_AXES, 1 << max(1, (dim - 1).bit_length()))


def half_for(rows: int) -> int:
    """Directions of half a code such that a filter holds about half a vector by chance."""
    return int(np.clip(1 << int(np.ceil(np.log2(max(1, 2 * rows * PASSED)) / 2)), LEAST_HALF, MOST_HALF))


@functools.lru_cache(64)
def threshold(axes: int, half: int) -> float:
    """The inner product that a random direction exceeds with PASSED of the half * half filters."""
    t = np.linspace(-1, 1, 200_001)
    share = np.cumsum(((1 - t * t).clip(0) ** ((axes - 3) / 2))[::-1])
    return float(t[::-1][np.searchsorted(share / share[-1], PASSED / half**2)])


@functools.lru_cache(64)
def directions(axes: int, half: int, table: int, side: int) -> np.ndarray:
    v = np.random.default_rng([20_241, axes, half, table, side]).standard_normal((half, axes // 2))
    return v / np.linalg.norm(v, axis=1, keepdims=True) / np.sqrt(2)


def rotated(unit: np.ndarray, table: int) -> np.ndarray:
    """A pseudo-random rotation of vectors filled up with zeros."""
    axes = axes_for(unit.shape[1])
    x = np.zeros((len(unit), axes))
    x[:, : unit.shape[1]] = unit
    rng = np.random.default_rng([20_242, table, axes])
    for _ in range(3):
        x = ann.hadamard(x * rng.choice([-1.0, 1.0], axes))
    return x


def passed(unit: np.ndarray, table: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter): all filters of a code whose direction exceeds the threshold.  A filter is a direction of the left
    half beside one of the right half; a left one counts only if the best right one lifts it over the threshold."""
    y = rotated(unit, table)
    n, axes = y.shape
    least = threshold(axes, half)
    scores = [y[:, : axes // 2] @ directions(axes, half, table, 0).T, y[:, axes // 2 :] @ directions(axes, half, table, 1).T]
    best = [s.max(1) for s in scores]
    (row, left), (row_r, right) = (np.nonzero(scores[k] >= (least - best[1 - k])[:, None]) for k in (0, 1))
    value, value_r = scores[0][row, left], scores[1][row_r, right]
    order = np.lexsort((-value_r, row_r))
    row_r, right, value_r = row_r[order], right[order], value_r[order]
    starts = np.searchsorted(row_r, np.arange(n))
    # right halves lie in falling order within each row, so those that lift a left one enough come first
    fits = np.maximum(np.searchsorted(row_r * 4 + 1 - value_r, row * 4 + 1 - (least - value), "right") - starts[row], 0)
    source = np.repeat(np.arange(len(row)), fits)
    nth = np.arange(len(source)) - np.repeat(np.cumsum(fits) - fits, fits)
    return row[source], left[source] * half + right[starts[row[source]] + nth]


def signs(unit: np.ndarray) -> np.ndarray:
    """(rows, SIGNS / 64): signs of random projections as bits."""
    planes = np.random.default_rng([20_243, unit.shape[1]]).standard_normal((unit.shape[1], SIGNS))
    return np.packbits(unit @ planes > 0, axis=1).view(np.int64)


def _encoded(classes: DataFrame, halves: dict[int, int]) -> DataFrame:
    """Adds the filters that each vector passes, and its signs."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows, filters, sign = [], [], np.zeros((batch.num_rows, 2), np.int64)
                for d, (own, v) in grid.by_length(batch.column("embedding")).items():
                    unit = ann.unit(v)
                    sign[own] = signs(unit)
                    for table in range(TABLES):
                        row, code = passed(unit, table, halves[d])
                        rows.append(own[row])
                        filters.append((d << 32) + (table << 24) * 4 + code)
                row, code = np.concatenate(rows), np.concatenate(filters)
                order = np.lexsort((code, row))
                offsets = np.searchsorted(row[order], np.arange(batch.num_rows + 1)).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(code[order]))
                yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("n"), batch.column("embedding"), listed, pa.array(sign[:, 0]), pa.array(sign[:, 1])], ["cls", "n", "embedding", "filters", "s1", "s2"])

    return classes.select("cls", "n", "embedding").mapInArrow(encode, "cls bigint, n bigint, embedding array<double>, filters array<bigint>, s1 bigint, s2 bigint")


def _labels(coded: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(cls, label): vectors of filters with over HOT vectors, by the fullest filter that theirs lead to."""
    entries = coded.select("cls", F.explode("filters").alias("filter"))
    full = entries.groupBy("filter").agg(F.count("*").alias("size")).filter(F.col("size") > HOT)
    hot = scratch.keep(entries.join(full, "filter"), "hot")
    own = hot.groupBy("cls").agg(F.max(F.struct("size", "filter")).alias("own"))
    led = hot.join(own, "cls").groupBy("filter").agg(F.max("own").alias("led"))
    return hot.join(led, "filter").groupBy("cls").agg(F.max("led")["filter"].alias("label"))


def _centres(members: DataFrame) -> DataFrame:
    """(label, centre): the direction of the sum of each label's unit vectors; batches are summed before they meet."""

    def sums(table: pa.Table, vectors: np.ndarray) -> pa.Table:
        label, which = np.unique(table["label"].to_numpy(), return_inverse=True)
        total = np.zeros((len(label), vectors.shape[1]))
        np.add.at(total, which, vectors)
        offsets = np.arange(0, total.size + 1, vectors.shape[1], dtype=np.int32)
        return pa.table({"label": label, "centre": pa.ListArray.from_arrays(pa.array(offsets), pa.array(total.ravel()))})

    def batch_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, v in grid.by_length(batch.column("embedding")).values():
                yield from sums(pa.Table.from_batches([batch]).take(pa.array(rows)), ann.unit(v)).to_batches()

    def total(table: pa.Table) -> pa.Table:
        (_, v), = grid.by_length(table["centre"]).values()
        return sums(table, v)

    schema = "label bigint, centre array<double>"
    return members.mapInArrow(batch_sums, schema).groupBy("label").applyInArrow(total, schema)


def _cosines(table: pa.RecordBatch, left: str, right: str) -> np.ndarray:
    """Cosines row by row; a row's two vectors are of one length, or its cosine is -1."""
    out = np.full(table.num_rows, -1.0)
    (a, na), (b, nb) = (grid.matrix(table.column(c)) for c in (left, right))
    sa, sb = np.cumsum(na) - na, np.cumsum(nb) - nb
    for d in np.unique(na[na == nb]):
        rows = np.flatnonzero((na == d) & (nb == d))
        x, y = a[sa[rows][:, None] + np.arange(d)], b[sb[rows][:, None] + np.arange(d)]
        some = (x != 0).any(1) & (y != 0).any(1)  # a centre may be zero
        out[rows[some]] = ann.cosine(x[some], y[some])
    return out


def _balls(coded: DataFrame, labels: DataFrame, least: float, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """((cls, ent): members of balls, (ent, centre)).  All members lie within half the angle of ``least`` around their
    centre, so any two of them are linked.  A ball is named after its least member."""
    close = np.sqrt((1 + least) / 2) + MARGIN
    members = scratch.keep(coded.select("cls", "embedding").join(labels, "cls"), "labelled")
    centres = scratch.keep(_centres(members), "centres")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.flatnonzero(_cosines(batch, "embedding", "centre") >= close)
            yield batch.select(["cls", "label"]).take(pa.array(near))

    held = scratch.keep(members.join(centres, "label").select("cls", "label", "embedding", "centre").mapInArrow(inside, "cls bigint, label bigint"), "inside")
    named = held.groupBy("label").agg(F.min("cls").alias("ent"))
    return held.join(named, "label").select("cls", "ent"), named.join(centres, "label").select("ent", "centre")


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of entries that share a cell, rows of which come one after the other.  Two single vectors of which too
    many signs differ are left out."""
    held: pa.Table | None = None

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ent, s1, s2 = (rows[c].to_numpy() for c in ("ent", "s1", "s2"))
        s1, s2 = s1.view(np.uint64), s2.view(np.uint64)  # bits of a negative number would be those of its amount
        ball, block = rows["ball"].to_numpy(), rows["block"].to_numpy()
        cell = np.stack([rows[c].to_numpy() for c in ("filter", "row", "col")])
        new = np.ones(len(ent), bool)
        new[1:] = (cell[:, 1:] != cell[:, :-1]).any(0)
        ends = np.append(np.flatnonzero(new)[1:], len(ent))[np.cumsum(new) - 1]
        one_block = cell[1] == cell[2]
        at, found, size = np.arange(len(ent)), [], 0
        for step in range(1, len(ent)):
            at = at[at + step < ends[at]]
            if not len(at):
                break
            other = at + step
            differ = np.bitwise_count(s1[at] ^ s1[other]).astype(np.int16) + np.bitwise_count(s2[at] ^ s2[other])
            keep = (differ <= DIFFER) | ball[at] | ball[other]
            keep &= (one_block[at] | (block[at] != block[other])) & (ent[at] != ent[other])
            a, b = ent[at[keep]], ent[other[keep]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            size += len(a)
            if size > 500_000:
                yield _batch_of(found)
                found, size = [], 0
        if size:
            yield _batch_of(found)

    def _batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        last = [rows[c][-1].as_py() for c in ("filter", "row", "col")] if rows.num_rows else None
        if last is None:
            continue
        same = np.logical_and.reduce([rows[c].to_numpy() == v for c, v in zip(("filter", "row", "col"), last)])
        cut = int(np.argmax(same))
        if cut:
            yield from pairs(rows.slice(0, cut))
        held = rows.slice(cut)
    if held is not None:
        yield from pairs(held)


def _candidates(entries: DataFrame) -> DataFrame:
    """(a, b) with a < b: entities that share a filter, each pair once.  Filters of more than CELL entries are split
    into cells in which two blocks of them meet."""
    sizes = entries.groupBy("filter").agg(F.count("*").alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / F.lit(CELL)).cast("int")
    own = entries.join(sizes, "filter").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(F.lit(5), "ent"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = met.select("filter", F.least("block", "other").alias("row"), F.greatest("block", "other").alias("col"), "block", "ent", "ball", "s1", "s2")
    dealt = cells.repartition("filter", "row", "col").sortWithinPartitions("filter", "row", "col", "ent")
    return dealt.mapInArrow(_meeting, "a bigint, b bigint").distinct()


def _near(pairs: DataFrame, sides: DataFrame, least: float) -> DataFrame:
    """(a, b, ball_a, ball_b) of pairs whose angle is at most that of ``least`` and, for each side that is a ball, half
    as much again.  ``sides``: id, vec, ball."""
    angle = np.arccos(least)
    bounds = np.array([least, np.cos(1.5 * angle) - MARGIN, np.cos(min(2 * angle, np.pi)) - MARGIN])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            balls = sum(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int8) for c in ("ball_a", "ball_b"))
            keep = np.flatnonzero(_cosines(batch, "vec_a", "vec_b") >= bounds[balls])
            yield batch.select(["a", "b", "ball_a", "ball_b"]).take(pa.array(keep))

    side = lambda x: sides.select(F.col("id").alias(x), F.col("vec").alias(f"vec_{x}"), F.col("ball").alias(f"ball_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ball_a", "ball_b", "vec_a", "vec_b")
    return both.mapInArrow(near, "a bigint, b bigint, ball_a boolean, ball_b boolean")


def linked(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept): each vector's links of cosine >= ``least``, the least id that links lead
    to, and whether it is its own.  ``least`` may not be below LEAST.

    ``vectors`` has vec_id and embedding; other columns are ignored.  Equal vectors are one class.  Each class passes
    the filters of TABLES product codes whose directions it exceeds; classes that share a filter are verified on the
    original vectors in double precision, so no link is wrong, and at a cosine of 0.95 fewer than one in 10,000 is
    missed.  Dense groups are found from overfull filters: members within half the angle around their centre are linked
    with each other by the triangle inequality, count as one ball and are compared only with others.  Vectors that are
    null, empty, zero or hold a null or non-finite component link with nothing; vectors only meet others of their
    length; rows that share an id stand for one vector, the least usable one; rows without an id are left out; an empty
    table gives no rows."""
    if not LEAST <= least <= 1:
        raise ValueError(f"filters find links of cosine {LEAST} or more, not {least}")
    spark = vectors.sparkSession
    scratch = common.Scratch(spark, "cap_filters")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null")
    usable = grid.finite("embedding") & F.exists("embedding", lambda x: x != 0)
    clean = F.when(usable, F.transform("embedding", lambda x: x + F.lit(0.0)))  # a negative zero is a zero
    ids = rows.groupBy("vec_id").agg(F.min(clean).alias("embedding"))
    ids = scratch.keep(ids.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(9), "embedding")}), "ids")
    classes = scratch.keep(ids.filter("embedding is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("cls"), F.count("*").alias("n"), F.first("embedding").alias("embedding")), "classes")
    halves = {int(r[0]): half_for(int(r[1])) for r in classes.groupBy(F.size("embedding")).count().collect()}
    coded = scratch.keep(_encoded(classes, halves), "coded")
    members, centres = _balls(coded, _labels(coded, scratch), least, scratch)
    members, centres = scratch.keep(members, "members"), scratch.keep(centres, "ball_centres")

    known = coded.join(members, "cls", "left")
    single = known.filter("ent is null").select(F.explode("filters").alias("filter"), F.col("cls").alias("ent"), F.lit(False).alias("ball"), "s1", "s2")
    zero = F.lit(0).cast("bigint")
    ball = coded.join(members, "cls").select(F.explode("filters").alias("filter"), "ent").distinct().select("filter", "ent", F.lit(True).alias("ball"), zero.alias("s1"), zero.alias("s2"))
    pairs = scratch.keep(_candidates(single.union(ball)), "pairs")
    sides = known.filter("ent is null").select(F.col("cls").alias("id"), F.col("embedding").alias("vec"), F.lit(False).alias("ball"))
    near = scratch.keep(_near(pairs, sides.union(centres.select("ent", "centre", F.lit(True))), least), "near")

    # what may link with a ball meets each of its members
    wide = near.filter("ball_a or ball_b")
    inner = lambda x: members.select(F.col("ent").alias(x), F.col("cls").alias(f"in_{x}"))
    opened = wide.join(inner("a"), "a", "left").join(inner("b"), "b", "left").select(F.coalesce("in_a", "a").alias("a"), F.coalesce("in_b", "b").alias("b"))
    singles = coded.select(F.col("cls").alias("id"), F.col("embedding").alias("vec"), F.lit(False).alias("ball"))
    links = scratch.keep(near.filter("not ball_a and not ball_b").select("a", "b").union(_near(opened, singles, least).select("a", "b")), "links")

    weight = coded.select("cls", "n")
    both = links.select("a", "b").union(links.select("b", "a"))
    outside = both.join(weight.select(F.col("cls").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("outside"))
    held = members.join(weight, "cls").groupBy("ent").agg(F.sum("n").alias("held"))
    counts = weight.join(members, "cls", "left").join(held, "ent", "left").join(outside.withColumnRenamed("a", "cls"), "cls", "left")
    counts = counts.select("cls", (F.coalesce("held", "n") - 1 + F.coalesce("outside", zero)).alias("n_links"))
    star = members.select(F.col("cls").alias("a"), F.col("ent").alias("b"))
    groups = components.components(links.union(star), scratch, "components").withColumnRenamed("id", "cls")
    classes = classes.select("h1", "h2", "cls").join(counts, "cls").join(groups, "cls", "left")
    of_class = classes.select("h1", "h2", "n_links", F.coalesce("component", "cls").alias("component_id"))
    left = ids.filter("embedding is null").select("vec_id", zero.alias("n_links"), F.col("vec_id").alias("component_id"))
    found = ids.filter("embedding is not null").select("vec_id", "h1", "h2").join(of_class, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    return found.union(left).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op12_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(common.table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.95 END
), r AS (
  SELECT vec_id, vec_id AS reached FROM v
  UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a
)
SELECT r.vec_id, (SELECT count(*) FROM l WHERE l.a = r.vec_id) AS n_links, min(reached) AS component_id,
  r.vec_id = min(reached) AS kept
FROM r GROUP BY r.vec_id
"""
