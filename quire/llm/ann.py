"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import common, grid

TABLES = 16
#: Rows that a bucket should hold; more rows mean more rotations in a hash.
BUCKET_ROWS = 512
#: Queries on which the number of probes is fitted, and the recall that it must reach there.
FIT_QUERIES, FIT_RECALL = 128, 0.97
#: Probes a table beyond which all classes are scored instead.
PROBES = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    m, half = x.shape[1], 1
    while half < m:
        x = x.reshape(len(x), m // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(-1, m)
        half *= 2
    return x / np.sqrt(m)


def rotated(unit: np.ndarray, table: int, part: int) -> np.ndarray:
    """A pseudo-random rotation: three rounds of random signs and a Hadamard transform."""
    m = 1 << max(1, int(unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), m))
    x[:, : unit.shape[1]] = unit
    rng = np.random.default_rng([20_240, table, part, m])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], m))
    return x


def axes(m: int, part: int, widths: list[int]) -> int:
    """Axes that count in this part of a hash: all, or fewer in the last."""
    return min(m, widths[part])


def parts_for(rows: int, dim: int) -> list[int]:
    """Axes of each part such that buckets hold about BUCKET_ROWS rows; always at least one full part."""
    m = 1 << max(1, (dim - 1).bit_length())
    widths, buckets = [m], 2 * m
    while rows / buckets > BUCKET_ROWS:
        more = min(m, 1 << max(0, int(np.ceil(np.log2(rows / buckets / BUCKET_ROWS))) - 1))
        widths.append(more)
        buckets *= 2 * more
    return widths


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def codes(u: np.ndarray, widths: list[int]) -> np.ndarray:
    """The bucket of each row in each table."""
    out = np.zeros((len(u), TABLES), np.int64)
    for t in range(TABLES):
        for p in range(len(widths)):
            y = rotated(u, t, p)[:, : axes(1 << 30, p, widths)]
            axis = np.abs(y).argmax(1)
            side = y[np.arange(len(y)), axis] < 0
            out[:, t] = out[:, t] * (2 * y.shape[1]) + 2 * axis + side
    return out


def probes(u: np.ndarray, widths: list[int], most: int) -> np.ndarray:
    """(rows, tables, most) buckets, nearest first: those whose signed axes lie closest to the rotated query."""
    out = np.full((len(u), TABLES, most), -1, np.int64)
    for t in range(TABLES):
        code, cost = np.zeros((len(u), 1), np.int64), np.zeros((len(u), 1))
        for p in range(len(widths)):
            y = rotated(u, t, p)[:, : axes(1 << 30, p, widths)]
            signed = np.stack([y, -y], 2).reshape(len(y), -1)
            near = np.argsort(-signed, axis=1, kind="stable")[:, : min(most, signed.shape[1])]
            best = np.take_along_axis(signed, near, 1)
            gap = (best[:, :1] - best) ** 2
            code = (code[:, :, None] * signed.shape[1] + near[:, None, :]).reshape(len(y), -1)
            cost = (cost[:, :, None] + gap[:, None, :]).reshape(len(y), -1)
            take = np.argsort(cost, axis=1, kind="stable")[:, :most]
            code, cost = np.take_along_axis(code, take, 1), np.take_along_axis(cost, take, 1)
        out[:, t, : code.shape[1]] = code
    return out


def cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row, in double precision on the vectors as they are."""
    a, b = np.abs(q).max(1), np.abs(c).max(1)
    q, c = q / a[:, None], c / b[:, None]
    return (q * c).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((c * c).sum(1)))


def _pairs(left: pa.Table, right: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, -cosine, candidate row) of each query's k best candidates in this block."""
    cands, place = grid.by_length(right["embedding"]), right["place"].to_numpy()
    found = []
    for d, (qrow, q) in grid.by_length(left["embedding"]).items():
        if d not in cands:
            continue
        crow, c = cands[d]
        uq, uc = unit(q), unit(c)
        step = max(1, 4_000_000 // max(1, len(c)))
        for at in range(0, len(q), step):
            r, j = grid.top_of_block(np.round(uq[at : at + step] @ uc.T, 14), place[crow], k)
            found.append((qrow[at + r], -cosine(q[at + r], c[j]), crow[j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    rows, neg, cols = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.argsort(rows, kind="stable")
    return rows[order], neg[order], cols[order]


def _fit(coded: DataFrame, sample: DataFrame, k: int, widths: dict[int, list[int]]) -> int:
    """The least probes a table that reach FIT_RECALL on the sample, whose true neighbours one scan finds; above PROBES
    where so many don't."""
    queries = sample.toArrow()
    if not queries.num_rows:
        return 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = pa.Table.from_batches([batch])
            rows, neg, cols = _pairs(queries, right, k + 1)
            yield from pa.table({"query": queries["vec"].take(pa.array(rows)), "neg": pa.array(neg), "vec": right["vec"].take(pa.array(cols)), "place": right["place"].take(pa.array(cols)), "codes": right["codes"].take(pa.array(cols))}).to_batches()

    near = coded.mapInArrow(scan, "query bigint, neg double, vec bigint, place bigint, codes array<bigint>").filter("query <> vec")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("neg", "place"))
    truth = near.withColumn("r", rank).filter(F.col("r") <= k).select("query", "codes").toArrow()
    at = {v: i for i, v in enumerate(queries["vec"].to_pylist())}
    needed, most = [], PROBES
    for d, (rows, q) in grid.by_length(queries["embedding"]).items():
        seen = probes(unit(q), widths.get(d, parts_for(0, d)), most)
        row_of = {r: i for i, r in enumerate(rows)}
        for query, code in zip(truth["query"].to_pylist(), truth["codes"].to_pylist()):
            if at[query] in row_of:
                hit = seen[row_of[at[query]]] == np.asarray(code)[:, None]
                needed.append(int(np.where(hit.any(1), hit.argmax(1), most).min()))
    return int(np.quantile(needed, FIT_RECALL, method="higher")) + 1 if needed else 1


def nearest(queries: DataFrame, candidates: DataFrame, k: int, cell_rows: int = grid.CELL_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of largest cosine among those it finds.

    Both inputs have ``vec_id`` and ``embedding``; other columns are ignored.  Equal vectors form one class, of
    which the k + 1 smallest ids are kept: no query can need more.  Each class is hashed into TABLES tables; a query
    looks into its nearest buckets of each, their number fitted on up to FIT_QUERIES queries whose true neighbours
    one scan over all rows finds.  What shares a bucket is scored exactly on the original vectors.  Oversize buckets
    are split into a grid of cells, never cut.  Where PROBES probes don't reach FIT_RECALL, and for queries that find
    fewer than they could, the queries are scored against all classes in such cells.  Rows with a null id, and vectors that are null, empty, zero or hold
    a null or non-finite component, take no part; vectors only meet others of their length; ties go to the smaller
    id; a query never finds its own id; empty inputs give no rows."""
    spark = candidates.sparkSession
    scratch = common.Scratch(spark, "nearest")

    def valid(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        df = df.filter(F.col("vec_id").isNotNull() & grid.finite("embedding")).filter(F.exists("embedding", lambda x: x != 0))
        return df.withColumn("vec", F.xxhash64("embedding"))

    ids, wanted = valid(candidates), valid(queries).select("vec_id", "vec", "embedding").distinct()
    pick = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = ids.withColumn("n", pick).filter(F.col("n") <= k + 1)
    classes = few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding"))
    dims = {int(r[0]): int(r[1]) for r in ids.groupBy(F.size("embedding")).count().collect()}
    widths = {d: parts_for(n, d) for d, n in dims.items()}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, TABLES), np.int64)
            for d, (rows, v) in grid.by_length(batch.column("embedding")).items():
                out[rows] = codes(unit(v), widths[d])
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, TABLES, dtype=np.int32)), pa.array(out.ravel()))
            names = ["vec", "ids", "place", "embedding"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), listed], [*names, "codes"])

    # classes are numbered in order of their smallest ids, so that merged lists put equal cosines in that order
    classes = classes.withColumn("first", F.col("ids")[0]).repartitionByRange("first", "vec").sortWithinPartitions("first", "vec")
    classes = classes.withColumn("place", F.monotonically_increasing_id())
    coded = scratch.keep(classes.mapInArrow(encode, "vec bigint, ids array<bigint>, place bigint, embedding array<double>, codes array<bigint>"), "coded")
    sought = scratch.keep(wanted.groupBy("vec").agg(F.first("embedding").alias("embedding")), "queries")
    most = _fit(coded, sought.orderBy(F.xxhash64(F.lit(3), "vec")).limit(FIT_QUERIES), k, widths)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, (rows, v) in grid.by_length(batch.column("embedding")).items():
                seen = probes(unit(v), widths.get(d, parts_for(0, d)), most)
                row, tab, nth = np.nonzero(seen >= 0)
                taken = pa.array(rows[row])
                yield pa.RecordBatch.from_arrays([batch.column("vec").take(taken), pa.array(tab.astype(np.int32)), pa.array(seen[row, tab, nth]), batch.column("embedding").take(taken)], ["vec", "tab", "bucket", "embedding"])

    q = sought.mapInArrow(look, "vec bigint, tab int, bucket bigint, embedding array<double>")
    c = coded.select("vec", "place", "embedding", F.posexplode("codes").alias("tab", "bucket"))
    keys = ["tab", "bucket"]

    def score(left: pa.Table, right: pa.Table, part: int) -> pa.Table:
        rows, neg, cols = _pairs(left, right, k + 1)
        return grid.hits_table(left["vec"].to_numpy(), part, rows, neg, right["place"].to_numpy()[cols])

    def search(q: DataFrame, c: DataFrame) -> DataFrame:
        q, c, parts = grid.grid(q, c, keys, "vec", "vec", cell_rows)
        lists = grid.score_cells(q, c, keys, "double", score).withColumn("part", F.col("part") + parts * F.pmod(F.hash("hits"), F.lit(16)))
        return grid.merge_lists(lists, 4 * (k + 1), 16 * parts, distinct=True)

    def whole(df: DataFrame) -> DataFrame:
        return df.drop("ids", "codes").withColumns({"tab": F.lit(0), "bucket": F.lit(0).cast("bigint")})

    if most > PROBES:
        best = search(whole(sought), whole(coded))
    else:
        best = scratch.keep(search(q, c), "best")
        dim = F.size("embedding").alias("dim")
        enough = sought.select("vec", dim).join(F.broadcast(coded.groupBy(dim).agg(F.least(F.count("*"), F.lit(k + 1)).alias("least"))), "dim")
        short = enough.join(best.select(F.col("query").alias("vec"), F.size("hits").alias("n")), "vec", "left").filter("coalesce(n, 0) < least").select("vec")
        short = scratch.keep(sought.join(short, "vec", "left_semi"), "short")
        if not short.isEmpty():
            best = best.join(short.select(F.col("vec").alias("query")), "query", "left_anti").unionByName(search(whole(short), whole(coded)))
    opened = best.select(F.col("query").alias("qvec"), F.explode("hits").alias("hit")).select("qvec", F.col("hit.neg").alias("neg"), F.col("hit.id").alias("place"))
    opened = opened.join(coded.select("place", "ids"), "place").select("qvec", "neg", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy("neg", "vec_id")
    answers = wanted.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec")).distinct().join(opened, "qvec").filter("query_id <> vec_id")
    answers = answers.groupBy("query_id", "vec_id").agg(F.min("neg").alias("neg")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return answers.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", (-F.col("neg")).alias("score"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return nearest(vectors.filter(F.col("vec_id") % 50 == 0), vectors, 5)
