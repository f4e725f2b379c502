"""Blocked query-by-candidate scoring: oversize groups become a grid of bounded cells, and
per-cell top lists are merged in a tree."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of either side in one cell.
CELL_ROWS = 16_384
#: Lists that meet in one step of the merge tree.
FAN_IN = 8
HITS = "hits array<struct<neg:{kind},id:bigint>>"


def finite(vec: str) -> Column:
    """True where the vector has a value and each component is a finite number."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vec).isNotNull() & ok, F.lit(False))


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat float64 values and the length of each list."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    lengths = np.diff(arr.offsets.to_numpy())
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lengths


def by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (row numbers, matrix)}: vectors of different lengths never meet."""
    flat, lengths = matrix(column)
    starts = np.cumsum(lengths) - lengths
    out = {}
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        out[int(d)] = rows, flat[starts[rows][:, None] + np.arange(d)]
    return out


def top_of_block(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest scores, ties to the smaller id; -inf counts as absent."""
    n = scores.shape[1]
    if n > k:
        floor = np.partition(scores, n - k, axis=1)[:, n - k]
        row, col = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
    else:
        row, col = np.nonzero(scores > -np.inf)
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def grid(queries: DataFrame, candidates: DataFrame, keys: list[str], qid: str, cid: str, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame, int]:
    """Adds (row, col) cell numbers so that no cell holds more than about ``cell_rows`` of either side.

    A group with Q queries and C candidates becomes ceil(Q / cell_rows) x ceil(C / cell_rows) cells; a query is
    repeated in each column of its group and a candidate in each row.  Returns both sides and the most columns."""
    sizes = queries.groupBy(*keys).agg(F.count("*").alias("q")).join(candidates.groupBy(*keys).agg(F.count("*").alias("c")), keys)
    cut = lambda n: F.ceil(F.col(n) / F.lit(cell_rows)).cast("int")
    large = sizes.filter((F.col("q") > cell_rows) | (F.col("c") > cell_rows)).select(*keys, cut("q").alias("_r"), cut("c").alias("_c"))
    columns = large.agg(F.max("_c")).first()[0] or 1
    one = lambda n: F.coalesce(F.col(n), F.lit(1))
    spread = lambda id_, n: F.pmod(F.xxhash64(F.lit(11), F.col(id_)), one(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), one(n) - 1))
    q = queries.join(large, keys, "left").withColumn("_row", spread(qid, "_r")).withColumn("_col", every("_c"))
    c = candidates.join(large, keys, "left").withColumn("_col", spread(cid, "_c")).withColumn("_row", every("_r"))
    return q.drop("_r", "_c"), c.drop("_r", "_c"), columns


def hits_table(query: np.ndarray, part: int, rows: np.ndarray, neg: np.ndarray, ids: np.ndarray) -> pa.Table:
    """One row for each query: its list of (neg, id); ``rows`` are sorted positions in ``query``."""
    found, counts = np.unique(rows, return_counts=True)
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(neg), pa.array(ids)], names=["neg", "id"])
    return pa.table({"query": pa.array(query[found]), "part": pa.array(np.full(len(found), part, np.int32)), "hits": pa.ListArray.from_arrays(pa.array(offsets), items)})


def score_cells(q: DataFrame, c: DataFrame, keys: list[str], kind: str, scorer: Callable[[pa.Table, pa.Table, int], pa.Table]) -> DataFrame:
    """Runs ``scorer`` in each cell: (query, part, hits)."""
    keys = [*keys, "_row", "_col"]
    schema = f"query bigint, part int, {HITS.format(kind=kind)}"
    empty = pa.schema([("query", pa.int64()), ("part", pa.int32()), ("hits", pa.list_(pa.struct([("neg", pa.int64() if kind == "bigint" else pa.float64()), ("id", pa.int64())])))])

    def cell(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty.empty_table()
        return scorer(left, right, int(key[-1].as_py())).cast(empty)

    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(cell, schema)


def merge_lists(lists: DataFrame, k: int, parts: int, distinct: bool = False) -> DataFrame:
    """Merges each query's lists FAN_IN parts at a time, so that a merge holds a bounded number of entries."""
    while True:
        parts = -(-parts // FAN_IN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int") if parts > 1 else F.lit(0))
        merged = F.flatten(F.collect_list("hits"))
        merged = F.array_distinct(merged) if distinct else merged
        lists = lists.groupBy("query", "part").agg(F.slice(F.sort_array(merged), 1, k).alias("hits"))
        if parts <= 1:
            return lists.drop("part")
