"""Exact top-k search: tiled matrix products of queries and candidate shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common, grid

#: Scores held at once in a tile.
TILE_SCORES = 4_000_000
#: Rows of a shard below which small tables aren't cut further.
LEAST_ROWS = 1024


def quantised(vectors: np.ndarray) -> np.ndarray:
    return np.floor(1024.0 * vectors)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products.  float64 holds them exactly below 2**53; larger ones are computed in whole numbers
    and held to the range of a long."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)))
    if np.abs(q).max() * np.abs(c).max() * max(q.shape[1], 1) < 2.0**53:
        return q @ c.T
    whole = np.array([[int(x) for x in v] for v in q], dtype=object) @ np.array([[int(x) for x in v] for v in c], dtype=object).T
    top = 2**63 - 1
    return np.array([[min(max(x, -top), top) for x in row] for row in whole], dtype=object)


def _tile(k: int):
    def score(left: pa.Table, right: pa.Table, part: int) -> pa.Table:
        right = right.sort_by("vec_id")
        qids, cids = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
        cands = grid.by_length(right["embedding"])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for d, (qrow, q) in grid.by_length(left["embedding"]).items():
            if d not in cands:
                continue
            crow, c = cands[d]
            q, c, own = quantised(q), quantised(c), cids[crow]
            step = max(1, TILE_SCORES // max(1, len(c)))
            for at in range(0, len(q), step):
                exact = products(q[at : at + step], c)
                s = exact.astype(np.float64) if exact.dtype == object else exact
                ids = qids[qrow[at : at + step]]
                lo, hi = np.searchsorted(own, ids), np.searchsorted(own, ids, side="right")
                for i in np.flatnonzero(lo < hi):
                    s[i, lo[i] : hi[i]] = -np.inf
                if exact.dtype == object:  # too large for float64: sort in whole numbers
                    for i in range(len(s)):
                        order = sorted((j for j in range(len(own)) if s[i, j] > -np.inf), key=lambda j: (-exact[i, j], own[j]))[:k]
                        found.append((np.full(len(order), qrow[at + i]), np.array([-exact[i, j] for j in order], np.int64), own[order]))
                    continue
                r, j = grid.top_of_block(s, own, k)
                found.append((qrow[at + r], (-s[r, j]).astype(np.int64), own[j]))
        rows, neg, ids = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]).astype(np.int64) for i in range(3))
        order = np.argsort(rows, kind="stable")
        return grid.hits_table(qids, part, rows[order], neg[order], ids[order])

    return score


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int, cell_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k highest integer inner products of floor(1024 * x).

    Both inputs have ``vec_id`` and ``embedding``; other columns are ignored.  Queries and candidates meet in a grid
    of cells of at most ``cell_rows`` rows a side; each cell keeps k hits for each query, and the lists are merged in
    a tree.  Rows with a null id, and vectors that are null or hold a null or non-finite component, take no part.
    Vectors only meet others of their own length.  A query never finds rows with its own id; ties go to the smaller
    id.  Where several query rows share an id, the smallest vector stands for them; repeated candidate rows are
    candidates each.  Empty inputs give no rows."""
    keep = lambda df: df.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & grid.finite("embedding"))
    q = keep(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    c = keep(candidates)
    if cell_rows is None:
        slots = 2 * candidates.sparkSession.sparkContext.defaultParallelism
        cell_rows = min(grid.CELL_ROWS, max(LEAST_ROWS, -(-c.count() // slots)))
    q, c, parts = grid.grid(q.withColumn("_all", F.lit(0)), c.withColumn("_all", F.lit(0)), ["_all"], "query_id", "vec_id", cell_rows)
    lists = grid.score_cells(q, c, ["_all"], "bigint", _tile(k))
    best = grid.merge_lists(lists, k, parts)
    hits = best.select(F.col("query").alias("query_id"), F.posexplode("hits").alias("pos", "hit"))
    return hits.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.neg")).alias("score"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return exact_topk(vectors.filter(F.col("vec_id") % 100 == 0), vectors, 10)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
