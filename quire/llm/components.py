"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch


def _star(edges: DataFrame) -> DataFrame:
    """One round: each vertex ties its larger neighbours, then its smaller ones, to the least of them."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(down, "a")
    return small.select(F.col("a"), F.col("m").alias("b")).union(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component): the least id that links lead to, for each id in ``links`` (a, b).  Links of an id with itself
    and null ids are ignored.  Each round is a written table; hubs are pre-aggregated, so no vertex's links meet."""
    pair = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, mark = scratch.keep(pair, f"{name}-0"), None
    step = 0
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            break
        mark = state
        step += 1
        edges = scratch.keep(_star(edges), f"{name}-{step}")
        if step > 1:
            scratch.drop(f"{name}-{step - 2}")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
