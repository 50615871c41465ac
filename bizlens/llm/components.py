"""Connected components of an edge table by alternating large and small stars.

Every round is two aggregations (smallest neighbour per node) and joins, so a node with a third
of all edges is pre-aggregated like any other key. The loop ends when the edges no longer
change; then every node hangs directly below the smallest node of its component. It never
returns earlier: should ``max_rounds`` not suffice, it raises.

A round is many short stages over light rows, so the edges are read in as many tasks as their
number needs (``EDGES_PER_TASK``) rather than in one per shuffle partition.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import materialize

EDGES_PER_TASK = 20_000


def _stored(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``edges`` computed once, read in tasks of about ``EDGES_PER_TASK`` rows (``rows``: their number, where known)."""
    edges = materialize(edges)
    return edges.coalesce(max(1, math.ceil((edges.count() if rows is None else rows) / EDGES_PER_TASK)))


def _state(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node below the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours below the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b, not NULL); the component is
    its smallest node. Self-links and repeated edges are allowed; no edges give no rows."""
    nodes = edges.where("a = b").select("a").distinct()
    current = _stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(current)
    if before[0]:
        for _ in range(max_rounds):
            # neither star has more edges than it is given
            current = _stored(_small_star(_stored(_large_star(current), before[0])), before[0])
            after = _state(current)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components still change after {max_rounds} rounds")
    below = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    alone = nodes.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return below.unionByName(roots).unionByName(alone.join(below.unionByName(roots).select("node"), "node", "left_anti"))
