"""Reachability from start nodes.

Where edges are few, by a count that is made first, a search runs in one task; else a level is a round of joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netweave.operators import components as K
from netweave.operators.components import arrays, connected_components, in_one_task
from netweave.plans.session import Growing, materialise


def reach_components(contacts: DataFrame, seeds: DataFrame) -> DataFrame:
    """``gid`` of all that contacts (``a, b``, either way) connect with a seed (``gid``); seeds without contacts too.

    Labels all components, in rounds that grow with the logarithm of the longest chain.
    """
    parts = materialise(connected_components(contacts, "a", "b").withColumnRenamed("node", "gid"), "components")
    start = seeds.select("gid").distinct()
    hit = parts.join(start, "gid").select("component").distinct()
    return parts.join(hit, "component").select("gid").unionByName(start).distinct()


def reach_frontier(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node, level`` of all that directed edges (``src, dst``) lead to from a seed (``node``), a level a round.

    Many edges cost what is reached, a job a level: for shallow searches, and for edges that lead one way.
    """
    asked = seeds.select(F.col("node").alias("src"), F.lit(-1).cast("bigint").alias("dst"), F.lit(True).alias("seed"))
    both = edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"), F.lit(False).alias("seed")).unionByName(asked)
    if both.count() <= K.FEW_EDGES:
        return materialise(in_one_task(both).mapInArrow(_levels, "node bigint, level int"), "levels")
    frontier, level = materialise(seeds.select("node", F.lit(0).alias("level")).distinct(), "frontier"), 0
    visited = Growing(frontier)
    while True:
        level += 1
        found = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = materialise(found.join(visited.df, "node", "left_anti").withColumn("level", F.lit(level)), "frontier")
        if frontier.isEmpty():
            return visited.df
        visited.add(frontier)


def _expand(first: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of all edges that begin at the nodes ``at``."""
    n = count[at]
    return np.repeat(first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    src, dst, seed = arrays(batches, ["src", "dst", "seed"])
    seed = seed.astype(bool)
    start, src, dst = np.unique(src[seed]), src[~seed], dst[~seed]
    names, at = np.unique(np.concatenate([start, src, dst]), return_inverse=True)
    front, a, b = at[: len(start)], at[len(start) : len(start) + len(src)], at[len(start) + len(src) :]
    b = b[np.argsort(a, kind="stable")]
    count = np.bincount(a, minlength=len(names))
    first = np.cumsum(count) - count
    level, depth = np.full(len(names), -1, np.int32), 0
    while len(front):
        level[front] = depth
        front = np.unique(b[_expand(first, count, front)])
        front, depth = front[level[front] < 0], depth + 1
    hit = level >= 0
    yield pa.record_batch([pa.array(names[hit], pa.int64()), pa.array(level[hit])], ["node", "level"])


def reach_conditional(edges: DataFrame, gated: DataFrame, start: int) -> DataFrame:
    """``node`` of all that ``edges`` (``src, dst``) lead to from ``start``, and ``gated`` ones (``src, dst, need``) once ``need`` is reached."""
    free = edges.select("src", "dst", F.lit(None).cast("bigint").alias("need"))
    both = free.unionByName(gated.select("src", "dst", "need"))
    if both.count() <= K.FEW_EDGES:

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ways: dict[int, list[tuple[int, int | None]]] = {}
            waiting: dict[int, list[tuple[int, int]]] = {}
            for batch in batches:
                for s, d, need in zip(*(batch.column(c).to_pylist() for c in ("src", "dst", "need")), strict=True):
                    ways.setdefault(s, []).append((d, need))
                    if need is not None:
                        waiting.setdefault(need, []).append((s, d))
            seen, queue = {start}, [start]
            for node in queue:
                new = [d for d, need in ways.get(node, []) if need is None or need in seen]
                new += [d for s, d in waiting.get(node, []) if s in seen]
                for d in new:
                    if d not in seen:
                        seen.add(d)
                        queue.append(d)
            yield pa.record_batch([pa.array(queue, pa.int64())], ["node"])

        return materialise(in_one_task(both).mapInArrow(search, "node bigint"), "reached")
    spark, size = edges.sparkSession, 0
    seed = spark.createDataFrame([(start,)], "node bigint")
    found = seed
    while True:
        open_ = gated.join(found.select(F.col("node").alias("need")), "need", "left_semi").select("src", "dst")
        found = reach_frontier(materialise(edges.select("src", "dst").unionByName(open_), "ways"), seed).select("node")
        now = found.count()
        if now == size:
            return found
        size = now
