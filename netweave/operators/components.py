"""Connected components of an undirected edge list, by alternating star contraction.

Every round is two aggregations and two equi-joins; the number of rounds grows with the logarithm of the
longest chain, so a snake-like net does not need one round per hop. Nothing is collected: the driver only
reads three counters a round to see whether the edge set still changes. The edges of a node with very many neighbours
stay where they are, and a round's table goes when the next one stands.

A few edges, counted first, are labelled in one task, by hooking and pointer jumping on arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netweave.operators.skew import join_counted
from netweave.plans.session import discard, materialise

#: Up to so many edges one task is enough; it holds some 60 bytes an edge.
FEW_EDGES = 1 << 20


def in_one_task(df: DataFrame) -> DataFrame:
    """A small table, its rows counted before, as one partition."""
    return df.coalesce(1)


def arrays(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    """The columns of all batches; of integers without nulls."""
    parts = [[batch.column(c).to_numpy(zero_copy_only=False) for c in names] for batch in batches if batch.num_rows]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64) for _ in names]


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = arrays(batches, ["u", "v"])
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while not (root[a] == root[b]).all():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    yield pa.record_batch([pa.array(names, pa.int64()), pa.array(names[root], pa.int64())], ["node", "component"])


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.sum(F.when(F.col("u") == F.col("v"), 1).otherwise(0)).alias("loops"),
    ).first()
    return row["n"], row["x"], row["loops"]


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """Label the nodes of an undirected graph.

    ``edges`` holds pairs of orderable, non-null ids (rows with a null end are ignored, self-loops and repeats
    are harmless). Returns ``node, component`` for every node that occurs in an edge with two different ends;
    ``component`` is the smallest id in the node's component. An empty input gives an empty result.
    """
    spark = edges.sparkSession
    cur = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    cur = materialise(cur)
    state = _digest(cur)
    if state[0] <= FEW_EDGES and all(cur.schema[c].dataType.simpleString() == "bigint" for c in ("u", "v")):
        return materialise(in_one_task(cur).mapInArrow(_label, "node bigint, component bigint"), "components")
    while state[0]:
        # large star: larger neighbours of a node are hung on the smallest node of its neighbourhood
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        star = (
            join_counted(both, low, "u", "n", 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        )
        # small star: a node and its smaller neighbours are hung on the smallest of them
        star = materialise(star)
        low = star.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hung = join_counted(star, low, "u", "n", star.count())
        last, cur = cur, (
            hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(hung.select("u", F.col("m").alias("v")))
            .where("u > v")
            .distinct()
        )
        cur = materialise(cur)
        discard(last)
        discard(star)
        now = _digest(cur)
        if now == state:
            break
        state = now
    low = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return low.unionByName(roots)
