"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks, and every pair of blocks meets in one task. There the vectors are
quantised to int8 with a scale of their own; a product of int8 tiles (integers, which float32 multiplies exactly up
to a thousand components at a time) gives each inner product with a bound on its error, from the exact norms of what
quantisation left out. A candidate whose upper bound is below the k-th largest lower bound can't be among the k
nearest; the others are recomputed in double precision. A heap for each query, one at a time, merges the blocks' lists.
The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netweave.llm.vectors import block_rows, dot_rows, matrix, usable
from netweave.llm.words import tidied
from netweave.plans.session import materialise

#: Queries of one int8 tile, and components that are summed in one float32 product.
TILE, PART = 256, 1024


class Quantised:
    """Rows as ``scale * code`` plus a remainder of known norm."""

    def __init__(self, x: np.ndarray):
        self.scale = np.abs(x).max(axis=1) / 127.0
        self.code = np.rint(x / self.scale[:, None]).astype(np.int8)
        near = self.code * self.scale[:, None]
        self.near_norm = np.sqrt((near * near).sum(axis=1))
        rest = x - near
        self.rest_norm = np.sqrt((rest * rest).sum(axis=1))
        self.norm = np.sqrt((x * x).sum(axis=1))

    def tile(self, rows: slice, other: Quantised) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of ``rows`` with all of ``other``, and how far off they may be."""
        total = 0.0
        for at in range(0, self.code.shape[1], PART):
            a = self.code[rows, at : at + PART].astype(np.float32)
            total = total + (a @ other.code[:, at : at + PART].astype(np.float32).T).astype(np.float64)
        estimate = total * self.scale[rows, None] * other.scale[None, :]
        off = self.near_norm[rows, None] * other.rest_norm[None, :] + self.rest_norm[rows, None] * other.norm[None, :]
        return estimate, off * (1 + 1e-9) + 1e-12 * self.norm[rows, None] * other.norm[None, :]


def nearest_in_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query in turn its ``k`` nearest of the block, ties to the smaller id: ids, scores, and which are of its id and vector."""
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    qq, cc = Quantised(q), Quantised(c)
    for at in range(0, len(qid), TILE):
        rows = slice(at, min(at + TILE, len(qid)))
        estimate, off = qq.tile(rows, cc)
        low, high = estimate - off, estimate + off
        edge = np.partition(low, len(cid) - k, axis=1)[:, len(cid) - k] if len(cid) > k else np.full(len(low), -np.inf)
        for i in range(len(low)):
            left = np.flatnonzero(high[i] >= edge[i])
            score = dot_rows(c[left], q[at + i])
            best = np.lexsort((cid[left], -score))[:k]
            found = left[best]
            own = cid[found] == qid[at + i]
            own[own] = (c[found[own]] == q[at + i]).all(axis=1)
            yield cid[found], score[best], own


def nearest_neighbours(table: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``table`` with the largest inner product for each row of ``queries``.

    Returns ``query_id, rank`` (from 1), the neighbour's id and ``score``, in double precision. Every row is a candidate,
    and every query row gets a list, also where ids or whole rows repeat; one row of a query's id and vector, its own,
    is not its candidate. Fewer candidates give fewer rows, ties go to the smaller id. What takes part is said in
    ``vectors.usable``, for queries as for candidates; other columns are ignored, an empty table gives an empty result.
    """
    good, dim = usable(table, id_col, vec_col)
    asked, _ = usable(queries, id_col, vec_col, dim)
    numbered = lambda df, name: materialise(df.withColumn("row", F.monotonically_increasing_id()), name)
    good, asked = numbered(good, "vectors"), numbered(asked, "queries")
    rows = block_rows(dim)
    n_c = max(1, -(-good.count() // rows))
    n_q = max(1, -(-asked.count() // rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = good.select("id", "row", "v", F.lit(1).alias("role"), every(n_q).alias("qb"), F.pmod(F.xxhash64("row"), F.lit(n_c)).cast("int").alias("cb")).unionByName(
        asked.select("id", "row", "v", F.lit(0).alias("role"), F.pmod(F.xxhash64("row"), F.lit(n_q)).cast("int").alias("qb"), every(n_c).alias("cb"))
    )
    names = ["query", "query_id", "id", "score", "own"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]

    def block(group: pa.Table) -> pa.Table:
        role = group.column("role").to_numpy()
        row, ids, x = group.column("row").to_numpy(), group.column("id").to_numpy(), matrix(group.column("v"), dim)
        asks = role == 0
        out: list[tuple] = []
        if asks.any() and not asks.all():
            # one more than asked for, as a query's own row may be among them
            for q, i, found in zip(row[asks], ids[asks], nearest_in_block(ids[asks], x[asks], ids[~asks], x[~asks], k + 1), strict=True):
                out.append((np.full(len(found[0]), q), np.full(len(found[0]), i), *found))
        columns = [np.concatenate(c) if c else np.zeros(0) for c in (list(zip(*out, strict=True)) or [()] * 5)]
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    lists = sides.groupBy("qb", "cb").applyInArrow(block, "query long, query_id long, id long, score double, own boolean")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of their query: a heap of the k + 1 best so far, given when the next query begins."""
        out: list[tuple] = []
        heap: list[tuple[float, int, bool]] = []
        last = None

        def close() -> None:
            best = sorted(heap, reverse=True)
            own = next((n for n, (_, _, mine) in enumerate(best) if mine), None)
            if own is not None:
                del best[own]
            out.extend((last[1], rank, -i, s) for rank, (s, i, _) in enumerate(best[:k], 1))

        def rows() -> pa.RecordBatch:
            given = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            made = pa.record_batch([pa.array([x[n] for x in out], kind) for n, kind in enumerate(given)], ["query_id", "rank", id_col, "score"])
            out.clear()
            return made

        for batch in batches:
            for q, of, i, s, mine in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if last is None or q != last[0]:
                    if heap:
                        close()
                    heap, last = [], (q, of)
                (heapq.heappush if len(heap) <= k else heapq.heappushpop)(heap, (s, -i, mine))
            if len(out) > 10_000:
                yield rows()
        if heap:
            close()
        yield rows()

    merged = lists.repartition("query").sortWithinPartitions("query")
    return merged.mapInArrow(tidied(merge), f"query_id long, rank int, `{id_col}` long, score double")
