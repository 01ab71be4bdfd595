"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector, rotated at random, is coded by the signs of its components, one bit each; stored with the code is the
inner product of the vector and its code's direction. For a rotated vector q and a code x the quotient <x, q> / <x, o>
is an unbiased estimate of <o, q>, and its error is bounded with a confidence that ``SIGMAS`` sets. A pair whose upper
bound is below the threshold is left alone, every other is recomputed in double precision.

Pairs aren't sought everywhere: vectors belong to the cell of their nearest pivot, and a vector is compared with
another cell only if its angle to that cell's pivot exceeds the cell's radius by no more than the angle of the
threshold. By the triangle inequality on angles nothing is lost that way. Rows of equal vectors are one vector that
counts as many, whatever their ids. A task holds a bounded block of a cell and sees its guests pass by; it gives counts and a spanning forest of
the links, never the links themselves, so a group of copies costs its members' rows and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netweave.operators.skew import join_counted
from netweave.llm.vectors import block_rows, dot_rows, matrix, takes_part, usable
from netweave.operators.components import connected_components
from netweave.llm.words import tidied
from netweave.plans.session import materialise

THRESHOLD = 0.9
#: Half-width of the confidence interval; at six the error exceeds it about once in 10**8.
SIGMAS = 6.0
#: Vectors of a cell, about, and how many cells there are at most; pivots are a sample of the vectors.
CELL, MAX_PIVOTS = 4096, 512
GUESTS = 1024


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """``dim`` x ``bits`` with orthonormal rows: a random rotation of the vectors, padded to a multiple of 64 bits, 128 at least."""
    bits = max(128, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim].astype(np.float32)


class Codes:
    """Binary codes of unit vectors, packed, and their correction factors."""

    def __init__(self, unit: np.ndarray, turn: np.ndarray):
        self.rotated = unit.astype(np.float32) @ turn
        self.bits = turn.shape[1]
        self.packed = np.packbits(self.rotated > 0, axis=1)
        self.own = np.abs(self.rotated).sum(axis=1) / np.sqrt(self.bits)

    def estimate(self, rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of rotated unit vectors (rows) with the coded ones (columns), and half their intervals."""
        signs = np.unpackbits(self.packed, axis=1).astype(np.float32) * 2 - 1
        estimate = (rotated @ signs.T) / (np.sqrt(self.bits) * self.own)
        half = SIGMAS * np.sqrt(np.maximum(1 - self.own**2, 0)) / self.own / np.sqrt(self.bits - 1)
        return estimate, half


def links_between(guests: np.ndarray, hosts: np.ndarray, turned: np.ndarray, codes: Codes, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Guest and host numbers of the pairs of unit vectors whose exact cosine reaches ``threshold``."""
    estimate, half = codes.estimate(turned)
    g, h = np.nonzero(estimate + half >= threshold)
    if len(g) > guests.shape[0] * hosts.shape[0] // 16:  # most need it: all at once is cheaper
        exact = guests @ hosts.T
        near = exact >= threshold - 1e-9
        g, h = np.nonzero(near)
    keep = np.concatenate([np.zeros(0, bool), *(dot_rows(guests[g[a : a + 65536]], hosts[h[a : a + 65536]]) >= threshold for a in range(0, len(g), 65536))])
    return g[keep], h[keep]


class _Block:
    """The hosts of one task: counts of links and a union-find of the hosts by root number."""

    def __init__(self, cell: tuple, ids: np.ndarray, times: np.ndarray, unit: np.ndarray, turn: np.ndarray):
        order = np.argsort(ids)
        self.cell, self.ids, self.times, self.unit = cell, ids[order], times[order], unit[order]
        self.codes = Codes(self.unit, turn)
        self.links = np.zeros(len(ids), np.int64)
        self.root = np.arange(len(ids))

    def meet(self, ids: np.ndarray, times: np.ndarray, unit: np.ndarray, visitor: np.ndarray, turn: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
        """Rows ``id, other, links``: the guests' counts, each with a host that it is linked to."""
        g, h = links_between(unit, self.unit, unit.astype(np.float32) @ turn, self.codes, threshold)
        # two of the same cell meet twice, each being the other's guest once; one meeting counts
        keep = visitor[g] | (self.ids[h] < ids[g])
        g, h = g[keep], h[keep]
        if not len(g):
            return []
        np.add.at(self.links, h, times[g])
        count = np.bincount(g, self.times[h], minlength=len(ids)).astype(np.int64)
        out = []
        edge = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        for a, b in zip(edge, np.append(edge[1:], len(g)), strict=True):
            roots = np.unique(self.root[h[a:b]])
            if len(roots) > 1:
                self.root[np.isin(self.root, roots)] = roots[0]
            out.append((int(ids[g[a]]), int(self.ids[h[a]]), int(count[g[a]])))
        return out

    def close(self) -> list[tuple[int, int, int]]:
        touched = np.flatnonzero((self.links > 0) | (self.root != np.arange(len(self.root))))
        return [(int(self.ids[i]), int(self.ids[self.root[i]]), int(self.links[i])) for i in touched]


def near_duplicate_vectors(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row of ``table``.

    ``n_links`` is the number of other rows whose vector has a cosine of ``threshold`` or more, ``component_id`` the
    smallest id that links reach, ``kept`` whether that is the row's own. Rows that take no part (see
    ``vectors.usable``) are linked with nothing and have their own id as component; a null id has a null component and
    is kept. Repeated ids and repeated rows are rows like others. Other columns are ignored; an empty table gives an
    empty result.
    """
    good, dim = usable(table, id_col, vec_col)
    copies = good.groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("times"))
    # a vector's own number, written down so that it stays the same
    copies = materialise(copies.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    n = copies.count()
    n_pivots = max(1, min(MAX_PIVOTS, -(-n // CELL)))
    pivots = np.array([r["v"] for r in copies.orderBy(F.xxhash64("v"), "v").limit(n_pivots).collect()], np.float64).reshape(-1, max(dim, 1))
    pivots /= np.maximum(np.sqrt((pivots * pivots).sum(axis=1, keepdims=True)), 1e-300)
    turn = rotation(max(dim, 1))
    rows_a_block = block_rows(dim, most=CELL)
    reach_angle = float(np.arccos(min(1.0, threshold))) + 1e-6

    def unit_rows(column: pa.Array) -> np.ndarray:
        x = matrix(column, dim)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
        return x / np.sqrt(dot_rows(x, x))[:, None]

    def angles(unit: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(unit @ pivots.T, -1, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angle = angles(unit_rows(batch.column("v")))
                cell = angle.argmin(axis=1)
                yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell])], [*batch.schema.names, "cell", "angle"])

    element = copies.schema["v"].dataType.simpleString()
    placed = materialise(copies.select("v", "rep", "times").mapInArrow(tidied(assign), f"v {element}, rep long, times long, cell int, angle double"), "cells")
    radius, size = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect():
        radius[r["cell"]], size[r["cell"]] = r["r"], r["n"]
    blocks = np.maximum(1, -(-size // rows_a_block))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                cell, rep = part.column("cell").to_numpy(), part.column("rep").to_numpy()
                # a guest of its own cell, and of each later cell within reach; in every block of it
                near = angles(unit_rows(part.column("v"))) <= radius + reach_angle
                near &= np.arange(len(pivots)) > cell[:, None]
                near[np.arange(len(cell)), cell] = True
                who, where = np.nonzero(near)
                who, where, block = np.repeat(who, blocks[where]), np.repeat(where, blocks[where]), np.concatenate([np.arange(b) for b in blocks[where]])
                mine = rep % blocks[cell]
                take = np.concatenate([np.arange(len(cell)), who])
                role = np.concatenate([np.zeros(len(cell), int), np.where(where == cell[who], 1, 2)])
                for start in range(0, len(take), 4096):
                    s = slice(start, start + 4096)
                    rows = part.take(pa.array(take[s]))
                    yield pa.record_batch(
                        [pa.array(np.concatenate([cell, where])[s], pa.int32()), pa.array(np.concatenate([mine, block])[s], pa.int32()), pa.array(role[s], pa.int32()), rows.column("rep"), rows.column("times"), rows.column("v")],
                        ["cell", "block", "role", "rep", "times", "v"])

    dealt = placed.mapInArrow(tidied(visit), f"cell int, block int, role int, rep long, times long, v {element}")
    n_blocks = int(blocks.sum())
    dealt = dealt.repartition(max(1, min(n_blocks * 4, 20_000)), "cell", "block").sortWithinPartitions("cell", "block", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(out: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["id", "other", "links"])

        block, hosts, last = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("cell", "block", "role")], 1).astype(np.int64)
            key[:, 2] = key[:, 2] > 0
            edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            for a, b in zip(edge, np.append(edge[1:], len(key)), strict=True):
                for at in range(a, b, GUESTS):
                    part = batch.slice(at, min(GUESTS, b - at))
                    ids, times, role, unit = part.column("rep").to_numpy(), part.column("times").to_numpy(), part.column("role").to_numpy(), unit_rows(part.column("v"))
                    here = (key[at][0], key[at][1])
                    if here != last:
                        if block:
                            yield rows(block.close())
                        block, hosts, last = None, [], here
                    if not key[at][2]:
                        hosts.append((ids, times, unit))
                        continue
                    if hosts:
                        block = _Block(here, *(np.concatenate(x) for x in zip(*hosts, strict=True)), turn)
                        hosts = []
                    if block:
                        yield rows(block.meet(ids, times, unit, role == 2, turn, threshold))
        if block:
            yield rows(block.close())

    found = materialise(dealt.mapInArrow(tidied(compare), "id long, other long, links long"), "links")
    counts = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    parts = materialise(connected_components(found.select(F.col("id").alias("u"), F.col("other").alias("v"))), "components")
    # a component is named by the smallest id of its rows
    ends = parts.join(copies.select(F.col("rep").alias("node"), "low"), "node").groupBy("component").agg(F.min("low").alias("least"), F.count("*").alias("held"))
    named = join_counted(parts, ends, "component", "held", parts.count()).select(F.col("node").alias("rep"), "least")
    # copies: each is linked with its fellows, and with all that the one that stands for them is linked with
    known = copies.drop("v").join(counts, "rep", "left").join(named, "rep", "left")
    known = materialise(known.select("rep", "low", "times", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("least", "low").alias("component_id")), "known")
    single = known.where("times = 1").select(F.col("low").alias("id"), "n_links", "component_id")
    # no vector holds more than its rows, and those that hold many are few
    several = known.where("times > 1").select("rep", "times", "n_links", "component_id").join(copies.select("rep", "v"), "rep")
    alike = join_counted(good, several, "v", "times", int(known.agg(F.sum("times")).first()[0] or 0)).select("id", "n_links", "component_id")
    ident = F.col(id_col).cast("long")
    apart = table.where(~(takes_part(id_col, vec_col) & (F.size(vec_col) == dim))).select(ident.alias("id"), F.lit(0).cast("long").alias("n_links"), ident.alias("component_id"))
    rows = single.unionByName(alike).unionByName(apart)
    return rows.select(F.col("id").alias(id_col), F.col("n_links").cast("long"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
