"""Transistor gates: where a poly shape crosses an active area, the area is cut, and conducts only if the poly is driven.

Cutting is geometry and done once for all areas, and so is what each poly makes conduct. What depends on the search, which
polys are driven and in which order pieces are entered, is a search: where edges are few, by a count that is made first,
a queue in one task; else by levels, whose new nodes are found by joins and numbered in the order in which a queue would
have taken them in, so that results which depend on that order come out the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from netweave.functions import geometry as G
from netweave.operators import components as K
from netweave.operators.spatial import BOX, box_pairs, touching
from netweave.plans.session import Growing, materialise
from netweave.sources.layout_text import gid_pid

SLICE_BASE = 1 << 62
_PIECE_BITS = 24


def piece_node(aa: Column, idx: Column) -> Column:
    """The node number of a piece of an active area (by gid); never a gid."""
    return F.lit(SLICE_BASE) + F.shiftleft(gid_pid(aa).cast("bigint"), _PIECE_BITS) + idx.cast("bigint")


def gate_candidates(polygons: DataFrame, poly_lid: int, aa_lid: int) -> DataFrame:
    """``poly, aa``: gids whose boxes share a point. If both are of one layer, a polygon is its own candidate too."""
    spark = polygons.sparkSession
    poly, aa = polygons.where(F.col("lid") == poly_lid), polygons.where(F.col("lid") == aa_lid)
    pairs = box_pairs(poly, aa, spark.createDataFrame([(poly_lid, aa_lid)], "lid int, nlid int")).select(F.col("a").alias("poly"), F.col("b").alias("aa"))
    return pairs.unionByName(poly.select(F.col("gid").alias("poly"), F.col("gid").alias("aa"))) if poly_lid == aa_lid else pairs


def gate_crossings(polygons: DataFrame, candidates: DataFrame) -> DataFrame:
    """Polys clipped to the box of an area, in half units, and the sides of the box they reach.

    ``poly, aa``, the area's box in half units (``left2, right2, bottom2, top2``), the clipped poly's (``minx2 ...``) and
    ``on_left, on_right, on_bottom, on_top``.
    """
    side = ("left2", "bottom2", "right2", "top2")
    aa = polygons.select(F.col("gid").alias("aa"), *[(F.col(c) * 2).alias(n) for c, n in zip(BOX, side, strict=True)])
    inner = {f"{c}2": f(F.col(c) * 2, F.col(n)) for c, n, f in zip(BOX, side, (F.greatest, F.greatest, F.least, F.least), strict=True)}
    kept = ["poly", "aa", *side, *inner]
    # a poly that is a box needs no clipping: what the area's box holds of it is a box, or less than a ring
    boxes = polygons.where("is_rect").select(F.col("gid").alias("poly"), *BOX)
    boxes = candidates.join(boxes, "poly").join(aa, "aa").withColumns(inner).select(*kept).where("minx2 < maxx2 and miny2 < maxy2")
    at = lambda n: (F.col(f"min{n[0]}2") == F.col(n[1])) | (F.col(f"max{n[0]}2") == F.col(n[1]))
    boxes = boxes.withColumns({f"on_{name}": at(("xy"[name in ("bottom", "top")], f"{name}2")) for name in ("left", "right", "bottom", "top")})
    rings = candidates.join(polygons.where("not is_rect").select(F.col("gid").alias("poly"), "v"), "poly").join(aa, "aa").withColumn("v", G.doubled(F.col("v")))
    for horizontal, edge, keep_lower in ((False, "left2", False), (False, "right2", True), (True, "bottom2", False), (True, "top2", True)):
        rings = rings.withColumn("v", G.clip_raw(F.col("v"), horizontal, F.col(edge), keep_lower)).withColumn("v", G.without_repeats(F.col("v")))
    rings = rings.where(F.size("v") >= 3)
    on = lambda c, edge: F.exists("v", lambda p: p[c] == F.col(edge))
    box = {f"{n}2": c for n, c in G.ring_box(F.col("v")).items()}
    rings = rings.withColumns({**box, "on_left": on("x", "left2"), "on_right": on("x", "right2"), "on_bottom": on("y", "bottom2"), "on_top": on("y", "top2")})
    return boxes.unionByName(rings.select(*boxes.columns))


def cut_lines(crossings: DataFrame, orientation: str = "as_coded") -> DataFrame:
    """``aa, poly, horizontal, coord2, span_min2, span_max2``: the lines that crossings cut an area along.

    ``as_coded``: a poly that reaches left and right cuts upright, one that reaches bottom and top cuts level, each
    through the middle of the area's box. ``physical``: along the poly, through its own middle. A poly that covers the
    area may do both. A line must lie strictly within the area.
    """
    c = F.col
    half = lambda a, b: F.call_function("div", c(a) + c(b), F.lit(2).cast("bigint"))
    level_run = c("on_left") & c("on_right") & (c("maxy2") > c("miny2"))
    upright_run = c("on_bottom") & c("on_top") & (c("maxx2") > c("minx2"))
    upright = ("left2", "right2", half("minx2", "maxx2"), F.greatest("miny2", "bottom2"), F.least("maxy2", "top2"))
    level = ("bottom2", "top2", half("miny2", "maxy2"), F.greatest("minx2", "left2"), F.least("maxx2", "right2"))
    made = []
    for crosses, horizontal, (low, high, at, start, stop) in ((level_run, False, upright), (upright_run, True, level)):
        if orientation == "physical":
            crosses = upright_run if crosses is level_run else level_run
        lines = crossings.where(crosses).select("aa", "poly", F.lit(horizontal).alias("horizontal"), at.alias("coord2"), start.alias("span_min2"), stop.alias("span_max2"), c(low).alias("low"), c(high).alias("high"))
        made.append(lines.where("coord2 > low and coord2 < high").drop("low", "high"))
    return made[0].unionByName(made[1])


def merge_lines(lines: DataFrame) -> DataFrame:
    """Lines (``aa, horizontal, coord2, span_min2, span_max2, is_high``) with those fused whose spans overlap by more than an end.

    A fused line is high if one of its parts is. Where lines have a ``poly``, the fused one has ``polys``, of all parts.
    """
    polys = [F.collect_set("poly").alias("polys")] if "poly" in lines.columns else []
    along = W.partitionBy("aa", "horizontal", "coord2").orderBy("span_min2", "span_max2")
    reach = F.max("span_max2").over(along.rowsBetween(W.unboundedPreceding, -1))
    begins = F.coalesce(~(F.col("span_min2") < F.least(reach, F.col("span_max2"))), F.lit(True))
    island = F.sum(F.col("begins").cast("int")).over(along.rowsBetween(W.unboundedPreceding, 0))
    return (
        lines.withColumn("begins", begins).withColumn("island", island).groupBy("aa", "horizontal", "coord2", "island")
        .agg(F.min("span_min2").alias("span_min2"), F.max("span_max2").alias("span_max2"), F.bool_or("is_high").alias("is_high"), *polys).drop("island")
    )


# -- cutting: an area with one upright and one level line at most, which is all that lines as coded can make, by expressions


def cut_pieces(v: Column, horizontal: bool, coord2: Column) -> Column:
    """The rings that a line cuts ``v`` into, the lower first; ``v`` alone if the line is null or doesn't reach into it.

    An odd line runs between the units: what lies on it moves half a unit back into its part.
    """
    across = "y" if horizontal else "x"

    def part(twice: Column, lower: bool) -> Column:
        shift = F.when(F.pmod(coord2, F.lit(2)) != 0, F.lit(-1 if lower else 1)).otherwise(F.lit(0)).cast("bigint")
        moved = lambda p, c: p[c] + F.when(p[c] == coord2, shift).otherwise(F.lit(0).cast("bigint")) if c == across else p[c]
        clipped = G.without_repeats(G.clip_raw(twice, horizontal, coord2, lower))
        ring = F.transform(clipped, lambda p: G.point(moved(p, "x"), moved(p, "y")))
        half = lambda x: F.call_function("div", x, F.lit(2).cast("bigint"))
        whole = lambda v: (F.size(v) >= 3) & F.forall(v, lambda p: (p["x"] % 2 == 0) & (p["y"] % 2 == 0))
        halved = lambda v: F.transform(v, lambda p: G.point(half(p["x"]), half(p["y"])))
        # the half unit may have brought the last vertex upon the first
        closed = lambda v: F.when(F.get(v, F.lit(0)) == F.get(v, F.size(v) - 1), F.slice(v, F.lit(1), F.size(v) - 1)).otherwise(v)
        some = lambda v: F.when(F.size(v) >= 3, G.counter_clockwise(v))
        return G.let(ring, lambda v: F.when(whole(v), G.let(G.let(halved(v), closed), some)))

    def cut(v: Column) -> Column:
        place = F.transform(v, lambda p: p[across] * 2)
        both = lambda twice: F.filter(F.array(part(twice, True), part(twice, False)), lambda r: r.isNotNull())
        made = G.let(G.let(G.doubled(v), both), lambda parts: F.when(F.size(parts) > 0, parts).otherwise(F.array(v)))
        return F.when((F.array_min(place) < coord2) & (coord2 < F.array_max(place)), made).otherwise(F.array(v))

    return G.let(v, cut)


# -- cutting along any number of lines: one small area after another, its lines in order

Ring = list[tuple[int, int]]


def half_plane(ring: Ring, axis: int, at: int, lower: bool) -> Ring:
    """The part of a ring on one closed side of a line across ``axis``, without vertices that repeat the last."""
    out: Ring = []

    def put(p: tuple[int, int]) -> None:
        if not out or out[-1] != p:
            out.append(p)

    for a, b in zip([ring[-1], *ring[:-1]], ring, strict=True):
        a_in, b_in = ((a[axis] <= at, b[axis] <= at) if lower else (a[axis] >= at, b[axis] >= at))
        if a_in != b_in:
            rise, run = b[axis] - a[axis], b[1 - axis] - a[1 - axis]
            whole, product = abs((at - a[axis]) * run) // abs(rise), (at - a[axis]) * run * rise
            met = a[1 - axis] + (whole if product >= 0 else -whole)
            put((at, met) if axis == 0 else (met, at))
        if b_in:
            put(b)
    if len(out) > 1 and out[0] == out[-1]:
        out.pop()
    return out


def cut_ring(ring: Ring, horizontal: bool, coord2: int) -> list[Ring]:
    """The lower and the upper part, as far as they are rings; the ring itself if neither is.

    An odd line runs between the units: what lies on it moves half a unit back into its part.
    """
    axis = 1 if horizontal else 0
    out = []
    for lower in (True, False):
        part = half_plane([(2 * x, 2 * y) for x, y in ring], axis, coord2, lower)
        if coord2 % 2:
            off = -1 if lower else 1
            part = [tuple(c + off if i == axis and c == coord2 else c for i, c in enumerate(p)) for p in part]
        if len(part) < 3 or any(c % 2 for p in part for c in p):
            continue
        made = [(x // 2, y // 2) for x, y in part]
        if made[0] == made[-1]:
            made.pop()
        if len(made) >= 3:
            area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(made, [*made[1:], made[0]], strict=True))
            out.append(made[::-1] if area < 0 else made)
    return out or [ring]


def cut_area(ring: Ring, lines: list[tuple[bool, int]]) -> list[Ring]:
    """The pieces of an area in order: each line in turn cuts every piece that reaches across it."""
    pieces = [ring]
    for horizontal, coord2 in lines:
        nxt: list[Ring] = []
        for piece in pieces:
            c = [p[1 if horizontal else 0] * 2 for p in piece]
            nxt += cut_ring(piece, horizontal, coord2) if min(c) < coord2 < max(c) else [piece]
        pieces = nxt
    return pieces


def slices(areas: DataFrame, lines: DataFrame) -> DataFrame:
    """Pieces of all areas: ``aa, idx`` and polygon columns, with ``gid`` the piece's node. An uncut area is its one piece."""
    order = lines.groupBy("aa").agg(F.array_sort(F.collect_set(F.struct("horizontal", "coord2"))).alias("lines"))
    with_lines = areas.select(F.col("gid").alias("aa"), "lid", "pid", "v").join(order, "aa", "left")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for aa, v, todo in zip(frame["aa"], frame["v"], frame["lines"], strict=True):
                ring = [(int(p["x"]), int(p["y"])) for p in v]
                for idx, piece in enumerate(cut_area(ring, [(bool(s["horizontal"]), int(s["coord2"])) for s in todo])):
                    rows.append((aa, idx, [{"x": x, "y": y} for x, y in piece]))
            yield pd.DataFrame(rows, columns=["aa", "idx", "v"])

    of = lambda level: F.filter("lines", lambda s: s["horizontal"] == F.lit(level))
    once = F.coalesce((F.size(of(False)) <= 1) & (F.size(of(True)) <= 1), F.lit(False))
    crossed = with_lines.where("lines is not null").select("aa", "v", "lines", once.alias("once"))
    coords = {name: F.get(of(level), F.lit(0))["coord2"] for name, level in (("upright2", False), ("level2", True))}
    simple = crossed.where("once").withColumns(coords).withColumn("first", cut_pieces(F.col("v"), False, F.col("upright2")))
    rings = F.flatten(F.transform("first", lambda v: cut_pieces(v, True, F.col("level2"))))
    simple = simple.select("aa", F.posexplode(rings).alias("idx", "v"))
    made = crossed.where("not once").select("aa", "v", "lines").mapInPandas(cut, f"aa bigint, idx int, v {G.RING}")
    whole = with_lines.where("lines is null").select("aa", F.lit(0).alias("idx"), "v")
    both = whole.unionByName(simple).unionByName(made)
    return both.select(
        "aa", "idx", F.shiftright("aa", 32).cast("int").alias("lid"), gid_pid(F.col("aa")).alias("pid"), piece_node(F.col("aa"), F.col("idx")).alias("gid"),
        *[c.alias(n) for n, c in G.ring_box(F.col("v")).items()], "v", G.is_rectangle(F.col("v")).alias("is_rect"),
    )


def _connected(pieces: DataFrame, lines: DataFrame, kept: list[str]) -> DataFrame:
    """``aa, a, b``, both ways, and the ``kept`` columns of the line: what each line would connect."""
    c = F.col
    along = lambda e: F.when(c("horizontal"), c(f"{e}x") * 2).otherwise(c(f"{e}y") * 2)
    across = lambda e: F.when(c("horizontal"), c(f"{e}y") * 2).otherwise(c(f"{e}x") * 2)
    boxes = pieces.select("aa", "idx", *BOX)
    by_line = boxes.join(lines, "aa").withColumns({"lo": along("min"), "hi": along("max"), "low_side": across("max") <= c("coord2"), "high_side": across("min") >= c("coord2")})
    by_line = by_line.where(G.overlap_open(c("lo"), c("hi"), c("span_min2"), c("span_max2")))
    key = ["aa", "horizontal", "coord2", "span_min2", "span_max2"]
    left = by_line.where("low_side").select(*key, *kept, c("idx").alias("a"), c("lo").alias("a0"), c("hi").alias("a1"))
    right = by_line.where("high_side and not low_side").select(*key, c("idx").alias("b"), c("lo").alias("b0"), c("hi").alias("b1"))
    pairs = left.join(right, key).where(G.overlap_open(c("a0"), c("a1"), c("b0"), c("b1"))).select("aa", "a", "b", *kept)
    return pairs.unionByName(pairs.select("aa", F.col("b").alias("a"), F.col("a").alias("b"), *kept))


def conduction(pieces: DataFrame, lines: DataFrame) -> DataFrame:
    """``aa, a, b``: piece numbers that a high line connects, both ways.

    A line connects every piece on its one side with every piece on its other, touching or not, if their extents along
    the line and its span overlap by more than an end.
    """
    return _connected(pieces, lines.where("is_high"), []).distinct()


def conduction_by_poly(pieces: DataFrame, lines: DataFrame) -> DataFrame:
    """``aa, a, b, poly``: piece numbers that are connected if ``poly`` is driven, both ways, for lines (``aa, poly, ...``) of any state."""
    merged = merge_lines(lines.withColumn("is_high", F.lit(True)))
    return _connected(pieces, merged, ["polys"]).select("aa", "a", "b", F.explode("polys").alias("poly")).distinct()


def static_edges(polygons: DataFrame, pieces: DataFrame, adjacency: DataFrame, aa_lid: int) -> DataFrame:
    """What leads where regardless of any gate: ``src, branch, kind, dst, aa, idx``.

    ``kind`` 0: to a polygon ``dst``. 1: into piece ``idx`` of area ``aa``. 2: the source touches area ``aa``, which is
    thereby cut. ``branch``: -1 within a layer, else the place of the neighbour layer. Whole areas are reached only
    within their layer, from a whole area; pieces don't lead on within their layer.
    """
    none, no_idx = F.lit(None).cast("bigint"), F.lit(None).cast("int")
    aa = polygons.where(F.col("lid") == aa_lid)
    shape = lambda df: df.select("gid", "lid", *BOX, "v", "is_rect")
    all_shapes = materialise(shape(polygons).unionByName(shape(pieces)), "shapes")
    same = polygons.select("lid", F.col("lid").alias("nlid")).distinct()
    within = touching(shape(polygons), shape(polygons), same, once=True)
    within = within.unionByName(within.select(F.col("b").alias("a"), F.col("a").alias("b")))
    within = within.select(F.col("a").alias("src"), F.lit(-1).alias("branch"), F.lit(0).alias("kind"), F.col("b").alias("dst"), none.alias("aa"), no_idx.alias("idx"))
    layer = lambda c: F.when(F.col(c) >= SLICE_BASE, F.lit(aa_lid)).otherwise(F.shiftright(c, 32).cast("int"))
    # one join for all that neighbour layers connect; an area that is its own neighbour touches itself
    met = touching(all_shapes, all_shapes, adjacency.select("lid", "nlid"))
    own = aa.select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    met = met.unionByName(own).withColumn("lid", layer("a")).withColumn("nlid", layer("b"))
    met = materialise(met.join(adjacency.select("lid", "nlid", F.col("ord").alias("branch")), ["lid", "nlid"]).select(F.col("a").alias("src"), "branch", F.col("b").alias("dst"), "nlid"), "met")
    across = met.where(F.col("nlid") != aa_lid).select("src", "branch", F.lit(0).alias("kind"), "dst", none.alias("aa"), no_idx.alias("idx"))
    touched = met.where((F.col("nlid") == aa_lid) & (F.col("dst") < SLICE_BASE)).select("src", "branch", F.col("dst").alias("aa"))
    entered = met.where((F.col("nlid") == aa_lid) & (F.col("dst") >= SLICE_BASE)).select("src", "branch", "dst").join(pieces.select(F.col("gid").alias("dst"), "aa", "idx"), "dst")
    entered = entered.join(touched.select("src", "aa"), ["src", "aa"], "left_semi").select("src", "branch", F.lit(1).alias("kind"), "dst", "aa", "idx")
    touched = touched.select("src", "branch", F.lit(2).alias("kind"), none.alias("dst"), "aa", no_idx.alias("idx"))
    return within.unionByName(across).unionByName(entered).unionByName(touched)


def enter_pieces(events: list[tuple[int, int, int]], pairs: list[tuple[int, int]], visited: set[int], flood: str) -> list[tuple[int, int, int, int]]:
    """Pieces of one area that ``events`` (order, branch, piece) newly visit: order, branch, place, piece.

    A piece entered for the first time takes its neighbours with it: the next ones (``one_hop``), or all that they
    lead to (``fixpoint``). A piece that was visited before takes none.
    """
    near: dict[int, list[int]] = {}
    for a, b in sorted(pairs):
        near.setdefault(a, []).append(b)
    out: list[tuple[int, int, int, int]] = []
    for order, branch, piece in sorted(events):
        queue = [piece]
        for n, p in enumerate(queue):
            if p in visited:
                continue
            visited.add(p)
            out.append((order, branch, len(out), p))
            if n == 0 or flood == "fixpoint":
                queue += near.get(p, [])
    return out


def search_in_order(edges: DataFrame, start: int, flood: str, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, ord`` of what a queue would visit from ``start``, numbered in its order, and the areas it touched (``aa``).

    ``pairs`` (``aa, a, b, poly``): pieces that conduct if ``poly`` is null, or was taken from the queue no later than
    the node that first touched the area.
    """
    if edges.count() + pairs.count() <= K.FEW_EDGES:
        return _search_in_one_task(edges, start, flood, pairs)
    return _search_by_levels(edges, start, flood, pairs)


def _search_in_one_task(edges: DataFrame, start: int, flood: str, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = ["src", "branch", "kind", "dst", "aa", "idx"]
    none = F.lit(None)
    rows = edges.select(*names, F.lit(None).cast("bigint").alias("poly")).unionByName(
        pairs.select(none.cast("bigint").alias("src"), F.col("a").alias("branch"), F.lit(3).alias("kind"), none.cast("bigint").alias("dst"), "aa", F.col("b").alias("idx"), "poly")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways: dict[int, list[tuple]] = {}
        near: dict[int, list[tuple]] = {}
        for batch in batches:
            for src, branch, kind, dst, aa, idx, poly in zip(*(batch.column(c).to_pylist() for c in (*names, "poly")), strict=True):
                if kind == 3:
                    near.setdefault(aa, []).append((branch, idx, poly))
                else:  # in the order of a queue: by branch, then target; an area is touched before it is entered
                    ways.setdefault(src, []).append((branch, (dst if kind == 0 else aa) & 0xFFFFFFFF, kind != 2, -1 if idx is None else idx, kind, dst, aa))
        taken, order = {start: 0}, [start]
        conducts: dict[int, list[tuple[int, int]]] = {}
        entered: dict[int, set[int]] = {}
        for at, node in enumerate(order):
            mine = sorted(ways.get(node, []), key=lambda w: w[:4])
            for _, _, _, _, kind, _, aa in mine:
                if kind and aa not in conducts:
                    conducts[aa] = sorted({(a, b) for a, b, poly in near.get(aa, []) if poly is None or taken.get(poly, at + 1) <= at})
            for branch, _, _, idx, kind, dst, aa in mine:
                if kind == 0 and dst not in taken:
                    taken[dst] = len(order)
                    order.append(dst)
                elif kind == 1:
                    for _, _, _, piece in enter_pieces([(at, branch, idx)], conducts[aa], entered.setdefault(aa, set()), flood):
                        made = SLICE_BASE + ((aa & 0xFFFFFFFF) << _PIECE_BITS) + piece
                        taken[made] = len(order)
                        order.append(made)
        yield pa.record_batch([pa.array(order, pa.int64()), pa.array(range(len(order)), pa.int64()), pa.array([False] * len(order), pa.bool_())], ["node", "ord", "area"])
        yield pa.record_batch([pa.array(list(conducts), pa.int64()), pa.array([-1] * len(conducts), pa.int64()), pa.array([True] * len(conducts), pa.bool_())], ["node", "ord", "area"])

    found = materialise(K.in_one_task(rows).mapInArrow(search, "node bigint, ord bigint, area boolean"), "searched")
    return found.where("not area").select("node", "ord"), found.where("area").select(F.col("node").alias("aa"))


def _search_by_levels(edges: DataFrame, start: int, flood: str, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    spark = edges.sparkSession
    frontier, count = spark.createDataFrame([(start, 0)], "node bigint, ord bigint"), 1
    visited = Growing(frontier)
    touched = Growing(spark.createDataFrame([], "aa bigint, ord bigint"))
    conducting = Growing(spark.createDataFrame([], "aa bigint, a int, b int"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for aa, events, pairs, seen in zip(frame["aa"], frame["events"], frame["pairs"], frame["seen"], strict=True):
                pairs = [] if pairs is None else [(p["a"], p["b"]) for p in pairs]
                seen = set() if seen is None else set(seen)
                rows += [(aa, *r) for r in enter_pieces([(e["ord"], e["branch"], e["idx"]) for e in events], pairs, seen, flood)]
            yield pd.DataFrame(rows, columns=["aa", "ord", "branch", "place", "idx"])

    while True:
        events = materialise(frontier.join(edges, F.col("node") == F.col("src")).select("ord", "branch", "kind", "dst", "aa", "idx"), "events")
        plain = events.where("kind = 0").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("ord", "branch")).alias("k")).join(visited.df, "node", "left_anti")
        plain = plain.select("node", "k.ord", "k.branch", gid_pid(F.col("node")).alias("target"), F.lit(0).alias("place"))
        fresh = materialise(events.where("kind > 0").groupBy("aa").agg(F.min("ord").alias("ord")).join(touched.df, "aa", "left_anti"), "fresh")
        if not fresh.isEmpty():
            touched.add(fresh)
            seen = visited.df.select(F.col("node").alias("poly"), F.col("ord").alias("poly_ord"))
            now = pairs.join(fresh, "aa").join(seen, "poly", "left").where("poly is null or poly_ord <= ord")
            conducting.add(materialise(now.select("aa", "a", "b").distinct(), "conducting"))
        # what an area has is looked up for the level's areas alone
        per_area = materialise(events.where("kind = 1").groupBy("aa").agg(F.collect_set(F.struct("ord", "branch", "idx")).alias("events")), "entered")
        here = per_area.select("aa")
        near = conducting.df.join(here, "aa", "left_semi").groupBy("aa").agg(F.collect_set(F.struct("a", "b")).alias("pairs"))
        of_node = F.shiftright(F.col("node") - SLICE_BASE, _PIECE_BITS)
        inside = visited.df.where(F.col("node") >= SLICE_BASE).withColumn("pid", of_node).join(here.select(gid_pid(F.col("aa")).cast("bigint").alias("pid")), "pid", "left_semi")
        seen = inside.groupBy("pid").agg(F.collect_set((F.col("node") % (1 << _PIECE_BITS)).cast("int")).alias("seen"))
        areas = per_area.join(near, "aa", "left").withColumn("pid", gid_pid(F.col("aa")).cast("bigint")).join(seen, "pid", "left").select("aa", "events", "pairs", "seen")
        pieces = areas.mapInPandas(fold, "aa bigint, ord bigint, branch int, place int, idx int").select(piece_node(F.col("aa"), F.col("idx")).alias("node"), "ord", "branch", gid_pid(F.col("aa")).alias("target"), "place")
        # a level's nodes are numbered in one task; polygons at large never are
        number = F.row_number().over(W.orderBy("ord", "branch", "target", "place")) - 1 + count
        frontier = materialise(plain.unionByName(pieces).select("node", number.cast("bigint").alias("ord")), "frontier")
        found = frontier.count()
        if not found:
            return visited.df, touched.df.select("aa")
        count += found
        visited.add(frontier)
