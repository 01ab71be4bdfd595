"""Geometry expressions against plain Python on random shapes, and properties of the spatial join."""

import random

import pytest
from pyspark.sql import functions as F

from netweave.functions import geometry as G
from netweave.operators import gate as C
from netweave.operators import spatial as S
from netweave.operators.components import connected_components
from netweave.sources.layout_text import polygons_of


def staircase(rng):
    """A ring that climbs in steps, of either turn."""
    x, y, pts = rng.randrange(-20, 20), rng.randrange(-20, 20), []
    x0, y0 = x, y
    for _ in range(rng.randrange(1, 5)):
        pts += [(x, y)]
        x += rng.randrange(1, 9)
        pts += [(x, y)]
        y += rng.randrange(1, 9)
    pts += [(x, y), (x0, y)]
    return pts[::-1] if rng.random() < 0.5 else pts


def region(ring):
    """Unit cells and lattice points of a closed rectilinear region."""
    n = len(ring)
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    up = [(a[0], min(a[1], b[1]), max(a[1], b[1])) for a, b in zip(ring, ring[1:] + ring[:1]) if a[0] == b[0]]
    points = set()
    for x in range(min(xs), max(xs)):
        for y in range(min(ys), max(ys)):
            if sum(1 for ex, lo, hi in up if ex > x and lo <= y < hi) % 2:
                points |= {(x, y), (x + 1, y), (x, y + 1), (x + 1, y + 1)}
    assert n >= 4
    return points


@pytest.fixture(scope="module")
def shapes(spark):
    rng = random.Random(5)
    rings = [staircase(rng) for _ in range(60)]
    rows = [(i % 2, i, [{"x": x, "y": y} for x, y in r]) for i, r in enumerate(rings)]
    return rings, spark.createDataFrame(rows, f"lid int, pid int, v {G.RING}")


def test_areas_boxes_and_turn(shapes):
    rings, df = shapes
    area2 = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1]))
    for row in df.select("pid", G.signed_area2(F.col("v")).alias("a"), G.counter_clockwise(F.col("v")).alias("c"), *[c.alias(n) for n, c in G.ring_box(F.col("v")).items()]).collect():
        r = rings[row["pid"]]
        assert row["a"] == area2(r) and area2([tuple(p) for p in row["c"]]) == abs(area2(r))
        assert (row["minx"], row["miny"], row["maxx"], row["maxy"]) == (min(p[0] for p in r), min(p[1] for p in r), max(p[0] for p in r), max(p[1] for p in r))


def test_points(spark, shapes):
    rings, df = shapes
    at = spark.createDataFrame([(x, y) for x in range(-24, 40, 3) for y in range(-24, 40, 3)], "px bigint, py bigint")
    got = df.crossJoin(at).where(G.point_in_ring(F.col("px"), F.col("py"), F.col("v"))).select("pid", "px", "py").collect()
    want = {(i, x, y) for i, r in enumerate(rings) for x, y in region(r) if (x + 24) % 3 == 0 and (y + 24) % 3 == 0 and x < 40 and y < 40}
    assert {tuple(r) for r in got} == want


@pytest.mark.parametrize("base", [1, 16, 4096])
def test_touching_does_not_depend_on_the_grid(spark, shapes, base):
    rings, df = shapes
    polygons = polygons_of(df)
    layers = spark.createDataFrame([(0, 0), (1, 1), (0, 1), (1, 0)], "lid int, nlid int")
    got = {(r["a"] & 0xFFFFFFFF, r["b"] & 0xFFFFFFFF) for r in S.touching(polygons, polygons, layers, once=True, base=base).collect()}
    regions = [region(r) for r in rings]
    want = {(i, j) for i in range(60) for j in range(60) if (i % 2, i) < (j % 2, j) and regions[i] & regions[j]}
    assert got == want


@pytest.mark.parametrize("horizontal", [False, True])
@pytest.mark.parametrize("lower", [False, True])
def test_clipping_columns_and_python_agree(shapes, horizontal, lower):
    rings, df = shapes
    clip = G.without_repeats(G.clip_raw(G.doubled(F.col("v")), horizontal, F.lit(5).cast("bigint"), lower))
    for row in df.select("pid", clip.alias("c")).collect():
        ring = [(2 * x, 2 * y) for x, y in rings[row["pid"]]]
        assert [tuple(p) for p in row["c"]] == C.half_plane(ring, 1 if horizontal else 0, 5, lower)


def test_even_cuts_keep_the_area():
    area2 = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1])))
    ring = [(0, 0), (12, 0), (12, 8), (0, 8)]
    pieces = C.cut_area(ring, [(False, 8), (False, 16), (True, 4)])
    assert len(pieces) == 6 and sum(map(area2, pieces)) == area2(ring)


def test_lines_merge_where_spans_overlap(spark):
    rows = [(1, False, 4, 0, 10, False), (1, False, 4, 10, 12, True), (1, False, 4, 11, 20, False), (1, True, 4, 0, 5, True), (2, False, 4, 3, 5, False)]
    lines = spark.createDataFrame(rows, "aa bigint, horizontal boolean, coord2 bigint, span_min2 bigint, span_max2 bigint, is_high boolean")
    got = sorted(tuple(r) for r in C.merge_lines(lines).collect())
    assert got == [(1, False, 4, 0, 10, False), (1, False, 4, 10, 20, True), (1, True, 4, 0, 5, True), (2, False, 4, 3, 5, False)]


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(120)] + [(7, 7), (900, 900)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_slice_edges_leave_slants_out_and_box_intersection(spark):
    df = spark.range(1).select(F.expr("array(named_struct('x', 0L, 'y', 0L), named_struct('x', 4L, 'y', 0L), named_struct('x', 4L, 'y', 0L), named_struct('x', 6L, 'y', 3L), named_struct('x', 0L, 'y', 3L))").alias("v"))
    edges = df.select(F.explode(G.slice_edges(F.col("v"))).alias("e")).select("e.*").collect()
    assert [tuple(e) for e in edges] == [(0, 0, 4, 0, True), (4, 0, 4, 0, False), (6, 3, 0, 3, True), (0, 3, 0, 0, False)]
    boxes = spark.createDataFrame([(0, 0, 4, 4, 2, 3, 9, 9), (0, 0, 1, 1, 2, 2, 3, 3)], ", ".join(f"{p}_{c} bigint" for p in "ab" for c in ("minx", "miny", "maxx", "maxy")))
    assert [tuple(r) for r in boxes.select(*[c.alias(n) for n, c in G.box_intersection().items()]).collect()] == [(2, 3, 4, 4), (0, 0, 0, 0)]


def test_points_of_words(spark):
    from netweave.sources.layout_text import parse_points

    lines = spark.createDataFrame([("(0,1) (2,3) x (4,5)",), ("(0,1),(2,3) (7,8)",), ("(0,1)(2,3) (,)",)], "line string")
    got = [[tuple(p) for p in r[0]] for r in lines.select(parse_points(F.col("line"), dialect="whitespace")).collect()]
    assert got == [[(0, 1), (2, 3), (4, 5)], [(0, 1), (7, 8)], [(0, 1)]]


def test_pieces_by_expression_are_those_of_cutting_one_after_another(spark):
    import random

    from netweave.functions.geometry import RING
    from netweave.operators.gate import cut_area, slices

    rng = random.Random(17)
    areas, lines = [], []
    for i in range(120):
        x, y, w, h = rng.randrange(-20, 20), rng.randrange(-20, 20), rng.randrange(2, 12), rng.randrange(2, 12)
        a, b = rng.randrange(1, w), rng.randrange(1, h)
        rings = [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)], [(x, y), (x + w, y), (x + w, y + b), (x + a, y + b), (x + a, y + h), (x, y + h)]]
        if w > 3:  # a notch, which a level line may cut twice
            rings.append([(x, y), (x + w, y), (x + w, y + h), (x + w - 1, y + h), (x + w - 1, y + b), (x + 1, y + b), (x + 1, y + h), (x, y + h)])
        ring = rings[i % len(rings)]
        areas.append((i, 2, i, [{"x": p, "y": q} for p, q in ring]))
        cuts = [(False, rng.randrange(2 * x - 2, 2 * (x + w) + 3))] * (i % 4 > 0) + [(True, rng.randrange(2 * y - 2, 2 * (y + h) + 3))] * (i % 3 > 0) + [(True, 2 * y + 1)] * (i % 7 == 6)
        lines += [(i, *c) for c in dict.fromkeys(cuts)]
    got = slices(spark.createDataFrame(areas, f"gid bigint, lid int, pid int, v {RING}"), spark.createDataFrame(lines, "aa bigint, horizontal boolean, coord2 bigint"))
    found = {(r["aa"], r["idx"]): [tuple(p) for p in r["v"]] for r in got.collect()}
    want = {}
    for i, _, _, v in areas:
        for n, ring in enumerate(cut_area([(p["x"], p["y"]) for p in v], sorted((h, c) for a, h, c in lines if a == i))):
            want[i, n] = ring
    assert found == want and len(want) > 200
