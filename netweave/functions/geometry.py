"""Geometry of rectilinear rings as column expressions.

A ring is ``array<struct<x:bigint,y:bigint>>``, closed implicitly from its last vertex to its first. Everything here is
built from higher-order functions, so it stays in the JVM; coordinates are 64-bit throughout. Boxes are four columns
``minx, miny, maxx, maxy`` with an optional prefix and are closed: sharing a border point is overlapping.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

POINT = "struct<x:bigint,y:bigint>"
RING = f"array<{POINT}>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that stands in the expression once, however often ``body`` names it.

    Without it, an expression that names its argument twice doubles with every step that is built on it, and
    Catalyst, which moves expressions up and down a plan, would be slower than the query.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))


def turned(v: Column, back: bool = False) -> Column:
    """The ring begun one vertex later, or with ``back`` one vertex earlier."""
    less = lambda v: F.greatest(F.size(v) - 1, F.lit(0))
    if back:
        return let(v, lambda v: F.concat(F.slice(v, F.greatest(F.size(v), F.lit(1)), F.lit(1)), F.slice(v, F.lit(1), less(v))))
    return let(v, lambda v: F.concat(F.slice(v, F.lit(2), less(v)), F.slice(v, F.lit(1), F.lit(1))))


def signed_area2(v: Column) -> Column:
    """Twice the signed area; positive for counter-clockwise rings."""
    cross = let(v, lambda v: F.zip_with(v, turned(v), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]))
    return F.aggregate(cross, F.lit(0).cast("bigint"), lambda s, c: s + c)


def counter_clockwise(v: Column) -> Column:
    """A clockwise ring reversed (so it begins with its former last vertex), any other as it is."""
    return let(v, lambda v: F.when(signed_area2(v) < 0, F.reverse(v)).otherwise(v))


def ring_box(v: Column) -> dict[str, Column]:
    """``minx, miny, maxx, maxy``; zeros for an empty ring."""
    low = lambda c: F.coalesce(F.array_min(F.transform(v, lambda p: p[c])), F.lit(0).cast("bigint"))
    high = lambda c: F.coalesce(F.array_max(F.transform(v, lambda p: p[c])), F.lit(0).cast("bigint"))
    return {"minx": low("x"), "miny": low("y"), "maxx": high("x"), "maxy": high("y")}


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A counter-clockwise rectangle from its lower left corner on."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def is_rectangle(v: Column) -> Column:
    """Whether a ring of four vertices fills its box."""

    def fills(v: Column) -> Column:
        b = ring_box(v)
        return let(F.abs(signed_area2(v)), lambda area: (F.size(v) == 4) & (area != 0) & (area == 2 * (b["maxx"] - b["minx"]) * (b["maxy"] - b["miny"])))

    return let(v, fills)


def ring_edges(v: Column) -> Column:
    """``array<struct<ax,ay,bx,by,is_h>>``; an edge that isn't axis-parallel is put to the nearer direction."""
    def edge(a: Column, b: Column) -> Column:
        level = (a["y"] == b["y"]) | ((a["x"] != b["x"]) & (F.abs(a["y"] - b["y"]) < F.abs(a["x"] - b["x"])))
        return F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), level.alias("is_h"))

    return let(v, lambda v: F.zip_with(v, turned(v), edge))


def slice_edges(v: Column) -> Column:
    """Edges of a ring made by cutting: upright ones first in doubt, slanted ones left out."""
    def edge(a: Column, b: Column) -> Column:
        return F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), ((a["x"] != b["x"]) & (a["y"] == b["y"])).alias("is_h"))

    return F.filter(let(v, lambda v: F.zip_with(v, turned(v), edge)), lambda e: (e["ax"] == e["bx"]) | (e["ay"] == e["by"]))


def between(a: Column, b: Column, c: Column) -> Column:
    """Whether ``c`` lies in the closed interval that ``a`` and ``b`` end, in either order."""
    return c.between(F.least(a, b), F.greatest(a, b))


def overlap_closed(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(a0, b0) <= F.least(a1, b1)


def overlap_open(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two intervals share more than an end."""
    return F.greatest(a0, b0) < F.least(a1, b1)


def boxes_overlap(a: str = "a_", b: str = "b_") -> Column:
    """Whether the closed boxes of two column prefixes share a point."""
    c = F.col
    return overlap_closed(c(f"{a}minx"), c(f"{a}maxx"), c(f"{b}minx"), c(f"{b}maxx")) & overlap_closed(c(f"{a}miny"), c(f"{a}maxy"), c(f"{b}miny"), c(f"{b}maxy"))


def box_intersection(a: str = "a_", b: str = "b_") -> dict[str, Column]:
    """The common box of two column prefixes, zeros if there is none."""
    both = {c: f(f"{a}{c}", f"{b}{c}") for c, f in (("minx", F.greatest), ("miny", F.greatest), ("maxx", F.least), ("maxy", F.least))}
    return {c: F.when(boxes_overlap(a, b), x).otherwise(F.lit(0).cast("bigint")) for c, x in both.items()}


def canonical_ring(v: Column) -> Column:
    """The ring, counter-clockwise, from its smallest vertex on, so that equal rings are equal however they begin."""
    begun = lambda v: let(F.array_position(v, F.array_min(v)).cast("int"), lambda k: F.concat(F.slice(v, k, F.size(v) - k + 1), F.slice(v, F.lit(1), k - 1)))
    return let(counter_clockwise(v), begun)


def segments_touch(e: Column, f: Column) -> Column:
    """Whether two axis-parallel segments (structs ``ax, ay, bx, by``) share a point; collinear ones may overlap."""
    e_level, f_level = e["ay"] == e["by"], f["ay"] == f["by"]
    along = lambda s, c: (F.least(s[f"a{c}"], s[f"b{c}"]), F.greatest(s[f"a{c}"], s[f"b{c}"]))
    return (
        F.when(e_level & ~f_level, between(e["ax"], e["bx"], f["ax"]) & between(f["ay"], f["by"], e["ay"]))
        .when(~e_level & f_level, between(f["ax"], f["bx"], e["ax"]) & between(e["ay"], e["by"], f["ay"]))
        .when(e_level & f_level, (e["ay"] == f["ay"]) & overlap_closed(*along(e, "x"), *along(f, "x")))
        .otherwise((e["ax"] == f["ax"]) & overlap_closed(*along(e, "y"), *along(f, "y")))
    )


def point_on_segment(x: Column, y: Column, e: Column) -> Column:
    """Closed; never on a segment that isn't axis-parallel."""
    return (
        F.when(e["ax"] == e["bx"], (x == e["ax"]) & between(e["ay"], e["by"], y))
        .when(e["ay"] == e["by"], (y == e["ay"]) & between(e["ax"], e["bx"], x))
        .otherwise(F.lit(False))
    )


def point_in_ring(x: Column, y: Column, v: Column) -> Column:
    """Whether a point lies in the closed region: on an edge, or left of an odd number of upright edges.

    An upright edge counts from its lower end (in) to its upper end (out), so a vertex isn't counted twice.
    """
    return let(ring_edges(v), lambda edges: _in_edges(x, y, edges))


def _in_edges(x: Column, y: Column, edges: Column) -> Column:
    right = lambda e: (e["ax"] == e["bx"]) & (y >= F.least(e["ay"], e["by"])) & (y < F.greatest(e["ay"], e["by"])) & (e["ax"] > x)
    return F.exists(edges, lambda e: point_on_segment(x, y, e)) | (F.size(F.filter(edges, right)) % 2 == 1)


def rings_touch(a: Column, b: Column) -> Column:
    """Whether two closed rectilinear regions share a point, one touching corner included.

    Their borders cross, or a vertex of one lies in the other. Boxes are to be compared before.
    """
    level = lambda s: F.filter(s, lambda e: e["is_h"])
    upright = lambda s: F.filter(s, lambda e: ~e["is_h"])
    cross = lambda s, t: F.exists(s, lambda e: F.exists(t, lambda f: segments_touch(e, f)))
    held = lambda s, t: F.exists(s, lambda e: _in_edges(e["ax"], e["ay"], t))
    either = lambda s, t: cross(level(s), upright(t)) | cross(upright(s), level(t)) | held(s, t) | held(t, s)
    return let(ring_edges(a), lambda s: let(ring_edges(b), lambda t: either(s, t)))


def doubled(v: Column) -> Column:
    """The ring in half units, where centre lines of odd boxes are whole numbers."""
    return F.transform(v, lambda p: point(p["x"] * 2, p["y"] * 2))


def cut_point(a: Column, b: Column, coord2: Column, horizontal: bool) -> Column:
    """Where an edge meets a cut line; the quotient is truncated towards zero."""
    run, across = ("x", "y") if horizontal else ("y", "x")
    rise = b[across] - a[across]
    step = F.call_function("div", (coord2 - a[across]) * (b[run] - a[run]), F.nullif(rise, F.lit(0).cast("bigint")))
    moved = a[run] + step
    made = point(moved, coord2) if horizontal else point(coord2, moved)
    return F.when(rise == 0, point(a["x"], a["y"])).otherwise(made)


def clip_raw(v: Column, horizontal: bool, coord2: Column, keep_lower: bool) -> Column:
    """One pass of clipping a ring in half units by a closed half-plane; vertices may repeat."""
    c = "y" if horizontal else "x"
    inside = (lambda p: p[c] <= coord2) if keep_lower else (lambda p: p[c] >= coord2)
    none = F.array().cast(RING)

    def step(s: Column, e: Column) -> Column:
        cut = cut_point(s, e, coord2, horizontal)
        here = point(e["x"], e["y"])
        return F.when(inside(s) & inside(e), F.array(here)).when(inside(e), F.array(cut, here)).when(inside(s), F.array(cut)).otherwise(none)

    return let(v, lambda v: F.flatten(F.zip_with(turned(v, back=True), v, step)))


def without_repeats(v: Column) -> Column:
    """The ring without vertices that equal the one before them, across its end too."""
    same = lambda p, q: (p["x"] == q["x"]) & (p["y"] == q["y"])
    before = lambda v: F.concat(F.array(F.lit(None).cast(POINT)), F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))))
    pairs = let(v, lambda v: F.zip_with(v, F.when(F.size(v) > 0, before(v)).otherwise(v), lambda p, q: F.struct(p.alias("p"), F.coalesce(same(p, q), F.lit(False)).alias("r"))))
    once = F.transform(F.filter(pairs, lambda s: ~s["r"]), lambda s: s["p"])
    closes = lambda v: (F.size(v) >= 2) & same(F.get(v, F.lit(0)), F.get(v, F.size(v) - 1))
    return let(once, lambda v: F.when(closes(v), F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0)))).otherwise(v))
