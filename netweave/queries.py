"""Queries over derived layouts, each an operator at work on a whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from netweave.functions import geometry as G
from netweave.operators import gate as C
from netweave.operators import spatial as S
from netweave.operators.reach import reach_frontier
from netweave.plans.derive import GATE, GATE_SEEDS, GATE_VIAS, gate_layout, l_layout, l_ring, layers, placed, rect_layout
from netweave.plans.session import materialise, scratch_path
from netweave.plans.trace import Trace, TraceOptions, contacts, trace
from netweave.sources import layout_text as T

CHAIN = ("L0", "L1", "L2", "L3")
#: Gates: layer 1 over layer 2.
POLY, AREA = 1, 2
SEEDS = tuple(range(1, 9))


def _polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rect_layout(spark, sf_dir).polygons


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygons as a table, for joins that read them several times."""
    return materialise(_polygons(spark, sf_dir), "polygons")


def _same(spark: SparkSession) -> DataFrame:
    return layers(spark).select("lid", F.col("lid").alias("nlid"))


def _adjacency(spark: SparkSession) -> DataFrame:
    return S.layer_adjacency(spark, layers(spark), [CHAIN])


def _seeds(spark: SparkSession, sf_dir: str, keys: tuple[int, ...]) -> DataFrame:
    """Start points at the lower left corners of some boxes."""
    at = placed(spark, sf_dir).where(F.col("k").isin(*keys))
    return at.join(layers(spark), "lid").select(F.col("k").cast("int").alias("idx"), F.col("name").alias("layer"), F.col("x0").alias("x"), F.col("y0").alias("y"))


def _rule(spark: SparkSession, sf_dir: str, keys: tuple[int, ...], vias=(CHAIN,), gate=None) -> T.Rule:
    rows = {r["idx"]: (r["layer"], r["x"], r["y"]) for r in _seeds(spark, sf_dir, keys).collect()}
    return T.Rule(tuple(rows[k] for k in keys if k in rows), tuple(vias), gate)


def _trace(spark: SparkSession, sf_dir: str, keys: tuple[int, ...], vias=(CHAIN,), gate=None, **options) -> Trace:
    return trace(spark, rect_layout(spark, sf_dir), _rule(spark, sf_dir, keys, vias, gate), TraceOptions(**options))


def polygons_table(spark, sf_dir):
    return _polygons(spark, sf_dir).select("lid", "pid", "gid", *S.BOX, "is_rect")


def bbox_project(spark, sf_dir):
    return l_layout(spark, sf_dir).polygons.select("gid", *S.BOX, "is_rect")


def gid_pack(spark, sf_dir):
    return _polygons(spark, sf_dir).select("gid", T.gid_lid(F.col("gid")).alias("lid"), T.gid_pid(F.col("gid")).alias("pid"))


def ring_area2(spark, sf_dir):
    ring = F.when(F.col("k") % 2 == 1, F.reverse(l_ring())).otherwise(l_ring())
    return placed(spark, sf_dir).select("k", G.signed_area2(ring).alias("area2"))


def ring_ccw(spark, sf_dir):
    ring = F.when(F.col("k") % 2 == 1, F.reverse(l_ring())).otherwise(l_ring())
    return placed(spark, sf_dir).select("k", T.format_ring(G.counter_clockwise(ring)).alias("ring"))


def edge_split(spark, sf_dir):
    return _polygons(spark, sf_dir).select("gid", F.explode(G.ring_edges(F.col("v"))).alias("e")).select("gid", "e.*")


def edge_touch(spark, sf_dir):
    """Touching pairs of edges of any two polygons of a layer whose boxes meet."""
    p = _stored(spark, sf_dir)
    edges = p.select("gid", F.explode(G.ring_edges(F.col("v"))).alias("e"))
    pairs = S.box_pairs(p, p, _same(spark), once=True).select("a", "b")
    met = pairs.join(edges.select(F.col("gid").alias("a"), F.col("e").alias("ea")), "a").join(edges.select(F.col("gid").alias("b"), F.col("e").alias("eb")), "b")
    return met.groupBy("a", "b").agg(F.count_if(G.segments_touch(F.col("ea"), F.col("eb"))).alias("n"))


def layer_bounds(spark, sf_dir):
    return S.layer_bounds(_polygons(spark, sf_dir))


def cell_size_median(spark, sf_dir):
    p = _polygons(spark, sf_dir)
    return S.side_median(p).crossJoin(S.cell_size(p))


def grid_cells(spark, sf_dir):
    return S.grid_cells(_polygons(spark, sf_dir), 32)


def grid_occupancy(spark, sf_dir):
    per_cell = S.grid_cells(_polygons(spark, sf_dir), 32).groupBy("lid", "cx", "cy").count()
    return per_cell.groupBy("lid").agg(F.count("*").alias("cells"), F.max("count").alias("most"), F.sum("count").cast("bigint").alias("entries"))


def overlap_same_layer(spark, sf_dir):
    p = _stored(spark, sf_dir)
    return S.touching(p, p, _same(spark), once=True)


def overlap_via(spark, sf_dir):
    p = _stored(spark, sf_dir)
    return S.touching(p, p, _adjacency(spark).select("lid", "nlid"))


def overlap_l_shapes(spark, sf_dir):
    p = materialise(l_layout(spark, sf_dir).polygons, "polygons")
    return S.touching(p, p, _same(spark), once=True)


def contact_degree(spark, sf_dir):
    layout = T.Layout(layers(spark), _stored(spark, sf_dir))
    pairs = contacts(layout, _adjacency(spark))
    ends = pairs.select(F.col("a").alias("gid")).unionByName(pairs.select(F.col("b").alias("gid")))
    return ends.groupBy("gid").agg(F.count("*").alias("degree"))


def via_adjacency(spark, sf_dir):
    return S.layer_adjacency(spark, layers(spark), [("L0", "L1", "L2"), ("L3", "L2", "NONE", "L0"), ("L1", "L0"), ("L3", "L3")])


def seed_locate(spark, sf_dir):
    layout = rect_layout(spark, sf_dir)
    return S.locate_seeds(layout.polygons, layout.layers, _seeds(spark, sf_dir, SEEDS))


def point_in_ring(spark, sf_dir):
    c, v = F.col, l_ring()
    xm, ym = (F.call_function("div", c(a) + c(b), F.lit(2).cast("bigint")) for a, b in (("x0", "x1"), ("y0", "y1")))
    at = {"corner": (c("x0"), c("y0")), "notch": (xm, ym), "beyond": (c("x1"), c("y1")), "arm": (xm, c("y1")), "inner": (xm - 1, ym + 1), "outer": (xm + 1, ym + 1)}
    return placed(spark, sf_dir).select("k", *[G.point_in_ring(x, y, v).alias(n) for n, (x, y) in at.items()])


def _reach(spark, sf_dir, keys, vias=(CHAIN,)):
    return _trace(spark, sf_dir, keys, vias).found.select("lid", "gid")


def reach_q1(spark, sf_dir):
    return _reach(spark, sf_dir, (1,), ())


def reach_q2(spark, sf_dir):
    return _reach(spark, sf_dir, (1,))


def reach_q2_frontier(spark, sf_dir):
    return _trace(spark, sf_dir, (1,), search="frontier").found.select("lid", "gid")


def reach_multi_seed(spark, sf_dir):
    return _reach(spark, sf_dir, SEEDS, ())


def reach_by_layer(spark, sf_dir):
    return _reach(spark, sf_dir, (1,)).groupBy("lid").agg(F.count("*").alias("n"))


def reach_levels(spark, sf_dir):
    layout = T.Layout(layers(spark), _stored(spark, sf_dir))
    pairs = contacts(layout, _adjacency(spark))
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    seeds = S.locate_seeds(layout.polygons, layout.layers, _seeds(spark, sf_dir, (1,))).select(F.col("gid").alias("node"))
    return reach_frontier(materialise(edges, "edges"), seeds).select(F.col("node").alias("gid"), "level")


def visited_anti(spark, sf_dir):
    return _polygons(spark, sf_dir).select("gid").join(_reach(spark, sf_dir, (1,)), "gid", "left_anti")


def result_lines(spark, sf_dir):
    found = _trace(spark, sf_dir, (1,)).found
    return T.result_lines(layers(spark), found)


def layout_text_roundtrip(spark, sf_dir):
    """The derived layout as a text file, read back."""
    layout = rect_layout(spark, sf_dir)
    path = scratch_path(spark, "layout")
    T.write_result(layout.layers, layout.polygons.select("lid", F.col("gid").alias("ord"), "v"), path)
    back = T.read_layout(spark, path)
    names = back.layers.select(F.col("lid").alias("read_lid"), "name").join(layout.layers, "name").select("read_lid", F.col("lid").alias("l"))
    return back.polygons.join(names, F.col("lid") == F.col("read_lid")).select(F.col("l").alias("lid"), *S.BOX, T.format_ring(F.col("v")).alias("ring"))


def parse_points(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit(" ("), s("x0"), F.lit(","), s("y0"), F.lit("),(12) ( "), s("x1"), F.lit(" , -"), s("y0"), F.lit(",7);(+"), s("x1"), F.lit(","), s("y1"), F.lit("x)(1,2"))
    return placed(spark, sf_dir).select("k", T.format_ring(T.parse_points(line)).alias("ring"))


def format_ring(spark, sf_dir):
    return _polygons(spark, sf_dir).select("gid", T.format_ring(F.col("v")).alias("ring"))


def gate_candidates(spark, sf_dir):
    return C.gate_candidates(_polygons(spark, sf_dir), POLY, AREA)


def _crossings(spark, sf_dir):
    p = _stored(spark, sf_dir)
    return materialise(C.gate_crossings(p, C.gate_candidates(p, POLY, AREA)), "crossings")


def gate_penetration(spark, sf_dir):
    return _crossings(spark, sf_dir).select("poly", "aa", "minx2", "maxx2", "miny2", "maxy2", "on_left", "on_right", "on_bottom", "on_top")


def gate_cut_lines(spark, sf_dir):
    return C.cut_lines(_crossings(spark, sf_dir))


def gate_cut_lines_physical(spark, sf_dir):
    return C.cut_lines(_crossings(spark, sf_dir), "physical")


def _merged(lines):
    return C.merge_lines(lines.withColumn("is_high", T.gid_pid(F.col("poly")) % 2 == 0).drop("poly"))


def gate_line_merge(spark, sf_dir):
    return _merged(C.cut_lines(_crossings(spark, sf_dir)))


def _slices(spark, sf_dir, lines):
    return C.slices(_polygons(spark, sf_dir).where(F.col("lid") == AREA), lines)


def gate_slices(spark, sf_dir):
    return _slices(spark, sf_dir, C.cut_lines(_crossings(spark, sf_dir))).select("aa", "idx", *S.BOX)


def gate_slice_adjacency(spark, sf_dir):
    lines = C.cut_lines(_crossings(spark, sf_dir))
    return C.conduction(materialise(_slices(spark, sf_dir, lines), "pieces"), _merged(lines))


def gate_slice_rings(spark, sf_dir):
    """The rings of all pieces, odd cuts with their gap included, from their smallest vertex on."""
    made = _slices(spark, sf_dir, C.cut_lines(_crossings(spark, sf_dir)))
    return made.select("aa", "idx", T.format_ring(G.canonical_ring(F.col("v"))).alias("ring"))


def _gated(spark: SparkSession, sf_dir: str, **options) -> Trace:
    return trace(spark, gate_layout(spark, sf_dir), T.Rule(GATE_SEEDS, GATE_VIAS, GATE), TraceOptions(**options))


def gate_polygons(spark, sf_dir):
    return gate_layout(spark, sf_dir).polygons.select("lid", "pid", "gid", *S.BOX, "is_rect")


def reach_q3(spark, sf_dir):
    """Order-true gate search; no SQL form, held against a queue in the tests."""
    return _gated(spark, sf_dir).found.select("lid", "ord", T.format_ring(G.canonical_ring(F.col("v"))).alias("ring"))


def reach_q3_fixpoint(spark, sf_dir):
    found = _gated(spark, sf_dir, gate_flood="fixpoint", phase1="fixpoint").found
    return found.select("lid", "gid", T.format_ring(G.canonical_ring(F.col("v"))).alias("ring"))


def poly_high(spark, sf_dir):
    """Polys that the first start drives, whatever the order."""
    return _gated(spark, sf_dir, gate_flood="fixpoint", phase1="fixpoint").high.select(F.col("poly").alias("gid"))


def trace_metrics_gate(spark, sf_dir):
    return _gated(spark, sf_dir, gate_flood="fixpoint", phase1="fixpoint").metrics


def edge_cross_hv(spark, sf_dir):
    """Level edges and the upright edges of other polygons of a layer that they meet."""
    p = _stored(spark, sf_dir)
    edges = p.select("gid", F.explode(G.ring_edges(F.col("v"))).alias("e"))
    pairs = S.box_pairs(p, p, _same(spark)).select("a", "b")
    level = edges.where("e.is_h").select(F.col("gid").alias("a"), F.col("e").alias("ea"))
    upright = edges.where("not e.is_h").select(F.col("gid").alias("b"), F.col("e").alias("eb"))
    met = pairs.join(level, "a").join(upright, "b").where(G.segments_touch(F.col("ea"), F.col("eb")))
    return met.select("a", "b", F.col("eb.ax").alias("x"), F.col("ea.ay").alias("y"))


def edge_colinear_overlap(spark, sf_dir):
    """Parallel edges of two polygons of a layer that lie on one line and share a point."""
    p = _stored(spark, sf_dir)
    edges = p.select("gid", F.explode(G.ring_edges(F.col("v"))).alias("e"))
    pairs = S.box_pairs(p, p, _same(spark), once=True).select("a", "b")
    both = pairs.join(edges.select(F.col("gid").alias("a"), F.col("e").alias("ea")), "a").join(edges.select(F.col("gid").alias("b"), F.col("e").alias("eb")), "b")
    met = both.where(F.col("ea.is_h") == F.col("eb.is_h")).where(G.segments_touch(F.col("ea"), F.col("eb")))
    return met.select("a", "b", F.col("ea.is_h").alias("is_h"), F.when(F.col("ea.is_h"), F.col("ea.ay")).otherwise(F.col("ea.ax")).alias("at"))


def layer_numbers(spark, sf_dir):
    """Layers as a file that names them in another order, and some again, numbers them; and the numbers of its polygons."""
    back = T.read_layout(spark, _text_file(spark, sf_dir))
    return back.polygons.join(back.layers, "lid").select("name", "lid", "pid", *S.BOX)


def _text_file(spark: SparkSession, sf_dir: str) -> str:
    """The derived layout as text: a header before every polygon, in the order of k; those too small to be polygons too."""
    c, path = F.col, scratch_path(spark, "layout")
    s = lambda n: c(n).cast("string")
    point = lambda x, y: F.concat(F.lit("("), s(x), F.lit(","), s(y), F.lit(")"))
    ring = F.concat_ws(",", point("x0", "y0"), point("x1", "y0"), F.when(c("k") % 11 != 3, F.concat_ws(",", point("x1", "y1"), point("x0", "y1"))))
    lines = placed(spark, sf_dir).select("k", F.concat(F.lit("layer "), ((c("k") * 3 + 2) % 5).cast("string"), F.lit("\n"), ring).alias("line"))
    lines.orderBy("k").select("line").coalesce(1).write.text(path)
    return path


def rule_rows(spark, sf_dir):
    """A rule file made from the first parts, read back row by row."""
    path = scratch_path(spark, "rule")
    some = placed(spark, sf_dir).where("k < 6").orderBy("k").collect()
    text = "before\nVia\nA  B\tC\n" + "".join(f"StartPos\n L{r['lid']} ({r['x0']},{r['y0']}) more\nL{r['lid']} ({r['x0']}, {r['y0']})\n\nVia\nL{r['lid']} X\n" for r in some) + "Gate\nP Q\nR\n"
    spark.createDataFrame([(text,)], "line string").coalesce(1).write.text(path)
    rule = T.read_rule(spark, path)
    rows = [("seed", i, " ".join(map(str, x))) for i, x in enumerate(rule.seeds)] + [("via", i, " ".join(x)) for i, x in enumerate(rule.vias)] + [("gate", 0, " ".join(rule.gate or ()))]
    return spark.createDataFrame(rows, "section string, place int, content string")


def parse_numbers(spark, sf_dir):
    """What a coordinate may look like: signs, zeros in front, blanks, anything behind; -1 and not ``ok`` where it is no 32-bit number."""
    k = F.col("k")
    zeros = F.repeat(F.lit("0"), ((k % 7) * 9).cast("int"))
    field = F.concat(F.element_at(F.array(*map(F.lit, ("", "+", "-", "+-", " ", "\t-", "--", "x"))), (k % 8 + 1).cast("int")), zeros, (k * 1_234_567 % 5_000_000_000).cast("string"), F.element_at(F.array(F.lit(""), F.lit("abc"), F.lit(".5")), (k % 3 + 1).cast("int")))
    n = placed(spark, sf_dir).select("k", T.leading_int(field, strict=False).alias("n"))
    return n.select("k", F.col("n").isNotNull().alias("ok"), F.coalesce("n", F.lit(-1).cast("bigint")).alias("n"))


def trace_metrics(spark, sf_dir):
    return _trace(spark, sf_dir, (1,)).metrics


QUERIES = {
    f.__name__: f
    for f in (
        polygons_table, bbox_project, gid_pack, ring_area2, ring_ccw, edge_split, edge_touch, layer_bounds, cell_size_median, grid_cells, grid_occupancy,
        overlap_same_layer, overlap_via, overlap_l_shapes, contact_degree, via_adjacency, seed_locate, point_in_ring, reach_q1, reach_q2, reach_q2_frontier,
        reach_multi_seed, reach_by_layer, reach_levels, visited_anti, result_lines, layout_text_roundtrip, parse_points, format_ring, gate_candidates,
        gate_penetration, gate_cut_lines, gate_cut_lines_physical, gate_line_merge, gate_slices, gate_slice_adjacency, gate_slice_rings, gate_polygons, reach_q3, reach_q3_fixpoint, poly_high, trace_metrics, trace_metrics_gate,
        edge_cross_hv, edge_colinear_overlap, layer_numbers, rule_rows, parse_numbers,
    )
}

# -- the same in SQL

_BOXES = """
WITH RECURSIVE n AS (SELECT CAST(floor(18 * sqrt(count(*))) AS BIGINT) AS w FROM part),
k AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS BIGINT) AS s FROM part),
b0 AS (SELECT k, s, (k*k*31 + k*7919) % w AS x0, (k*k*17 + k*104729) % w AS y0 FROM k, n),
b AS (SELECT k, CAST(k % 4 AS INTEGER) AS lid, CAST(k // 4 AS INTEGER) AS pid, x0, y0, x0 + 8 + (k*17) % 40 AS x1, y0 + 8 + s AS y1 FROM b0),
p AS (SELECT lid, pid, CAST(lid AS BIGINT) * 4294967296 + pid AS gid, x0 AS minx, y0 AS miny, x1 AS maxx, y1 AS maxy FROM b),
l AS (SELECT *, (x0 + x1) // 2 AS xm, (y0 + y1) // 2 AS ym FROM b)"""
_MET = "a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy"
_RECT = "'(' || minx || ',' || miny || '),(' || maxx || ',' || miny || '),(' || maxx || ',' || maxy || '),(' || minx || ',' || maxy || ')'"
_L = "'(' || x0 || ',' || y0 || '),(' || x1 || ',' || y0 || '),(' || x1 || ',' || ym || '),(' || xm || ',' || ym || '),(' || xm || ',' || y1 || '),(' || x0 || ',' || y1 || ')'"
_E = """,
e AS (SELECT gid, lid, minx AS ax, miny AS ay, maxx AS bx, miny AS "by", true AS is_h FROM p UNION ALL SELECT gid, lid, maxx, miny, maxx, maxy, false FROM p
      UNION ALL SELECT gid, lid, maxx, maxy, minx, maxy, true FROM p UNION ALL SELECT gid, lid, minx, maxy, minx, miny, false FROM p)"""
_SAME = f"a.lid = b.lid AND {_MET}"
_LINKED = f"(a.lid = b.lid OR abs(a.lid - b.lid) = 1) AND {_MET}"


def _seed_sql(keys: tuple[int, ...]) -> str:
    return f""",
s AS (SELECT k AS idx, lid, x0 AS x, y0 AS y FROM b WHERE k IN ({', '.join(map(str, keys))})),
g AS (SELECT idx, gid FROM (SELECT s.idx, p.gid, row_number() OVER (PARTITION BY s.idx ORDER BY (maxx - minx) * (maxy - miny) DESC, pid) AS n
      FROM s JOIN p ON p.lid = s.lid AND s.x BETWEEN minx AND maxx AND s.y BETWEEN miny AND maxy) WHERE n = 1)"""


def _reach_sql(keys: tuple[int, ...], on: str) -> str:
    return _BOXES + _seed_sql(keys) + f""",
c AS (SELECT a.gid AS a, b.gid AS b FROM p a JOIN p b ON a.gid <> b.gid AND {on}),
r AS (SELECT DISTINCT gid FROM g UNION SELECT c.b FROM r JOIN c ON c.a = r.gid)"""


_CROSS = f""",
cand AS (SELECT a.gid AS poly, b.gid AS aa, a.pid AS poly_pid, a.minx AS px0, a.miny AS py0, a.maxx AS px1, a.maxy AS py1, b.minx AS ax0, b.miny AS ay0, b.maxx AS ax1, b.maxy AS ay1
         FROM p a JOIN p b ON a.lid = {POLY} AND b.lid = {AREA} AND {_MET}),
x AS (SELECT *, 2 * greatest(px0, ax0) AS minx2, 2 * least(px1, ax1) AS maxx2, 2 * greatest(py0, ay0) AS miny2, 2 * least(py1, ay1) AS maxy2 FROM cand),
f AS (SELECT *, minx2 = 2 * ax0 OR maxx2 = 2 * ax0 AS on_left, maxx2 = 2 * ax1 OR minx2 = 2 * ax1 AS on_right, miny2 = 2 * ay0 OR maxy2 = 2 * ay0 AS on_bottom, maxy2 = 2 * ay1 OR miny2 = 2 * ay1 AS on_top
      FROM x WHERE maxx2 > minx2 AND maxy2 > miny2)"""
# a box that only touches an area's border clips to less than a ring where it is a point, and to a flat ring of two vertices
_LINES = _CROSS + """,
ln AS (SELECT aa, poly, poly_pid, false AS horizontal, (minx2 + maxx2) // 2 AS coord2, miny2 AS span_min2, maxy2 AS span_max2, 2 * ax0 AS low, 2 * ax1 AS high FROM f WHERE on_left AND on_right
       UNION ALL SELECT aa, poly, poly_pid, true, (miny2 + maxy2) // 2, minx2, maxx2, 2 * ay0, 2 * ay1 FROM f WHERE on_bottom AND on_top)"""
_MERGED = _LINES + """,
m0 AS (SELECT aa, horizontal, coord2, span_min2, span_max2, poly_pid % 2 = 0 AS is_high FROM ln WHERE coord2 > low AND coord2 < high),
m1 AS (SELECT *, max(span_max2) OVER (PARTITION BY aa, horizontal, coord2 ORDER BY span_min2, span_max2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m0),
m2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR span_min2 >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY aa, horizontal, coord2 ORDER BY span_min2, span_max2 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m1),
m AS (SELECT aa, horizontal, coord2, min(span_min2) AS span_min2, max(span_max2) AS span_max2, bool_or(is_high) AS is_high FROM m2 GROUP BY aa, horizontal, coord2, island)"""
_PIECES = f""",
cv AS (SELECT aa, max(CASE WHEN NOT horizontal THEN coord2 END) AS v, max(CASE WHEN horizontal THEN coord2 END) AS h FROM m GROUP BY aa),
aa AS (SELECT gid AS aa, minx, miny, maxx, maxy, v, h FROM p LEFT JOIN cv ON cv.aa = p.gid WHERE lid = {AREA}),
px AS (SELECT aa, 0 AS i, minx, coalesce((v - v % 2) // 2, maxx) AS maxx, miny, maxy, h FROM aa UNION ALL SELECT aa, 1, (v + v % 2) // 2, maxx, miny, maxy, h FROM aa WHERE v IS NOT NULL),
pc AS (SELECT aa, i * CASE WHEN h IS NULL THEN 1 ELSE 2 END AS idx, minx, miny, maxx, coalesce((h - h % 2) // 2, maxy) AS maxy FROM px
       UNION ALL SELECT aa, i * 2 + 1, minx, (h + h % 2) // 2, maxx, maxy FROM px WHERE h IS NOT NULL)"""

ORACLES = {
    "polygons_table": _BOXES + "SELECT lid, pid, gid, minx, miny, maxx, maxy, true AS is_rect FROM p",
    "bbox_project": _BOXES + "SELECT gid, minx, miny, maxx, maxy, false AS is_rect FROM p",
    "gid_pack": _BOXES + "SELECT gid, lid, pid FROM p",
    "ring_area2": _BOXES + "SELECT k, CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END * 2 * ((x1 - x0) * (ym - y0) + (xm - x0) * (y1 - ym)) AS area2 FROM l",
    "ring_ccw": _BOXES + f"SELECT k, {_L} AS ring FROM l",
    "edge_split": _BOXES + _E + 'SELECT gid, ax, ay, bx, "by", is_h FROM e',
    "edge_touch": _BOXES + _E + f"""
SELECT a.gid AS a, b.gid AS b, count(*) FILTER (least(ea.ax, ea.bx) <= greatest(eb.ax, eb.bx) AND least(eb.ax, eb.bx) <= greatest(ea.ax, ea.bx)
  AND least(ea.ay, ea."by") <= greatest(eb.ay, eb."by") AND least(eb.ay, eb."by") <= greatest(ea.ay, ea."by")) AS n
FROM p a JOIN p b ON a.gid < b.gid AND {_SAME} JOIN e ea ON ea.gid = a.gid JOIN e eb ON eb.gid = b.gid GROUP BY 1, 2""",
    "layer_bounds": _BOXES + "SELECT lid, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM p GROUP BY lid",
    "cell_size_median": _BOXES + """,
w AS (SELECT list_sort(list(side)) AS s FROM (SELECT maxx - minx AS side FROM p UNION ALL SELECT maxy - miny FROM p))
SELECT s[len(s) // 2 + 1] AS median, CAST(least(4096, greatest(16, s[len(s) // 2 + 1])) AS BIGINT) AS cell FROM w""",
    "grid_cells": _BOXES + """,
o AS (SELECT lid, min(minx) AS ox, min(miny) AS oy FROM p GROUP BY lid),
c AS (SELECT p.lid, gid, (minx - ox) // 32 AS cx0, (maxx - ox) // 32 AS cx1, (miny - oy) // 32 AS cy0, (maxy - oy) // 32 AS cy1 FROM p JOIN o ON o.lid = p.lid),
cx AS (SELECT *, unnest(generate_series(cx0, cx1)) AS cx FROM c)
SELECT lid, cx, unnest(generate_series(cy0, cy1)) AS cy, gid FROM cx""",
    "grid_occupancy": _BOXES + """,
o AS (SELECT lid, min(minx) AS ox, min(miny) AS oy FROM p GROUP BY lid),
c AS (SELECT p.lid, gid, (minx - ox) // 32 AS cx0, (maxx - ox) // 32 AS cx1, (miny - oy) // 32 AS cy0, (maxy - oy) // 32 AS cy1 FROM p JOIN o ON o.lid = p.lid),
cx AS (SELECT *, unnest(generate_series(cx0, cx1)) AS cx FROM c),
cc AS (SELECT lid, cx, unnest(generate_series(cy0, cy1)) AS cy FROM cx),
q AS (SELECT lid, cx, cy, count(*) AS n FROM cc GROUP BY ALL)
SELECT lid, count(*) AS cells, max(n) AS most, CAST(sum(n) AS BIGINT) AS entries FROM q GROUP BY lid""",
    "overlap_same_layer": _BOXES + f"SELECT a.gid AS a, b.gid AS b FROM p a JOIN p b ON a.gid < b.gid AND {_SAME}",
    "overlap_via": _BOXES + f"SELECT a.gid AS a, b.gid AS b FROM p a JOIN p b ON abs(a.lid - b.lid) = 1 AND {_MET}",
    "overlap_l_shapes": _BOXES + f""",
h AS (SELECT lid, CAST(lid AS BIGINT) * 4294967296 + pid AS gid, x0 AS minx, y0 AS miny, x1 AS maxx, ym AS maxy FROM l
      UNION ALL SELECT lid, CAST(lid AS BIGINT) * 4294967296 + pid, x0, y0, xm, y1 FROM l)
SELECT DISTINCT a.gid AS a, b.gid AS b FROM h a JOIN h b ON a.gid < b.gid AND {_SAME}""",
    "contact_degree": _BOXES + f"SELECT a.gid, count(*) AS degree FROM p a JOIN p b ON a.gid <> b.gid AND {_LINKED} GROUP BY a.gid",
    "via_adjacency": "SELECT CAST(a AS INTEGER) AS lid, CAST(b AS INTEGER) AS nlid, CAST(o AS INTEGER) AS ord FROM (VALUES (0, 1, 0), (1, 0, 0), (1, 2, 1), (2, 1, 0), (3, 2, 0), (2, 3, 1), (3, 3, 1)) AS t(a, b, o)",
    "seed_locate": _BOXES + _seed_sql(SEEDS) + "SELECT CAST(idx AS INTEGER) AS idx, gid FROM g",
    "point_in_ring": _BOXES + """
SELECT k, true AS corner, true AS notch, false AS beyond, true AS arm,
  (xm - 1 BETWEEN x0 AND xm AND ym + 1 BETWEEN y0 AND y1) OR (xm - 1 BETWEEN x0 AND x1 AND ym + 1 BETWEEN y0 AND ym) AS inner, false AS outer FROM l""",
    "reach_q1": _reach_sql((1,), _SAME) + "SELECT p.lid, p.gid FROM r JOIN p ON p.gid = r.gid",
    "reach_q2": _reach_sql((1,), _LINKED) + "SELECT p.lid, p.gid FROM r JOIN p ON p.gid = r.gid",
    "reach_q2_frontier": _reach_sql((1,), _LINKED) + "SELECT p.lid, p.gid FROM r JOIN p ON p.gid = r.gid",
    "reach_multi_seed": _reach_sql(SEEDS, _SAME) + "SELECT p.lid, p.gid FROM r JOIN p ON p.gid = r.gid",
    "reach_by_layer": _reach_sql((1,), _LINKED) + "SELECT p.lid, count(*) AS n FROM r JOIN p ON p.gid = r.gid GROUP BY p.lid",
    "visited_anti": _reach_sql((1,), _LINKED) + "SELECT gid FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.gid = p.gid)",
    "result_lines": _reach_sql((1,), _LINKED) + f""",
q AS (SELECT p.* FROM r JOIN p ON p.gid = r.gid)
SELECT lid, gid AS ord, {_RECT} AS line FROM q UNION ALL SELECT DISTINCT lid, CAST(-1 AS BIGINT), 'L' || lid FROM q""",
    "layout_text_roundtrip": _BOXES + f"SELECT lid, minx, miny, maxx, maxy, {_RECT} AS ring FROM p",
    "parse_points": _BOXES + "SELECT k, '(' || x0 || ',' || y0 || '),(' || x1 || ',' || -y0 || '),(' || x1 || ',' || y1 || ')' AS ring FROM b",
    "format_ring": _BOXES + f"SELECT gid, {_RECT} AS ring FROM p",
    "gate_candidates": _BOXES + _CROSS + "SELECT poly, aa FROM cand",
    "gate_penetration": _BOXES + _CROSS + "SELECT poly, aa, minx2, maxx2, miny2, maxy2, on_left, on_right, on_bottom, on_top FROM f",
    "gate_cut_lines": _BOXES + _LINES + "SELECT aa, poly, horizontal, coord2, span_min2, span_max2 FROM ln WHERE coord2 > low AND coord2 < high",
    "gate_cut_lines_physical": _BOXES + _CROSS + """,
ln AS (SELECT aa, poly, false AS horizontal, (minx2 + maxx2) // 2 AS coord2, miny2 AS span_min2, maxy2 AS span_max2, 2 * ax0 AS low, 2 * ax1 AS high FROM f WHERE on_bottom AND on_top
       UNION ALL SELECT aa, poly, true, (miny2 + maxy2) // 2, minx2, maxx2, 2 * ay0, 2 * ay1 FROM f WHERE on_left AND on_right)
SELECT aa, poly, horizontal, coord2, span_min2, span_max2 FROM ln WHERE coord2 > low AND coord2 < high""",
    "gate_line_merge": _BOXES + _MERGED + "SELECT aa, horizontal, coord2, span_min2, span_max2, is_high FROM m",
    "gate_slices": _BOXES + _MERGED + _PIECES + "SELECT aa, CAST(idx AS INTEGER) AS idx, minx, miny, maxx, maxy FROM pc",
    "gate_slice_adjacency": _BOXES + _MERGED + _PIECES + """,
sd AS (SELECT m.aa, idx, m.horizontal, coord2, span_min2, span_max2, CASE WHEN m.horizontal THEN 2 * minx ELSE 2 * miny END AS lo, CASE WHEN m.horizontal THEN 2 * maxx ELSE 2 * maxy END AS hi,
         CASE WHEN m.horizontal THEN 2 * maxy ELSE 2 * maxx END <= coord2 AS below, CASE WHEN m.horizontal THEN 2 * miny ELSE 2 * minx END >= coord2 AS above
       FROM m JOIN pc ON pc.aa = m.aa WHERE is_high),
se AS (SELECT * FROM sd WHERE greatest(lo, span_min2) < least(hi, span_max2)),
pr AS (SELECT a.aa, a.idx AS a, b.idx AS b FROM se a JOIN se b ON a.aa = b.aa AND a.horizontal = b.horizontal AND a.coord2 = b.coord2 AND a.span_min2 = b.span_min2
       AND a.span_max2 = b.span_max2 AND a.below AND b.above AND NOT b.below AND greatest(a.lo, b.lo) < least(a.hi, b.hi))
SELECT DISTINCT aa, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM (SELECT aa, a, b FROM pr UNION ALL SELECT aa, b, a FROM pr)""",
    "trace_metrics": _reach_sql((1,), _LINKED) + """
SELECT CAST(0 AS BIGINT) AS phase1_visited, CAST(0 AS BIGINT) AS poly_high, CAST(0 AS BIGINT) AS aa_cut, CAST(0 AS BIGINT) AS pieces_generated, CAST(0 AS BIGINT) AS pieces_visited, count(*) AS reachable FROM r""",
}
ORACLES = {k: v.replace(")SELECT", ")\nSELECT") for k, v in ORACLES.items()}
ORACLES["reach_levels"] = _reach_sql((1,), _LINKED) + """,
lv AS (SELECT gid, 0 AS level FROM g UNION SELECT c.b, level + 1 FROM lv JOIN c ON c.a = lv.gid WHERE level < 40)
SELECT gid, CAST(min(level) AS INTEGER) AS level FROM lv GROUP BY gid"""

ORACLES["gate_slice_rings"] = _BOXES + _MERGED + _PIECES + f"SELECT aa, CAST(idx AS INTEGER) AS idx, {_RECT} AS ring FROM pc"
ORACLES["edge_cross_hv"] = _BOXES + _E + f"""
SELECT a.gid AS a, b.gid AS b, eb.ax AS x, ea.ay AS y FROM p a JOIN p b ON a.gid <> b.gid AND {_SAME}
JOIN e ea ON ea.gid = a.gid AND ea.is_h JOIN e eb ON eb.gid = b.gid AND NOT eb.is_h
WHERE eb.ax BETWEEN least(ea.ax, ea.bx) AND greatest(ea.ax, ea.bx) AND ea.ay BETWEEN least(eb.ay, eb."by") AND greatest(eb.ay, eb."by")"""
ORACLES["edge_colinear_overlap"] = _BOXES + _E + f"""
SELECT a.gid AS a, b.gid AS b, ea.is_h, CASE WHEN ea.is_h THEN ea.ay ELSE ea.ax END AS at FROM p a JOIN p b ON a.gid < b.gid AND {_SAME}
JOIN e ea ON ea.gid = a.gid JOIN e eb ON eb.gid = b.gid AND eb.is_h = ea.is_h
WHERE CASE WHEN ea.is_h THEN ea.ay = eb.ay AND greatest(least(ea.ax, ea.bx), least(eb.ax, eb.bx)) <= least(greatest(ea.ax, ea.bx), greatest(eb.ax, eb.bx))
  ELSE ea.ax = eb.ax AND greatest(least(ea.ay, ea."by"), least(eb.ay, eb."by")) <= least(greatest(ea.ay, ea."by"), greatest(eb.ay, eb."by")) END"""
ORACLES["layer_numbers"] = _BOXES + """,
t AS (SELECT *, 'layer ' || ((k * 3 + 2) % 5) AS name FROM b),
o AS (SELECT name, row_number() OVER (ORDER BY min(k)) - 1 AS l FROM t GROUP BY name)
SELECT name, CAST(l AS INTEGER) AS lid, CAST(row_number() OVER (PARTITION BY name ORDER BY k) - 1 AS INTEGER) AS pid, x0 AS minx, y0 AS miny, x1 AS maxx, y1 AS maxy
FROM t JOIN o USING (name) WHERE k % 11 <> 3"""
ORACLES["rule_rows"] = _BOXES + """,
o AS (SELECT *, CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS n FROM b WHERE k < 6)
SELECT 'seed' AS section, n - 1 AS place, 'L' || lid || ' ' || x0 || ' ' || y0 AS content FROM o
UNION ALL SELECT 'via', n, 'L' || lid || ' X' FROM o UNION ALL VALUES ('via', 0, 'A B C'), ('gate', 0, 'R Q')"""
ORACLES["parse_numbers"] = _BOXES + """,
v AS (SELECT k, (k * 1234567) % 5000000000 AS n FROM b),
r AS (SELECT k, CASE WHEN k % 8 IN (3, 6, 7) THEN NULL WHEN k % 8 IN (2, 5) AND n <= 2147483648 THEN -n WHEN k % 8 IN (0, 1, 4) AND n <= 2147483647 THEN n END AS n FROM v)
SELECT k, n IS NOT NULL AS ok, CAST(coalesce(n, -1) AS BIGINT) AS n FROM r"""

# rows of transistors: polygons as p, so that lines and pieces are those of the SQL above
_TRANSISTORS = """
WITH RECURSIVE c AS (SELECT greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT)) AS across FROM part),
t AS (SELECT CAST(p_partkey AS BIGINT) AS k, across, (CAST(p_partkey AS BIGINT) % across) * 30 AS x, (CAST(p_partkey AS BIGINT) // across) * 40 AS y FROM part, c),
sh AS (
  SELECT 0 AS lid, k * 3 AS pid, x + 15 AS minx, y + 1 AS miny, x + 33 AS maxx, y + 3 AS maxy FROM t WHERE (k + 1) % across <> 0
  UNION ALL SELECT 0, k * 3 + 1, x + 16, y + 17, x + 18, y + 43 FROM t WHERE k % 3 = 0
  UNION ALL SELECT 0, k * 3 + 2, x + 21, y + 2, x + 22, y + 10 FROM t WHERE k % 5 = 2
  UNION ALL SELECT 1, k * 2, x - 2, y + 8, x + 22, y + 12 FROM t WHERE k % 5 <> 4
  UNION ALL SELECT 1, k * 2 + 1, x + 8, y - 2, x + 12, y + 22 FROM t WHERE k % 4 = 1 OR k % 5 = 4
  UNION ALL SELECT 2, k, x, y, x + 20 + k % 2, y + 20 FROM t
  UNION ALL SELECT 3, k, x - 2, y + 9, x + 29, y + 11 FROM t WHERE k % 13 <> 3),
p AS (SELECT CAST(lid AS INTEGER) AS lid, CAST(pid AS INTEGER) AS pid, CAST(lid AS BIGINT) * 4294967296 + pid AS gid, minx, miny, maxx, maxy FROM sh)"""
_NODE = "4611686018427387904 + (aa % 4294967296) * 16777216 + "
_GATED = _TRANSISTORS + _MERGED + _PIECES + f""",
nd AS MATERIALIZED (SELECT gid AS node, lid, minx, miny, maxx, maxy FROM p WHERE lid <> {AREA} UNION ALL SELECT {_NODE}idx, {AREA}, minx, miny, maxx, maxy FROM pc),
adj AS (SELECT * FROM (VALUES (0, 2), (2, 0), (0, 1), (1, 0), (3, 1), (1, 3)) AS v(f, g)),
w AS MATERIALIZED (SELECT a.node AS s, b.node AS d FROM nd a JOIN nd b ON a.node <> b.node AND {_MET}
      AND ((a.lid = b.lid AND a.lid <> {AREA}) OR EXISTS (SELECT 1 FROM adj WHERE f = a.lid AND g = b.lid))),
sd AS (SELECT m2.aa, poly, idx, m2.horizontal, m2.coord2, island, CASE WHEN m2.horizontal THEN 2 * minx ELSE 2 * miny END AS lo, CASE WHEN m2.horizontal THEN 2 * maxx ELSE 2 * maxy END AS hi,
         CASE WHEN m2.horizontal THEN 2 * maxy ELSE 2 * maxx END <= m2.coord2 AS below, CASE WHEN m2.horizontal THEN 2 * miny ELSE 2 * minx END >= m2.coord2 AS above, m2.span_min2, m2.span_max2
       FROM (SELECT m2.*, ln.poly FROM m2 JOIN ln USING (aa, horizontal, coord2, span_min2, span_max2)) m2 JOIN pc ON pc.aa = m2.aa),
se AS (SELECT * FROM sd WHERE greatest(lo, span_min2) < least(hi, span_max2)),
cd0 AS (SELECT a.aa, a.poly, a.idx AS i, b.idx AS j FROM se a JOIN se b ON a.aa = b.aa AND a.horizontal = b.horizontal AND a.island = b.island AND a.poly = b.poly
        AND a.below AND b.above AND NOT b.below AND greatest(a.lo, b.lo) < least(a.hi, b.hi)),
cd AS MATERIALIZED (SELECT DISTINCT {_NODE}i AS s, {_NODE}j AS d, poly FROM cd0 UNION SELECT {_NODE}j, {_NODE}i, poly FROM cd0),
s1 AS (SELECT min(gid) AS node FROM p WHERE lid = 3 AND 0 BETWEEN minx AND maxx AND 10 BETWEEN miny AND maxy),
s2 AS (SELECT min(gid) AS node FROM p WHERE lid = 0 AND 20 BETWEEN minx AND maxx AND 2 BETWEEN miny AND maxy),
r1(node) USING KEY (node) AS (SELECT node FROM s1 UNION (SELECT d FROM (
   SELECT w.d FROM r1 JOIN w ON w.s = r1.node
   UNION SELECT cd.d FROM r1 JOIN cd ON cd.s = r1.node JOIN recurring.r1 h ON h.node = cd.poly
   UNION SELECT cd.d FROM r1 JOIN cd ON cd.poly = r1.node JOIN recurring.r1 h ON h.node = cd.s) x WHERE d NOT IN (SELECT node FROM recurring.r1))),
hi AS (SELECT r1.node AS poly FROM r1 JOIN p ON p.gid = r1.node AND p.lid = {POLY}),
w2 AS MATERIALIZED (SELECT s, d FROM w UNION SELECT s, d FROM cd JOIN hi USING (poly)),
r2 AS (SELECT node FROM s2 UNION SELECT w2.d FROM r2 JOIN w2 ON w2.s = r2.node)"""

ORACLES["gate_polygons"] = _TRANSISTORS + "\nSELECT lid, pid, gid, minx, miny, maxx, maxy, true AS is_rect FROM p"
ORACLES["poly_high"] = _GATED + "\nSELECT poly AS gid FROM hi"
ORACLES["reach_q3_fixpoint"] = _GATED + f"\nSELECT CAST(lid AS INTEGER) AS lid, nd.node AS gid, {_RECT} AS ring FROM r2 JOIN nd ON nd.node = r2.node"
ORACLES["trace_metrics_gate"] = _GATED + f""",
to_ AS (SELECT DISTINCT b.gid AS aa FROM r2 JOIN nd a ON a.node = r2.node AND a.lid = 0 JOIN p b ON b.lid = {AREA} AND {_MET}),
n AS (SELECT aa, count(*) AS n FROM pc JOIN to_ USING (aa) GROUP BY aa)
SELECT (SELECT count(*) FROM r1) AS phase1_visited, (SELECT count(*) FROM hi) AS poly_high, (SELECT count(*) FROM n WHERE n > 1) AS aa_cut,
       CAST((SELECT sum(n) FROM n) AS BIGINT) AS pieces_generated, (SELECT count(*) FROM r2 WHERE node >= 4611686018427387904) AS pieces_visited, (SELECT count(*) FROM r2) AS reachable"""
