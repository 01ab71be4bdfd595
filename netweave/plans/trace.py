"""Connectivity queries over a layout: start points, rules between layers, and gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from netweave.operators import gate as C
from netweave.operators.reach import reach_components, reach_conditional, reach_frontier
from netweave.operators.spatial import BASE, layer_adjacency, locate_seeds, touching
from netweave.plans.session import materialise, ship
from netweave.sources.layout_text import Layout, Rule, read_layout, read_rule, write_result, write_result_file

METRICS = ("phase1_visited", "poly_high", "aa_cut", "pieces_generated", "pieces_visited", "reachable")


@dataclass(frozen=True)
class TraceOptions:
    """``gate_orientation``: ``as_coded`` or ``physical`` (see ``cut_lines``). ``gate_flood``: a piece entered takes its
    neighbours with it (``one_hop``) or all that they lead to (``fixpoint``). ``phase1``: whether a poly is driven is
    judged when an area is first touched (``reference_order``) or when nothing changes any more (``fixpoint``).
    ``search``: ``components`` or ``frontier``, for queries without a gate. ``base``: smallest cell of the grid."""

    gate_orientation: str = "as_coded"
    gate_flood: str = "one_hop"
    phase1: str = "reference_order"
    search: str = "components"
    base: int = BASE

    def __post_init__(self):
        for name, allowed in (("gate_orientation", ("as_coded", "physical")), ("gate_flood", ("one_hop", "fixpoint")), ("phase1", ("reference_order", "fixpoint")), ("search", ("components", "frontier"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}")


@dataclass(frozen=True)
class Trace:
    """``found``: ``lid, ord, gid, v`` in output order by ``(lid, ord)``. ``metrics``: one row. ``high``: ``poly``, the
    polys that the first start drives; None without a gate."""

    found: DataFrame
    metrics: DataFrame
    high: DataFrame | None = None


def contacts(layout: Layout, adjacency: DataFrame, base: int = BASE) -> DataFrame:
    """``a, b``: polygons that connect, each pair once: those of a layer, or of neighbour layers, that share a point."""
    same = layout.layers.select("lid", F.col("lid").alias("nlid"))
    return touching(layout.polygons, layout.polygons, same.unionByName(adjacency.select("lid", "nlid")).distinct(), once=True, base=base)


def _metrics(spark: SparkSession, **known: int) -> DataFrame:
    return spark.createDataFrame([tuple(known.get(m, 0) for m in METRICS)], ", ".join(f"{m} bigint" for m in METRICS))


def _seeds(spark: SparkSession, layout: Layout, rule: Rule) -> DataFrame:
    rows = [(i, *s) for i, s in enumerate(rule.seeds)]
    return locate_seeds(layout.polygons, layout.layers, spark.createDataFrame(rows, "idx int, layer string, x bigint, y bigint"))


def trace(spark: SparkSession, layout: Layout, rule: Rule, options: TraceOptions | None = None) -> Trace:
    """Everything that is connected with the rule's start points.

    Without a gate, or with one start point, all of them count and a gate is ignored. With a gate and two or more, the
    first drives polys and the second is traced. An unknown layer, or a start that hits nothing, gives an empty result
    with a gate and is left out without.
    """
    ship(spark)
    options = options or TraceOptions()
    if rule.gate is None or len(rule.seeds) <= 1:
        return _trace_plain(spark, layout, rule, options)
    return _trace_gate(spark, layout, rule, options)


def _trace_plain(spark: SparkSession, layout: Layout, rule: Rule, options: TraceOptions) -> Trace:
    layout = Layout(layout.layers, materialise(layout.polygons, "polygons"))
    seeds = materialise(_seeds(spark, layout, rule).select("gid").distinct(), "seeds")
    pairs = materialise(contacts(layout, layer_adjacency(spark, layout.layers, rule.vias), options.base), "contacts")
    if options.search == "components":
        reached = reach_components(pairs, seeds)
    else:
        edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))
        reached = reach_frontier(materialise(edges, "edges"), seeds.withColumnRenamed("gid", "node")).select(F.col("node").alias("gid"))
    reached = materialise(reached, "reached")
    found = layout.polygons.join(reached, "gid").select("lid", F.col("gid").alias("ord"), "gid", "v")
    return Trace(found, _metrics(spark, reachable=reached.count()))


def _trace_gate(spark: SparkSession, layout: Layout, rule: Rule, options: TraceOptions) -> Trace:
    empty = spark.createDataFrame([], "lid int, ord bigint, gid bigint, v array<struct<x:bigint,y:bigint>>")
    nothing = Trace(empty, _metrics(spark), spark.createDataFrame([], "poly bigint"))
    polygons = materialise(layout.polygons, "polygons")
    layout = Layout(layout.layers, polygons)
    lids = {r["name"]: r["lid"] for r in layout.layers.where(F.col("name").isin(*rule.gate)).collect()}
    start = {r["idx"]: r["gid"] for r in _seeds(spark, layout, Rule(rule.seeds[:2], (), None)).collect()}
    if len(lids) < len(set(rule.gate)) or 0 not in start or 1 not in start:
        return nothing
    poly_lid, aa_lid = lids[rule.gate[0]], lids[rule.gate[1]]
    adjacency = materialise(layer_adjacency(spark, layout.layers, rule.vias), "adjacency")
    lines = materialise(C.cut_lines(C.gate_crossings(polygons, C.gate_candidates(polygons, poly_lid, aa_lid)), options.gate_orientation), "lines")
    pieces = materialise(C.slices(polygons.where(F.col("lid") == aa_lid), lines), "pieces")
    edges = materialise(C.static_edges(polygons, pieces, adjacency, aa_lid), "edges")
    polys = polygons.where(F.col("lid") == poly_lid).select("gid")
    pairs = materialise(C.conduction_by_poly(pieces, lines), "pairs")
    node = lambda c: C.piece_node(F.col("aa"), F.col(c))
    free = edges.where("kind < 2").select("src", "dst")

    if options.phase1 == "reference_order":
        seen, _ = C.search_in_order(edges, start[0], options.gate_flood, pairs)
    else:
        seen = reach_conditional(free, pairs.select(node("a").alias("src"), node("b").alias("dst"), F.col("poly").alias("need")), start[0])
    seen = materialise(seen.select("node"), "seen")
    high = materialise(polys.join(seen, F.col("gid") == F.col("node")).select(F.col("gid").alias("poly")), "high")
    driven = materialise(pairs.join(high, "poly", "left_semi").select("aa", "a", "b").distinct(), "conducting")
    if options.gate_flood == "fixpoint":
        ways = free.unionByName(driven.select(node("a").alias("src"), node("b").alias("dst")))
        visited = reach_frontier(materialise(ways, "ways"), spark.createDataFrame([(start[1],)], "node bigint")).select("node", F.col("node").alias("ord"))
        cut = edges.where("kind = 2").join(visited.select(F.col("node").alias("src")), "src", "left_semi").select("aa").distinct()
    else:
        visited, cut = C.search_in_order(edges, start[1], options.gate_flood, driven.withColumn("poly", F.lit(None).cast("bigint")))
    visited = materialise(visited, "visited")
    whole = visited.join(polygons, F.col("node") == F.col("gid")).select("lid", F.col("gid").alias("ord"), "gid", "v")
    part = visited.join(pieces, F.col("node") == F.col("gid")).select("lid", F.col("ord").alias("k"), "gid", "v")
    part = part.select("lid", (F.lit(C.SLICE_BASE) + (F.col("k") if options.gate_flood == "one_hop" else F.col("gid") - C.SLICE_BASE)).alias("ord"), "gid", "v")
    touched = pieces.join(cut, "aa", "left_semi").groupBy("aa").count()
    per = touched.agg(F.sum("count").alias("n"), F.count_if(F.col("count") > 1).alias("cut")).first()
    metrics = _metrics(
        spark, phase1_visited=seen.count(), poly_high=high.count(), aa_cut=per["cut"] or 0, pieces_generated=per["n"] or 0,
        pieces_visited=visited.where(F.col("node") >= C.SLICE_BASE).count(), reachable=visited.count(),
    )
    return Trace(whole.unionByName(part), metrics, high)


def trace_files(spark: SparkSession, layout: str, rule: str, output: str, options: TraceOptions | None = None, strict: bool = True, one_file: bool = False) -> Trace:
    """Read a layout and a rule file, trace, and write the result below ``output``, or as that one file."""
    made = read_layout(spark, layout, strict)
    result = trace(spark, made, read_rule(spark, rule, strict), options)
    (write_result_file if one_file else write_result)(made.layers, result.found, output)
    return result
