"""Layouts of rectangles, of L shapes, or of rows of transistors, derived from the table ``part`` by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netweave.functions import geometry as G
from netweave.plans.session import tables
from netweave.sources.layout_text import Layout, polygons_of

LAYERS = 4


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k, lid, pid, x0, y0, x1, y1`` for each part: boxes strewn over a square that grows with their number."""
    part = tables(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("k"), F.col("p_size").cast("bigint").alias("s"))
    width = part.agg(F.floor(18 * F.sqrt(F.count("*"))).cast("bigint").alias("w"))
    k = F.col("k")
    boxes = part.crossJoin(F.broadcast(width)).withColumns({"x0": (k * k * 31 + k * 7919) % F.col("w"), "y0": (k * k * 17 + k * 104729) % F.col("w")})
    return boxes.select(
        "k", (k % LAYERS).cast("int").alias("lid"), F.call_function("div", k, F.lit(LAYERS).cast("bigint")).cast("int").alias("pid"),
        "x0", "y0", (F.col("x0") + 8 + (k * 17) % 40).alias("x1"), (F.col("y0") + 8 + F.col("s")).alias("y1"),
    )


def layers(spark: SparkSession) -> DataFrame:
    return spark.range(LAYERS).select(F.col("id").cast("int").alias("lid"), F.concat(F.lit("L"), F.col("id").cast("string")).alias("name"))


def rect_layout(spark: SparkSession, sf_dir: str) -> Layout:
    boxes = placed(spark, sf_dir)
    ring = G.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return Layout(layers(spark), polygons_of(boxes.select("lid", "pid", ring.alias("v"))))


def l_ring() -> Column:
    """A box without its upper right quarter."""
    c = F.col
    xm, ym = (F.call_function("div", c(a) + c(b), F.lit(2).cast("bigint")) for a, b in (("x0", "x1"), ("y0", "y1")))
    return F.array(G.point(c("x0"), c("y0")), G.point(c("x1"), c("y0")), G.point(c("x1"), ym), G.point(xm, ym), G.point(xm, c("y1")), G.point(c("x0"), c("y1")))


def l_layout(spark: SparkSession, sf_dir: str) -> Layout:
    return Layout(layers(spark), polygons_of(placed(spark, sf_dir).select("lid", "pid", l_ring().alias("v"))))


#: Width and height of a transistor's place in ``gate_layout``; via chains, gate and start points of the query on it.
PITCH = (30, 40)
GATE_VIAS = (("L0", "L2"), ("L0", "L1"), ("L3", "L1"))
GATE = ("L1", "L2")
GATE_SEEDS = (("L3", 0, 10), ("L0", 20, 2))


def gate_layout(spark: SparkSession, sf_dir: str) -> Layout:
    """A transistor for each part, in rows: an active area (L2) under a poly along, a poly across, or both (L1).

    Metal (L0) links the right end of an area with the left end of the next, every third upper right corner with the
    row above, and every fifth poly with its own area's metal; straps (L3) join the polys of a row as far as they go.
    So some gates are driven from the strap, some only through areas that conduct, and some never.
    """
    part = tables(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("k"))
    across = part.agg(F.greatest(F.lit(1), F.floor(F.sqrt(F.count("*")))).cast("bigint").alias("across"))
    k = F.col("k")
    at = part.crossJoin(F.broadcast(across)).withColumns({"x": k % F.col("across") * PITCH[0], "y": F.call_function("div", k, F.col("across")) * PITCH[1]})

    def box(lid: int, pid: Column, x0, y0, x1, y1, where: Column) -> Column:
        x, y = F.col("x"), F.col("y")
        ring = G.rectangle(x + x0, y + y0, x + x1, y + y1)
        return F.when(where, F.struct(F.lit(lid).alias("lid"), pid.cast("int").alias("pid"), ring.alias("v")))

    always = F.lit(True)
    shapes = [
        box(0, k * 3, 15, 1, 33, 3, (k + 1) % F.col("across") != 0),
        box(0, k * 3 + 1, 16, 17, 18, 43, k % 3 == 0),
        box(0, k * 3 + 2, 21, 2, 22, 10, k % 5 == 2),
        box(1, k * 2, -2, 8, 22, 12, k % 5 != 4),
        box(1, k * 2 + 1, 8, -2, 12, 22, (k % 4 == 1) | (k % 5 == 4)),
        box(2, k, 0, 0, F.lit(20) + k % 2, 20, always),
        box(3, k, -2, 9, 29, 11, k % 13 != 3),
    ]
    made = at.select(F.explode(F.array_compact(F.array(*shapes))).alias("s")).select("s.*")
    return Layout(layers(spark), polygons_of(made))
