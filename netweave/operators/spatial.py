"""Which polygons touch: a bucketed spatial join that Catalyst plans as equi-joins.

Cells come in sizes, each four times the last. A polygon's own size is the smallest whose cells are as wide as its
box, so it covers four cells of it at most, and so does anything smaller. Of two polygons the one of the smaller size
looks for the other in the other's cells. Nothing is exploded into many cells, however large a polygon is, and a pair
is met in several cells but kept only in the last cell that both begin in, which needs no ``distinct``.

Large sizes have few polygons and few cells, each of which a whole region of smaller polygons falls into. The polygons of
a size that are few, by a count, are broadcast by their cells, so that the smaller ones stay where they are; the sizes
that are left have as many cells as polygons, and are exchanged by cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from netweave.functions.geometry import boxes_overlap, point_in_ring, rings_touch

BOX = ("minx", "miny", "maxx", "maxy")
BASE = 16
SIZES = 17  # 16 * 4**16 is wider than any 32-bit box
#: Polygons of one size that are broadcast, at most; some 5 MB in their cells.
FEW_HOSTS = 1 << 14


def side_median(polygons: DataFrame) -> DataFrame:
    """``median``: of all widths and heights together, the value at place n/2 in order; no row for no polygons.

    Exact, from counts of the different values, so nothing is gathered.
    """
    sides = polygons.select(F.explode(F.array(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))).alias("side"))
    counts = sides.groupBy("side").count()
    total = counts.agg(F.sum("count").alias("n"))
    upto = counts.withColumn("upto", F.sum("count").over(W.orderBy("side"))).crossJoin(F.broadcast(total))
    return upto.where(F.col("upto") > F.floor(F.col("n") / 2)).agg(F.min("side").alias("median")).where("median is not null")


def cell_size(polygons: DataFrame, hint: int = -1) -> DataFrame:
    """``cell``: the hint if positive, else the median clamped to 16..4096."""
    if hint > 0:
        return polygons.sparkSession.range(1).select(F.lit(hint).cast("bigint").alias("cell"))
    return side_median(polygons).select(F.least(F.lit(4096), F.greatest(F.lit(16), F.col("median"))).cast("bigint").alias("cell"))


def layer_bounds(polygons: DataFrame) -> DataFrame:
    return polygons.groupBy("lid").agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def floor_div(a: Column, b: Column) -> Column:
    """Quotient of integers towards minus infinity, for positive ``b``."""
    return F.call_function("div", a - F.pmod(a, b), b)


def grid_cells(polygons: DataFrame, cell: int) -> DataFrame:
    """``lid, cx, cy, gid``: every cell of one size that a box covers, counted from the layer's lower left corner."""
    size = F.lit(cell).cast("bigint")
    low = layer_bounds(polygons).select("lid", F.col("minx").alias("x0"), F.col("miny").alias("y0"))
    at = lambda c, o: floor_div(F.col(c) - F.col(o), size)
    wide = polygons.join(low, "lid").withColumn("cx", F.explode(F.sequence(at("minx", "x0"), at("maxx", "x0"))))
    return wide.withColumn("cy", F.explode(F.sequence(at("miny", "y0"), at("maxy", "y0")))).select("lid", "cx", "cy", "gid")


def _own_size(base: int) -> Column:
    side = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    own = F.lit(SIZES - 1)
    for s in reversed(range(SIZES - 1)):
        own = F.when(side <= base * 4**s, s).otherwise(own)
    return own


def _in_cells(df: DataFrame, base: int) -> DataFrame:
    """Rows of ``df`` (a box, a ``size``) in the cells that they cover: ``cx, cy``, and ``x0, y0`` where they begin."""
    width = F.lit(base).cast("bigint") * F.pow(F.lit(4), F.col("size")).cast("bigint")
    at = lambda c: floor_div(F.col(c), F.col("__width"))
    begun = df.withColumn("__width", width).withColumns({"x0": at("minx"), "y0": at("miny"), "__x1": at("maxx"), "__y1": at("maxy")})
    return begun.withColumn("cx", F.explode(F.sequence("x0", "__x1"))).withColumn("cy", F.explode(F.sequence("y0", "__y1"))).drop("__width", "__x1", "__y1")


def box_pairs(left: DataFrame, right: DataFrame, layer_pairs: DataFrame, once: bool = False, base: int = BASE) -> DataFrame:
    """Pairs of different polygons whose boxes share a point, of the given layers.

    ``left``, ``right``: ``gid, lid``, a box, ``is_rect``; ``layer_pairs``: ``lid, nlid``. Returns ``a, b`` (gids of
    left and right) and ``sure`` (both are rectangles, so the boxes are all there is to compare). With ``once``,
    for one set on both sides, each unordered pair comes once, the smaller gid as ``a``.
    """
    columns, spark = ["gid", "lid", *BOX, "is_rect"], left.sparkSession
    lhs = left.select(*columns).withColumn("own", _own_size(base))
    rhs = right.select(*columns).withColumn("own", _own_size(base))
    sides = rhs.select("own", F.lit(1).alias("side")).unionByName(lhs.select("own", F.lit(0).alias("side")))
    held = {(r["side"], r["own"]): r["count"] for r in sides.groupBy("side", "own").count().collect()}  # at most 2 * SIZES rows
    small = {"gid": "a", "lid": "a_lid", "own": "a_own", "x0": "a_x0", "y0": "a_y0", "is_rect": "a_rect", **{c: f"a_{c}" for c in BOX}}
    large = {k: "b" + v[1:] for k, v in small.items()}
    met = F.col("cx").eqNullSafe(F.greatest("a_x0", "b_x0")) & F.col("cy").eqNullSafe(F.greatest("a_y0", "b_y0")) & boxes_overlap() & (F.col("a") != F.col("b"))

    def search(guests: DataFrame, hosts: DataFrame, side: int, pairs: DataFrame, tie: Column) -> DataFrame:
        """The smaller ones, in the cells of every size of the hosts from their own on, against the larger in their own."""
        order = ((F.col("a_own") < F.col("b_own")) | ((F.col("a_own") == F.col("b_own")) & tie))
        few = [size for (of, size), n in sorted(held.items()) if of == side and n <= FEW_HOSTS]
        many = [size for (of, size), n in sorted(held.items()) if of == side and n > FEW_HOSTS]
        wanted = pairs.select(F.col("lid").alias("a_lid"), F.col("nlid").alias("b_lid"))
        found = []
        for sizes in filter(None, (few, many)):
            larger = F.filter(F.array(*map(F.lit, sizes)), lambda s: s >= F.col("own"))
            g = _in_cells(guests.withColumn("size", F.explode(larger)), base).withColumnsRenamed(small).join(wanted, "a_lid")
            h = _in_cells(hosts.where(F.col("own").isin(sizes)).withColumn("size", F.col("own")), base).withColumnsRenamed(large)
            near = g.join(F.broadcast(h) if sizes is few else h, ["b_lid", "size", "cx", "cy"]).where(met & order)
            found.append(near.select("a", "b", (F.col("a_rect") & F.col("b_rect")).alias("sure")))
        if not found:
            return spark.createDataFrame([], "a bigint, b bigint, sure boolean")
        return found[0].unionByName(found[1]) if len(found) > 1 else found[0]

    if once:
        found = search(lhs, rhs, 1, layer_pairs, F.col("a") < F.col("b"))
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sure")
    back = layer_pairs.select(F.col("nlid").alias("lid"), F.col("lid").alias("nlid"))
    forth = search(lhs, rhs, 1, layer_pairs, F.lit(True))
    return forth.unionByName(search(rhs, lhs, 0, back, F.lit(False)).select(F.col("b").alias("a"), F.col("a").alias("b"), "sure"))


def touching(left: DataFrame, right: DataFrame, layer_pairs: DataFrame, once: bool = False, base: int = BASE) -> DataFrame:
    """``a, b``: the pairs of ``box_pairs`` whose closed regions share a point. Rings are fetched only where needed."""
    pairs = box_pairs(left, right, layer_pairs, once, base)
    rings = pairs.where("not sure").join(left.select(F.col("gid").alias("a"), F.col("v").alias("av")), "a").join(right.select(F.col("gid").alias("b"), F.col("v").alias("bv")), "b")
    return pairs.where("sure").select("a", "b").unionByName(rings.where(rings_touch(F.col("av"), F.col("bv"))).select("a", "b"))


def layer_adjacency(spark: SparkSession, layers: DataFrame, vias: Sequence[Sequence[str]]) -> DataFrame:
    """``lid, nlid, ord``: neighbours of each layer in the order in which the chains bring them up.

    Adjacent names of a chain connect both ways; unknown names connect nothing; a name next to itself makes a layer its
    own neighbour.
    """
    steps = [(i * 2 + back, *((q, p) if back else (p, q))) for i, (p, q) in enumerate((p, q) for chain in vias for p, q in zip(chain, chain[1:], strict=False)) for back in (0, 1)]
    named = spark.createDataFrame(steps, "step long, name string, other string")
    lid = layers.select("name", "lid")
    found = named.join(lid, "name").join(lid.select(F.col("name").alias("other"), F.col("lid").alias("nlid")), "other")
    first = found.groupBy("lid", "nlid").agg(F.min("step").alias("step"))
    return first.select("lid", "nlid", (F.row_number().over(W.partitionBy("lid").orderBy("step")) - 1).cast("int").alias("ord"))


def locate_seeds(polygons: DataFrame, layers: DataFrame, seeds: DataFrame) -> DataFrame:
    """``idx, gid``: of the polygons that hold a seed (``idx, layer, x, y``), the one with the largest box, then smallest number.

    Seeds on unknown layers, or that hit nothing, give no row.
    """
    asked = seeds.join(layers.withColumnRenamed("name", "layer"), "layer").select("idx", F.col("lid").alias("s_lid"), "x", "y")
    inside = (F.col("lid") == F.col("s_lid")) & F.col("x").between(F.col("minx"), F.col("maxx")) & F.col("y").between(F.col("miny"), F.col("maxy"))
    # seeds are the lines of a rule file, which the driver has read; more than fit a broadcast are joined by layer
    few = seeds.count() <= FEW_HOSTS
    hit = polygons.join(F.broadcast(asked) if few else asked, inside).where(F.when(F.col("is_rect"), F.lit(True)).otherwise(point_in_ring(F.col("x"), F.col("y"), F.col("v"))))
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    return hit.groupBy("idx").agg(F.max_by("gid", F.struct(area.alias("area"), -F.col("pid"))).alias("gid"))
