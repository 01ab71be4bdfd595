"""Layouts and rules from text, and results back to text.

A layout file names a layer on a line of its own and then lists polygons, one a line, as ``(x,y),(x,y)...``. Line order
carries meaning (which layer a polygon belongs to, and its number), so every line keeps the place of its file block and
its place in it; what must be carried from block to block goes through a table with one row a block, and no window
spans more than a block.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from netweave.functions.geometry import RING, counter_clockwise, is_rectangle, ring_box
from netweave.plans.session import materialise

_BLANKS = r"[ \t\n\x0B\f\r]"
_INT32 = (-(1 << 31), (1 << 31) - 1)


class LayoutError(ValueError):
    """A layout or rule file that can't be read."""


@dataclass(frozen=True)
class Layout:
    """``layers``: ``lid, name``. ``polygons``: ``lid, pid, gid, minx, miny, maxx, maxy, v, is_rect``."""

    layers: DataFrame
    polygons: DataFrame


@dataclass(frozen=True)
class Rule:
    """``seeds``: (layer, x, y) in order. ``vias``: chains of layer names. ``gate``: (poly layer, active layer) or None."""

    seeds: tuple[tuple[str, int, int], ...]
    vias: tuple[tuple[str, ...], ...]
    gate: tuple[str, str] | None


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, f"^{_BLANKS}+|{_BLANKS}+$", "")


def make_gid(lid: Column, pid: Column) -> Column:
    return F.shiftleft(lid.cast("bigint"), 32).bitwiseOR(pid.cast("bigint"))


def gid_lid(gid: Column) -> Column:
    return F.shiftright(gid, 32).cast("int")


def gid_pid(gid: Column) -> Column:
    return gid.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def leading_int(s: Column, strict: bool) -> Column:
    """The number a field begins with, blanks before it and anything behind it aside; null, or an error, if there is none."""
    # one sign or none; zeros in front don't count, whatever their number, and eleven digits are too many
    shape = F.regexp_extract(s, f"^{_BLANKS}*([+-]?[0-9]+)", 1)
    n = F.concat(F.when(F.startswith(shape, F.lit("-")), F.lit("-")).otherwise(F.lit("")), F.regexp_extract(shape, "^[+-]?0*([0-9]{1,11})$", 1)).try_cast("bigint")
    ok = n.between(*_INT32)
    bad = F.raise_error(F.concat(F.lit("no 32-bit coordinate in "), s)).cast("bigint") if strict else F.lit(None).cast("bigint")
    return F.when(F.coalesce(ok, F.lit(False)), n.cast("bigint")).otherwise(bad)


def parse_points(line: Column, strict: bool = True, dialect: str = "any") -> Column:
    """The points of a line, ``array<struct<x,y>>``.

    ``any`` takes every ``(...)`` of the line whatever stands between them; ``whitespace`` takes words, each of which
    is one point or none. A token without a comma, or too short to be a point, is left out. In a field only the number
    it begins with counts; where there is none, or it isn't a 32-bit number, ``strict`` raises and else the point is
    left out.
    """
    if dialect == "any":
        inner = F.regexp_extract_all(line, F.lit(r"\(([^)]*)\)"), F.lit(1))
    else:
        words = F.filter(F.split(line, f"{_BLANKS}+"), lambda w: w.startswith("(") & w.endswith(")"))
        inner = F.transform(words, lambda w: F.substring(w, F.lit(2), F.greatest(F.length(w) - 2, F.lit(0))))
    inner = F.filter(inner, lambda s: (F.length(s) >= 3) & F.contains(s, F.lit(",")))
    points = F.transform(inner, lambda s: F.struct(leading_int(F.substring_index(s, ",", 1), strict).alias("x"), leading_int(F.substring(s, F.instr(s, ",") + 1, F.length(s)), strict).alias("y")))
    return F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull()).cast(RING)


def polygons_of(rings: DataFrame) -> DataFrame:
    """Polygon columns for rows ``lid, pid, v`` with rings of either turn."""
    v = rings.withColumn("v", counter_clockwise(F.col("v")))
    return v.select(
        F.col("lid").cast("int").alias("lid"), F.col("pid").cast("int").alias("pid"), make_gid(F.col("lid"), F.col("pid")).alias("gid"),
        *[c.alias(n) for n, c in ring_box(F.col("v")).items()], "v", is_rectangle(F.col("v")).alias("is_rect"),
    )


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``blk, seq, line``: lines in file order by block and place in it, blank ones left out."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).alias("blk"), F.monotonically_increasing_id().alias("seq"), trimmed(F.col("value")).alias("line")
    )
    return raw.where("line <> ''")


def read_layout(spark: SparkSession, path: str, strict: bool = True, dialect: str = "any") -> Layout:
    """Read a layout file; ``strict`` raises on a coordinate that isn't a number, else its point is left out.

    A line without ``(`` names a layer, also again; layers are numbered as they first occur, one without polygons too.
    A polygon needs three points, else it is dropped and takes no number, as are polygons before the first layer.
    """
    lines = materialise(_lines(spark, path), "lines")
    header = F.when(~F.contains("line", F.lit("(")), F.col("line"))
    block = W.partitionBy("blk").orderBy("seq")
    within = lines.withColumn("name", F.last(header, ignorenulls=True).over(block.rowsBetween(W.unboundedPreceding, 0)))
    # one row a block: the layer that its first lines belong to
    ends = lines.groupBy("blk").agg(F.max_by(header, F.when(header.isNotNull(), F.col("seq"))).alias("ends"))
    carried = ends.select("blk", F.last("ends", ignorenulls=True).over(W.orderBy("blk").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    named = within.join(carried, "blk").withColumn("name", F.coalesce("name", "carried"))
    heads = named.where(header.isNotNull()).groupBy(F.col("line").alias("name")).agg(F.min(F.struct("blk", "seq")).alias("at"))
    layers = materialise(heads.select((F.row_number().over(W.orderBy("at")) - 1).cast("int").alias("lid"), "name"), "layers")
    rings = materialise(
        named.where(header.isNull() & F.col("name").isNotNull()).join(layers, "name").select("blk", "seq", "lid", parse_points(F.col("line"), strict, dialect).alias("v")).where(F.size("v") >= 3), "rings"
    )
    # polygon numbers: what earlier blocks hold of the layer, and the place among the block's own
    counts = rings.groupBy("lid", "blk").count()
    before = counts.select("lid", "blk", (F.sum("count").over(W.partitionBy("lid").orderBy("blk")) - F.col("count")).alias("before"))
    place = F.row_number().over(W.partitionBy("lid", "blk").orderBy("seq")) - 1
    numbered = rings.withColumn("place", place).join(before, ["lid", "blk"]).select("lid", (F.col("before") + F.col("place")).alias("pid"), "v")
    return Layout(layers, polygons_of(numbered))


def read_rule(spark: SparkSession, path: str, strict: bool = True) -> Rule:
    """Read a rule file: sections ``StartPos``, ``Via`` and ``Gate``, which may repeat; a few lines, so read whole.

    A start position is a layer and a point without blanks, else its line is dropped. Of the gate lines the last
    counts, where a line of one name changes the first layer alone.
    """
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line")).select("at", trimmed(F.col("line")).alias("line")).where("line <> ''")
    section = F.last(F.when(F.col("line").isin("StartPos", "Via", "Gate"), F.col("line")), ignorenulls=True).over(W.orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    words = F.split("line", f"{_BLANKS}+")
    rows = text.withColumn("section", section).where("section is not null").where(~F.col("line").isin("StartPos", "Via", "Gate")).withColumn("words", words)
    seed = F.when((F.size("words") > 1) & (F.col("section") == "StartPos"), parse_points(F.get("words", F.lit(1)), strict, "whitespace"))
    seeds, vias, gate = [], [], ["", ""]
    for r in rows.select("at", "section", "words", seed.alias("point")).orderBy("at").collect():
        if r["section"] == "Via":
            vias.append(tuple(r["words"]))
        elif r["section"] == "Gate":
            gate = [r["words"][0], r["words"][1] if len(r["words"]) > 1 else gate[1]]
        elif r["point"]:
            seeds.append((r["words"][0], r["point"][0]["x"], r["point"][0]["y"]))
    return Rule(tuple(seeds), tuple(vias), tuple(gate) if all(gate) else None)


def format_ring(v: Column) -> Column:
    """``(x,y),(x,y)...``"""
    return F.array_join(F.transform(v, lambda p: F.concat(F.lit("("), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit(")"))), ",")


def result_lines(layers: DataFrame, found: DataFrame) -> DataFrame:
    """``lid, ord, line``: for each layer that has any, its name and then its polygons in order.

    ``found``: ``lid, ord, v``; repeats of ``(lid, ord)`` count once, rings of fewer than three vertices don't count.
    """
    rings = found.where(F.size("v") >= 3).dropDuplicates(["lid", "ord"]).select("lid", "ord", format_ring(F.col("v")).alias("line"))
    heads = layers.join(rings.select("lid").distinct(), "lid").select("lid", F.lit(-1).cast("bigint").alias("ord"), F.col("name").alias("line"))
    return heads.unionByName(rings)


def write_result(layers: DataFrame, found: DataFrame, path: str) -> None:
    """Write the result as text below ``path``, in order over its files; an empty result gives no lines."""
    result_lines(layers, found).orderBy("lid", "ord").select("line").write.mode("overwrite").text(path)


def write_result_file(layers: DataFrame, found: DataFrame, path: str) -> None:
    """Write the result as the one text file ``path``, replaced if there is one; an empty result gives an empty file.

    The parts are written by the tasks, as ``write_result`` does, beside the file; the file is then put together from
    them block by block, so that the driver holds a block and never the result.
    """
    spark = found.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files, parts = at(path).getFileSystem(conf), f"{path.rstrip('/')}.parts-{uuid.uuid4().hex[:8]}"
    try:
        write_result(layers, found, parts)
        names = sorted(f.getPath().toString() for f in files.listStatus(at(parts)) if f.getPath().getName().startswith("part-"))
        files.delete(at(path), True)
        out = files.create(at(path), True)
        try:
            for name in names:
                part = files.open(at(name))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                finally:
                    part.close()
        finally:
            out.close()
    finally:
        files.delete(at(parts), True)
