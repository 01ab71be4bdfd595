"""Layouts small enough to follow by hand, through text files and back."""

import pytest

from netweave.plans.trace import TraceOptions, trace_files
from netweave.sources.layout_text import LayoutError, read_layout, read_rule  # noqa: F401


def box(x0, y0, x1, y1):
    return f"({x0},{y0}),({x1},{y0}),({x1},{y1}),({x0},{y1})"


def text(**layers):
    return "".join(f"{name}\n" + "".join(f"{ring}\n" for ring in rings) for name, rings in layers.items())


def rule(*seeds, via=(), gate=None):
    out = "StartPos\n" + "".join(f"{s}\n" for s in seeds)
    out += "Via\n" + "".join(f"{v}\n" for v in via) if via else ""
    return out + (f"Gate\n{gate}\n" if gate else "")


def run(spark, tmp_path, layout, rules, **options):
    (tmp_path / "layout.txt").write_text(layout)
    (tmp_path / "rule.txt").write_text(rules)
    got = trace_files(spark, str(tmp_path / "layout.txt"), str(tmp_path / "rule.txt"), str(tmp_path / "out"), TraceOptions(**options))
    lines = [r["value"] for p in sorted((tmp_path / "out").glob("part-*")) for r in spark.read.text(str(p)).collect()]
    return lines, got.metrics.first().asDict()


A, B, C = box(0, 0, 2, 2), box(2, 2, 4, 4), box(10, 10, 12, 12)


@pytest.mark.parametrize("search", ["components", "frontier"])
def test_corner_touch_connects(spark, tmp_path, search):
    assert run(spark, tmp_path, text(L1=[A, B, C]), rule("L1 (1,1)"), search=search)[0] == ["L1", A, B]


def test_seed_on_a_shared_corner_takes_the_first(spark, tmp_path):
    assert run(spark, tmp_path, text(L1=[A, B, C]), rule("L1 (2,2)"))[0] == ["L1", A, B]


def test_containment_connects(spark, tmp_path):
    rings = [box(0, 0, 10, 10), box(4, 4, 5, 5)]
    assert run(spark, tmp_path, text(L1=rings), rule("L1 (0,0)"))[0] == ["L1", *rings]


def test_a_notch_does_not(spark, tmp_path):
    u = "(0,0),(10,0),(10,10),(8,10),(8,2),(2,2),(2,10),(0,10)"
    assert run(spark, tmp_path, text(L1=[u, box(4, 4, 6, 6)]), rule("L1 (1,1)"))[0] == ["L1", u]


def test_vias_connect_neighbours_of_a_chain_only(spark, tmp_path):
    rings = dict(L1=[box(0, 0, 4, 4)], L2=[box(10, 10, 12, 12)], L3=[box(0, 0, 4, 4)])
    assert run(spark, tmp_path, text(**rings), rule("L1 (1,1)", via=["L1 L2 L3"]))[0] == ["L1", box(0, 0, 4, 4)]
    (tmp_path / "b").mkdir()
    rings["L2"] = [box(2, 2, 6, 6)]
    assert len(run(spark, tmp_path / "b", text(**rings), rule("L1 (1,1)", via=["L1 L2 L3"]))[0]) == 6


def test_clockwise_rings_are_turned(spark, tmp_path):
    assert run(spark, tmp_path, text(L1=["(0,0),(0,4),(4,4),(4,0)"]), rule("L1 (1,1)"))[0] == ["L1", "(4,0),(4,4),(0,4),(0,0)"]


def test_blanks_and_missing_commas_in_lines(spark, tmp_path):
    layout = "  L1 \n (0, 0),(4,0) (4,4),(0,4)\r\n\n"
    assert run(spark, tmp_path, layout, rule("L1 (1, 1)"))[0] == []
    (tmp_path / "b").mkdir()
    assert run(spark, tmp_path / "b", layout, rule("L1 (1,1)"))[0] == ["L1", box(0, 0, 4, 4)]


def test_dropped_polygons_take_no_number(spark, tmp_path):
    (tmp_path / "l.txt").write_text("(0,0),(1,0),(1,1)\nL1\n(0,0),(1,1)\n" + box(5, 5, 6, 6) + "\nL2\nL1\n" + A)
    got = read_layout(spark, str(tmp_path / "l.txt"))
    assert [(r["lid"], r["pid"], r["gid"], r["minx"], r["is_rect"]) for r in got.polygons.orderBy("gid").collect()] == [(0, 0, 0, 5, True), (0, 1, 1, 0, True)]
    assert [(r["lid"], r["name"]) for r in got.layers.orderBy("lid").collect()] == [(0, "L1"), (1, "L2")]


def test_lines_of_many_blocks_keep_their_layers_and_numbers(spark, tmp_path):
    rows = []
    for layer in range(7):
        rows.append(f"layer {layer % 5}")
        rows += [box(i, layer, i + 1, layer + 1) for i in range(400)]
    (tmp_path / "l.txt").write_text("\n".join(rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = read_layout(spark, str(tmp_path / "l.txt")).polygons.orderBy("gid").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = sorted((layer % 5, (layer // 5) * 400 + i, i, layer) for layer in range(7) for i in range(400))
    assert [(r["lid"], r["pid"], r["minx"], r["miny"]) for r in got] == want


def test_bad_numbers_raise_or_are_left_out(spark, tmp_path):
    (tmp_path / "l.txt").write_text("L\n(0,0),(1,0),(x,1),(1,1),(99999999999,2),(0,1)\n")
    with pytest.raises(Exception, match="no 32-bit coordinate"):
        read_layout(spark, str(tmp_path / "l.txt"))
    got = read_layout(spark, str(tmp_path / "l.txt"), strict=False).polygons.first()
    assert [tuple(p) for p in got["v"]] == [(0, 0), (1, 0), (1, 1), (0, 1)]


def test_numbers_may_have_signs_and_junk_behind(spark, tmp_path):
    (tmp_path / "l.txt").write_text("L\n(-1,+2),( 3,4x,9),(5 ,6)\n")
    assert [tuple(p) for p in read_layout(spark, str(tmp_path / "l.txt")).polygons.first()["v"]] == [(-1, 2), (3, 4), (5, 6)]


def test_rules(spark, tmp_path):
    (tmp_path / "r.txt").write_text("ignored\nVia\nA B C\n\nStartPos\nA (1,-2)\nB (1, 2)\nVia\nC\nGate\nP\nP2 X Y\nP3\n")
    got = read_rule(spark, str(tmp_path / "r.txt"))
    assert got.seeds == (("A", 1, -2),) and got.vias == (("A", "B", "C"), ("C",)) and got.gate == ("P3", "X")


def test_gate_with_one_seed_is_ignored_and_two_seeds_without_gate_unite(spark, tmp_path):
    layout = text(L1=[A, B, C])
    assert run(spark, tmp_path, layout, rule("L1 (1,1)", gate="P Q"))[0] == ["L1", A, B]
    (tmp_path / "b").mkdir()
    assert run(spark, tmp_path / "b", layout, rule("L1 (1,1)", "L1 (10,10)"))[0] == ["L1", A, B, C]


P_UP = box(4, -2, 6, 6)
AA = box(0, 0, 10, 4)
M = [box(0, 0, 3, 4), box(7, 0, 10, 4)]
FA = "POLY\n" + P_UP + "\nAA\n" + AA + "\nMETAL1\n" + M[0] + "\nMETAL1\n" + M[1] + "\n"
FA_HIGH = rule("POLY (5,0)", "METAL1 (1,2)", via=["POLY AA", "AA METAL1"], gate="POLY AA")
FA_LOW = rule("METAL1 (1,2)", "METAL1 (1,2)", via=["AA METAL1"], gate="POLY AA")
HALVES = ["(0,2),(0,0),(10,0),(10,2)", "(0,2),(10,2),(10,4),(0,4)"]
SIDES = [box(0, 0, 5, 4), box(5, 0, 10, 4)]


def test_upright_poly(spark, tmp_path):
    lines, metrics = run(spark, tmp_path, FA, FA_HIGH)
    assert lines == ["POLY", P_UP, "AA", *HALVES, "METAL1", *M]
    assert (metrics["phase1_visited"], metrics["poly_high"], metrics["aa_cut"], metrics["reachable"]) == (5, 1, 1, 5)


def test_upright_poly_undriven(spark, tmp_path):
    lines, metrics = run(spark, tmp_path, FA, FA_LOW)
    assert lines == ["AA", *HALVES, "METAL1", *M]
    assert (metrics["phase1_visited"], metrics["poly_high"]) == (4, 0)


@pytest.mark.parametrize("options", [{}, {"gate_flood": "fixpoint", "phase1": "fixpoint"}])
def test_upright_poly_physical(spark, tmp_path, options):
    assert sorted(run(spark, tmp_path, FA, FA_HIGH, gate_orientation="physical", **options)[0]) == sorted(["POLY", P_UP, "AA", *SIDES, "METAL1", *M])
    (tmp_path / "b").mkdir()
    assert run(spark, tmp_path / "b", FA, FA_LOW, gate_orientation="physical", **options)[0] == ["AA", SIDES[0], "METAL1", M[0]]


FB_M = [box(0, 0, 10, 1), box(0, 3, 10, 4)]
FB = text(POLY=[box(0, 1, 10, 3)], AA=[AA], METAL1=FB_M)


@pytest.mark.parametrize("orientation, pieces, low", [("as_coded", SIDES, 4), ("physical", HALVES, 2)])
def test_level_poly(spark, tmp_path, orientation, pieces, low):
    high = rule("POLY (5,2)", "METAL1 (5,0)", via=["POLY AA", "AA METAL1"], gate="POLY AA")
    lines, metrics = run(spark, tmp_path, FB, high, gate_orientation=orientation)
    assert lines == ["POLY", box(0, 1, 10, 3), "AA", *pieces, "METAL1", *FB_M]
    (tmp_path / "b").mkdir()
    undriven = rule("METAL1 (5,0)", "METAL1 (5,0)", via=["AA METAL1"], gate="POLY AA")
    lines, metrics = run(spark, tmp_path / "b", FB, undriven, gate_orientation=orientation)
    assert metrics["reachable"] == low
    assert lines == (["AA", *pieces, "METAL1", *FB_M] if low == 4 else ["AA", pieces[0], "METAL1", FB_M[0]])


def test_odd_cut_leaves_a_gap(spark, tmp_path):
    layout = text(POLY=[box(0, 1, 5, 3)], AA=[box(0, 0, 5, 4)])
    lines, _ = run(spark, tmp_path, layout, rule("POLY (1,1)", "POLY (1,1)", via=["POLY AA"], gate="POLY AA"))
    assert lines == ["POLY", box(0, 1, 5, 3), "AA", box(0, 0, 2, 4), box(3, 0, 5, 4)]


FD_PIECES = ["(0,4),(0,0),(4,0),(4,4)", "(0,4),(4,4),(4,8),(0,8)", "(4,4),(4,0),(8,0),(8,4)", "(4,4),(8,4),(8,8),(4,8)"]


@pytest.mark.parametrize("flood, n", [("one_hop", 3), ("fixpoint", 4)])
def test_four_pieces(spark, tmp_path, flood, n):
    layout = text(POLY=[box(0, 3, 8, 5), box(3, 0, 5, 8)], AA=[box(0, 0, 8, 8)], METAL1=[box(0, 0, 1, 1), box(7, 7, 8, 8)])
    lines, metrics = run(spark, tmp_path, layout, rule("POLY (1,4)", "METAL1 (0,0)", via=["AA METAL1"], gate="POLY AA"), gate_flood=flood)
    assert lines[:1] == ["AA"] and sorted(lines[1 : n + 1]) == sorted(FD_PIECES[:n])
    assert len(lines) == n + 2 + (2 if flood == "fixpoint" else 1) and metrics["poly_high"] == 2 and metrics["pieces_generated"] == 4


def test_searches_by_levels_are_those_of_a_queue(spark):
    from netweave.operators import gate

    area, piece = 5 << 32, lambda n: (1 << 62) + n
    edges = [(1, 0, 2, None, area, None), (1, 0, 1, None, area, 0), (1, 1, 0, 9, None, None), (piece(1), 0, 0, 8, None, None), (9, 0, 2, None, area, None), (9, 0, 1, None, area, 2)]
    edges = spark.createDataFrame(edges, "src bigint, branch int, kind int, dst bigint, aa bigint, idx int")
    pairs = spark.createDataFrame([(area, 0, 1, 1), (area, 1, 0, 1), (area, 1, 2, 9), (area, 0, 3, None)], "aa bigint, a int, b int, poly bigint")
    want = [1, piece(0), piece(1), piece(3), 9, 8, piece(2)]
    for search in (gate._search_in_one_task, gate._search_by_levels):
        found, areas = search(edges, 1, "one_hop", pairs)
        assert [r["node"] for r in found.orderBy("ord").collect()] == want and [r["aa"] for r in areas.collect()] == [area]


def test_one_file_of_results(spark, tmp_path):
    from netweave.sources.layout_text import write_result_file

    (tmp_path / "l.txt").write_text(text(L1=[A, B], L2=[], L3=[C]))
    layout = read_layout(spark, str(tmp_path / "l.txt"))
    for n in (1, 2):  # a file that is there is replaced
        found = layout.polygons.where(f"pid < {n}").select("lid", "gid", "v").withColumnRenamed("gid", "ord")
        write_result_file(layout.layers, found.repartition(3), str(tmp_path / "out.txt"))
        assert (tmp_path / "out.txt").read_text() == "\n".join(["L1", A, B, "L3", C] if n == 2 else ["L1", A, "L3", C]) + "\n"
    write_result_file(layout.layers, found.where("false"), str(tmp_path / "none.txt"))
    assert (tmp_path / "none.txt").read_text() == "" and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["l.txt", "none.txt", "out.txt"]


def test_numbers_as_the_c_library_reads_them(spark, tmp_path):
    (tmp_path / "l.txt").write_text("L\n(+-5,1),(0000000000000000000000000000000000000007,2),(-00000000000000000003,+2147483647),(1,-2147483648),(2147483648,1),(--1,2),(4,4)\n")
    got = read_layout(spark, str(tmp_path / "l.txt"), strict=False).polygons.first()
    assert {tuple(p) for p in got["v"]} == {(7, 2), (-3, 2147483647), (1, -2147483648), (4, 4)}
    (tmp_path / "m.txt").write_text("L\n(0,0),(+-5,1),(1,1)\n")
    with pytest.raises(Exception, match="no 32-bit coordinate"):
        read_layout(spark, str(tmp_path / "m.txt")).polygons.collect()


def test_a_seed_on_an_area_stays_whole(spark, tmp_path):
    lines, metrics = run(spark, tmp_path, FA, rule("METAL1 (1,2)", "AA (1,1)", via=["AA METAL1"], gate="POLY AA"))
    assert lines == ["AA", AA, *HALVES, "METAL1", *M] and metrics["reachable"] == 5


def test_touching_areas_do_not_connect_with_a_gate(spark, tmp_path):
    layout = text(POLY=[box(100, 100, 101, 101)], AA=[box(0, 0, 4, 4), box(4, 0, 8, 4)], METAL1=[box(0, 0, 1, 1), box(7, 0, 8, 1)])
    seeds, via = ("POLY (100,100)", "METAL1 (0,0)"), ["AA METAL1"]
    assert run(spark, tmp_path, layout, rule(*seeds, via=via, gate="POLY AA"))[0] == ["AA", box(0, 0, 4, 4), "METAL1", box(0, 0, 1, 1)]
    (tmp_path / "b").mkdir()
    assert run(spark, tmp_path / "b", layout, rule(*seeds, via=via))[1]["reachable"] == 5


def test_phase_one_judges_an_area_when_it_is_first_touched(spark, tmp_path):
    layout = text(POLY=[box(0, 3, 8, 5), box(20, 0, 21, 8)], AA=[box(0, 0, 8, 8)], METAL1=[box(0, 0, 1, 4), box(7, 0, 21, 1)])
    rules = rule("METAL1 (0,0)", "METAL1 (0,0)", via=["AA METAL1", "METAL1 POLY"], gate="POLY AA")
    _, metrics = run(spark, tmp_path, layout, rules)
    assert (metrics["phase1_visited"], metrics["poly_high"], metrics["reachable"]) == (3, 1, 6)
    (tmp_path / "b").mkdir()
    assert run(spark, tmp_path / "b", layout, rules, phase1="fixpoint")[1]["poly_high"] == 2


@pytest.mark.parametrize("rules", [rule("POLY (5,0)", "NONE (1,2)", gate="POLY AA"), rule("POLY (5,0)", "METAL1 (50,50)", gate="POLY AA"), rule("POLY (5,0)", "METAL1 (1,2)", gate="POLY NONE")])
def test_unknown_names_give_nothing(spark, tmp_path, rules):
    assert run(spark, tmp_path, FA, rules)[0] == []
