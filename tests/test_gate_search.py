"""The gate search over rows of transistors against a plain queue that knows boxes only."""

import pytest

from netweave.plans.derive import GATE, GATE_SEEDS, GATE_VIAS, gate_layout
from netweave.plans.trace import TraceOptions, trace
from netweave.sources.layout_text import Rule

ADJACENT = {0: [2, 1], 1: [0, 3], 2: [0], 3: [1]}  # in the order in which the via chains name them
POLY, AREA = 1, 2


def meet(a, b):
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def cut_lines(poly, area):
    """Upright, twice the place, span from and to (twice) of the lines that one poly makes."""
    x0, y0, x1, y1 = max(poly[0], area[0]), max(poly[1], area[1]), min(poly[2], area[2]), min(poly[3], area[3])
    if x0 >= x1 or y0 >= y1:
        return
    if (x0, x1) == (area[0], area[2]):
        yield True, x0 + x1, 2 * y0, 2 * y1
    if (y0, y1) == (area[1], area[3]):
        yield False, y0 + y1, 2 * x0, 2 * x1


def pieces_of(area, lines):
    upright, level = ({at for up, at, _, _ in lines if up == side} for side in (True, False))
    boxes = [area]
    for at in upright:
        boxes = [p for b in boxes for p in ((b[0], b[1], (at - at % 2) // 2, b[3]), ((at + at % 2) // 2, b[1], b[2], b[3]))]
    for at in level:
        boxes = [p for b in boxes for p in ((b[0], b[1], b[2], (at - at % 2) // 2), (b[0], (at + at % 2) // 2, b[2], b[3]))]
    return boxes


def joins(pieces, line):
    up, at, start, stop = line
    across, along = (0, 1) if up else (1, 0)
    for i, a in enumerate(pieces):
        for j, b in enumerate(pieces):
            low, high = max(2 * a[along], 2 * b[along], start), min(2 * a[along + 2], 2 * b[along + 2], stop)
            if 2 * a[across + 2] <= at <= 2 * b[across] and i != j and low < high:
                yield i, j
                yield j, i


class Chip:
    def __init__(self, rows):
        self.box = {(r["lid"], r["pid"]): (r["minx"], r["miny"], r["maxx"], r["maxy"]) for r in rows}
        self.layer = {lid: sorted(k for k in self.box if k[0] == lid) for lid in range(4)}
        self.pieces, self.pairs = {}, {}
        for area in self.layer[AREA]:
            lines = [(p, line) for p in self.layer[POLY] if meet(self.box[p], self.box[area]) for line in cut_lines(self.box[p], self.box[area])]
            self.pieces[area] = pieces_of(self.box[area], [line for _, line in lines])
            self.pairs[area] = {(p, i, j) for p, line in lines for i, j in joins(self.pieces[area], line)}

    def at(self, layer, point):
        return min(k for k in self.layer[layer] if meet(self.box[k], (*point, *point)))

    def queue(self, start, driven=None, follow=False):
        """Nodes in the order in which a queue takes them in. Without ``driven`` an area is judged when it is first touched."""
        order, place, conducts = [start], {start: 0}, {}

        def take(node):
            if node not in place:
                place[node] = len(order)
                order.append(node)
                return True
            return False

        for now, node in enumerate(order):
            box = self.pieces[node[:2]][node[2]] if len(node) == 3 else self.box[node]
            if len(node) == 2:
                for other in self.layer[node[0]]:
                    if meet(box, self.box[other]):
                        take(other)
            for layer in ADJACENT[node[0]]:
                for other in self.layer[layer]:
                    if not meet(box, self.box[other]):
                        continue
                    if layer != AREA:
                        take(other)
                        continue
                    if other not in conducts:
                        high = driven if driven is not None else {p for p in self.layer[POLY] if place.get(p, now + 1) <= now}
                        conducts[other] = sorted({(i, j) for p, i, j in self.pairs[other] if p in high})
                    for i, piece in enumerate(self.pieces[other]):
                        if meet(box, piece) and take((*other, i)):
                            todo = [i]
                            for a in todo:
                                for x, j in conducts[other]:
                                    if x == a and take((*other, j)) and follow:
                                        todo.append(j)
        return order

    def fixpoint(self, start):
        high = set()
        while True:
            now = {n for n in self.queue(start, high, True) if n[0] == POLY}
            if now == high:
                return high
            high = now


@pytest.mark.parametrize("flood, phase1", [("one_hop", "reference_order"), ("fixpoint", "fixpoint")])
def test_gate_search_is_that_of_a_queue(spark, sf_dir, flood, phase1):
    layout = gate_layout(spark, sf_dir)
    chip = Chip(layout.polygons.collect())
    starts = [chip.at(int(layer[1:]), (x, y)) for layer, x, y in GATE_SEEDS]
    high = chip.fixpoint(starts[0]) if phase1 == "fixpoint" else {n for n in chip.queue(starts[0], follow=flood == "fixpoint") if n[0] == POLY}
    want = chip.queue(starts[1], high, flood == "fixpoint")
    got = trace(spark, layout, Rule(GATE_SEEDS, GATE_VIAS, GATE), TraceOptions(gate_flood=flood, phase1=phase1))
    assert {(r["poly"] >> 32, r["poly"] & 0xFFFFFFFF) for r in got.high.collect()} == high
    rows = got.found.collect()
    assert sorted((r["gid"] >> 32, r["gid"] & 0xFFFFFFFF) for r in rows if r["gid"] < 1 << 62) == sorted(n for n in want if len(n) == 2)
    pieces = [(AREA, (r["gid"] - (1 << 62)) >> 24, r["gid"] & 0xFFFFFF) for r in sorted(rows, key=lambda r: r["ord"]) if r["gid"] >= 1 << 62]
    in_order = [n for n in want if len(n) == 3]
    assert pieces == in_order if flood == "one_hop" else sorted(pieces) == sorted(in_order)
    for r in rows:
        if r["gid"] >= 1 << 62:
            x0, y0, x1, y1 = chip.pieces[AREA, (r["gid"] - (1 << 62)) >> 24][r["gid"] & 0xFFFFFF]
            assert {tuple(p) for p in r["v"]} == {(x0, y0), (x1, y0), (x1, y1), (x0, y1)}
    m = got.metrics.first()
    assert (m["poly_high"], m["pieces_visited"], m["reachable"]) == (len(high), len(pieces), len(rows))


def test_the_modes_differ_on_this_layout(spark, sf_dir):
    chip = Chip(gate_layout(spark, sf_dir).polygons.collect())
    starts = [chip.at(int(layer[1:]), (x, y)) for layer, x, y in GATE_SEEDS]
    late, high = {n for n in chip.queue(starts[0]) if n[0] == POLY}, chip.fixpoint(starts[0])
    sizes = [len(chip.queue(starts[1], h, follow)) for h in (late, high) for follow in (False, True)]
    assert len(late) < len(high) and len(set(sizes)) >= 3 and min(sizes) > 30
