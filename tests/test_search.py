"""Searches in one task and by rounds of joins give the same; joins on heavy keys give what plain joins do."""

import random

import pytest
from pyspark.sql import functions as F

from netweave.operators import components as K
from netweave.operators import skew
from netweave.operators.reach import reach_conditional, reach_frontier

FEW = pytest.mark.parametrize("few", [0, 1 << 20])


def pairs(spark, rows, names="u, v"):
    return spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in names.split(", ")))


@pytest.mark.parametrize("few, heavy", [(1 << 20, 4096), (0, 2)])
def test_components(spark, monkeypatch, few, heavy):
    monkeypatch.setattr(K, "FEW_EDGES", few)
    monkeypatch.setattr(skew, "HEAVY", heavy)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 108)] + [(7, i) for i in range(200, 212)] + [(rng.randrange(300, 320), rng.randrange(300, 320)) for _ in range(12)] + [(5, 5), (8, 6), (6, 8)]
    root = {n: n for e in edges for n in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["node"]: r["component"] for r in K.connected_components(pairs(spark, edges)).collect()}
    assert got == {n: find(n) for n in root}
    assert K.connected_components(pairs(spark, [])).count() == 0


@FEW
def test_frontier(spark, monkeypatch, few):
    monkeypatch.setattr(K, "FEW_EDGES", few)
    edges = [(1, 2), (2, 3), (1, 3), (3, 4), (9, 1), (4, 1)]
    got = {r["node"]: r["level"] for r in reach_frontier(pairs(spark, edges, "src, dst"), pairs(spark, [(1,), (50,)], "node")).collect()}
    assert got == {1: 0, 50: 0, 2: 1, 3: 1, 4: 2}
    assert reach_frontier(pairs(spark, [], "src, dst"), pairs(spark, [], "node")).count() == 0


@FEW
def test_conditional_edges_open_when_what_they_need_is_reached(spark, monkeypatch, few):
    monkeypatch.setattr(K, "FEW_EDGES", few)
    edges, gated = [(1, 2), (3, 4), (5, 6)], [(2, 3, 2), (4, 5, 6), (2, 7, 4), (7, 8, 99)]
    got = sorted(r["node"] for r in reach_conditional(pairs(spark, edges, "src, dst"), pairs(spark, gated, "src, dst, need"), 1).collect())
    assert got == [1, 2, 3, 4, 7]


@pytest.mark.parametrize("heavy", [4096, 3, 1])
def test_heavy_keys(spark, monkeypatch, heavy):
    monkeypatch.setattr(skew, "HEAVY", heavy)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 20 + [2] * 9 + [3, 3, 4, None])], "k long, i int")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").withColumn("x", F.col("k") * 10)
    got = sorted(tuple(r) for r in skew.join_counted(rows, keyed, "k", "n", 33).select("k", "i", "x").collect())
    assert got == sorted(tuple(r) for r in rows.join(keyed, "k").select("k", "i", "x").collect()) and len(got) == 31
    assert skew.join_counted(rows, keyed, "k", "n", 33, "left_semi", narrow=F.col("k") > 1).columns == ["k", "i"]
