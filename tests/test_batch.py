from netweave.__main__ import main
from netweave.plans.batch import run_cases


def test_cases_are_compared_whatever_vertex_a_ring_begins_with(spark, tmp_path):
    for d in ("rules", "layouts", "answers"):
        (tmp_path / d).mkdir()
    for name in ("a", "b", "c"):
        (tmp_path / "rules" / f"{name}.txt").write_text("StartPos\nL (1,1)\n")
        (tmp_path / "layouts" / f"{name}.txt").write_text("L\n(0,0),(2,0),(2,2),(0,2)\n(9,9),(8,9),(8,8)\n")
    (tmp_path / "answers" / "a.txt").write_text("L\n(2,2),(0,2),(0,0),(2,0)\n")
    (tmp_path / "answers" / "b.txt").write_text("L\n(2,2),(0,2),(0,0),(3,0)\n")
    got = run_cases(spark, *(str(tmp_path / d) for d in ("rules", "layouts", "answers", "out")))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, True), ("b", 1, False), ("c", 1, None)]


def test_missing_paths_give_the_usage(capsys):
    assert main(["-layout", "x", "-unknown", "y"]) == 1
    assert "usage" in capsys.readouterr().err
