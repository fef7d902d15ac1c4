import pytest

from strandgraph.__main__ import run

from .conftest import TOY


def lines(capsys):
    return [x.split("\t") for x in capsys.readouterr().out.strip().split("\n")]


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "e.txt").write_text("# toy\n" + "\n".join(f"{s * 10} {t * 10}" for s, t in TOY))
    path = lambda name: str(tmp_path / name)
    run(spark, ["renumber", path("e.txt"), path("r")])
    run(spark, ["compress", path("r"), path("c"), "--variant", "final", "--ws", "2", "--code", "residuals=zeta3"])
    out = lines(capsys)
    assert out[0][:2] == ["max_id", "links"] and out[1][:2] == ["10", "20"]
    run(spark, ["report", path("c")])
    assert lines(capsys) == out
    run(spark, ["bfs", path("c"), "1", "0", "--print"])
    out = lines(capsys)
    assert [x[0] for x in out[1:12]] == ["1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "0"] and out[13] == ["1", "11"]
    assert out[-1] == ["0", "1"]
    run(spark, ["pagerank", path("c"), "3", "0.15", "2", "4"])
    out = lines(capsys)
    assert [x[0] for x in out[1:3]] == ["2", "4"] and len(out) == 4


def test_bad_arguments(spark):
    with pytest.raises(SystemExit):
        run(spark, ["compress", "a"])
