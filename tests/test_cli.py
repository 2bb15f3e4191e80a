import json

import pytest

from tessera.cli import METHODS, main
from tessera.sources import generate


def test_a_method_runs_on_a_file(spark, tmp_path, capsys):
    import numpy as np

    w = np.zeros((3, 3))
    w[0, 2] = w[1, 2] = 1.0
    generate.frame(spark, generate.linear(w, 800, seed=1), "abc").write.parquet(str(tmp_path / "t.parquet"))
    assert main(["pc", str(tmp_path / "t.parquet"), "alpha=0.01", "--out", str(tmp_path / "g")]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["edges"] == [["a", "c", "directed"], ["b", "c", "directed"]]
    assert main(["ges", str(tmp_path / "t.parquet"), "--graph", "dot"]) == 0
    assert "digraph" in capsys.readouterr().out


@pytest.mark.parametrize("args", [[], ["nothing", "x"], ["pc", "x", "bogus=1"]])
def test_wrong_calls(args, capsys):
    assert main(args) == 2
    assert "pc" in capsys.readouterr().out and len(METHODS) > 40


@pytest.fixture
def collider(spark, tmp_path):
    import numpy as np

    w = np.zeros((3, 3))
    w[0, 2] = w[1, 2] = 1.0
    generate.frame(spark, generate.linear(w, 800, seed=1), "abc").write.parquet(str(tmp_path / "t.parquet"))
    return str(tmp_path / "t.parquet")


def test_bootstrap_and_markov_check(spark, collider, tmp_path, capsys):
    assert main(["bootstrap", "pc", collider, "n_resamples=6", "alpha=0.001"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["n_resamples"] == 6 and ["a", "c", "directed"] in out["average"]
    assert main(["pc", collider, "--out", str(tmp_path / "g")]) == 0
    capsys.readouterr()
    assert main(["markov-check", str(tmp_path / "g"), collider]) == 0
    assert json.loads(capsys.readouterr().out)["n_tests"] == 1


def test_config_file_then_options(spark, collider, tmp_path, capsys):
    (tmp_path / "c.yaml").write_text("# a test\nalpha: 0.01\nindep_test: student_t  # by t\n")
    assert main(["run", "pc", collider, "alpha=0.02", "--config", str(tmp_path / "c.yaml"), "--limit", "1"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["options"] == {"alpha": 0.02, "indep_test": "student_t"} and out["n_edges"] == 2 and len(out["edges"]) == 1
    (tmp_path / "bad.yaml").write_text("alhpa: 0.01\n")
    assert main(["run", "pc", collider, "--config", str(tmp_path / "bad.yaml")]) == 2
    assert "alhpa" in capsys.readouterr().out


def test_lists_and_settings(spark, capsys):
    assert main(["list", "--json"]) == 0
    assert set(json.loads(capsys.readouterr().out)) == set(METHODS)
    assert main(["schema", "pc"]) == 0
    assert json.loads(capsys.readouterr().out)["pc"]["options"]["alpha"] == {"required": False, "default": 0.05}
    assert main(["config"]) == 0 and "spark.master" in capsys.readouterr().out
    assert main(["calibrate"]) == 0 and json.loads(capsys.readouterr().out)["cells"] > 0
    assert main(["schema", "nothing"]) == 2
