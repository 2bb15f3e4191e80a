import numpy as np
import pytest

from tessera.operators.profile import DataError
from tessera.sources.tables import parse_bif, read_panel, read_table

BIF = """network unknown {}
variable rain { type discrete [ 2 ] { yes, no }; }
variable wet { type discrete [ 2 ] { yes, no }; }
probability ( rain ) { table 0.2, 0.8; }
probability ( wet | rain ) { (yes) 0.9, 0.1; (no) 0.1, 0.9; }
"""


@pytest.mark.parametrize(("name", "text"), [("a.csv", "x,y\n1,2\nNA,3\n"), ("a.tsv", "x\ty\n1\t2\n\t3\n"), ("a.txt", "x y\n1 2\nNA 3\n")])
def test_text_tables(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    df = read_table(spark, str(tmp_path / name))
    assert df.dtypes == [("x", "double"), ("y", "double")]
    assert sorted(map(tuple, df.collect()), key=lambda r: r[1]) == [(1.0, 2.0), (None, 3.0)]


def test_headless_and_mixed_first_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2\n3,4\n")
    assert read_table(spark, str(tmp_path / "a.csv")).columns == ["X0", "X1"]
    (tmp_path / "b.csv").write_text("x,2\n3,4\n")
    with pytest.raises(DataError, match="mixes"):
        read_table(spark, str(tmp_path / "b.csv"))


def test_arrays_and_panels(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(3, 2))
    assert read_table(spark, str(tmp_path / "a.npy")).count() == 3
    assert read_panel(spark, [str(tmp_path / "a.npy")] * 2).groupBy("dataset_id").count().count() == 2


def test_networks():
    n = parse_bif(BIF)
    assert n.parents == {"rain": [], "wet": ["rain"]}
    assert n.graph().oriented_edges() == [("rain", "wet", "directed")]
    x = n.sample(4000, seed=1)
    assert abs((x.rain == "yes").mean() - 0.2) < 0.03
    assert abs((x[x.rain == "yes"].wet == "yes").mean() - 0.9) < 0.05
