import numpy as np

from tessera.operators.moments import moments
from tessera.streaming import moments as running


def test_running_moments_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    for k in range(3):
        spark.createDataFrame(rng.standard_normal((50, 2)).tolist(), "a double, b double").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    source = spark.readStream.schema("a double, b double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = running.accumulate(source, ["a", "b"], str(tmp_path / "sums"), str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = running.current(spark, ["a", "b"], str(tmp_path / "sums"))
    want = moments(spark.read.parquet(str(tmp_path / "in" / "*")), ["a", "b"])
    assert got.n == want.n == 150
    assert np.allclose(got.cov, want.cov)
