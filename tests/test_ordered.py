import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import moments as mm
from tessera.operators import ordered, profile
from tessera.operators.ci import make_test
from tessera.plans import resample, temporal


def numbers(spark, n=500, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(int(i), float(np.round(x, 1)), f"s{i % 3}") for i, x in enumerate(rng.normal(size=n))], "t long, x double, g string").repartition(5)


def test_average_ranks(spark):
    df = numbers(spark).unionByName(spark.createDataFrame([(9999, None, "s0")], "t long, x double, g string"))
    x = np.array([r["x"] for r in df.collect() if r["x"] is not None])
    for r in ordered.average_ranks(df, "x").collect():
        assert r["n"] == (x == r["value"]).sum() and r["rank"] == (x < r["value"]).sum() + (r["n"] + 1) / 2


def test_normal_scores_of_missing_and_tied_values(spark, monkeypatch):
    df = numbers(spark, 60).select("t", "x", F.when(F.col("t") % 4 > 0, F.col("x") * 2).alias("y"))
    wide = [sorted((r["x"], r["y"] is None, r["y"] or 0.0) for r in profile.normal_scores(df, ["x", "y"]).collect())]
    monkeypatch.setattr(profile, "MOST_RANKS", 3)
    wide.append(sorted((r["x"], r["y"] is None, r["y"] or 0.0) for r in profile.normal_scores(df, ["x", "y"]).collect()))
    assert np.allclose(np.array(wide[0], float), np.array(wide[1], float)) and len(wide[0]) == 60
    assert sum(m for _, m, _ in wide[0]) == 15


@pytest.mark.parametrize("n", [1, 2, 300])
def test_adjusted_p_values_equal_those_of_an_array(spark, n):
    p = np.random.default_rng(n).random(n).round(2) / 7
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, p double").repartition(4)
    got = {r["i"]: r["q"] for r in ordered.benjamini_hochberg(df, "p", "q").collect()}
    assert np.allclose([got[i] for i in range(n)], temporal.benjamini_hochberg(p))
    m, z = ordered.anderson_darling(df, "p")
    assert m == n and np.isclose(z, resample.anderson_darling(p)[0])


def lags_of(rows, lags, need):
    """Brute force: (series, t, x, x at the lags)."""
    out = []
    by: dict = {}
    for t, x, g in sorted(rows):
        by.setdefault(g, []).append((t, x))
    for g, s in by.items():
        out += [(g, t, x, *(s[i - k][1] for k in range(1, lags + 1))) for i, (t, x) in enumerate(s) if i >= need]
    return sorted(out)


@pytest.mark.parametrize(("series", "lags", "first", "parts"), [(None, 2, 0, 7), ("g", 2, 0, 7), ("g", 3, 5, 40), (None, 40, 0, 40), ("g", 1, 0, 1)])
def test_lags_across_ranges(spark, series, lags, first, parts):
    df = numbers(spark, 150, 2)
    rows = [(r["t"], r["x"], r["g"] if series else "all") for r in df.collect()]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = mm.lagged(df, ["x"], "t", lags, series, first)
        got = sorted(((r[series] if series else "all"), r["t"], r["x"], *(r[f"x__{k}"] for k in range(1, lags + 1))) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == lags_of(rows, lags, max(lags, first))


def test_lags_of_an_empty_and_a_short_series(spark):
    df = numbers(spark, 3)
    assert mm.lagged(df.where("t < 0"), ["x"], "t", 2).count() == 0
    assert mm.lagged(df, ["x"], "t", 3).count() == 0 and mm.lagged(df, ["x"], "t", 2).count() == 1


@pytest.mark.parametrize("kind", ["boolean", "double", "date", "decimal(10,3)", "string", "int"])
def test_categories_of_any_type(spark, kind):
    values = {"boolean": [False, True], "double": [1e-5, 0.1, 1e22], "date": ["2024-01-02", "2023-12-31"], "decimal(10,3)": ["1.500", "-2.250"], "string": ["b", "a", "é"], "int": [10, 9, -1]}[kind]
    rows = [(i, None if i % 7 == 6 else str(values[i % len(values)])) for i in range(70)]
    df = spark.createDataFrame(rows, "i int, v string").withColumn("v", F.col("v").cast(kind)).cache()
    coded, levels = profile.encoded(df, ["v"])
    real = {r["i"]: r["v"] for r in df.collect()}
    assert levels["v"] == sorted({v for v in real.values() if v is not None})
    for r in coded.collect():
        assert r["v"] == (None if real[r["i"]] is None else levels["v"].index(real[r["i"]]))


def test_many_categories_are_joined_and_too_many_refused(spark):
    df = spark.range(300).select(F.concat(F.lit("v"), F.col("id") % 100).alias("v"), (F.col("id") % 2 == 0).alias("w"))
    coded, levels = profile.encoded(df, ["v", "w"])
    assert coded.columns == ["v", "w"] and sorted(r["v"] for r in coded.collect()) == sorted(levels["v"].index(f"v{i % 100}") for i in range(300))
    with pytest.raises(profile.DataError, match="in v$"):
        profile.encoded(df, ["v", "w"], most=50)


def test_booleans_that_agree_are_dependent(spark):
    df = spark.range(400).select((F.col("id") % 2 == 0).alias("a"), ((F.col("id") % 2 == 0) != (F.col("id") % 10 == 0)).alias("b"))
    assert make_test(df, "gsq").pvalue(0, 1) < 1e-10


def test_half_samples_of_repeated_rows_are_binomial(spark):
    """12,000 rows of 12 distinct values: each row is drawn for itself."""
    df = spark.range(12_000).select((F.col("id") % 12).cast("double").alias("x"), (F.col("id") % 4 * 2).cast("double").alias("y")).repartition(6)
    n = np.array([m.n for m in resample.resampled_moments(df, ["x", "y"], 40)])
    assert abs(n.mean() - 6000) < 4 * np.sqrt(3000 / 40) and 20 < n.std() < 100
    poisson = resample.resampled_moments(df, ["x", "y"], 40, resampling="bootstrap")
    assert abs(np.mean([m.n for m in poisson]) - 12_000) < 4 * np.sqrt(12_000 / 40)
    whole = mm.moments(df, ["x", "y"])
    assert np.allclose(np.mean([m.cov for m in poisson], axis=0), whole.cov, rtol=0.02)
    assert [m.n for m in resample.resampled_moments(df, ["x", "y"], 3)] == [m.n for m in resample.resampled_moments(df, ["x", "y"], 3)]
    rows = [resample.resample_rows(df, b).count() for b in range(3)]
    assert all(abs(k - 6000) < 300 for k in rows) and len(set(rows)) > 1


def test_resampled_cells_and_blocks(spark):
    from tessera.operators.cells import cells

    df = spark.range(4000).select((F.col("id") % 2 == 0).alias("a"), (F.col("id") % 3).cast("string").alias("b"), "id")
    drawn = resample.resampled_cells(cells(df, ["a", "b"]), 30)
    n = np.array([c.n for c in drawn])
    assert abs(n.mean() - 2000) < 30 and 15 < n.std() < 70
    kept = {r["id"] for r in resample.resample_rows(df, 1, order="id", block=10).collect()}
    assert all(len({i in kept for i in range(k, k + 10)}) == 1 for k in range(0, 4000, 10)) and 1000 < len(kept) < 3000
    units = {r["b"] for r in resample.resample_rows(df, 3, unit="b").collect()}
    assert all(df.where(F.col("b") == u).count() == resample.resample_rows(df, 3, unit="b").where(F.col("b") == u).count() for u in units)


def test_anderson_darling_of_one_value():
    for u in (0.5, 0.01, 0.97):
        z, p = resample.anderson_darling([u])
        assert np.isclose(p, 2 * min(u, 1 - u)) and np.isclose(z, -1 - np.log(u) - np.log1p(-u))
    assert resample.anderson_darling([0.0, 1e-200])[0] > resample.anderson_darling([1e-12, 1e-12])[0]


def test_ancestors_of_a_long_chain(spark):
    from tessera.operators.graphs import ancestors

    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    assert ancestors(chain).count() == 5050
    ring = spark.createDataFrame([(i, (i + 1) % 5) for i in range(5)], "a long, b long")
    assert ancestors(ring).count() == 25 and ancestors(chain.where("a < 0")).count() == 0


def test_cells_by_query_equal_joint_ones(spark, monkeypatch):
    from tessera.operators import cells as module
    from tessera.operators.ci import ChiSquare
    from tessera.operators.scores import BDeu
    from tessera.sources import generate

    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, k, 800) for k in (2, 3, 2, 3, 2)])
    df = generate.frame(spark, x).select(*(F.col(f"X{j}").cast("string").alias(f"X{j}") for j in range(5)))
    whole = module.cells(df, df.columns)
    monkeypatch.setattr(module, "MOST", 20)
    part = module.cells(df, df.columns)
    assert isinstance(part, module.TableCells) and part.n == whole.n == 800
    queries = [(0, 1, ()), (1, 3, (0,)), (2, 4, (0,)), (3, 4, ())]
    for g in (False, True):
        assert np.allclose(ChiSquare(part, g).many(queries), ChiSquare(whole, g).many(queries))
    assert np.allclose(ChiSquare(part).pvalues_given(0, [2, 4], (1,)), ChiSquare(whole).pvalues_given(0, [2, 4], (1,)))
    assert np.isclose(BDeu(part).local(1, [0, 2]), BDeu(whole).local(1, [0, 2]))
    with pytest.raises(profile.DataError, match="X0, X1, X2, X3"):
        part.table(1, 3, [0, 2])
