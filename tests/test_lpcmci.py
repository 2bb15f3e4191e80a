import numpy as np

from tessera.plans import temporal


def test_links_that_four_conditions_separate_go(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(3000, 4))
    x, y = (z.sum(axis=1) + rng.normal(size=3000) for _ in range(2))
    rows = [(i, *map(float, r)) for i, r in enumerate(np.column_stack([z, x, y]))]
    df = spark.createDataFrame(rows, "t long, z1 double, z2 double, z3 double, z4 double, x double, y double").coalesce(1)
    g = temporal.lpcmci(df, "t", tau_max=1, alpha=0.001)
    assert not g.marks[0][4, 5] and g.marks[0][0, 4] and g.marks[0][0, 5]
    capped = temporal.lpcmci(df, "t", tau_max=1, alpha=0.001, max_p_global=3)
    assert capped.marks[0][4, 5]
