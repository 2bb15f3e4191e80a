import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import inputs, metrics, ordered
from tessera.operators.ci import ChiSquare, RCoT, RCoTTable, bounded_rows
from tessera.operators.cells import cells
from tessera.operators.moments import moments, of_matrix
from tessera.operators.profile import DataError
from tessera.plans import constraint, functional, lingam, orient
from tessera.plans.graph import Graph, TemporalGraph
from tessera.plans.knowledge import Knowledge, resolve_lagged
from tessera.sources import generate, tables


def test_categories_must_be_whole(spark):
    df = spark.createDataFrame([(1.0, 0.5, "a"), (2.0, 1.0, "b")], "x double, y double, z string")
    inputs.check_categories(df, ["x", "z"])
    with pytest.raises(DataError, match="y$"):
        inputs.check_categories(df, ["x", "y", "z"])
    assert inputs.settings(df, categorical=["x"]) == (["x", "y"], ["x"], "mixed")


def test_environments_need_rows_and_variation(spark):
    df = spark.createDataFrame([("a", float(i), 1.0 * (i % 2)) for i in range(6)] + [("b", 3.0, float(i)) for i in range(3)], "e string, x double, y double")
    assert inputs.check_environments(df, "e", ["y"]) == {"a": 6, "b": 3}
    with pytest.raises(DataError, match="x in b"):
        inputs.check_environments(df, "e", ["x", "y"])
    with pytest.raises(DataError, match="b \\(3\\)"):
        inputs.check_environments(df, "e", ["y"], min_rows=4)
    with pytest.raises(DataError, match="two environments"):
        inputs.check_environments(df.where("e = 'a'"), "e", ["y"])
    assert inputs.take_columns(df, ["e"], "environment") == ["x", "y"]
    with pytest.raises(DataError):
        inputs.take_columns(df, ["g"], "environment")


def test_copies_and_sums_are_refused():
    x = np.random.default_rng(0).normal(size=(200, 3))
    inputs.check_columns(of_matrix(x, "abc"))
    copies = of_matrix(np.column_stack([x, 3 - 2 * x[:, 1], x[:, 1] / 7]), "abcde")
    assert inputs.copy_groups(copies) == [["b", "d", "e"]]
    with pytest.raises(DataError, match="b, d, e"):
        inputs.check_columns(copies)
    with pytest.raises(DataError, match="a, b, d"):
        inputs.check_columns(of_matrix(np.column_stack([x, x[:, 0] + x[:, 1]]), "abcd"))


def test_warnings_come_once_and_seeds_resolve(spark):
    with pytest.warns(inputs.SizeWarning):
        inputs.warn_past_boundary("exact_search", 21)
    assert not inputs.warn_once("again", key="exact_search", category=inputs.SizeWarning)
    assert inputs.past_boundary("pc", 5) is None and inputs.select_engine(10, 10) == "driver" and inputs.select_engine(10**9, 10) == "spark"
    assert inputs.resolve_seed(spark) == 0 and inputs.resolve_seed(spark, 5) == 5
    spark.conf.set("tessera.seed", "7")
    assert inputs.resolve_seed(spark) == 7
    spark.conf.unset("tessera.seed")


def dags(d):
    """All directed acyclic graphs of d nodes."""
    from itertools import product

    from tessera.plans.graph import has_cycle

    pairs = [(i, j) for i in range(d) for j in range(i)]
    for marks in product((0, 1, 2), repeat=len(pairs)):
        a = np.zeros((d, d), bool)
        for (i, j), k in zip(pairs, marks, strict=True):
            if k:
                a[(i, j) if k == 1 else (j, i)] = True
        if not has_cycle(a):
            yield a


def test_admits_and_ancestors_by_all_members():
    """Against the members of each class of four nodes: which admit an edge, and which pairs are ancestors in all."""
    from tessera.plans.graph import reach

    by: dict = {}
    for a in dags(4):
        by.setdefault(orient.dag_to_cpdag(a).tobytes(), []).append(a)
    rng = np.random.default_rng(0)
    keys = sorted(by)
    for key in (keys[k] for k in rng.permutation(len(keys))[:40]):
        members = by[key]
        m = np.frombuffer(key, np.int8).reshape(4, 4)
        for x in range(4):
            for y in range(4):
                if x != y:
                    assert orient.surely_ancestor(m, x, y) == all(y in reach([x], a) for a in members)
                    k = Knowledge(required=((f"X{x}", f"X{y}"),)).resolve([f"X{v}" for v in range(4)])
                    assert orient.admits(m, k) == any(a[x, y] for a in members)
                    k = Knowledge(forbidden=((f"X{x}", f"X{y}"),)).resolve([f"X{v}" for v in range(4)])
                    assert orient.admits(m, k) == any(not a[x, y] for a in members)


def test_rules_in_column_order_agree_where_nothing_conflicts():
    for a in list(dags(4))[::7]:
        m = orient.dag_to_cpdag(a)
        assert (orient.meek_in_order(m) == m).all()
        start = np.where(a | a.T, 1, 0).astype(np.int8)
        i, j = np.argwhere(a)[0] if a.any() else (0, 0)
        if a.any():
            orient.arrow(start, i, j)
            ours = orient.meek_in_order(start, rule4=True)
            assert (orient.directed(ours) | orient.lines(ours)).any()


def test_ancestral_knowledge_orients(spark):
    line = np.zeros((3, 3), np.int8)
    line[0, 1] = line[1, 0] = line[1, 2] = line[2, 1] = 1
    m = orient.restricted_to_ancestors(line, [(0, 2)], [])
    assert orient.directed(m)[0, 1] and orient.directed(m)[1, 2]
    m = orient.restricted_to_ancestors(line, [], [(0, 1)])
    assert orient.directed(m)[1, 0]


def test_lagged_knowledge():
    k = Knowledge(required=(("a", "b", 1),), forbidden=(("b", "a"), ("a", "a", 2)), tiers=(("a",), ("b",)))
    c = resolve_lagged(k, ["a", "b"], 2)
    assert c.required[1, 0, 1] and not c.required[2].any() and c.forbidden[:, 1, 0].all() and c.forbidden[2, 0, 0] and not c.forbidden[1, 0, 0]
    assert (1, 0, 0) in c.banned() and not c.allows(1, 0, 0) and c.allows(0, 1, 2)
    assert not resolve_lagged(None, ["a"], 1).forbidden.any()
    for bad in (Knowledge(forbidden=(("a", "z"),)), Knowledge(forbidden=(("a", "b", 5),)), Knowledge(required=(("a", "b", 1),), forbidden=(("a", "b"),))):
        with pytest.raises(ValueError):
            resolve_lagged(bad, ["a", "b"], 2)


def test_more_metrics():
    hidden = Graph.from_edges([(4, 0, 1, 2), (4, 1, 1, 2), (5, 2, 1, 2), (5, 3, 1, 2)], 6, "dag", list("abcdLM"))
    hidden = Graph(hidden.marks, "dag", hidden.labels, frozenset({4, 5}))
    other = Graph(Graph.from_edges([(4, 0, 1, 2), (4, 1, 1, 2), (4, 2, 1, 2), (4, 3, 1, 2)], 6, "dag", list("abcdLM")).marks, "dag", list("abcdLM"), frozenset({4, 5}))
    assert metrics.latent_cluster_ari(hidden, hidden) == 1.0 and metrics.latent_cluster_ari(other, hidden) < 1
    a = Graph.from_edges([(0, 1, 2, 2), (1, 2, 1, 2)], 3, "mag")
    b = Graph.from_edges([(0, 1, 2, 2), (0, 2, 2, 2)], 3, "mag")
    assert metrics.confounder_pair_scores(a, b) == {"precision": 1.0, "recall": 0.5, "f1": 2 / 3}
    assert metrics.decision_rate([1, 0, -1, 1], [1, 2, 1, 0]) == 0.5 and metrics.pairwise_accuracy([1, 0, -1], [1, 1, 1]) == 0.5
    assert metrics.score(a, b)["confounders"]["recall"] == 0.5 and metrics.score(hidden, hidden)["latent_cluster_ari"] == 1.0
    t = TemporalGraph(np.array([[[0, 0], [0, 0]], [[0, 1], [0, 0]]], np.int8), ("x", "y"))
    assert metrics.score(t, t) == {"shd": 0, "lagged": {"precision": 1.0, "recall": 1.0, "f1": 1.0}}


def test_interop(spark, tmp_path):
    g = Graph.of_dag(np.array([[0, 1, 0], [0, 0, 1], [0, 0, 0]]), list("abc"))
    assert tables.from_marks(g.marks, labels=g.labels).kind == "dag"
    for bad in (np.ones((2, 3)), np.full((2, 2), 5), np.array([[1, 0], [0, 0]]), np.array([[0, 1], [0, 0]])):
        with pytest.raises(ValueError):
            tables.from_marks(bad)
    values, i, j = tables.to_coo(g)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 1), (1, 2)] and values.tolist() == [1.0, 1.0]
    assert tables.to_csr(g)[2].tolist() == [0, 1, 2, 2]
    tables.save_npz(g, str(tmp_path / "g.npz"))
    again = tables.load_npz(str(tmp_path / "g.npz"))
    assert (again.marks == g.marks).all() and again.labels == g.labels and again.kind == "dag"

    class Edges(list):
        def __call__(self, data=False):
            return [(u, v, {}) for u, v in self]

    class Net:
        nodes, edges = ["a", "b", "c"], Edges([("a", "b"), ("b", "c"), ("c", "b")])

        def is_directed(self):
            return True

    assert tables.from_networkx(Net()).oriented_edges() == [("a", "b", "directed"), ("b", "c", "undirected")]
    assert tables.truncated({"edges": [1, 2, 3]}, 2) == ({"edges": [1, 2], "n_edges": 3}, True)


def test_datasets_of_a_folder(spark, tmp_path):
    (tmp_path / "net.bif").write_text("variable a { type discrete [ 2 ] { y, n }; }\nvariable b { type discrete [ 2 ] { y, n }; }\nprobability ( a ) { table 0.3, 0.7; }\nprobability ( b | a ) { (y) 0.9, 0.1; (n) 0.2, 0.8; }\n")
    df, g = tables.load_dataset(spark, "net", str(tmp_path), n=50)
    assert df.count() == 50 and g.oriented_edges() == [("a", "b", "directed")]
    with pytest.raises(DataError):
        tables.load_dataset(spark, "none", str(tmp_path))


def test_generators():
    a = generate.random_dag(8, 3.0, seed=1, kind="sw")
    for kind in ("er", "sf", "sw", "hub"):
        from tessera.plans.graph import has_cycle

        assert not has_cycle(generate.random_dag(8, 3.0, seed=1, kind=kind))
    for model in ("location_scale", "post_nonlinear", "non_monotone", "random_features"):
        x = generate.curved(a, 200, model=model, seed=2)
        assert np.isfinite(x).all() and x.shape == (200, 8)
    w = np.zeros((3, 3))
    w[0, 1] = w[1, 2] = 2.0
    hard = generate.intervened(w, 500, {1: {"value": 3.0}}, seed=1)
    assert (hard[:, 1] == 3.0).all() and abs(np.corrcoef(hard[:, 0], hard[:, 2])[0, 1]) < 0.15
    soft = generate.intervened(w, 500, {1: {"shift": 5.0}}, seed=1)
    assert abs(soft[:, 1].mean() - 5) < 0.5 and np.corrcoef(soft[:, 0], soft[:, 1])[0, 1] > 0.8
    x = generate.linear(w, 400, seed=3)
    for how in ("mcar", "mar", "mnar", "self"):
        gone = np.isnan(generate.missing_by(x, 0.2, how, seed=1))
        assert 0.1 < gone[:, 2].mean() < 0.3 and (how == "mar") == (not gone[:, 0].any())
    assert np.corrcoef(generate.measured(x, [2])[:, 2], x[:, 2])[0, 1] > 0.8
    g = Graph.of_dag(w != 0)
    assert generate.marginal(g, ["X1"]).oriented_edges() == [("X0", "X2", "directed")] and generate.marginal(g, ["X1"], "pag").kind == "pag"
    m = generate.mixed(a, [v % 2 == 0 for v in range(8)], 300, seed=4)
    assert all(len(np.unique(m[:, v])) <= 3 for v in range(0, 8, 2)) and len(np.unique(m[:, 1])) == 300
    rows, weights = generate.context_series(3, 2, datasets=4, steps=30)
    assert len(rows) == 120 and weights.shape == (3, 5, 5) and (rows.groupby("dataset").C0.nunique() == 1).all()


def test_report(spark):
    w = np.zeros((3, 3))
    w[0, 1] = w[1, 2] = 1.5
    r = generate.report(generate.frame(spark, generate.linear(w, 500, seed=1)), ["X0", "X1", "X2"], w)
    assert r["varsortability"] == 1.0 and r["edges"] == 2 and 0.5 < r["faithfulness_margin"] < 1


def test_rises_and_falls(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 3.0), (3, 2.0)], "t int, x double")
    assert [tuple(r) for r in ordered.row_pattern(df, ["x"], "t").orderBy("t").collect()] == [(1, 1), (2, 0), (3, -1)]


def test_one_target_against_many_candidates(spark):
    df = generate.frame(spark, generate.categorical(generate.random_dag(5, 2.0, seed=2), [2, 3, 2, 3, 2], 500, seed=3)).select(*(F.col(f"X{j}").cast("string").alias(f"X{j}") for j in range(5)))
    for g in (False, True):
        test = ChiSquare(cells(df, df.columns), g)
        for s in ((), (4,), (3, 4)):
            assert np.allclose(test.pvalues_given(1, [0, 2], s), [test.pvalue(1, v, s) for v in (0, 2)])


def test_random_features_of_a_table_and_of_its_rows(spark):
    """The whole table's test equals the test of all its rows, but for the sums' order and the widths' rows."""
    rng = np.random.default_rng(1)
    z = rng.normal(size=1200)
    df = generate.frame(spark, np.column_stack([z + 0.5 * rng.normal(size=1200), np.sin(2 * z) + 0.5 * rng.normal(size=1200), z, rng.normal(size=1200)]), "xyzw").repartition(3)
    table = RCoTTable(df, list("xyzw"), width_rows=5000)
    rows = RCoT(bounded_rows(df, list("xyzw"), 5000), list("xyzw"))
    queries = [(0, 1, ()), (0, 1, (2,)), (0, 3, ()), (0, 3, (1, 2))]
    p = table.many(queries)
    assert p[0] < 1e-6 and (p[1:] > 0.01).all()
    import tessera.operators.ci as ci

    width = ci.median_width
    ci.median_width = lambda x, rows=100: width(x, None)
    try:
        want = [rows.pvalue(*q) for q in queries]
    finally:
        ci.median_width = width
    assert np.allclose(p, want, atol=1e-3)


def test_additive_fits_of_a_table_and_of_its_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, 1500)
    df = generate.frame(spark, np.column_stack([x, np.sin(2 * x) + 0.3 * rng.normal(size=1500), rng.normal(size=1500)])).repartition(3)
    table = functional.AdditiveTable(df, df.columns)
    assert table.variance(1, [0]) < 0.35 < 0.9 < table.variance(1, [2])
    assert table.pvalue(1, [0, 2], 0) < 1e-10 and table.pvalue(1, [0, 2], 2) > 1e-3
    picks = functional.boosting_counts(table, 1, [0, 2])
    assert picks[0] > picks[2] and picks[1] == 0
    g = functional.cam(df)
    assert g.directed[0, 1] and g.meta["rows"] == 1500 and not g.marks[2].any()


def test_independent_components_of_a_table(spark):
    rng = np.random.default_rng(0)
    s = rng.uniform(-1, 1, (3000, 3))
    mix = np.array([[1, 0.5, 0], [0, 1, 0.3], [0.2, 0, 1]])
    df = generate.frame(spark, s @ mix.T).repartition(4)
    w = lingam.fast_ica_table(df, df.columns, start_rows=500)
    p = np.abs(w @ mix)
    p = p / p.max(axis=1, keepdims=True)
    assert (np.sort(p, axis=1)[:, -2] < 0.1).all() and sorted(p.argmax(axis=1)) == [0, 1, 2]


def test_indicator_invariance(spark):
    rng = np.random.default_rng(3)
    e = np.repeat([0, 1], 1000)
    x = rng.normal(size=2000) + 2 * e
    y = x + 0.5 * rng.normal(size=2000)
    df = generate.frame(spark, np.column_stack([x, y, y + rng.normal(size=2000), e]), ["x", "y", "z", "e"])
    g = constraint.icp(df, "e", target="y", invariance_test="indicator", alpha=0.01)
    assert g.oriented_edges() == [("x", "y", "directed")]


def test_virtual_rows_correct_like_covariances(spark):
    from tessera.operators.ci import FisherZ, Testwise, missing_patterns
    from tessera.operators.profile import checked

    w = np.zeros((3, 3))
    w[0, 2] = w[1, 2] = 1.0
    x = generate.linear(w, 6000, seed=2)
    x[x[:, 2] > 0.5, 1] = np.nan
    df = checked(generate.frame(spark, x), ["X0", "X1", "X2"], missing=True)
    test = Testwise(missing_patterns(df, df.columns), df.columns, FisherZ)
    assert test.many([(0, 1, ())])[0] < 1e-6
    assert constraint.Permuted(test, {1: [2]}, df, df.columns).pvalue(0, 1) > 1e-3
    assert moments(df, ["X0"]).n == 6000
