import numpy as np
import pytest

from tessera.operators.ci import FisherZ
from tessera.operators.moments import of_matrix
from tessera.operators.scores import BIC
from tessera.plans import constraint, continuous, functional, lingam, orient, resample, score_search, temporal
from tessera.plans.graph import Graph
from tessera.sources import generate

#: The linear Gaussian model of five variables: X0 -> X1, X2; X1, X2 -> X3 -> X4.
W = np.zeros((5, 5))
W[0, 1], W[0, 2], W[1, 3], W[2, 3], W[3, 4] = 0.9, 0.8, 1.0, 1.0, 0.9


@pytest.fixture(scope="module")
def gauss(spark):
    return generate.frame(spark, generate.linear(W, 3000, seed=3)).cache()


TRUE = orient.dag_to_cpdag(W != 0)
COLUMNS = [f"X{j}" for j in range(5)]


@pytest.mark.parametrize("collider_rule", ["sepsets", "majority", "conservative"])
def test_pc(gauss, collider_rule):
    assert (constraint.pc(gauss, alpha=0.01, collider_rule=collider_rule).marks == TRUE).all()


@pytest.mark.parametrize("name", ["ges", "xges", "boss", "grasp", "exact_search"])
def test_equivalence_searches_agree(gauss, name):
    assert (getattr(score_search, name)(gauss).marks == TRUE).all()


def test_ages_orients_at_least_as_much(gauss):
    g = score_search.ages(gauss)
    assert ((g.marks != 0) == (TRUE != 0)).all()


@pytest.mark.parametrize("name", ["hc", "tabu", "mmhc"])
def test_searches_over_dags(gauss, name):
    """No single change of an arrow improves what they find, and every true pair is adjacent."""
    g = getattr(score_search, name)(gauss)
    x = np.array([tuple(r) for r in gauss.collect()])
    score = BIC(of_matrix(x), ebic_gamma=1.0)
    c = score_search.none(5)
    changes = [m for k, m in score_search._changes(g.directed, score, c) if k[0] * score.n < -1e-6]
    assert name == "mmhc" or all(score_search.has_cycle(score_search._applied(g.directed, m)) for m in changes)
    assert ((TRUE != 0) & ~(g.marks != 0)).sum() == 0


def test_objective_is_the_sum_of_local_scores(gauss):
    g = score_search.ges(gauss)
    x = np.array([tuple(r) for r in gauss.collect()])
    score = BIC(of_matrix(x), ebic_gamma=1.0)
    assert np.isclose(g.meta["objective"], score.total(W != 0))


def test_greedy_equals_exact_on_small_random_models():
    for seed in range(6):
        a = generate.random_dag(5, 2, seed)
        x = generate.linear(generate.random_weights(a, seed=seed), 2000, seed=seed)
        score = BIC(of_matrix(x), ebic_gamma=1.0)
        best = score_search.exact_search(None, score=score).meta["objective"]
        assert score_search.ges(None, score=score).meta["objective"] >= best - 1e-6
        assert abs(score_search.boss(None, score=score).meta["objective"] - best) < 1e-6


def test_hidden_variable_searches_keep_the_skeleton(gauss):
    for g in (constraint.fci(gauss, alpha=0.01), *(score_search.hybrid_fci(gauss, m, alpha=0.01) for m in ("gfci", "boss_fci", "grasp_fci"))):
        assert ((g.marks != 0) == (TRUE != 0)).all()
        assert g.marks[3, 1] == g.marks[3, 2] == 2


def test_blankets(gauss):
    assert constraint.blanket(gauss, method="iamb", target="X1", alpha=0.01) == ["X0", "X2", "X3"]
    assert constraint.blanket(gauss, method="inter_iamb", target="X4", alpha=0.01) == ["X3"]
    assert constraint.blanket(gauss, method="mmpc", target="X3", alpha=0.01) == ["X1", "X2", "X4"]
    assert (constraint.blanket(gauss, method="iamb", alpha=0.01).marks == TRUE).all()


def test_environments(spark):
    x = generate.environments(W, 700, [{}, {3: 3.0}, {4: 3.0}], seed=1)
    df = generate.frame(spark, x, [*COLUMNS, "env"])
    g = score_search.gnies(df, "env")
    assert set(g.meta["targets"]) == {"X3", "X4"}
    gi = score_search.gies(df, "env", {1.0: ["X3"], 2.0: ["X4"]})
    assert ((gi.marks != 0) == (TRUE != 0)).all() and orient.directed(gi.marks)[3, 4]
    shifted = generate.environments(W, 700, [{}, {0: 3.0}, {1: 3.0}, {2: 3.0, 4: 3.0}], seed=2)
    found = constraint.icp(generate.frame(spark, shifted, [*COLUMNS, "env"]), "env", target="X3")
    assert set(found.parents("X3")) <= {"X1", "X2"} and found.parents("X3")
    u = score_search.igsp(df, "env", {1.0: ["X3"], 2.0: ["X4"]}, n_starts=3)
    assert ((u.marks != 0) == (TRUE != 0)).all()


def test_missing_values(spark):
    x = generate.with_missing(generate.linear(W, 4000, seed=8), 0.05, seed=1)
    df = generate.frame(spark, x)
    assert (constraint.pc(df, alpha=0.001, missing="testwise").marks == TRUE).all()
    assert (score_search.structural_em(df, score_search.boss, COLUMNS, ebic_gamma=1.0).marks == TRUE).all()


def test_a_cause_of_missingness_is_corrected_for(spark):
    """X1 goes missing where X2 = X0 + X1 + noise is large: complete rows alone make X0 and X1 dependent."""
    w = np.zeros((3, 3))
    w[0, 2] = w[1, 2] = 1.0
    x = generate.linear(w, 6000, seed=2)
    x[x[:, 2] > 0.5, 1] = np.nan
    df = generate.frame(spark, x)
    assert constraint.pc(df, alpha=0.001, missing="testwise").marks[0, 1] != 0
    g = constraint.pc(df, alpha=0.001, missing="mvpc")
    assert g.meta["missingness_causes"] == {"X1": ["X2"]}
    assert g.oriented_edges() == [("X0", "X2", "directed"), ("X1", "X2", "directed")]


def test_lingam(spark):
    w = np.zeros((5, 5))
    w[0, 1], w[0, 2], w[1, 2], w[1, 3], w[2, 4], w[3, 4] = 0.6, 0.4, 0.7, 0.5, 0.3, 0.8
    df = generate.frame(spark, generate.linear(w, 3000, kind="uniform", seed=5))
    for g in (lingam.direct_lingam(df), lingam.ica_lingam(df, seed=1)):
        assert (g.directed == (w != 0)).all()
        assert np.allclose(g.meta["weights"].T, w, atol=0.1)
    both = lingam.multi_group_direct_lingam([df, generate.frame(spark, generate.linear(1.3 * w, 2000, kind="uniform", seed=6))])
    assert all((g.directed == (w != 0)).all() for g in both)
    skewed = generate.frame(spark, generate.linear(w, 3000, kind="exponential", seed=5))
    assert (lingam.direct_lingam(skewed, measure="skew").directed == (w != 0)).all()
    heavy = generate.frame(spark, generate.linear(w, 3000, kind="laplace", seed=5))
    assert (lingam.direct_lingam(heavy, measure="tanh").directed == (w != 0)).all()


def test_hidden_linear_models(spark):
    x = generate.linear(np.array([[0, 0.9, 0], [0, 0, 0.9], [0, 0, 0]]), 600, kind="uniform", seed=1)
    df = generate.frame(spark, x)
    g = lingam.rcd(df)
    assert g.directed[0, 1] and g.directed[1, 2]
    p = lingam.bottom_up_parce_lingam(df)
    assert p.meta["order"][-1] == ["X2"]


def test_continuous_searches(spark):
    df = generate.frame(spark, generate.linear(1.2 * W, 2000, seed=3))
    for f in (continuous.notears, continuous.dagma):
        assert (f(df).directed == (W != 0)).all(), f.__name__


def test_pairs(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, 300)
    df = generate.frame(spark, np.column_stack([x, x**3 + x + 0.2 * rng.uniform(-1, 1, 300)]))
    for method in ("anm", "loci"):
        assert functional.pair_direction(df, method).directed[0, 1]
    assert functional.pair_directions(df, "anm", most_rows=150).count() == 1


def test_additive_models(spark):
    a = np.zeros((3, 3), bool)
    a[0, 1] = a[1, 2] = True
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, 500)
    y = np.sin(2 * x) + 0.2 * rng.standard_normal(500)
    z = y**2 + 0.2 * rng.standard_normal(500)
    df = generate.frame(spark, np.column_stack([x, y, z]))
    assert (functional.cam(df).directed == a).all()
    assert functional.resit(df, most_rows=250).directed[0, 1]
    for method in ("score_matching", "nogam"):
        g = functional.by_score(df, method, most_rows=300)
        assert ((g.marks != 0) == (a | a.T)).all()
    assert functional.camuv(df, most_rows=250).marks[0, 1]


def test_time_series(spark):
    a = [np.array([[0.5, 0.6, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.3]]), np.array([[0.0, 0.0, 0.0], [0.0, 0.0, -0.5], [0.0, 0.0, 0.0]])]
    x = generate.series(a, 1500, seed=4)
    df = generate.frame(spark, np.column_stack([x, np.arange(len(x))]), ["x", "y", "z", "t"])
    true = {("x", "x", 1), ("x", "y", 1), ("z", "z", 1), ("y", "z", 2)}
    for f in (temporal.granger, temporal.pcmci):
        g = f(df, "t", tau_max=2, alpha=0.001)
        assert set(g.links()) == true, f.__name__
    assert set(temporal.pcmciplus(df, "t", tau_max=2, alpha=0.001).links()) >= true
    d = temporal.dynotears(df, "t", tau_max=2)
    assert set(d.links()) == true
    assert g.summary() == {("x", "x"): [1], ("x", "y"): [1], ("z", "z"): [1], ("y", "z"): [2]}
    p = temporal.lpcmci(df, "t", tau_max=1, alpha=0.001)
    assert p.marks[1][0, 1]


def test_autoregressive_lingam(spark):
    b0 = np.array([[0, 0.8, 0], [0, 0, 0.7], [0, 0, 0]])
    x = generate.series([0.3 * np.eye(3)], 3000, contemporaneous=b0, kind="uniform", seed=2)
    df = generate.frame(spark, np.column_stack([x, np.arange(len(x))]), ["x", "y", "z", "t"])
    for g in (temporal.var_lingam(df, "t"), temporal.varma_lingam(df, "t")):
        assert g.meta["causal_order"] == ["x", "y", "z"]
        assert np.allclose(g.weights[0], b0, atol=0.12)


def test_panels(spark):
    from pyspark.sql import functions as F

    b0 = np.array([[0, 0.8], [0, 0]])
    parts = []
    for u in range(3):
        x = generate.series([0.4 * np.eye(2)], 400, contemporaneous=b0, kind="uniform", seed=u)
        parts.append(generate.frame(spark, np.column_stack([x, np.arange(400)]), ["x", "y", "t"]).withColumn("s", F.lit(u)))
    df = parts[0].unionByName(parts[1]).unionByName(parts[2])
    g = temporal.jpcmciplus(df, "t", "s", columns=["x", "y"])
    assert ("x", "x", 1) in g.links() and ("y", "y", 1) in g.links()
    rng = np.random.default_rng(1)
    first = rng.uniform(-1, 1, (800, 2))
    first[:, 1] += 0.8 * first[:, 0]
    second = 0.5 * first + rng.uniform(-1, 1, (800, 2)) @ np.array([[1, 0.8], [0, 1]])
    rows = np.concatenate([np.column_stack([v, np.arange(800), np.full(800, k)]) for k, v in enumerate((first, second))])
    out = temporal.longitudinal_lingam(generate.frame(spark, rows, ["x", "y", "unit", "occasion"]), "unit", "occasion")
    assert list(out) == [1.0] and abs(out[1.0].weights[0][0, 1] - 0.8) < 0.12


def test_resampling(spark, gauss):
    out = resample.bootstrap(gauss, lambda m: constraint.pc(None, alpha=0.01, test=FisherZ(m)), n_resamples=12, columns=COLUMNS, seed=1)
    assert out.frequency("X3", "X4") == 1.0
    assert (out.average().marks == TRUE).all()
    ms = resample.resampled_moments(gauss, COLUMNS, 3, resampling="bootstrap", seed=2)
    assert all(abs(m.n - 3000) < 300 for m in ms)
    rows = resample.resample_rows(gauss, 0, fraction=0.5)
    assert 1200 < rows.count() < 1800


def test_markov_check(gauss):
    good = resample.markov_check(gauss, Graph.of_dag(W != 0, COLUMNS))
    bad = resample.markov_check(gauss, Graph.of_dag(np.zeros((5, 5)), COLUMNS))
    assert good["n_tests"] == 5 and good["p_value"] > 0.001
    assert bad["p_value"] < 1e-3 and bad["dependent"] > 0.5


def test_anderson_darling_rejects_small_p_values():
    rng = np.random.default_rng(0)
    assert resample.anderson_darling(rng.random(200))[1] > 0.01
    assert resample.anderson_darling(rng.random(200) ** 3)[1] < 1e-4


def test_latent_clusters(spark):
    rng = np.random.default_rng(3)
    l1 = rng.uniform(-1, 1, 800)
    l2 = 0.9 * l1 + rng.uniform(-1, 1, 800)
    x = np.column_stack([l1, 0.9 * l1, 1.1 * l1, 0.8 * l2, 1.2 * l2, 0.9 * l2]) + 0.3 * rng.uniform(-1, 1, (800, 6))
    g = lingam.gin(generate.frame(spark, x), most_rows=500)
    assert sorted(map(tuple, g.meta["clusters"])) == [("X0", "X1", "X2"), ("X3", "X4", "X5")]


@pytest.mark.parametrize("outer", [lambda v: v**3 + v, np.exp, lambda v: np.tanh(1.2 * v), lambda v: v])
def test_post_nonlinear_pairs(spark, outer):
    """Whatever rising function distorts the effect, the noise is independent of the cause one way only."""
    rng = np.random.default_rng(4)
    x = rng.uniform(-2, 2, 600)
    y = outer(np.sin(1.5 * x) + 0.3 * x + 0.3 * rng.normal(size=600))
    g = functional.pair_direction(generate.frame(spark, np.column_stack([x, y])), "pnl", alpha=0.01)
    assert g.oriented_edges() == [("X0", "X1", "directed")]
    e = functional.post_nonlinear_residual(x, y)
    assert abs(np.corrcoef(e, np.sin(1.5 * x) + 0.3 * x)[0, 1]) < 0.1


def test_own_loss_and_penalty(spark):
    df = generate.frame(spark, generate.linear(1.2 * W, 2000, seed=3))
    seen = []

    def loss(cov, w):
        seen.append(1)
        r = cov @ w
        return 0.5 * (w * r).sum() - (w * cov).sum(), r - cov

    plain = continuous.notears(df)
    assert np.allclose(continuous.notears(df, loss=loss).meta["weights"], plain.meta["weights"], atol=1e-4) and seen
    free = continuous.notears(df, penalty=lambda w: (np.abs(w) < 0.1).astype(float))
    assert (free.directed == plain.directed).all() and np.abs(free.meta["weights"]).sum() > np.abs(plain.meta["weights"]).sum()
