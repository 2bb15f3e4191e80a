"""Results that other implementations give on the same generated inputs."""

import zlib

import numpy as np
import pytest

from tessera.operators.ci import FisherZ
from tessera.operators.moments import of_matrix
from tessera.operators.scores import BIC
from tessera.plans import constraint, lingam, score_search, temporal
from tessera.sources import generate


def shuffled(x, seed):
    return x[:, np.random.default_rng([seed, zlib.crc32(b"columns")]).permutation(x.shape[1])]


def linear(noise, seed, w):
    """Rows of a recursive linear model; w[effect][cause]."""
    w, rng = np.array(w, float), np.random.default_rng(seed)
    e = rng.uniform(-1, 1, (1000, 5)) if noise == "uniform" else rng.standard_normal((1000, 5))
    x = e.copy()
    for j in range(5):
        x[:, j] = e[:, j] + x @ np.where(np.arange(5) < j, w[j], 0)
    return shuffled(x, seed)


@pytest.fixture(scope="module")
def gauss():
    return of_matrix(linear("gaussian", 20240612, [[0, 0, 0, 0, 0], [0.8, 0, 0, 0, 0], [0.7, 0, 0, 0, 0], [0, 0.6, 0.5, 0, 0], [0, 0, 0, 0.9, 0]]))


# Mark matrices, a score, an order, weights and statistics.
SKELETON = [[0, 0, 1, 0, 0], [0, 0, 1, 1, 0], [1, 1, 0, 1, 1], [0, 1, 1, 0, 1], [0, 0, 1, 1, 0]]
GES = [[0, 0, 2, 0, 0], [0, 0, 1, 1, 0], [1, 2, 0, 0, 2], [0, 1, 0, 0, 1], [0, 0, 1, 1, 0]]
GES_SCORE, XGES_SCORE = 13.11250538538846, -21.564919101639987
LINGAM_ORDER = ["X0", "X3", "X4", "X2", "X1"]
LINGAM_WEIGHTS = [
    [0.0, 0.0, 0.0, 0.0, 0.0],
    [0.0, 0.0, 0.8205545199581271, 0.0, 0.2997561665942044],
    [0.0, 0.0, 0.0, 0.4898405801739042, 0.0],
    [0.5813538891885072, 0.0, 0.0, 0.0, 0.0],
    [0.42074431545246416, 0.0, 0.0, 0.6730646151665065, 0.0],
]
PCMCI_STATISTICS = [[0.4413422416465278, 0.48034628634017046, -0.025300750714899328], [-0.029263748746221847, 0.03217093045530747, -0.056372744421514485], [0.02021512464224874, -0.042096052893676406, 0.29820585692284]]
PCMCI_P = [[9.926961437150899e-48, 2.952674660471573e-57, 0.6011877144486951], [0.6011877144486951, 0.6011877144486951, 0.2734164117714349], [0.6011877144486951, 0.4763469941815826, 3.607606385025438e-21]]


def test_constraint_based(gauss):
    t = FisherZ(gauss)
    assert constraint.pc(None, test=t).marks.tolist() == SKELETON
    assert constraint.fci(None, test=t).marks.tolist() == (3 * np.array(SKELETON)).tolist()


def test_score_based(gauss):
    g = score_search.ges(None, score=BIC(gauss, 2.0, 1.0))
    assert g.marks.tolist() == GES
    assert np.isclose(g.meta["objective"], GES_SCORE, rtol=1e-12)
    assert np.isclose(score_search.xges(None, score=BIC(gauss, 1.0, 1.0)).meta["objective"], XGES_SCORE, rtol=1e-12)


def test_direct_lingam(spark):
    x = linear("uniform", 20240611, [[0, 0, 0, 0, 0], [0.6, 0, 0, 0, 0], [0.4, 0.7, 0, 0, 0], [0, 0.5, 0, 0, 0], [0, 0, 0.3, 0.8, 0]])
    g = lingam.direct_lingam(generate.frame(spark, x))
    assert g.meta["causal_order"] == LINGAM_ORDER
    assert np.allclose(g.meta["weights"], LINGAM_WEIGHTS, atol=1e-3)


def test_pcmci(spark):
    lags = [np.array([[0.5, 0, 0], [0.6, 0, 0], [0, 0, 0.3]]), np.array([[0, 0, 0], [0, 0, 0], [0, -0.5, 0]])]
    e = np.random.default_rng(20240619).standard_normal((1200, 3))
    x = np.zeros_like(e)
    for t in range(1200):
        x[t] = e[t] + sum((a @ x[t - k - 1] for k, a in enumerate(lags) if t > k), np.zeros(3))
    x = shuffled(x[200:], 20240619)
    g = temporal.pcmci(generate.frame(spark, np.column_stack([x, np.arange(1000)]), ["a", "b", "c", "t"]), "t", tau_max=2)
    assert np.allclose(g.weights[1], PCMCI_STATISTICS, rtol=1e-9)
    assert np.allclose(g.meta["pvalues"][1], PCMCI_P, rtol=1e-6)
