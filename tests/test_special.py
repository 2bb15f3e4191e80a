import math

import numpy as np

from tessera.functions import special


def test_normal_and_its_quantile_are_inverse():
    z = np.array([-3.0, -0.5, 0.0, 1.2, 4.0])
    assert np.allclose(special.normal_quantile(special.normal_cdf(z)), z, atol=1e-9)
    assert math.isclose(float(special.normal_sf(1.959963984540054)), 0.025, rel_tol=1e-12)


def test_chi_square_of_two_degrees_is_exponential():
    x = np.array([0.1, 1.0, 5.0, 30.0])
    assert np.allclose(special.chi2_sf(x, 2), np.exp(-x / 2), rtol=1e-12)
    assert special.chi2_sf(3.0, 0) == 1.0


def test_chi_square_with_real_degrees_is_between_its_neighbours():
    assert special.chi2_sf(4.0, 2) < special.chi2_sf(4.0, 2.5) < special.chi2_sf(4.0, 3)


def test_t_of_one_degree_is_cauchy_and_many_are_normal():
    t = np.array([0.2, 1.0, 7.0])
    assert np.allclose(special.t_two_sided(t, 1), 1 - 2 / math.pi * np.arctan(t), rtol=1e-10)
    assert np.allclose(special.t_two_sided(t[:2], 1e7), special.erfc(t[:2] / math.sqrt(2)), rtol=1e-5)


def test_f_of_one_numerator_degree_is_a_squared_t():
    assert math.isclose(float(special.f_sf(2.25, 1, 9)), float(special.t_two_sided(1.5, 9)), rel_tol=1e-10)


def test_matrix_exponential():
    a = np.array([[0.0, 1.0], [-1.0, 0.0]])
    assert np.allclose(special.expm(math.pi / 2 * a), [[0, 1], [-1, 0]], atol=1e-12)


def test_threads_of_linear_algebra_come_back():
    from tessera.functions import blas

    before = [get() for get, _ in blas._libraries()]
    with blas.one_thread():
        assert all(get() == 1 for get, _ in blas._libraries())
    assert [get() for get, _ in blas._libraries()] == before


def test_weighted_chi_squares_by_draws():
    rng = np.random.default_rng(0)
    for w in ([1.0], [2.0, 1.0], [3.0, 1.0, 0.5], [5, 4, 3, 2, 1, 0.5]):
        z = (rng.standard_normal((200_000, len(w))) ** 2) @ np.array(w)
        for q in (0.5, 0.9, 0.99):
            assert abs(special.weighted_chi2_sf(np.quantile(z, q), w) - (1 - q)) < 4 * np.sqrt(q * (1 - q) / 200_000)
    assert special.weighted_chi2_sf(-1, [1, 2]) == 1.0 and special.weighted_chi2_sf(1, []) == 0.0
