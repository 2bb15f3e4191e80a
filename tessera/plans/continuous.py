"""Continuous optimisation over weighted graphs; only the covariance is needed, so rows are read once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from tessera.functions.special import expm
from tessera.operators.moments import moments
from tessera.operators.profile import checked, numeric_columns
from tessera.plans.constraint import markov_blanket
from tessera.plans.graph import Graph, has_cycle


class Adam:
    def __init__(self, shape, rate):
        self.m, self.v, self.t, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def step(self, g):
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _proximal(w, smooth, lam, ok, steps, tol=1e-6):
    """Accelerated proximal gradient with backtracking: least value of smooth(w) + sum lam |w| over the allowed cells."""
    t, z, k = 1.0, w, 1.0
    shrink = lambda x, by: np.where(ok, np.sign(x) * np.maximum(np.abs(x) - by, 0), 0)
    for _ in range(steps):
        f, g = smooth(z)
        while True:
            new = shrink(z - t * g, t * lam)
            d = new - z
            if t < 1e-14 or smooth(new)[0] <= f + (g * d).sum() + (d * d).sum() / (2 * t) + 1e-12 * abs(f):
                break
            t /= 2
        if np.abs(new - w).max() < tol:
            return new
        if ((z - new) * (new - w)).sum() > 0:  # the momentum points the wrong way
            k = 1.0
        k2 = (1 + np.sqrt(1 + 4 * k * k)) / 2
        w, z, k, t = new, new + (k - 1) / k2 * (new - w), k2, 1.3 * t
    return w


def acyclic_fit(cov: np.ndarray, d: int, lam: float, *, h_tol=1e-8, rho_max=1e16, max_iter=100, inner=400, allowed=None, penalty=None, loss: Callable | None = None) -> np.ndarray:
    """Weights [cause, effect] of the first d columns on all columns, with lasso and acyclicity of the first d rows.

    loss: (value, gradient) of the weights instead of half the mean squared residuals, which follow from cov.

    Augmented Lagrangian on tr(exp(W * W)) - d.
    """
    k = len(cov)
    w = np.zeros((k, d))
    ok = np.ones((k, d), bool) if allowed is None else allowed.copy()
    ok[range(d), range(d)] = False
    weight = lam * (penalty if penalty is not None else 1.0)
    rho, a, h = 1.0, 0.0, np.inf

    def smooth(x):
        e = expm(np.minimum(x[:d] ** 2, 50))
        c = np.trace(e) - d
        if loss is None:
            r = cov @ x
            g = r - cov[:, :d]
            f = 0.5 * (x * r).sum() - (x * cov[:, :d]).sum()
        else:
            f, g = loss(x)
            g = np.array(g, float)
        f += rho / 2 * c * c + a * c
        g[:d] += (rho * c + a) * e.T * 2 * x[:d]
        return f, g

    for _ in range(max_iter):
        while True:
            trial = _proximal(w, smooth, weight, ok, inner)
            new = np.trace(expm(trial[:d] ** 2)) - d
            if new <= 0.25 * h or rho >= rho_max:
                break
            rho *= 10
        w, h = trial, new
        a += rho * h
        if h <= h_tol or rho >= rho_max:
            break
    return w


def cut_cycles(w: np.ndarray, threshold: float) -> np.ndarray:
    """Weights below the threshold go; then the weakest until no cycle is left."""
    w = np.where(np.abs(w) >= threshold, w, 0)
    while has_cycle(w != 0):
        i, j = min(zip(*np.nonzero(w), strict=True), key=lambda e: abs(w[e]))
        w[i, j] = 0
    return w


def _covariance(df, columns, standardize):
    m = moments(checked(df, columns), columns)
    return m.corr if standardize else m.cov


def _graph(w, columns) -> Graph:
    return Graph(Graph.of_dag(w != 0).marks, "dag", columns, meta={"weights": w.T})


def notears(df: DataFrame, *, lambda1=0.1, w_threshold=0.3, max_iter=100, h_tol=1e-8, rho_max=1e16, robust=False, mcp_lambda=0.4, standardize=False, columns=None, knowledge=None, loss: Callable | None = None, penalty: Callable | None = None) -> Graph:
    """Least squares with a lasso under acyclicity.

    loss(cov, w): another (value, gradient). penalty(w): factors of the lasso for a second fit, from the first's weights;
    with `robust`, those of a concave penalty.
    """
    columns = columns or numeric_columns(df)
    from tessera.plans.knowledge import resolved

    c = resolved(knowledge, columns)
    cov = _covariance(df, columns, standardize)
    own = None if loss is None else lambda w: loss(cov, w)
    options = {"h_tol": h_tol, "rho_max": rho_max, "max_iter": max_iter, "allowed": ~c.forbidden, "loss": own}
    w = acyclic_fit(cov, len(columns), lambda1, **options)
    if robust and penalty is None:  # large weights lose their penalty
        penalty = lambda w: np.maximum(0, 1 - np.abs(w) / mcp_lambda)
    if penalty is not None:
        w = acyclic_fit(cov, len(columns), lambda1, penalty=penalty(w), **options)
    return _graph(cut_cycles(w, w_threshold), columns)


def dagma(df: DataFrame, *, lambda1=0.03, w_threshold=0.3, stages=5, warm_iter=4000, max_iter=8000, lr=3e-3, standardize=False, columns=None, knowledge=None) -> Graph:
    """Central path with the log-determinant barrier -log det(s I - W * W) + d log s."""
    columns = columns or numeric_columns(df)
    from tessera.plans.knowledge import resolved

    ok = ~resolved(knowledge, columns).forbidden
    np.fill_diagonal(ok, False)
    cov, d = _covariance(df, columns, standardize), len(columns)
    w, mu = np.zeros((d, d)), 1.0
    for stage in range(stages):
        s, adam = (1.0, 0.9, 0.8, 0.7, 0.6)[min(stage, 4)], Adam((d, d), lr)
        for _ in range(warm_iter if stage < stages - 1 else max_iter):
            inv = np.linalg.inv(s * np.eye(d) - w * w)
            if (inv < -1e-12).any():
                adam.rate /= 2
                w *= 0.9
                if adam.rate < 1e-8:
                    break
                continue
            g = mu * (cov @ w - cov + lambda1 * np.sign(w)) + 2 * w * inv.T
            w = np.where(ok, w - adam.step(g), 0)
        mu *= 0.1
    return _graph(cut_cycles(w, w_threshold), columns)


def calm(df: DataFrame, *, lambda1=0.005, screen_alpha=0.01, use_moral_graph=True, w_threshold=0.3, gate_threshold=0.5, max_iter=25, subproblem_iter=800, lr=0.01, tau=0.5, rho_init=1e-3, rho_mult=3.0, rho_max=1e16, h_tol=1e-8, seed=0, standardize=False, columns=None) -> Graph:
    """Gated weights within the moral graph that Markov blankets give, by the Gaussian likelihood, variances fitted.

    Gates are drawn with logistic noise at each step, so that a half-open gate can't be made up for by a larger weight;
    the graph keeps the edges whose gate is open without noise.
    """
    from tessera.operators.ci import FisherZ

    columns = columns or numeric_columns(df)
    m = moments(checked(df, columns), columns)
    cov, d, rng = m.corr if standardize else m.cov, m.d, np.random.default_rng(seed)
    ok = np.ones((d, d), bool)
    if use_moral_graph:
        test = FisherZ(m)
        ok = np.zeros((d, d), bool)
        for v in range(d):
            ok[v, markov_blanket(test, v, screen_alpha)] = True
        ok |= ok.T
    np.fill_diagonal(ok, False)
    w, gate = rng.normal(0, 0.01, (d, d)), np.full((d, d), 1.0)
    rho, a, h = rho_init, 0.0, np.inf
    for _ in range(max_iter):
        aw, ag = Adam((d, d), lr), Adam((d, d), lr)
        for _ in range(subproblem_iter):
            u = rng.uniform(1e-6, 1 - 1e-6, (d, d))
            z = np.where(ok, 1 / (1 + np.exp(-np.clip((gate + np.log(u / (1 - u))) / tau, -40, 40))), 0)
            b = w * z
            r = np.eye(d) - b
            var = np.maximum((r.T @ cov @ r).diagonal(), 1e-9)
            e = expm(b * b)
            gb = -(cov @ r) / var + (rho * (np.trace(e) - d) + a) * e.T * 2 * b
            w = w - aw.step(gb * z)
            gate = np.clip(gate - ag.step((gb * w + lambda1) * z * (1 - z) / tau), -10, 10)
        z = np.where(ok, 1 / (1 + np.exp(-np.clip(gate / tau, -40, 40))), 0)
        new = np.trace(expm((w * z) ** 2)) - d
        a += rho * new
        rho = rho * rho_mult if new > 0.25 * h else rho
        h = new
        if h <= h_tol or rho > rho_max:
            break
    z = np.where(ok, 1 / (1 + np.exp(-np.clip(gate / tau, -40, 40))), 0)
    return _graph(cut_cycles(np.where(z >= gate_threshold, w * z, 0), w_threshold), columns)
