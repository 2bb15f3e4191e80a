"""Time series: lagged designs on Spark, searches on their moments."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.operators.ci import FisherZ, StudentT, Test
from tessera.operators.moments import Moments, lagged, moments, moments_by
from tessera.operators.profile import numeric_columns
from tessera.plans import orient
from tessera.plans.continuous import acyclic_fit
from tessera.plans.graph import ARROW, CIRCLE, TAIL, TemporalGraph
from tessera.plans.lingam import causal_order, causal_orders, weights_for

Link = tuple[int, int]  # (variable, lag)


def benjamini_hochberg(p: np.ndarray) -> np.ndarray:
    """Adjusted p-values: p m / rank, smallest from above, at most 1."""
    p = np.asarray(p, float)
    order = np.argsort(p, kind="stable")
    adjusted = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.minimum(adjusted, 1)
    return out


class LaggedTest:
    """A test over (variable, lag) nodes: all tests share the rows of one design."""

    def __init__(self, test: Test, names: list[str], lags: int):
        self.test, self.names, self.lags, self.d = test, names, lags, len(names)

    def at(self, v: Link) -> int:
        return v[1] * self.d + v[0]

    def many(self, queries) -> np.ndarray:
        return self.test.many([(self.at(x), self.at(y), tuple(self.at(v) for v in s)) for x, y, s in queries])

    def pvalue(self, x, y, s=()) -> float:
        return float(self.many([(x, y, s)])[0])

    def strength(self, x, y, s=()) -> float:
        return round(self.test.strength(self.at(x), self.at(y), tuple(self.at(v) for v in s)), 9)


def design(df: DataFrame, columns: list[str], order: str, lags: int, series: str | None = None) -> tuple[DataFrame, list[str]]:
    table = lagged(df, columns, order, lags, series)
    return table, [*columns, *(f"{c}__{k}" for k in range(1, lags + 1) for c in columns)]


def lagged_test(df: DataFrame, order: str, tau_max: int, *, columns=None, indep_test="student_t", series=None) -> LaggedTest:
    """The design uses lags up to 2 tau_max, so every test has the same rows."""
    columns = columns or [c for c in numeric_columns(df) if c not in (order, series)]
    table, names = design(df, columns, order, 2 * tau_max, series)
    return LaggedTest({"student_t": StudentT, "fisherz": FisherZ}[indep_test or "student_t"](moments(table, names)), columns, 2 * tau_max)


def pc1(test: LaggedTest, target: int, tau_max: int, alpha: float, forbidden=frozenset()) -> list[Link]:
    """Lagged parents of a target, strongest first."""
    parents = [(v, k) for k in range(1, tau_max + 1) for v in range(test.d) if (v, target, k) not in forbidden]
    strength = {p: math.inf for p in parents}
    size = 0
    while size <= len(parents) - 1:
        queries = [(p, (target, 0), tuple([q for q in parents if q != p][:size])) for p in parents]
        drop = set()
        for (p, _, s), pv in zip(queries, test.many(queries), strict=True):
            strength[p] = min(strength[p], test.strength(p, (target, 0), s))
            if pv > alpha:
                drop.add(p)
        parents = sorted((p for p in parents if p not in drop), key=lambda p: (-strength[p], p[0], p[1]))
        size += 1
    return parents


def _shift(links, k):
    return [(v, lag + k) for v, lag in links]


def pcmci(df: DataFrame, order: str, *, tau_max=1, pc1_alpha=0.2, alpha=0.05, fdr_method="fdr_bh", indep_test=None, columns=None, series=None, test: LaggedTest | None = None) -> TemporalGraph:
    """Lagged links by condition selection and momentary conditional independence."""
    test = test or lagged_test(df, order, tau_max, columns=columns, indep_test=indep_test, series=series)
    d = test.d
    parents = {j: pc1(test, j, tau_max, pc1_alpha) for j in range(d)}
    queries = []
    for j in range(d):
        for k in range(1, tau_max + 1):
            for i in range(d):
                s = {p for p in parents[j] if p != (i, k)} | set(_shift(parents[i], k))
                queries.append(((i, k), (j, 0), tuple(sorted(s - {(i, k), (j, 0)}))))
    p = test.many(queries)
    q = benjamini_hochberg(p) if fdr_method == "fdr_bh" else p
    marks, pvals, stats = np.zeros((tau_max + 1, d, d), np.int8), np.ones((tau_max + 1, d, d)), np.zeros((tau_max + 1, d, d))
    for ((i, k), (j, _), s), v in zip(queries, q, strict=True):
        pvals[k, i, j], stats[k, i, j] = v, test.test.partial(test.at((i, k)), test.at((j, 0)), tuple(test.at(u) for u in s))
        marks[k, i, j] = TAIL if v <= alpha else 0
    return TemporalGraph(marks, tuple(test.names), stats, {"pvalues": pvals, "parents": {test.names[j]: [(test.names[v], k) for v, k in ps] for j, ps in parents.items()}})


def pcmciplus(df: DataFrame, order: str, *, tau_max=1, alpha=0.01, indep_test=None, collider_rule="majority", columns=None, series=None, test: LaggedTest | None = None, contexts=()) -> TemporalGraph:
    """PCMCI+ : lagged parents, then a contemporaneous skeleton given them, colliders and Meek's rules at lag 0."""
    test = test or lagged_test(df, order, tau_max, columns=columns, indep_test=indep_test, series=series)
    d = test.d
    parents = {j: pc1(test, j, tau_max, alpha) for j in range(d)}
    adj = {(i, j) for i in range(d) for j in range(d) if i != j and not (i in contexts and j in contexts)}
    lag_links = {(p, j) for j in range(d) for p in parents[j] if j not in contexts}
    sepsets, strength = {}, {}
    size = 0
    near = lambda j: sorted((i for i in range(d) if (i, j) in adj), key=lambda i: (-strength.get((i, j), math.inf), i))
    while any(len(near(j)) - 1 >= size for j in range(d)):
        removed, gone = set(), set()
        for j in range(d):
            todo = [((i, 0), j) for i in near(j)] + [l for l in sorted(lag_links) if l[1] == j]
            for x, _ in todo:
                others = [i for i in near(j) if x != (i, 0)]
                for s in combinations(others, size):
                    z = {(i, 0) for i in s} | {p for p, t in lag_links if t == j and p != x} | set(_shift([p for p, t in lag_links if t == x[0]], x[1]))
                    z = {v for v in z if v[1] <= test.lags} - {x, (j, 0)}
                    p = test.pvalue(x, (j, 0), tuple(sorted(z)))
                    strength[(x[0], j)] = min(strength.get((x[0], j), math.inf), test.strength(x, (j, 0), tuple(sorted(z)))) if x[1] == 0 else strength.get((x[0], j), math.inf)
                    if p > alpha:
                        if x[1] == 0:
                            removed |= {(x[0], j), (j, x[0])}
                            sepsets[min(x[0], j), max(x[0], j)] = set(s)
                        else:
                            gone.add((x, j))
                            sepsets[x, j] = set(s)
                        break
        adj -= removed
        lag_links -= gone
        size += 1
    m = np.zeros((d, d), np.int8)
    for i, j in adj:
        m[i, j] = TAIL
    for i in contexts:
        for j in range(d):
            if m[i, j] and j not in contexts:
                orient.arrow(m, i, j)
    for (i, _), j in sorted(lag_links):  # a lagged cause with a contemporaneous neighbour of its effect
        for k in range(d):
            s = sepsets.get(((i, _), k))
            if m[j, k] == TAIL and m[k, j] == TAIL and ((i, _), k) not in lag_links and s is not None:
                if j not in s:
                    orient.arrow(m, k, j)
                else:
                    orient.arrow(m, j, k)
    m = orient.undirect_conflicts(orient.meek(orient.colliders(m, {k: v for k, v in sepsets.items() if isinstance(k[0], int)})))
    marks = np.zeros((tau_max + 1, d, d), np.int8)
    marks[0] = m
    for (i, k), j in lag_links:
        marks[k, i, j] = TAIL
    return TemporalGraph(marks, tuple(test.names))


def jpcmciplus(df: DataFrame, order: str, dataset: str, *, time_contexts=(), space_contexts=(), tau_max=1, alpha=0.01, columns=None, dummies=True) -> TemporalGraph:
    """PCMCI+ over several series with observed contexts and a dummy for each series."""
    system = columns or [c for c in numeric_columns(df) if c not in (order, dataset, *time_contexts, *space_contexts)]
    labels = sorted(r[0] for r in df.select(dataset).distinct().collect())
    extra = []
    if dummies:
        for k, v in enumerate(labels[1:], 1):
            df = df.withColumn(f"series_{k}", (F.col(dataset) == F.lit(v)).cast("double"))
            extra.append(f"series_{k}")
    names = [*system, *time_contexts, *space_contexts, *extra]
    table, _ = design(df, [*system, *time_contexts], order, 2 * tau_max, dataset)
    constant = [*space_contexts, *extra]
    if constant:
        table = table.join(F.broadcast(df.groupBy(dataset).agg(*(F.first(c).alias(c) for c in constant))), dataset)
        for c in constant:
            table = table.withColumns({f"{c}__{k}": F.col(c) + F.rand(7 + k) * 1e-9 for k in range(1, 2 * tau_max + 1)})
    every = [*names, *(f"{c}__{k}" for k in range(1, 2 * tau_max + 1) for c in names)]
    m = moments(table, every)
    test = LaggedTest(StudentT(Moments(m.names, m.n, m.mean, m.cov + np.diag(np.diag(m.cov)) * 1e-9)), names, 2 * tau_max)
    return pcmciplus(df, order, tau_max=tau_max, alpha=alpha, test=test, contexts=tuple(range(len(system), len(names))))


def lpcmci(df: DataFrame, order: str, *, tau_max=1, alpha=0.05, columns=None, indep_test=None, n_preliminary_iterations=1, max_p_global=None, series=None) -> TemporalGraph:
    """A time-series PAG: FCI over the (variable, lag) nodes of a window, with time order as knowledge and stationary marks.

    Each preliminary iteration's lagged causes join the conditions of the next. max_p_global: the most conditions
    besides these; None: no bound.
    """
    from tessera.plans.constraint import fci_rules

    test = lagged_test(df, order, tau_max, columns=columns, indep_test=indep_test, series=series)
    d = test.d
    parents = {j: [] for j in range(d)}
    for _ in range(n_preliminary_iterations + 1):
        adj = {((i, k), j) for k in range(tau_max + 1) for i in range(d) for j in range(d) if k or i != j}
        sepsets = {}
        size = 0
        while size <= max(sum(1 for l in adj if l[1] == j) for j in range(d)) - 1 and (max_p_global is None or size <= max_p_global):
            removed = set()
            for x, j in sorted(adj):
                default = [p for p in parents[j] if p != x] + [p for p in _shift(parents[x[0]], x[1]) if p[1] <= test.lags]
                others = [l[0] for l in sorted(adj) if l[1] == j and l[0] != x and l[0] not in default]
                for s in combinations(others, size):
                    z = tuple(sorted({*s, *default} - {x, (j, 0)}))
                    if test.pvalue(x, (j, 0), z) > alpha:
                        removed.add((x, j))
                        if x[1] == 0:
                            removed.add(((j, 0), x[0]))
                        sepsets[x, j] = set(z)
                        break
            adj -= removed
            size += 1
        n = d * (tau_max + 1)
        m = np.zeros((n, n), np.int8)
        node = lambda v: v[1] * d + v[0]
        sep = {}
        for (x, j) in ((x, j) for x in ((i, k) for k in range(tau_max + 1) for i in range(d)) for j in range(d)):
            for t in range(tau_max + 1 - x[1]):
                a, b = node((x[0], x[1] + t)), node((j, t))
                if a == b:
                    continue
                if (x, j) in adj:
                    m[a, b], m[b, a] = CIRCLE, ARROW if x[1] else CIRCLE
                elif (x, j) in sepsets:
                    sep[min(a, b), max(a, b)] = {node((v, k + t)) for v, k in sepsets[x, j] if k + t <= tau_max}
        for b in range(n):
            for a, c in combinations(np.flatnonzero(m[b]).tolist(), 2):
                s = sep.get((min(a, c), max(a, c)))
                if not m[a, c] and s is not None and b not in s:
                    m[b, a] = m[b, c] = ARROW
        m = fci_rules(m, sep, selection_bias=False)
        parents = {j: [(v, k) for k in range(1, tau_max + 1) for v in range(d) if m[node((v, k)), j] == TAIL] for j in range(d)}
    marks = np.zeros((tau_max + 1, d, d), np.int8)
    into = np.zeros((tau_max + 1, d, d), np.int8)
    for k in range(tau_max + 1):
        for i in range(d):
            for j in range(d):
                if (i, k) != (j, 0):
                    marks[k, i, j], into[k, i, j] = m[k * d + i, j], m[j, k * d + i]
    return TemporalGraph(marks, tuple(test.names), meta={"marks_at_effect": into})


def _ols(m: Moments, y: int, p: list[int]):
    """Coefficients, their t statistics and degrees of freedom, with an intercept."""
    g = np.linalg.inv(m.cov[np.ix_(p, p)])
    b = g @ m.cov[p, y]
    dof = m.n - len(p) - 1
    s2 = (m.n - 1) * (m.cov[y, y] - b @ m.cov[p, y]) / dof
    return b, b / np.sqrt(np.maximum(s2 * np.diag(g) / (m.n - 1), 1e-300)), dof


def granger(df: DataFrame, order: str, *, tau_max=1, alpha=0.05, fdr_method="fdr_bh", columns=None, series=None) -> TemporalGraph:
    """One regression per target on all lags; a t-test per lag coefficient."""
    columns = columns or [c for c in numeric_columns(df) if c not in (order, series)]
    table, names = design(df, columns, order, tau_max, series)
    m, d = moments(table, names), len(columns)
    p, w = np.ones((tau_max + 1, d, d)), np.zeros((tau_max + 1, d, d))
    for j in range(d):
        b, t, dof = _ols(m, j, list(range(d, len(names))))
        p[1:, :, j] = special.t_two_sided(t, dof).reshape(tau_max, d)
        w[1:, :, j] = b.reshape(tau_max, d)
    if fdr_method == "fdr_bh":
        p[1:] = benjamini_hochberg(p[1:].ravel()).reshape(p[1:].shape)
    marks = np.where(p <= alpha, TAIL, 0).astype(np.int8)
    marks[0] = 0
    return TemporalGraph(marks, tuple(columns), w, {"pvalues": p})


def dynotears(df: DataFrame, order: str, *, tau_max=1, lambda1=0.05, w_threshold=0.3, lag_threshold=0.1, columns=None, series=None) -> TemporalGraph:
    """A structural autoregression by continuous optimisation on the lagged moments."""
    columns = columns or [c for c in numeric_columns(df) if c not in (order, series)]
    table, names = design(df, columns, order, tau_max, series)
    m, d = moments(table, names), len(columns)
    w = acyclic_fit(m.cov, d, lambda1)
    weights = np.zeros((tau_max + 1, d, d))
    for k in range(tau_max + 1):
        part = w[k * d : (k + 1) * d]
        weights[k] = np.where(np.abs(part) >= (w_threshold if k == 0 else lag_threshold), part, 0)
    marks = np.zeros_like(weights, dtype=np.int8)
    marks[1:][weights[1:] != 0] = TAIL
    for i, j in zip(*np.nonzero(weights[0]), strict=True):
        orient.arrow(marks[0], i, j)
    return TemporalGraph(marks, tuple(columns), weights)


def var_lingam(df: DataFrame, order: str, *, tau_max=1, measure="pwling", columns=None, series=None, prune=False) -> TemporalGraph:
    """Autoregression by least squares, then DirectLiNGAM of its residuals, which are columns of the design."""
    columns = columns or [c for c in numeric_columns(df) if c not in (order, series)]
    table, names = design(df, columns, order, tau_max, series)
    m, d = moments(table, names), len(columns)
    lag = list(range(d, len(names)))
    b = np.linalg.solve(m.cov[np.ix_(lag, lag)], m.cov[np.ix_(lag, list(range(d)))])  # [lagged, target]
    residuals = table.select(*((F.col(c) - reduce(lambda x, y: x + y, (F.col(names[k]) * float(b[i, j]) for i, k in enumerate(lag)))).alias(c) for j, c in enumerate(columns)))
    o = causal_order(residuals, columns, measure)
    b0 = weights_for(moments(residuals, columns), o)
    weights = np.zeros((tau_max + 1, d, d))
    weights[0] = b0.T
    for k in range(1, tau_max + 1):
        weights[k] = ((np.eye(d) - b0) @ b[(k - 1) * d : k * d].T).T
    if prune:
        weights[1:][np.abs(weights[1:]) < 0.05] = 0
    marks = np.zeros_like(weights, dtype=np.int8)
    marks[1:][weights[1:] != 0] = TAIL
    for i, j in zip(*np.nonzero(weights[0]), strict=True):
        orient.arrow(marks[0], i, j)
    return TemporalGraph(marks, tuple(columns), weights, {"causal_order": [columns[v] for v in o]})


def varma_lingam(df: DataFrame, order: str, *, ar=1, ma=1, measure="pwling", columns=None, series=None) -> TemporalGraph:
    """A vector ARMA in two regressions (a long autoregression's residuals stand for the shocks), then DirectLiNGAM."""
    columns = columns or [c for c in numeric_columns(df) if c not in (order, series)]
    d, long = len(columns), 2 * (ar + ma) + 4
    table, names = design(df, columns, order, long, series)
    m = moments(table, names)
    lag = list(range(d, len(names)))
    b = np.linalg.solve(m.cov[np.ix_(lag, lag)], m.cov[np.ix_(lag, list(range(d)))])
    shock = [f"{c}__shock" for c in columns]
    with_shocks = table.select("*", *((F.col(c) - reduce(lambda x, y: x + y, (F.col(names[k]) * float(b[i, j]) for i, k in enumerate(lag)))).alias(s) for j, (c, s) in enumerate(zip(columns, shock, strict=True))))
    second, every = design(with_shocks, [*columns, *shock], order, max(ar, ma), series)
    wanted = [f"{c}__{k}" for k in range(1, ar + 1) for c in columns] + [f"{s}__{k}" for k in range(1, ma + 1) for s in shock]
    del every
    mm = moments(second, [*columns, *wanted])
    p = list(range(d, d + len(wanted)))
    coef = np.linalg.solve(mm.cov[np.ix_(p, p)], mm.cov[np.ix_(p, list(range(d)))])
    residuals = second.select(*((F.col(c) - reduce(lambda x, y: x + y, (F.col(w) * float(coef[i, j]) for i, w in enumerate(wanted)))).alias(c) for j, c in enumerate(columns)))
    o = causal_order(residuals, columns, measure)
    b0 = weights_for(moments(residuals, columns), o)
    weights = np.zeros((ar + 1, d, d))
    weights[0] = b0.T
    for k in range(1, ar + 1):
        weights[k] = ((np.eye(d) - b0) @ coef[(k - 1) * d : k * d].T).T
    theta = np.stack([(np.eye(d) - b0) @ coef[(ar + k) * d : (ar + k + 1) * d].T @ np.linalg.inv(np.eye(d) - b0) for k in range(ma)]) if ma else np.zeros((0, d, d))
    marks = np.zeros_like(weights, dtype=np.int8)
    marks[1:][weights[1:] != 0] = TAIL
    for i, j in zip(*np.nonzero(weights[0]), strict=True):
        orient.arrow(marks[0], i, j)
    return TemporalGraph(marks, tuple(columns), weights, {"ma_weights": theta, "causal_order": [columns[v] for v in o]})


def longitudinal_lingam(df: DataFrame, unit: str, occasion: str, *, tau_max=1, measure="pwling", columns=None) -> dict:
    """At each occasion: regression on the occasions before, then DirectLiNGAM of the residuals. Keyed by occasion.

    All occasions share their scans: one for the moments, then one for each variable.
    """
    columns = columns or [c for c in numeric_columns(df) if c not in (unit, occasion)]
    table, names = design(df, columns, occasion, tau_max, unit)
    d, out, maps, ms, lagged_weights = len(columns), {}, {}, {}, {}
    lag = list(range(d, len(names)))
    by = {t: m for t, m in moments_by(table, names, occasion).items() if m.n > len(names)}
    for t, m in by.items():
        b = np.linalg.lstsq(m.cov[np.ix_(lag, lag)], m.cov[np.ix_(lag, list(range(d)))], rcond=None)[0]
        maps[t], lagged_weights[t] = np.vstack([np.eye(d), -b]), b
        ms[t] = Moments(tuple(columns), m.n, m.mean @ maps[t], maps[t].T @ m.cov @ maps[t])
    known = table.where(F.col(occasion).isin(list(by))) if by else table
    for t, o in causal_orders(known, names, occasion, maps, ms, measure).items():
        b, b0 = lagged_weights[t], weights_for(ms[t], o)
        weights = np.stack([b0.T, *(((np.eye(d) - b0) @ b[k * d : (k + 1) * d].T).T for k in range(tau_max))])
        marks = np.zeros_like(weights, dtype=np.int8)
        marks[1:][weights[1:] != 0] = TAIL
        for i, j in zip(*np.nonzero(weights[0]), strict=True):
            orient.arrow(marks[0], i, j)
        out[t] = TemporalGraph(marks, tuple(columns), weights)
    return dict(sorted(out.items()))
