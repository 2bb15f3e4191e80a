"""Linear non-Gaussian models.

Residuals of linear regressions are linear in the columns, so a peel of the causal order needs no new table: the
coefficients of each residual go to the rows, and one pass sums the nonlinear moments of all pairs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from tessera.functions import special
from tessera.operators.ci import bounded_rows, hsic
from tessera.operators.moments import Moments, moments
from tessera.operators.profile import checked, numeric_columns
from tessera.operators.rowwise import Fetched, fetched, row_sums, row_sums_by
from tessera.plans.graph import CIRCLE, Graph, has_cycle
from tessera.plans.knowledge import Constraints, resolved

#: Constants of the maximum-entropy approximation: fixed values.
K1, K2, GAMMA = 79.047, 7.4129, 0.37457
H_NORMAL = 0.5 * (1 + math.log(2 * math.pi))


def entropy_of(log_cosh: np.ndarray, gauss: np.ndarray) -> np.ndarray:
    """Entropy of a standardised variable from E log cosh u and E u exp(-u^2 / 2)."""
    return H_NORMAL - K1 * (log_cosh - GAMMA) ** 2 - K2 * gauss**2


def _pair_weights(cov: np.ndarray, w: np.ndarray, left: list[int]) -> tuple[list, np.ndarray]:
    """Unit-variance combinations of the columns: each remaining variable, then each pair's residual i on j."""
    c = w @ cov @ w.T
    pairs, rows = [(i, None) for i in left], [w[i] / math.sqrt(c[i, i]) for i in left]
    for i in left:
        for j in left:
            if i != j:
                r = w[i] - c[i, j] / c[j, j] * w[j]
                pairs.append((i, j))
                rows.append(r / math.sqrt(max(r @ cov @ r, 1e-300)))
    return pairs, np.array(rows)


def score_plan(m: Moments, w: np.ndarray, left: list[int], measure: str) -> tuple:
    """(f, finish): what a scan sums over the rows of the variables, and the exogeneity of each remaining one from that."""
    if measure == "pwling":
        pairs, weights = _pair_weights(m.cov, w, left)

        def f(x):
            u = (x - m.mean) @ weights.T
            a = np.abs(u)
            return np.concatenate([(a + np.log1p(np.exp(-2 * a)) - math.log(2)).sum(axis=0), (u * np.exp(-(u**2) / 2)).sum(axis=0)])

        def finish(n, s):
            h = dict(zip(pairs, entropy_of(*np.split(s / n, 2)), strict=True))
            diff = {(i, j): (h[j, None] + h[i, j]) - (h[i, None] + h[j, i]) for i in left for j in left if i != j}
            return {i: -sum(min(0.0, diff[i, j]) ** 2 for j in left if j != i) for i in left}

        return f, finish
    c = w @ m.cov @ w.T
    u = np.array([w[i] / math.sqrt(c[i, i]) for i in left])
    rho, k = u @ m.cov @ u.T, len(left)

    def f(x):
        v = (x - m.mean) @ u.T
        g = np.tanh(v) if measure == "tanh" else v**2
        extra = (v**3).sum(axis=0) if measure == "skew" else np.zeros(k)
        return np.concatenate([(v.T @ g).ravel(), extra])

    def finish(n, s):
        e, third = s[: k * k].reshape(k, k) / n, s[k * k :] / n
        if measure == "skew":
            sign = np.sign(third)
            r = rho * (e.T * sign[:, None] - e * sign[None, :])  # rho * (E x_i^2 x_j - E x_i x_j^2), signed
        else:
            r = rho * (e - e.T)
        return {v: -float((np.minimum(0.0, r[a]) ** 2).sum()) for a, v in enumerate(left)}

    return f, finish


def scores(df: DataFrame, columns: list[str], m: Moments, w: np.ndarray, left: list[int], measure: str) -> dict[int, float]:
    """Exogeneity of each remaining variable; higher is more exogenous."""
    f, finish = score_plan(m, w, left, measure)
    return finish(*row_sums(df, columns, f))


def _peel(w: np.ndarray, cov: np.ndarray, left: list[int], v: int) -> None:
    """Take a variable's part out of the others: w holds each as a combination of the columns."""
    c = w @ cov @ w.T
    for i in left:
        if i != v:
            w[i] = w[i] - c[i, v] / c[v, v] * w[v]
    left.remove(v)


def causal_orders(df: DataFrame, columns: list[str], group: str, maps: dict, ms: dict, measure: str = "pwling") -> dict:
    """A causal order for each group of rows, all in step: one scan for each variable, whatever the number of groups.

    maps[g]: the group's variables as combinations (columns x variables) of the table's; ms[g]: their moments.
    """
    d = next(iter(maps.values())).shape[1] if maps else 0
    state = {g: (np.eye(d), list(range(d)), []) for g in maps}
    for _ in range(d - 1):
        plans = {g: score_plan(ms[g], w, left, measure) for g, (w, left, _) in state.items()}
        fs = {g: f for g, (f, _) in plans.items()}
        found = row_sums_by(df, columns, group, lambda g, x, fs=fs: fs[g](x @ maps[g]))
        for g, (w, left, order) in state.items():
            s = plans[g][1](*found[g])
            v = max(left, key=lambda i, s=s: (round(s[i], 9), -i))
            _peel(w, ms[g].cov, left, v)
            order.append(v)
    return {g: order + left for g, (_, left, order) in state.items()}


def causal_order(df: DataFrame, columns: list[str], measure: str = "pwling", c: Constraints | None = None, m: Moments | None = None) -> list[int]:
    """Most exogenous first. Each step reads the rows once; a small table is fetched before the first."""
    m, d = m or moments(df, columns), len(columns)
    df = fetched(df, columns, m.n)
    w, left, order = np.eye(d), list(range(d)), []
    before = c.required.copy() if c is not None else np.zeros((d, d), bool)
    if c is not None:
        for a, b in c.paths:
            before[a, b] = True
    while left:
        free = [v for v in left if not any(before[u, v] for u in left)] or left
        s = scores(df, columns, m, w, left, measure) if len(left) > 1 else {left[0]: 0.0}
        v = max(free, key=lambda i: (round(s[i], 9), -i))
        _peel(w, m.cov, left, v)
        order.append(v)
    return order


def lasso_path(g: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Coefficients at the knots of the lasso's path, from none to least squares: least angle steps from products alone."""
    d = len(b)
    beta, active, path = np.zeros(d), [], [np.zeros(d)]
    for _ in range(8 * d):
        c = b - g @ beta
        top = float(np.abs(c).max(initial=0.0))
        if top <= 1e-12 * max(1.0, float(np.abs(b).max(initial=0.0))):
            break
        if not active:
            active = [int(np.argmax(np.abs(c)))]
        s = np.sign(c[active])
        try:
            w = np.linalg.solve(g[np.ix_(active, active)], s)
        except np.linalg.LinAlgError:
            break
        rate = g[:, active] @ w
        step, event = top, None  # to where all correlations vanish
        for j in range(d):
            if j not in active:
                for x, y in ((top - c[j], 1 - rate[j]), (top + c[j], 1 + rate[j])):
                    if y > 1e-14 and 1e-14 < x / y < step:
                        step, event = float(x / y), ("in", j)
        for k, j in enumerate(active):
            if w[k] * beta[j] < 0 and 1e-14 < -beta[j] / w[k] < step:
                step, event = float(-beta[j] / w[k]), ("out", j)
        beta = beta.copy()
        beta[active] += step * w
        if event is None:
            path.append(beta)
            break
        if event[0] == "in":
            active.append(event[1])
        else:
            beta[event[1]] = 0.0
            active.remove(event[1])
        path.append(beta)
    return path


def adaptive_lasso(m: Moments, predictors: list[int], target: int) -> np.ndarray:
    """OLS weights, then the lasso's path on columns scaled by them, its knot chosen by BIC; from the Gram matrix alone."""
    p = list(predictors)
    if not p:
        return np.zeros(0)
    g, b = m.cov[np.ix_(p, p)], m.cov[p, target]
    w = np.abs(np.linalg.solve(g, b))
    g, b, yy = g * np.outer(w, w), b * w, m.cov[target, target]

    def bic(beta):
        rss = max(yy - 2 * beta @ b + beta @ g @ beta, 1e-300)
        return m.n * math.log(rss) + np.count_nonzero(beta) * math.log(m.n)

    return min(lasso_path(g, b), key=bic) * w


def weights_for(m: Moments, order: list[int], c: Constraints | None = None) -> np.ndarray:
    """[effect, cause] weights of a causal order."""
    b = np.zeros((m.d, m.d))
    for k, v in enumerate(order):
        p = [u for u in order[:k] if c is None or not c.forbidden[u, v]]
        b[v, p] = adaptive_lasso(m, p, v)
    return b


def _graph(b: np.ndarray, names, order, **meta) -> Graph:
    return Graph(Graph.of_dag(b.T != 0).marks, "dag", names, meta={"weights": b, "causal_order": [names[v] for v in order], **meta})


def direct_lingam(df: DataFrame, *, measure: str = "pwling", columns=None, knowledge=None) -> Graph:
    columns = columns or numeric_columns(df)
    data, c = checked(df, columns), resolved(knowledge, columns)
    m = moments(data, columns)
    order = causal_order(data, columns, measure, c, m)
    return _graph(weights_for(m, order, c), columns, order)


def multi_group_direct_lingam(frames: list[DataFrame], *, measure: str = "pwling", columns=None) -> list[Graph]:
    """One order for all groups: their scores add by sample size; weights for each group."""
    columns = columns or numeric_columns(frames[0])
    data = [checked(f, columns) for f in frames]
    ms, d = [moments(f, columns) for f in data], len(columns)
    ws, left, order = [np.eye(d) for _ in ms], list(range(d)), []
    while left:
        total = dict.fromkeys(left, 0.0)
        if len(left) > 1:
            for f, m, w in zip(data, ms, ws, strict=True):
                for v, s in scores(f, columns, m, w, left, measure).items():
                    total[v] += s * m.n
        v = max(left, key=lambda i: (round(total[i], 9), -i))
        for m, w in zip(ms, ws, strict=True):
            cov = w @ m.cov @ w.T
            for i in left:
                if i != v:
                    w[i] = w[i] - cov[i, v] / cov[v, v] * w[v]
        order.append(v)
        left.remove(v)
    return [_graph(weights_for(m, order), columns, order) for m in ms]


def fast_ica(x: np.ndarray, seed: int = 0, max_iter: int = 1000) -> np.ndarray:
    """Unmixing matrix by symmetric fixed-point steps with log cosh contrast."""
    rng = np.random.default_rng(seed)
    x = x - x.mean(axis=0)
    n, d = x.shape
    vals, vecs = np.linalg.eigh(x.T @ x / n)
    white = vecs / np.sqrt(vals) @ vecs.T
    z = x @ white
    w = np.linalg.qr(rng.standard_normal((d, d)))[0]
    for _ in range(max_iter):
        g = np.tanh(z @ w.T)
        new = g.T @ z / n - np.diag((1 - g**2).mean(axis=0)) @ w
        u, _, v = np.linalg.svd(new)
        new = u @ v
        done = np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < 1e-8
        w = new
        if done:
            break
    return w @ white


def fast_ica_table(df: DataFrame, columns: list[str], seed: int = 0, max_iter: int = 1000, start_rows: int = 10_000) -> np.ndarray:
    """The unmixing matrix of all rows: the fixed-point steps are expectations over the table, one scan each.

    They start from the solution of `start_rows` rows, so that a few steps reach the table's own.
    """
    m = moments(df, columns)
    df = fetched(df, columns, m.n)
    vals, vecs = np.linalg.eigh(m.cov * (m.n - 1) / m.n)
    white = vecs / np.sqrt(vals) @ vecs.T
    some = df.x[:start_rows] if isinstance(df, Fetched) else bounded_rows(df, columns, start_rows, seed)
    w = fast_ica(some, seed, max_iter) @ np.linalg.inv(white)
    u, _, v = np.linalg.svd(w)
    w, d = u @ v, len(columns)
    for _ in range(max_iter):

        def step(x, w=w):
            z = (x - m.mean) @ white
            g = np.tanh(z @ w.T)
            return np.concatenate([(g.T @ z).ravel(), (1 - g**2).sum(axis=0)])

        n, s = row_sums(df, columns, step)
        new = (s[: d * d].reshape(d, d) - np.diag(s[d * d :]) @ w) / n
        u, _, v = np.linalg.svd(new)
        new = u @ v
        done = np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < 1e-8
        w = new
        if done:
            break
    return w @ white


def assignment(cost: np.ndarray) -> np.ndarray:
    """Least-cost row for each column: shortest augmenting paths."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used, way = np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], np.inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    cur = cost[i0 - 1, j - 1] - u[i0] - v[j]
                    if cur < low[j]:
                        low[j], way[j] = cur, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return match[1:] - 1


def ica_lingam(df: DataFrame, *, seed=0, max_iter=1000, columns=None, start_rows: int = 10_000) -> Graph:
    """ICA-LiNGAM: unmixing matrix and weights are those of all rows."""
    columns = columns or numeric_columns(df)
    data = checked(df, columns)
    w = fast_ica_table(data, columns, seed or 0, max_iter, start_rows)
    w = w[assignment(1 / np.maximum(np.abs(w), 1e-12))]
    w = w / np.diag(w)[:, None]
    b = np.eye(len(w)) - w
    small = np.argsort(np.abs(b), axis=None)
    for k in range(len(columns) * (len(columns) + 1) // 2, b.size + 1):
        a = b.copy()
        a.ravel()[small[:k]] = 0
        if not has_cycle((a != 0).T):
            break
    from tessera.plans.graph import order_of

    order = order_of((a != 0).T)
    return _graph(weights_for(moments(data, columns), order), columns, order)


def fisher_pooled(p: np.ndarray) -> float:
    p = np.maximum(np.asarray(p, float), 1e-300)
    return float(special.chi2_sf(-2 * np.log(p).sum(), 2 * len(p)))


def bottom_up_parce_lingam(df: DataFrame, *, alpha=0.05, columns=None, most_rows=2_000) -> Graph:
    """Sinks whose residuals are independent of the rest come off from the bottom; what is left is unordered."""
    columns = columns or numeric_columns(df)
    data = checked(df, columns)
    x = bounded_rows(data, columns, most_rows)
    x = x - x.mean(axis=0)
    left, order = list(range(len(columns))), []
    while len(left) > 1:
        found = []
        for v in left:
            p = [u for u in left if u != v]
            r = x[:, v] - x[:, p] @ np.linalg.lstsq(x[:, p], x[:, v], rcond=None)[0]
            found.append((fisher_pooled([hsic(r, x[:, u])[1] for u in p]), v))
        p, v = max(found)
        if p <= alpha:
            break
        order.insert(0, v)
        left.remove(v)
    m, b = moments(data, columns), np.zeros((len(columns),) * 2)
    marks = np.zeros((len(columns),) * 2, np.int8)
    for k, v in enumerate(order):
        p = [*left, *order[:k]]
        b[v, p] = adaptive_lasso(m, p, v)
        for u in p:
            if b[v, u]:
                marks[u, v], marks[v, u] = 1, 2
    for i in left:
        for j in left:
            if i != j:
                marks[i, j] = CIRCLE
    return Graph(marks, "pag", columns, meta={"order": [[columns[v] for v in left], *([columns[v]] for v in order)], "weights": b})


def rcd(df: DataFrame, *, max_depth=2, cor_alpha=0.01, alpha=0.01, columns=None, most_rows=2_000) -> Graph:
    """Repetitive causal discovery: ancestors by independent residuals, parents, then confounded pairs as <->."""
    from itertools import combinations

    from tessera.operators.ci import FisherZ
    from tessera.operators.moments import of_matrix

    columns = columns or numeric_columns(df)
    x = bounded_rows(checked(df, columns), columns, most_rows)
    x = x - x.mean(axis=0)
    d = x.shape[1]
    up: list[set[int]] = [set() for _ in range(d)]

    def residual(v, on):
        on = list(on)
        return x[:, v] - x[:, on] @ np.linalg.lstsq(x[:, on], x[:, v], rcond=None)[0] if on else x[:, v]

    def dependent(a, b):
        return FisherZ(of_matrix(np.column_stack([a, b]))).pvalue(0, 1) < cor_alpha

    size, changed = 1, True
    while size <= max_depth:
        changed = False
        for group in combinations(range(d), size + 1):
            common = set.intersection(*(up[v] for v in group))
            r = {v: residual(v, common) for v in group}
            if any(v in up[u] for u in group for v in group) or not all(dependent(r[a], r[b]) for a, b in combinations(group, 2)):
                continue
            sinks = []
            for v in group:
                rest = [u for u in group if u != v]
                a = np.column_stack([r[u] for u in rest])
                e = r[v] - a @ np.linalg.lstsq(a, r[v], rcond=None)[0]
                if all(hsic(e, r[u])[1] > alpha for u in rest):
                    sinks.append(v)
            if len(sinks) == 1:
                new = set(group) - {sinks[0]} - up[sinks[0]]
                if new:
                    up[sinks[0]] |= new
                    changed = True
        size = 1 if changed else size + 1
    marks = np.zeros((d, d), np.int8)
    for v in range(d):
        for u in up[v]:
            if dependent(residual(v, up[v] - {u}), residual(u, up[v] & up[u])):
                marks[u, v], marks[v, u] = 1, 2
    for a, b in combinations(range(d), 2):
        if a not in up[b] and b not in up[a]:
            pa, pb = (np.flatnonzero(marks[:, v] == 1).tolist() for v in (a, b))
            if dependent(residual(a, pa), residual(b, pb)):
                marks[a, b] = marks[b, a] = 2
    return Graph(marks, "pag", columns, meta={"ancestors": {columns[v]: sorted(columns[u] for u in up[v]) for v in range(d)}})


def gin(df: DataFrame, *, alpha=0.05, columns=None, most_rows=2_000) -> Graph:
    """Clusters of indicators by the generalised independent noise condition, and an order of their latents."""
    from itertools import combinations

    columns = columns or numeric_columns(df)
    x = bounded_rows(checked(df, columns), columns, most_rows)
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    cov, d = np.cov(x, rowvar=False), x.shape[1]

    def noise(y, z):
        """Pooled p-value that the surrogate of y given z is independent of z."""
        _, _, v = np.linalg.svd(cov[np.ix_(z, y)])
        e = x[:, y] @ v[-1]
        return fisher_pooled([hsic(e, x[:, k])[1] for k in z])

    clusters, free, size = [], set(range(d)), 2
    while size <= max(2, len(free) - 1):
        found = []
        for y in combinations(sorted(free), size):
            z = [v for v in range(d) if v not in y]
            if len(z) >= size and noise(list(y), z) >= alpha:
                found.append(set(y))
        merged: list[set[int]] = []
        for s in found:
            for t in [t for t in merged if t & s]:
                merged.remove(t)
                s = s | t
            merged.append(s)
        clusters += merged
        for s in merged:
            free -= s
        size += 1
        if len(free) < size:
            break
    order, left = [], [sorted(c) for c in clusters]
    while left:
        best = None
        for c in left:
            p = 1.0
            for other in left:
                if other is not c:
                    before = [v for k in order for v in k[: len(k) // 2]]
                    rest = [v for k in order for v in k[len(k) // 2 :]]
                    p = min(p, noise([*before, c[0], *other[:1]], [*rest, *c[1:]]) if c[1:] or rest else 1.0)
            if best is None or p > best[0]:
                best = p, c
        order.append(best[1])
        left.remove(best[1])
    k = len(order)
    marks = np.zeros((d + k, d + k), np.int8)
    for i, c in enumerate(order):
        for v in c:
            marks[d + i, v], marks[v, d + i] = 1, 2
        for j in range(i + 1, k):
            marks[d + i, d + j], marks[d + j, d + i] = 1, 2
    return Graph(marks, "dag", [*columns, *(f"L{i + 1}" for i in range(k))], frozenset(range(d, d + k)), meta={"clusters": [[columns[v] for v in c] for c in order]})


