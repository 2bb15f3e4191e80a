"""Local scores of a node given parents; lower is better, on the scale of -2 log likelihood plus penalty."""

from __future__ import annotations

import math

import numpy as np

from tessera.functions import special
from tessera.operators import cells as cell_tables
from tessera.operators.ci import Mixed, degenerate
from tessera.operators.moments import Moments, moments
from tessera.operators.profile import categorical_columns, checked, normal_scores, numeric_columns


class Score:
    """`local(node, parents)`, cached; d variables, n rows."""

    names: tuple[str, ...]
    n: int

    def __init__(self):
        self._cache: dict = {}

    @property
    def d(self) -> int:
        return len(self.names)

    def _local(self, node: int, parents: tuple[int, ...]) -> float:
        raise NotImplementedError

    def local(self, node: int, parents) -> float:
        key = node, tuple(sorted(parents))
        if key not in self._cache:
            if len(self._cache) > 1_000_000:
                self._cache.clear()
            self._cache[key] = self._local(*key)
        return self._cache[key]

    def total(self, adjacency: np.ndarray) -> float:
        return sum(self.local(j, np.flatnonzero(adjacency[:, j]).tolist()) for j in range(self.d))


def ebic_penalty(k: int, d: int, gamma: float) -> float:
    """2 gamma ln C(d - 1, k)."""
    return 2 * gamma * (math.lgamma(d) - math.lgamma(k + 1) - math.lgamma(d - k)) if gamma and k else 0.0


class BIC(Score):
    """n ln(residual variance) + k ln(n) penalty + extended term; infinite where parents determine the node."""

    def __init__(self, m: Moments, penalty_discount: float = 1.0, ebic_gamma: float = 0.0, n_of=None):
        super().__init__()
        self.names, self.n, self.cov, self.pen, self.gamma = m.names, m.n, m.cov, penalty_discount, ebic_gamma

    def residual(self, cov, node, parents) -> float:
        if not parents:
            return float(cov[node, node])
        p = list(parents)
        try:
            b = np.linalg.solve(cov[np.ix_(p, p)], cov[p, node])
        except np.linalg.LinAlgError:
            return 0.0
        return float(cov[node, node] - cov[p, node] @ b)

    def _local(self, node, parents):
        k = len(parents)
        r = self.residual(self.cov, node, parents)
        if k > self.n - 2 or r <= 1e-12 * self.cov[node, node]:
            return math.inf
        return self.n * math.log(r) + self.pen * k * math.log(self.n) + ebic_penalty(k, self.d, self.gamma)


#: Beyond this ratio of a residual to a variance a rank-one update is replaced by two full scores.
THIN = 1e-8


def _extended(score: BIC, k: int) -> float:
    return score.pen * k * math.log(score.n) + ebic_penalty(k, score.d, score.gamma)


def _is_plain(score: Score) -> bool:
    return type(score) is BIC


def add_deltas(score: Score, node: int, base) -> np.ndarray:
    """score(node, base + u) - score(node, base) for every variable u at once; nan for the node and the base.

    For the Gaussian BIC one elimination of the base from the covariances gives all partial correlations with the node;
    variables that the base nearly determines, and other scores, take two full scores.
    """
    base, d = sorted(base), score.d
    out = np.full(d, np.nan)
    others = np.array([u for u in range(d) if u != node and u not in base], int)
    if _is_plain(score) and len(others) and len(base) + 1 <= score.n - 2:
        c = score.cov
        cols = [node, *others]
        rest_nu, rest_uu = c[node, cols].copy(), np.diag(c)[cols].copy()
        if base:
            try:
                solved = np.linalg.solve(c[np.ix_(base, base)], c[np.ix_(base, cols)])
            except np.linalg.LinAlgError:
                solved = None
            if solved is None:
                rest_uu[:] = 0
            else:
                rest_nu -= c[base, node] @ solved
                rest_uu -= (c[np.ix_(base, cols)] * solved).sum(axis=0)
        own, rest_nu, rest_uu = rest_uu[0], rest_nu[1:], rest_uu[1:]
        sound = (rest_uu > THIN * np.diag(c)[others]) & (own > THIN * c[node, node])
        with np.errstate(divide="ignore", invalid="ignore"):
            left = 1 - rest_nu**2 / (rest_uu * own)
            sound &= left > THIN
            out[others] = score.n * np.log(np.where(sound, left, 1.0)) + _extended(score, len(base) + 1) - _extended(score, len(base))
        others = others[~sound]
    for u in others:
        out[u] = score.local(node, [*base, int(u)]) - score.local(node, base)
    return out


def remove_deltas(score: Score, node: int, base) -> np.ndarray:
    """score(node, base - u) - score(node, base) for every u of the base at once; nan for the others."""
    base, out = sorted(base), np.full(score.d, np.nan)
    left = list(base)
    if _is_plain(score) and base and len(base) <= score.n - 2:
        own = [node, *base]
        c = score.cov[np.ix_(own, own)]
        sd = np.sqrt(np.diag(c))
        r = c / np.outer(sd, sd)
        if np.linalg.eigvalsh(r)[0] > THIN:
            k = np.linalg.inv(r)
            rho2 = k[0, 1:] ** 2 / (k[0, 0] * np.diag(k)[1:])
            out[base] = -score.n * np.log1p(-rho2) + _extended(score, len(base) - 1) - _extended(score, len(base))
            left = []
    for u in left:
        out[u] = score.local(node, [v for v in base if v != u]) - score.local(node, base)
    return out


def local_delta(score: Score, node: int, base, u: int, op: str) -> float:
    """The change of a node's score as one parent comes or goes: op is add or remove."""
    if op not in ("add", "remove"):
        raise ValueError(f"op is add or remove, not {op}")
    return float((add_deltas if op == "add" else remove_deltas)(score, node, base)[u])


def score_many_with_base(score: Score, node: int, base, moves: list[tuple[str, int]]) -> np.ndarray:
    """score(node, base with each move): moves are (add or remove, variable)."""
    whole = score.local(node, base)
    if not math.isfinite(whole):  # no difference can be taken from a base that determines the node
        return np.array([score.local(node, [*base, u] if op == "add" else [v for v in base if v != u]) for op, u in moves])
    ops = {op for op, _ in moves}
    d = {op: f(score, node, base) for op, f in (("add", add_deltas), ("remove", remove_deltas)) if op in ops}
    return np.array([whole + d[op][u] for op, u in moves])


class InterventionalBIC(BIC):
    """Each node scored on the rows where it isn't intervened on; ln of all rows in the penalty."""

    def __init__(self, per_node: list[Moments], n: int, penalty_discount: float = 1.0, ebic_gamma: float = 0.0):
        super().__init__(per_node[0], penalty_discount, ebic_gamma)
        self.per_node, self.n = per_node, n

    def _local(self, node, parents):
        m, k = self.per_node[node], len(parents)
        r = self.residual(m.cov, node, parents)
        if k > m.n - 2 or r <= 1e-12 * m.cov[node, node]:
            return math.inf
        return m.n * math.log(r) + self.pen * k * math.log(self.n) + ebic_penalty(k, self.d, self.gamma)


class CategoricalBIC(Score):
    def __init__(self, table: cell_tables.Cells, penalty_discount: float = 1.0):
        super().__init__()
        self.names, self.n, self.cells, self.pen = table.names, table.n, table, penalty_discount

    def _local(self, node, parents):
        t = self.cells.family(node, list(parents))
        sizes = self.cells.sizes()
        with np.errstate(divide="ignore", invalid="ignore"):
            ll = np.where(t > 0, t * np.log(t / t.sum(axis=1, keepdims=True)), 0.0).sum()
        return float(-2 * ll + self.pen * math.log(self.n) * math.prod(sizes[p] for p in parents) * (sizes[node] - 1))


class BDeu(Score):
    """-2 log marginal likelihood with an equivalent sample size and a structure prior."""

    def __init__(self, table: cell_tables.Cells, equivalent_sample_size: float = 1.0, structure_prior: float = 1.0):
        super().__init__()
        self.names, self.n, self.cells, self.ess, self.prior = table.names, table.n, table, equivalent_sample_size, structure_prior

    def _local(self, node, parents):
        sizes, t = self.cells.sizes(), self.cells.family(node, list(parents))
        q, r = math.prod(sizes[p] for p in parents), sizes[node]
        a, b = self.ess / q, self.ess / (q * r)
        ll = (math.lgamma(a) - special.log_gamma(t.sum(axis=1) + a)).sum() + (special.log_gamma(t + b) - math.lgamma(b)).sum()
        p = self.prior / (self.d - 1) if self.d > 1 else 1.0
        if p < 1:
            ll += len(parents) * math.log(p) + (self.d - 1 - len(parents)) * math.log(1 - p)
        return float(-2 * ll)


class DGScore(Score):
    """n ln det S(node | parents) + ln(n) times the product of the widths, on indicator columns."""

    def __init__(self, table: cell_tables.Cells, penalty_discount: float = 1.0):
        super().__init__()
        mixed = Mixed(table)
        self.m, self.owners = degenerate(mixed)
        self.names, self.n, self.pen = mixed.names, self.m.n, penalty_discount

    def _local(self, node, parents):
        a, g, c = self.owners[node], [j for p in parents for j in self.owners[p]], self.m.cov
        s = c[np.ix_(a, a)]
        if g:
            s = s - c[np.ix_(a, g)] @ np.linalg.pinv(c[np.ix_(g, g)], rcond=1e-10, hermitian=True) @ c[np.ix_(g, a)]
        sign, logdet = np.linalg.slogdet(s)
        return math.inf if sign <= 0 else float(self.n * logdet + self.pen * math.log(self.n) * len(a) * len(g))


class CGScore(Score):
    """-2 (l(family) - l(parents)) plus the parameters' penalty, of conditional Gaussian models."""

    def __init__(self, table: cell_tables.Cells, penalty_discount: float = 1.0):
        from tessera.operators.ci import CGTest

        super().__init__()
        self.test = CGTest(table)
        self.names, self.n, self.pen = self.test.names, table.n, penalty_discount

    def _local(self, node, parents):
        (a, ka), (b, kb) = self.test.fit(sorted((node, *parents))), self.test.fit(parents)
        return -2 * (a - b) + self.pen * math.log(self.n) * (ka - kb)


def make_score(df, name: str | None = None, columns=None, categorical=None, *, penalty_discount: float = 1.0, ebic_gamma: float = 1.0, equivalent_sample_size: float = 1.0) -> Score:
    """A score by name; without one, bdeu for categories, cond_gauss for mixed data, bic for numbers."""
    categorical = categorical_columns(df) if categorical is None else categorical
    columns = columns or [c for c in df.columns if c in categorical or c in numeric_columns(df)]
    own = [c for c in columns if c in categorical]
    name = name or ("bdeu" if len(own) == len(columns) else "cond_gauss" if own else "bic")
    if name == "bic" and own:
        name = "discrete_bic"
    if name in ("bic", "normal_scores"):
        data = checked(df, columns)
        return BIC(moments(normal_scores(data, columns) if name == "normal_scores" else data, columns), penalty_discount, ebic_gamma)
    con = [c for c in columns if c not in own]
    table = cell_tables.cells(df, own, con)
    if name == "bdeu":
        return BDeu(table, equivalent_sample_size)
    kinds = {"discrete_bic": CategoricalBIC, "cond_gauss": CGScore, "degenerate_gauss": DGScore}
    if name not in kinds:
        raise ValueError(f"no score {name}; known: bic, normal_scores, bdeu, {', '.join(kinds)}")
    return kinds[name](table, penalty_discount)
