"""Conditional-independence tests. A test answers queries (x, y, S) from statistics that one scan has gathered.

All p-values are independent of the order of x and y and of S.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from tessera.functions import special
from tessera.operators import cells as cell_tables
from tessera.operators.moments import Moments, moments
from tessera.operators.profile import DataError, categorical_columns, checked, normal_scores, numeric_columns
from tessera.operators.rowwise import row_sums

#: Correlations are kept this far from one; a variable of which the others leave less counts as dependent on them.
EPS, SINGULAR = 1e-12, 1e-12


class Test:
    """names: the variables. `many` gives p-values of queries; subclasses have `statistic` or `pvalue`."""

    names: tuple[str, ...]

    @property
    def d(self) -> int:
        return len(self.names)

    def pvalue(self, x: int, y: int, s=()) -> float:
        raise NotImplementedError

    def strength(self, x: int, y: int, s=()) -> float:
        """A statistic that grows with dependence."""
        return -math.log10(max(self.pvalue(x, y, s), 1e-300))

    def many(self, queries: list[tuple[int, int, tuple]]) -> np.ndarray:
        return np.array([self.pvalue(x, y, s) for x, y, s in queries])


class Correlation(Test):
    """Tests of partial correlations from a correlation matrix: closed forms up to one conditioner, stacked inverses above."""

    def __init__(self, m: Moments):
        self.names, self.n, self.r = m.names, m.n, m.corr

    def partial(self, x: int, y: int, s=()) -> float:
        return float(self.partials([(x, y, tuple(s))])[0])

    def partials(self, queries) -> np.ndarray:
        out, by = np.zeros(len(queries)), {}
        for k, (_, _, s) in enumerate(queries):
            by.setdefault(len(s), []).append(k)
        for size, at in by.items():
            idx = np.array([(*sorted((queries[k][0], queries[k][1])), *sorted(queries[k][2])) for k in at])
            r = self.r
            if size == 0:
                out[at] = r[idx[:, 0], idx[:, 1]]
            elif size == 1:
                a, b, c = idx.T
                out[at] = (r[a, b] - r[a, c] * r[b, c]) / np.sqrt((1 - r[a, c] ** 2) * (1 - r[b, c] ** 2))
            else:
                for lo in range(0, len(idx), 20_000):
                    some = idx[lo : lo + 20_000]
                    block = r[some[:, :, None], some[:, None, :]]
                    try:
                        p = np.linalg.inv(block)
                    except np.linalg.LinAlgError:
                        p = np.full_like(block, np.inf)
                    # a diagonal entry is one over the part of a variable that the others leave
                    own = np.diagonal(p, axis1=1, axis2=2)
                    if not ((own > 0) & (own < 1 / SINGULAR)).all():
                        raise DataError("variables of a test are linearly dependent")
                    out[np.array(at)[lo : lo + len(some)]] = -p[:, 0, 1] / np.sqrt(p[:, 0, 0] * p[:, 1, 1])
        return np.clip(out, -1 + EPS, 1 - EPS)

    def _p(self, r: np.ndarray, k: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def many(self, queries) -> np.ndarray:
        if not len(queries):
            return np.zeros(0)
        return self._p(self.partials(queries), np.array([len(q[2]) for q in queries]))

    def pvalue(self, x, y, s=()) -> float:
        return float(self.many([(x, y, tuple(s))])[0])

    def strength(self, x, y, s=()) -> float:
        return abs(self.partial(x, y, s))


class FisherZ(Correlation):
    def _p(self, r, k):
        df = self.n - k - 3
        if (df < 0).any():
            raise DataError("too few rows for so many conditioning variables")
        return special.erfc(np.sqrt(df) * np.abs(np.arctanh(r)) / math.sqrt(2))


class StudentT(Correlation):
    def _p(self, r, k):
        df = self.n - k - 2
        if (df <= 0).any():
            raise DataError("too few rows for so many conditioning variables")
        return special.t_two_sided(r * np.sqrt(df / (1 - r * r)), df)


def hypergeometric_g2(n: int, rows: np.ndarray, cols: np.ndarray) -> float:
    """Mean of 2 sum O ln(O / E) over shuffles of a table with these margins: exact for small expectations, else by moments."""
    total = 0.0
    for r in rows:
        for c in cols:
            mu = r * c / n
            if mu < 10:
                k = np.arange(max(1, r + c - n), min(r, c) + 1)
                logp = special.log_gamma(r + 1) - special.log_gamma(k + 1) - special.log_gamma(r - k + 1) + special.log_gamma(n - r + 1) - special.log_gamma(c - k + 1) - special.log_gamma(n - r - c + k + 1) - special.log_gamma(n + 1) + special.log_gamma(c + 1) + special.log_gamma(n - c + 1)
                total += float((np.exp(logp) * 2 * k * np.log(k / mu)).sum())
            else:
                var = mu * (1 - r / n) * (n - c) / (n - 1)
                third = var * (n - 2 * r) * (n - 2 * c) / (n * max(n - 2, 1))
                total += var / mu - third / (3 * mu**2) + 3 * var**2 / (6 * mu**3)
    return total


class ChiSquare(Test):
    """Pearson's or the likelihood-ratio statistic over the strata that occur; degrees of freedom are its mean under shuffles."""

    def __init__(self, table: cell_tables.Cells, g_square: bool = False):
        self.names, self.cells, self.g_square = table.names, table, g_square

    def statistic(self, x: int, y: int, s=()) -> tuple[float, float]:
        x, y = sorted((x, y))
        return self.of_table(self.cells.table(x, y, sorted(s)))

    def of_table(self, t: np.ndarray) -> tuple[float, float]:
        """(statistic, degrees of freedom) of counts [stratum, x, y]."""
        n = t.sum(axis=(1, 2))
        e = t.sum(axis=2)[:, :, None] * t.sum(axis=1)[:, None, :] / n[:, None, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            stat = np.where(t > 0, 2 * t * np.log(t / e), 0.0).sum() if self.g_square else np.where(e > 0, (t - e) ** 2 / e, 0.0).sum()
        rx, ry = (t.sum(axis=2) > 0).sum(axis=1), (t.sum(axis=1) > 0).sum(axis=1)
        if self.g_square:
            dof = sum(hypergeometric_g2(int(n[k]), t[k].sum(axis=1)[t[k].sum(axis=1) > 0], t[k].sum(axis=0)[t[k].sum(axis=0) > 0]) for k in range(len(t)) if rx[k] > 1 and ry[k] > 1)
        else:
            dof = np.where(n > 1, n * (rx - 1) * (ry - 1) / np.maximum(n - 1, 1), 0.0).sum()
        return float(stat), float(dof)

    def pvalue(self, x, y, s=()) -> float:
        stat, dof = self.statistic(x, y, s)
        return float(special.chi2_sf(stat, dof)) if dof > 0 else 1.0

    def strength(self, x, y, s=()) -> float:
        return self.statistic(x, y, s)[0]

    def many(self, queries) -> np.ndarray:
        if isinstance(self.cells, cell_tables.TableCells):
            self.cells.prefetch([[x, y, *s] for x, y, s in queries])
        return super().many(queries)

    def pvalues_given(self, target: int, candidates: list[int], s=()) -> np.ndarray:
        """p-values of the target and each candidate given one set, whose strata are found once."""
        if isinstance(self.cells, cell_tables.TableCells):
            return self.many([(target, v, tuple(s)) for v in candidates])
        key, k = self.cells.keys(sorted(s))
        sizes, out = self.cells.sizes(), []
        for v in candidates:
            t = np.zeros((k, sizes[target], sizes[v]))
            np.add.at(t, (key, self.cells.codes[:, target], self.cells.codes[:, v]), self.cells.counts)
            stat, dof = self.of_table(t if target < v else t.transpose(0, 2, 1))
            out.append(float(special.chi2_sf(stat, dof)) if dof > 0 else 1.0)
        return np.array(out)


class Mixed(Test):
    """Statistics of mixed data from joint cells; variables are the categorical columns, then the continuous ones."""

    def __init__(self, table: cell_tables.Cells):
        self.cells = table
        self.names = table.names + table.continuous
        self.k = len(table.names)
        total = table.sums.sum(axis=0) / table.n
        sd = np.sqrt(np.maximum(np.diagonal(table.products.sum(axis=0)) / table.n - total**2, 1e-300))
        self.mean, self.sd = total, sd

    def standard(self, columns: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Per cell: sums and products of standardised continuous columns."""
        c, mu, sd, n = columns, self.mean[columns], self.sd[columns], self.cells.counts
        s = self.cells.sums[:, c]
        p = self.cells.products[:, c][:, :, c]
        p = p - s[:, :, None] * mu[None, None] - mu[None, :, None] * s[:, None, :] + n[:, None, None] * np.outer(mu, mu)
        return (s - n[:, None] * mu) / sd, p / np.outer(sd, sd)


class CGTest(Mixed):
    """Likelihood ratio of conditional Gaussian models: 2 (l(xyS) - l(yS) - l(xS) + l(S))."""

    def fit(self, variables) -> tuple[float, float]:
        """(log likelihood, parameters) of a set of variables."""
        cat = [v for v in variables if v < self.k]
        con = [v - self.k for v in variables if v >= self.k]
        key, k = self.cells.keys(cat)
        n = np.bincount(key, self.cells.counts, minlength=k)
        total = float(n.sum())
        ll = float((n * np.log(n / total)).sum())
        d = len(con)
        if d:
            s, p = self.standard(con)
            sk, pk = np.zeros((k, d)), np.zeros((k, d, d))
            np.add.at(sk, key, s)
            np.add.at(pk, key, p)
            whole = pk.sum(axis=0) / total - np.outer(sk.sum(axis=0), sk.sum(axis=0)) / total**2
            cov = pk - sk[:, :, None] * sk[:, None, :] / n[:, None, None]
            cov = (cov + whole) / (n + 1)[:, None, None]
            scatter = pk - sk[:, :, None] * sk[:, None, :] / n[:, None, None]
            _, logdet = np.linalg.slogdet(cov)
            ll -= 0.5 * float((n * (d * math.log(2 * math.pi) + logdet) + np.einsum("kij,kji->k", scatter, np.linalg.inv(cov))).sum())
        sizes = self.cells.sizes()
        joint = math.prod(sizes[v] for v in cat)
        return ll, joint * (d * (d + 3) / 2 + 1) - 1

    def pvalue(self, x, y, s=()) -> float:
        (a, pa), (b, pb), (c, pc), (e, pe) = (self.fit(sorted(v)) for v in ((x, y, *s), (y, *s), (x, *s), s))
        dof = pa - pb - pc + pe
        return float(special.chi2_sf(2 * (a - b - c + e), dof)) if dof > 0 else 1.0


def degenerate(table: Mixed) -> tuple[Moments, list[list[int]]]:
    """Moments of the columns with each category but the last as an indicator, and each variable's columns."""
    t = table.cells
    sizes, n = t.sizes(), t.counts
    cols, owners = [], []
    for v in range(table.k):
        owners.append(list(range(len(cols), len(cols) + sizes[v] - 1)))
        cols += [(t.codes[:, v] == q).astype(float) for q in range(sizes[v] - 1)]
    for _ in t.continuous:
        owners.append([len(cols)])
        cols.append(None)
    d = len(cols)
    s, p = np.zeros((len(n), d)), np.zeros((len(n), d, d))
    con = [j for j in range(d) if cols[j] is None]
    for j in range(d):
        s[:, j] = t.sums[:, con.index(j)] if cols[j] is None else cols[j] * n
    for i in range(d):
        for j in range(d):
            if cols[i] is None and cols[j] is None:
                p[:, i, j] = t.products[:, con.index(i), con.index(j)]
            elif cols[i] is None:
                p[:, i, j] = t.sums[:, con.index(i)] * cols[j]
            elif cols[j] is None:
                p[:, i, j] = t.sums[:, con.index(j)] * cols[i]
            else:
                p[:, i, j] = n * cols[i] * cols[j]
    total = t.n
    mean = s.sum(axis=0) / total
    return Moments(tuple(map(str, range(d))), total, mean, (p.sum(axis=0) - total * np.outer(mean, mean)) / (total - 1)), owners


class DGTest(Mixed):
    """-n sum log(1 - rho^2) over canonical correlations given S, on indicator columns."""

    def __init__(self, table):
        super().__init__(table)
        self.m, self.owners = degenerate(self)

    def pvalue(self, x, y, s=()) -> float:
        c = self.m.cov
        a, b, g = self.owners[x], self.owners[y], [j for v in s for j in self.owners[v]]
        ab = a + b
        rest = c[np.ix_(ab, ab)]
        if g:
            rest = rest - c[np.ix_(ab, g)] @ np.linalg.pinv(c[np.ix_(g, g)], rcond=1e-10, hermitian=True) @ c[np.ix_(g, ab)]
        k = len(a)

        def root(m):
            w, v = np.linalg.eigh(m)
            keep = w > 1e-10 * max(w.max(initial=0), 1e-300)
            return v[:, keep] / np.sqrt(w[keep])

        ra, rb = root(rest[:k, :k]), root(rest[k:, k:])
        if not ra.shape[1] or not rb.shape[1]:
            return 1.0
        rho = np.clip(np.linalg.svd(ra.T @ rest[:k, k:] @ rb, compute_uv=False), 0, 1 - 1e-12)
        return float(special.chi2_sf(-self.m.n * np.log1p(-(rho**2)).sum(), ra.shape[1] * rb.shape[1]))


class Rows(Test):
    """Tests that need the rows: at most `most` of them, chosen by a seed, come to one place."""

    def __init__(self, x: np.ndarray, names, seed: int = 0):
        sd = x.std(axis=0)
        self.x, self.names, self.seed = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), tuple(names), seed


def _gram(x: np.ndarray, width: float) -> np.ndarray:
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    return np.exp(-d2 / (2 * width**2))


def median_width(x: np.ndarray, rows: int | None = 100) -> float:
    x = x[:rows] if rows else x
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    d = d[np.triu_indices(len(x), 1)]
    d = d[d > 0]
    return float(np.median(d)) if len(d) else 1.0


def centred(k: np.ndarray) -> np.ndarray:
    return k - k.mean(axis=0) - k.mean(axis=1)[:, None] + k.mean()


def hsic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(statistic, p-value) of the gamma approximation."""
    x, y = (np.asarray(v, float).reshape(len(v), -1) for v in (x, y))
    n = len(x)
    k, q = _gram(x, median_width(x)), _gram(y, median_width(y))
    kc, qc = centred(k), centred(q)
    stat = (kc * qc).sum() / n
    var = (kc * qc / 6) ** 2
    var = (var.sum() - np.trace(var)) / n / (n - 1) * 72 * (n - 4) * (n - 5) / n / (n - 1) / (n - 2) / (n - 3)
    off = 1 - np.eye(n)
    mx, my = (k * off).sum() / n / (n - 1), (q * off).sum() / n / (n - 1)
    mean = (1 + mx * my - mx - my) / n
    return float(stat), float(special.gamma_sf(stat, mean**2 / var, var * n / mean))


class KCI(Rows):
    """Kernel test with the gamma approximation; with conditioners, on kernel ridge residuals."""

    def pvalue(self, x, y, s=()) -> float:
        x, y = sorted((x, y))
        if not s:
            return hsic(self.x[:, [x]], self.x[:, [y]])[1]
        z = self.x[:, sorted(s)]
        n = len(z)
        width = math.sqrt(len(s)) * 0.8
        kx = centred(_gram(np.column_stack([self.x[:, [x]], z / 2]), width))
        ky, kz = centred(_gram(self.x[:, [y]], width)), centred(_gram(z, width))
        r = 1e-3 * np.linalg.inv(kz + 1e-3 * np.eye(n))
        kx, ky = r @ kx @ r, r @ ky @ r
        stat = (kx * ky).sum()
        prod = kx * ky  # entries of the product kernel's expansion
        wx, vx = np.linalg.eigh(kx)
        wy, vy = np.linalg.eigh(ky)
        keep_x, keep_y = wx > wx.max() * 1e-5, wy > wy.max() * 1e-5
        ux, uy = vx[:, keep_x] * np.sqrt(wx[keep_x]), vy[:, keep_y] * np.sqrt(wy[keep_y])
        w = (ux[:, :, None] * uy[:, None, :]).reshape(n, -1)
        ww = w @ w.T if w.shape[1] > n else w.T @ w
        mean, var = np.trace(ww), 2 * (ww * ww).sum()
        del prod
        return float(special.gamma_sf(stat, mean**2 / var, var / mean))


class RCoT(Rows):
    """Random Fourier features of x, y and S; a three-moment chi-square null."""

    def __init__(self, x, names, seed: int = 0, n_features: int = 5, n_features_cond: int = 100):
        super().__init__(x, names, seed)
        self.k, self.kc = n_features, n_features_cond

    def _features(self, columns: tuple, k: int) -> np.ndarray:
        rng = np.random.default_rng([self.seed, *columns, k])
        v = self.x[:, list(columns)]
        f = math.sqrt(2) * np.cos(v @ rng.standard_normal((v.shape[1], k)) / median_width(v, 500) + rng.uniform(0, 2 * math.pi, k))
        f = f - f.mean(axis=0)
        sd = f.std(axis=0)
        return f / np.where(sd > 0, sd, 1)

    def pvalue(self, x, y, s=()) -> float:
        x, y = sorted((x, y))
        a, b = self._features((x,), self.k), self._features((y,), self.k)
        n = len(a)
        if s:
            z = self._features(tuple(sorted(s)), self.kc)
            c = z.T @ z / n + 1e-10 * np.eye(z.shape[1])
            a, b = (v - z @ np.linalg.solve(c, z.T @ v / n) for v in (a, b))
        cov = (a - a.mean(axis=0)).T @ (b - b.mean(axis=0)) / n
        w = (a[:, :, None] * b[:, None, :]).reshape(n, -1)
        return three_moment_pvalue(n * float((cov**2).sum()), np.maximum(np.linalg.eigvalsh(np.cov(w, rowvar=False)), 0))


class RCoTTable(Test):
    """RCoT on all rows of a table: its statistics are moments of features, which two scans give a batch of queries.

    The first scan has the moments of the features of x, y and S, from which their regressions follow; the second those
    of the products of residuals. Kernel widths are medians over `width_rows` rows, as the method has it.
    """

    #: Numbers that a scan sums for a batch at most.
    AT_ONCE = 1 << 21

    def __init__(self, df: DataFrame, names, seed: int = 0, n_features: int = 5, n_features_cond: int = 100, width_rows: int = 500):
        self.df, self.names, self.seed, self.k, self.kc = df, tuple(names), seed, n_features, n_features_cond
        m = moments(df, list(names))
        self.n, self.mean, self.sd = m.n, m.mean, np.sqrt(np.where(np.diag(m.cov) > 0, np.diag(m.cov), 1) * (m.n - 1) / max(m.n, 1))
        self.some = (bounded_rows(df, list(names), width_rows, seed) - self.mean) / self.sd
        self._width: dict = {}

    def _map(self, columns: tuple, k: int):
        """Frequencies and phases of the features of some columns."""
        rng = np.random.default_rng([self.seed, *columns, k])
        if columns not in self._width:
            self._width[columns] = median_width(self.some[:, list(columns)], None)
        return list(columns), rng.standard_normal((len(columns), k)) / self._width[columns], rng.uniform(0, 2 * math.pi, k)

    def _maps(self, query) -> list:
        x, y, s = query
        x, y = sorted((x, y))
        return [self._map((x,), self.k), self._map((y,), self.k), *([self._map(tuple(sorted(s)), self.kc)] if s else [])]

    def pvalue(self, x, y, s=()) -> float:
        return float(self.many([(x, y, s)])[0])

    def many(self, queries) -> np.ndarray:
        width = (2 * self.k + (self.kc if any(q[2] for q in queries) else 0)) ** 2
        step = max(1, self.AT_ONCE // width)
        return np.array([p for at in range(0, len(queries), step) for p in self._batch(queries[at : at + step])])

    def _batch(self, queries) -> list[float]:
        names, mean, sd, k = list(self.names), self.mean, self.sd, self.k
        maps = [self._maps(q) for q in queries]

        def features(v, parts):
            return np.hstack([math.sqrt(2) * np.cos(v[:, c] @ w + p) for c, w, p in parts])

        def first(x):
            v, out = (x - mean) / sd, []
            for parts in maps:
                f = features(v, parts)
                out += [f.sum(axis=0), (f.T @ f).ravel()]
            return np.concatenate(out)

        n, sums = row_sums(self.df, names, first)
        fits, at = [], 0
        for parts in maps:
            d = sum(w.shape[1] for _, w, _ in parts)
            mu, second = sums[at : at + d] / n, sums[at + d : at + d + d * d].reshape(d, d) / n
            at += d + d * d
            cov = second - np.outer(mu, mu)
            scale = np.sqrt(np.where(np.diag(cov) > 1e-14, np.diag(cov), 1))
            cov = cov / np.outer(scale, scale)
            # residuals of the features of x and y: a linear map of all features
            to = np.eye(d)[:, : 2 * k]
            if d > 2 * k:
                to[2 * k :] = -np.linalg.solve(cov[2 * k :, 2 * k :] + 1e-10 * np.eye(d - 2 * k), cov[2 * k :, : 2 * k])
            fits.append((mu, to / scale[:, None], to.T @ cov @ to))

        def second(x):
            v, out = (x - mean) / sd, []
            for parts, (mu, to, _) in zip(maps, fits, strict=True):
                r = (features(v, parts) - mu) @ to
                w = (r[:, :k, None] * r[:, None, k:]).reshape(len(r), -1)
                out += [w.sum(axis=0), (w.T @ w).ravel()]
            return np.concatenate(out)

        _, sums = row_sums(self.df, names, second)
        out, size = [], k * k
        for j, (_, _, cov) in enumerate(fits):
            part = sums[j * (size + size * size) : (j + 1) * (size + size * size)]
            mu = part[:size] / n
            spread = (part[size:].reshape(size, size) - n * np.outer(mu, mu)) / max(n - 1, 1)
            out.append(three_moment_pvalue(n * float((cov[:k, k:] ** 2).sum()), np.maximum(np.linalg.eigvalsh(spread), 0)))
        return out


def three_moment_pvalue(stat: float, weights: np.ndarray) -> float:
    """P(sum of weighted chi-squares > stat) by the chi-square of the same first three cumulants."""
    k1, k2, k3 = weights.sum(), 2 * (weights**2).sum(), 8 * (weights**3).sum()
    if k2 <= 0:
        return 1.0
    nu = 8 * k2**3 / k3**2
    return float(special.chi2_sf(max(0.0, (stat - k1) / math.sqrt(k2) * math.sqrt(2 * nu) + nu), nu))


class CMIknn(Rows):
    """Nearest-neighbour conditional mutual information with a local permutation null."""

    def __init__(self, x, names, seed: int = 0, k: float = 0.1, k_perm: int = 5, permutations: int = 200):
        super().__init__(np.argsort(np.argsort(x, axis=0), axis=0) / len(x), names, seed)
        self.k, self.k_perm, self.permutations = k, k_perm, permutations

    def _cmi(self, x, y, z) -> float:
        n = len(x)
        k = max(1, min(n - 1, int(self.k * n) if self.k < 1 else int(self.k)))
        dx, dy = np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None])
        dz = np.abs(z[:, None] - z[None]).max(axis=2) if z.shape[1] else np.zeros((n, n))
        r = np.partition(np.maximum(np.maximum(dx, dy), dz), k, axis=1)[:, k][:, None]
        psi = lambda v: np.log(v) - 1 / (2 * v) - 1 / (12 * v**2)
        nz = (dz < r).sum(axis=1)
        return float(psi(k) - np.mean(psi((np.maximum(dx, dz) < r).sum(axis=1)) + psi((np.maximum(dy, dz) < r).sum(axis=1)) - psi(nz)))

    def pvalue(self, x, y, s=()) -> float:
        x, y = sorted((x, y))
        a, b, z = self.x[:, x], self.x[:, y], self.x[:, sorted(s)]
        rng = np.random.default_rng([self.seed, x, y, *sorted(s)])
        own = self._cmi(a, b, z)
        near = np.argsort(np.abs(z[:, None] - z[None]).max(axis=2), axis=1)[:, : self.k_perm] if s else None
        above = 0
        for _ in range(self.permutations):
            if near is None:
                p = rng.permutation(len(a))
            else:
                p, used = np.zeros(len(a), int), set()
                for i in rng.permutation(len(a)):
                    options = rng.permutation(near[i])
                    p[i] = next((o for o in options if o not in used), options[-1])
                    used.add(p[i])
            above += self._cmi(a[p], b, z) >= own
        return (above + 1) / (self.permutations + 1)


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    a, b = (centred(np.abs(v[:, None] - v[None])) for v in (x, y))
    d = math.sqrt(max((a * a).sum() * (b * b).sum(), 0))
    return math.sqrt(max((a * b).sum(), 0) / d) if d else 0.0


def gp_residual(y: np.ndarray, z: np.ndarray, noise=(0.01, 0.1, 0.3, 1.0)) -> np.ndarray:
    """Residual of a Gaussian process regression, width and noise by the marginal likelihood over a grid."""
    n, best = len(y), None
    y = (y - y.mean()) / (y.std() or 1)
    base = median_width(z)
    for f in (0.5, 1.0, 2.0):
        w, v = np.linalg.eigh(_gram(z, base * f))
        q = v.T @ y
        for s in noise:
            e = np.maximum(w, 0) + s
            like = -0.5 * ((q * q / e).sum() + np.log(e).sum())
            if best is None or like > best[0]:
                best = like, v @ (q * s / e)
    return best[1] if n else y


class GPDC(Rows):
    """Distance correlation of Gaussian-process residuals with a shuffle null."""

    permutations = 200

    def pvalue(self, x, y, s=()) -> float:
        x, y = sorted((x, y))
        z = self.x[:, sorted(s)]
        a, b = (gp_residual(self.x[:, v], z) if s else self.x[:, v] for v in (x, y))
        rng = np.random.default_rng([self.seed, x, y, *sorted(s)])
        own = distance_correlation(a, b)
        return (1 + sum(distance_correlation(rng.permutation(a), b) >= own for _ in range(self.permutations))) / (self.permutations + 1)


class Oracle(Test):
    """Answers by separation in a known graph."""

    def __init__(self, graph):
        self.graph, self.names = graph, graph.labels

    def pvalue(self, x, y, s=()) -> float:
        return 1.0 if self.graph.separated(x, y, s) else 0.0


class Testwise(Correlation):
    """Partial-correlation tests on the rows observed in all variables of a query.

    One aggregation gives the moments of each pattern of missing values; a query adds those of the patterns that
    have all its variables.
    """

    def __init__(self, patterns: list[tuple[np.ndarray, Moments]], names, kind=FisherZ):
        self.names, self.patterns, self.kind = tuple(names), patterns, kind

    def _moments(self, columns: list[int]) -> Moments:
        from tessera.operators.moments import pooled

        parts = [m.at(columns) for seen, m in self.patterns if seen[columns].all() and m.n]
        if not parts or sum(p.n for p in parts) < 2:
            raise DataError("no rows are observed in all variables of a test")
        return pooled(parts)

    def many(self, queries) -> np.ndarray:
        out = []
        for x, y, s in queries:
            columns = [*sorted((x, y)), *sorted(s)]
            m = self._moments(columns)
            out.append(float(self.kind(m).many([(0, 1, tuple(range(2, len(columns))))])[0]))
        return np.array(out)

    def partial(self, x, y, s=()) -> float:
        columns = [*sorted((x, y)), *sorted(s)]
        return self.kind(self._moments(columns)).partial(0, 1, tuple(range(2, len(columns))))


def missing_patterns(df: DataFrame, columns: list[str]) -> list[tuple[np.ndarray, Moments]]:
    """(observed columns, moments with zero for the others) of each pattern: one aggregation."""
    from pyspark.sql import functions as F

    from tessera.operators.moments import _pilot, _unpack, sums

    shift = _pilot(df, columns)
    seen = F.array(*(F.col(c).isNotNull() for c in columns))
    filled = df.select(seen.alias("__seen"), *(F.coalesce(F.col(c), F.lit(float(s))).alias(c) for c, s in zip(columns, shift, strict=True)))
    return [(np.array(r[0], bool), _unpack(r[2:], columns, shift, r[1])) for r in filled.groupBy("__seen").agg(F.count("*"), *sums(columns, shift)).collect()]


def bounded_rows(df: DataFrame, columns: list[str], most: int = 2_000, seed: int = 0) -> np.ndarray:
    """At most `most` complete rows, by the hash of the row and a seed, for methods that compare all pairs of rows."""
    from pyspark.sql import functions as F

    rows = df.select(columns).dropna()
    return np.array([tuple(r) for r in rows.orderBy(F.xxhash64(F.lit(seed), *columns), *columns).limit(most).collect()], float).reshape(-1, len(columns))


REGISTRY: dict[str, Callable] = {}


def register(name: str, factory: Callable) -> None:
    """Make a test known: factory(df, columns, categorical, **options) -> Test."""
    REGISTRY[name] = factory


def _gaussian(kind):
    def make(df, columns, categorical=(), missing=None, **_):
        if missing == "testwise":
            return Testwise(missing_patterns(checked(df, columns, missing=True), columns), columns, kind)
        return kind(moments(checked(df, columns), columns))

    return make


def _mixed(kind):
    def make(df, columns, categorical=(), **_):
        con = [c for c in columns if c not in categorical]
        return kind(cell_tables.cells(df, list(categorical), con))

    return make


def _rows(kind):
    return lambda df, columns, categorical=(), seed=0, most=2_000, **options: kind(bounded_rows(df, columns, most, seed or 0), columns, seed or 0, **options)


for _name, _factory in {
    "fisherz": _gaussian(FisherZ),
    "student_t": _gaussian(StudentT),
    "normal_scores": lambda df, columns, categorical=(), **_: FisherZ(moments(normal_scores(checked(df, columns), columns), columns)),
    "chisq": lambda df, columns, categorical=(), **_: ChiSquare(cell_tables.cells(df, columns)),
    "gsq": lambda df, columns, categorical=(), **_: ChiSquare(cell_tables.cells(df, columns), True),
    "cond_gauss": _mixed(CGTest),
    "degenerate_gauss": _mixed(DGTest),
    "kci": _rows(KCI),
    "rcot": lambda df, columns, categorical=(), seed=0, **options: RCoTTable(checked(df, columns), columns, seed or 0, **options),
    "cmiknn": _rows(CMIknn),
    "gpdc": _rows(GPDC),
}.items():
    register(_name, _factory)


def make_test(df: DataFrame, name: str | None = None, columns: list[str] | None = None, categorical: list[str] | None = None, **options) -> Test:
    """A test by name; without one, gsq for categories, cond_gauss for mixed data, fisherz for numbers."""
    categorical = categorical_columns(df) if categorical is None else categorical
    columns = columns or [c for c in df.columns if c in categorical or c in numeric_columns(df)]
    own = [c for c in columns if c in categorical]
    name = name or ("gsq" if len(own) == len(columns) else "cond_gauss" if own else "fisherz")
    if name not in REGISTRY:
        raise ValueError(f"no test {name}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](df, columns, own, **options)
