"""Constraint-based searches: PC, FCI and their relatives, invariant prediction, Markov blankets.

A search asks its test for whole batches of queries: one batch per conditioning size.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.operators.ci import Test, hsic, make_test
from tessera.operators.moments import moments_by, pooled
from tessera.operators.profile import DataError
from tessera.plans import orient
from tessera.plans.graph import ARROW, CIRCLE, TAIL, Graph
from tessera.plans.knowledge import none, resolved


def ranked(test: Test) -> list[int]:
    return list(range(test.d))


def skeleton(test: Test, alpha: float, *, max_depth=None, constraints=None, start=None):
    """(adjacency, sepsets, p-values). Neighbours are frozen per size; removals of a size are applied together.

    A removed pair's separating set is the union of all sets of that size that separate it; its p-value their largest.
    """
    d, constraints = test.d, constraints or none(test.d)
    adj = np.ones((d, d), bool) if start is None else start.copy()
    np.fill_diagonal(adj, False)
    adj &= ~constraints.apart
    sepsets, pvalues = {}, {}
    size = 0
    while size == 0 or size <= adj.sum(axis=1).max(initial=0) - 1:
        if max_depth is not None and size > max_depth:
            break
        queries = []
        for x, y in combinations(range(d), 2):
            if not adj[x, y] or constraints.keep[x, y]:
                continue
            sets = {s for a, b in ((x, y), (y, x)) for s in combinations([v for v in np.flatnonzero(adj[a]).tolist() if v != b], size)}
            queries += [(x, y, s) for s in sorted(sets)]
        for (x, y, s), p in zip(queries, test.many(queries), strict=True):
            if p > alpha:
                sepsets.setdefault((x, y), set()).update(s)
                pvalues[x, y] = max(pvalues.get((x, y), 0.0), float(p))
                adj[x, y] = adj[y, x] = False
        size += 1
    for x, y in combinations(range(d), 2):
        if constraints.apart[x, y] and (x, y) not in sepsets:
            found = first_separating(test, x, y, [v for v in np.flatnonzero(adj[x] | adj[y]).tolist() if v not in (x, y)], alpha, max_depth)
            if found is not None:
                sepsets[x, y] = set(found)
    return adj, sepsets, pvalues


def first_separating(test: Test, x: int, y: int, candidates, alpha: float, max_depth=None):
    most = len(candidates) if max_depth is None else min(max_depth, len(candidates))
    for size in range(most + 1):
        queries = [(x, y, s) for s in combinations(candidates, size)]
        for q, p in zip(queries, test.many(queries), strict=True):
            if p > alpha:
                return q[2]
    return None


def ambiguous_triples(test: Test, adj: np.ndarray, alpha: float, rule: str, sepsets: dict, max_depth=None) -> set:
    """Votes of the separating subsets of both ends' neighbours; sepsets are changed so that decided triples follow."""
    out = set()
    for b in range(test.d):
        for a, c in combinations(np.flatnonzero(adj[b]).tolist(), 2):
            if adj[a, c]:
                continue
            votes = []
            for end, other in ((a, c), (c, a)):
                near = [v for v in np.flatnonzero(adj[end]).tolist() if v != other]
                for size in range(min(len(near), max_depth if max_depth is not None else len(near)) + 1):
                    queries = [(a, c, s) for s in combinations(near, size)]
                    votes += [b in q[2] for q, p in zip(queries, test.many(queries), strict=True) if p >= alpha]
            if not votes:
                continue
            share = sum(votes) / len(votes)
            collider = share == 0 if rule == "conservative" else share < 0.5
            other = share == 1 if rule == "conservative" else share > 0.5
            if not collider and not other:
                out.add((a, b, c))
            s = sepsets.setdefault((a, c), set())
            (s.discard if collider else s.add)(b)
    return out


def _pc_marks(test, alpha, constraints, collider_rule="sepsets", max_depth=None, sources=()):
    adj, sepsets, pvalues = skeleton(test, alpha, max_depth=max_depth, constraints=constraints)
    ambiguous = set() if collider_rule == "sepsets" else ambiguous_triples(test, adj, alpha, collider_rule, sepsets, max_depth)
    m = np.where(adj, TAIL, 0).astype(np.int8)
    for s in sources:
        for j in np.flatnonzero(adj[s]):
            orient.arrow(m, s, int(j))
    for i, j in zip(*np.nonzero(orient.lines(m)), strict=True):
        if constraints.required[i, j] or (constraints.forbidden[j, i] and not constraints.forbidden[i, j]):
            orient.arrow(m, i, j)
    m = orient.colliders(m, sepsets, pvalues, ambiguous)
    m = orient.meek(m, rule4=bool(constraints.required.any() or constraints.forbidden.any()), ambiguous=ambiguous)
    return orient.undirect_conflicts(m), sepsets, pvalues


def pc(df: DataFrame, *, alpha: float = 0.05, indep_test: str | None = None, collider_rule: str = "sepsets", columns=None, categorical=None, max_depth=None, knowledge=None, test: Test | None = None, **options) -> Graph:
    """The CPDAG that PC-stable learns. missing: testwise deletion, or mvpc, which also corrects for what makes values missing."""
    if options.get("missing") == "mvpc":
        return _mvpc(df, alpha, columns or df.columns, collider_rule, max_depth, knowledge)
    test = test or make_test(df, indep_test, columns, categorical, **options)
    m, _, _ = _pc_marks(test, alpha, resolved(knowledge, test.names), collider_rule, max_depth)
    return Graph(m, "cpdag", test.names)


class Corrected(Test):
    """Tests on the rows that are complete in a query, corrected for the causes W of their being complete.

    The query's variables are regressed on W in those rows; W's distribution over all rows that have it is put in
    the place of theirs. With linear regressions only covariances are needed: B cov(W) B' plus the residuals'.
    """

    def __init__(self, test, causes: dict[int, list[int]]):
        self.test, self.names, self.causes = test, test.names, causes

    def pvalue(self, x, y, s=()) -> float:
        v = [*sorted((x, y)), *sorted(s)]
        w = sorted({c for u in v for c in self.causes.get(u, [])} - set(v))
        if not w:
            return self.test.pvalue(x, y, s)
        m, whole = self.test._moments([*v, *w]), self.test._moments(w).cov
        k = len(v)
        b = m.cov[:k, k:] @ np.linalg.pinv(m.cov[k:, k:])
        cov = b @ whole @ b.T + m.cov[:k, :k] - b @ m.cov[k:, :k]
        from tessera.operators.moments import Moments

        return self.test.kind(Moments(m.names[:k], m.n, m.mean[:k], cov)).pvalue(0, 1, tuple(range(2, k)))


class Permuted(Corrected):
    """The same correction by virtual rows: the query's variables at W values drawn from rows that have W, each with its own residual.

    A bounded number of complete rows is used, as they come to one place; the test of the virtual rows is by correlations.
    """

    def __init__(self, test, causes: dict[int, list[int]], df: DataFrame, columns: list[str], *, most: int = 20_000, seed: int = 0):
        super().__init__(test, causes)
        self.df, self.columns, self.most, self.seed = df, columns, most, seed

    def pvalue(self, x, y, s=()) -> float:
        from tessera.operators.ci import bounded_rows
        from tessera.operators.moments import of_matrix

        v = [*sorted((x, y)), *sorted(s)]
        w = sorted({c for u in v for c in self.causes.get(u, [])} - set(v))
        if not w:
            return self.test.pvalue(x, y, s)
        rows = bounded_rows(self.df, [self.columns[u] for u in [*v, *w]], self.most, self.seed)
        every = bounded_rows(self.df, [self.columns[u] for u in w], self.most, self.seed + 1)
        own, on = rows[:, : len(v)], np.column_stack([np.ones(len(rows)), rows[:, len(v) :]])
        beta = np.linalg.lstsq(on, own, rcond=None)[0]
        rng = np.random.default_rng([self.seed, *v])
        drawn = every[rng.integers(0, len(every), len(rows))]
        virtual = np.column_stack([np.ones(len(rows)), drawn]) @ beta + own - on @ beta
        return self.test.kind(of_matrix(virtual)).pvalue(0, 1, tuple(range(2, len(v))))


def _mvpc(df, alpha, columns, collider_rule, max_depth, knowledge) -> Graph:
    """PC by test-wise deletion, whose remaining edges are tested again with corrected tests."""
    from tessera.operators.ci import FisherZ, Testwise, missing_patterns
    from tessera.operators.profile import checked

    data = checked(df, columns, missing=True)
    empty = data.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns)).head()
    holes = [c for c in columns if empty[c]]
    with_marks = data.select(*columns, *(F.col(c).isNull().cast("double").alias(f"{c}__missing") for c in holes))
    every = [*columns, *(f"{c}__missing" for c in holes)]
    wide = Testwise(missing_patterns(with_marks, every), every, FisherZ)
    test = Testwise([(seen[: len(columns)], m.at(list(range(len(columns))))) for seen, m in wide.patterns], columns, FisherZ)
    constraints = resolved(knowledge, columns)
    adj, sepsets, pvalues = skeleton(test, alpha, max_depth=max_depth, constraints=constraints)
    causes = {}
    for k, c in enumerate(holes):
        mark, own = len(columns) + k, columns.index(c)
        near = [v for v in range(len(columns)) if v != own and wide.pvalue(v, mark) <= alpha]
        causes[own] = [v for v in near if all(wide.pvalue(v, mark, s) <= alpha for size in range(1, min(2, len(near) - 1) + 1) for s in combinations([u for u in near if u != v], size))]
    again = Corrected(test, causes)
    for x, y in combinations(range(len(columns)), 2):
        if adj[x, y] and not constraints.keep[x, y]:
            for a, b in ((x, y), (y, x)):
                found = first_separating(again, x, y, [v for v in np.flatnonzero(adj[a]).tolist() if v != b], alpha, max_depth)
                if found is not None:
                    adj[x, y] = adj[y, x] = False
                    sepsets[x, y] = set(found)
                    break
    ambiguous = set() if collider_rule == "sepsets" else ambiguous_triples(again, adj, alpha, collider_rule, sepsets, max_depth)
    m = orient.colliders(np.where(adj, TAIL, 0).astype(np.int8), sepsets, pvalues, ambiguous)
    return Graph(orient.undirect_conflicts(orient.meek(m, ambiguous=ambiguous)), "cpdag", columns, meta={"missingness_causes": {columns[v]: [columns[u] for u in us] for v, us in causes.items()}})


# FCI


def _circles(adj: np.ndarray) -> np.ndarray:
    return np.where(adj, CIRCLE, 0).astype(np.int8)


def _fci_colliders(m, sepsets, ambiguous=frozenset(), constraints=None):
    for b in range(len(m)):
        for a, c in combinations(np.flatnonzero(m[b]).tolist(), 2):
            s = sepsets.get((a, c))
            if not m[a, c] and s is not None and b not in s and (a, b, c) not in ambiguous and TAIL not in (m[b, a], m[b, c]):
                m[b, a] = m[b, c] = ARROW


def possible_dsep(m: np.ndarray, x: int) -> set[int]:
    """Nodes that paths reach whose every middle is a definite collider or in a triangle."""
    out, queue, seen = set(), [(x, int(v)) for v in np.flatnonzero(m[x])], set()
    while queue:
        a, b = queue.pop(0)
        if (a, b) in seen:
            continue
        seen.add((a, b))
        out.add(b)
        for c in np.flatnonzero(m[b]).tolist():
            if c not in (a, x) and ((m[b, a] == ARROW and m[b, c] == ARROW) or m[a, c]):
                queue.append((b, c))
    return out - {x}


def _uncovered_paths(m, start, goal, step, limit=10_000):
    """Paths from start to goal over allowed steps whose consecutive triples are unshielded."""
    todo, count = [list(start)], 0
    while todo and count < limit:
        path = todo.pop(0)
        count += 1
        for v in np.flatnonzero(m[path[-1]]).tolist():
            if v in path or not step(path[-1], v) or (len(path) > 1 and m[path[-2], v]):
                continue
            if v == goal:
                yield [*path, v]
            else:
                todo.append([*path, v])


def fci_rules(m: np.ndarray, sepsets: dict, ambiguous=frozenset(), test: Test | None = None, alpha: float = 0.05, selection_bias: bool = True) -> np.ndarray:
    """Rounds of R1 to R10 until no mark changes."""
    d = len(m)
    m = m.copy()
    possibly = lambda a, b: m[a, b] != ARROW and m[b, a] != TAIL
    sep = lambda a, b: sepsets.get((min(a, b), max(a, b)))
    while True:
        before = m.copy()
        for b in range(d):
            near = np.flatnonzero(m[b]).tolist()
            for a in near:
                for c in near:
                    if a == c:
                        continue
                    free = (min(a, c), b, max(a, c)) not in ambiguous
                    if not m[a, c] and free and m[b, a] == ARROW and m[b, c] == CIRCLE:  # R1
                        m[b, c], m[c, b] = TAIL, ARROW
                    if m[a, c] and m[c, a] == CIRCLE and m[b, a] == ARROW and m[c, b] == ARROW and (m[a, b] == TAIL or m[b, c] == TAIL):  # R2
                        m[c, a] = ARROW
                    if not m[a, c] and a < c and m[b, a] == ARROW and m[b, c] == ARROW:  # R3
                        for v in near:
                            if v not in (a, c) and m[b, v] == CIRCLE and m[v, a] == CIRCLE and m[v, c] == CIRCLE and sep(a, c) is not None and v in sep(a, c):
                                m[b, v] = ARROW
        _rule4(m, sepsets, test, alpha)
        if selection_bias:
            for a in range(d):  # R5
                for b in np.flatnonzero((m[a] == CIRCLE) & (m[:, a] == CIRCLE)).tolist():
                    for c in np.flatnonzero((m[a] == CIRCLE) & (m[:, a] == CIRCLE)).tolist():
                        if c == b or m[b, c]:
                            continue
                        for path in _uncovered_paths(m, [a, c], b, lambda u, v: m[u, v] == CIRCLE and m[v, u] == CIRCLE):
                            if not m[a, path[-2]]:
                                for u, v in zip([*path, path[-1]], [*path[1:], a], strict=True):
                                    if m[u, v]:
                                        m[u, v] = m[v, u] = TAIL
                                m[a, b] = m[b, a] = TAIL
                                break
            for b in range(d):  # R6, R7
                for a in np.flatnonzero(m[b]).tolist():
                    for c in np.flatnonzero(m[b] == CIRCLE).tolist():
                        if c != a and m[a, b] == TAIL and (m[b, a] == TAIL or (m[b, a] == CIRCLE and not m[a, c])):
                            m[b, c] = TAIL
        for a in range(d):
            for c in np.flatnonzero((m[a] == CIRCLE) & (m[:, a] == ARROW)).tolist():
                if any(m[b, c] == TAIL and m[c, b] == ARROW and m[a, b] == TAIL and m[b, a] in (ARROW, CIRCLE) for b in np.flatnonzero(m[a]).tolist()):  # R8
                    m[a, c] = TAIL
                    continue
                if any(not m[b, c] and (min(b, c), a, max(b, c)) not in ambiguous and next(_uncovered_paths(m, [a, b], c, possibly), None) for b in np.flatnonzero(m[a]).tolist() if b != c and possibly(a, b)):  # R9
                    m[a, c] = TAIL
                    continue
                into = [b for b in np.flatnonzero(m[c] == ARROW).tolist() if m[b, c] == TAIL and b != a]
                firsts = {b: {p[1] for p in _uncovered_paths(m, [a], b, possibly)} for b in into}  # R10
                if any(x != y and not m[x, y] for b, e in combinations(into, 2) for x in firsts[b] for y in firsts[e]):
                    m[a, c] = TAIL
        if (m == before).all():
            return m


def _rule4(m, sepsets, test, alpha, limit=10_000):
    """Discriminating paths t, ..., a, b, c: every node between t and b is a collider and a parent of c."""
    for c in range(len(m)):
        for b in np.flatnonzero(m[:, c] == CIRCLE).tolist():
            todo, count = [[a, b] for a in np.flatnonzero(m[b]).tolist() if a != c and m[a, c] == TAIL and m[c, a] == ARROW and m[a, b] == ARROW], 0
            while todo and count < limit and m[b, c] == CIRCLE:
                path = todo.pop(0)
                count += 1
                for t in np.flatnonzero(m[path[0]] == ARROW).tolist():
                    if t in path or t == c:
                        continue
                    if not m[t, c]:
                        middle, s = path[:-1], sepsets.get((min(t, c), max(t, c)))
                        inside = None
                        if test is not None:
                            without, with_b = test.pvalue(t, c, tuple(middle)), test.pvalue(t, c, tuple(path))
                            inside = True if with_b > alpha and with_b >= without else False if without > alpha else None
                        if inside is None and s is not None:
                            inside = b in s
                        if inside:
                            m[b, c], m[c, b] = TAIL, ARROW
                        elif inside is not None:
                            m[b, c] = m[c, b] = ARROW
                            m[b, path[-2]] = ARROW
                            m[path[-2], b] = ARROW
                        break
                    if m[t, c] == TAIL and m[c, t] == ARROW and m[t, path[0]] == ARROW:
                        todo.append([t, *path])


def fci_from(test: Test, adj, sepsets, alpha, *, constraints=None, collider_rule="sepsets", dsep=True, max_depth=None, sources=(), selection_bias=True, pattern=None) -> np.ndarray:
    """Marks of the PAG from an adjacency and separating sets."""
    constraints = constraints or none(test.d)
    m = _circles(adj)
    ambiguous = set() if collider_rule == "sepsets" else ambiguous_triples(test, adj, alpha, collider_rule, sepsets, max_depth)

    def known(m):
        for s in sources:
            for j in np.flatnonzero(m[s]):
                m[s, j], m[j, s] = TAIL, ARROW
        for i, j in zip(*np.nonzero(m), strict=True):
            if constraints.required[i, j]:
                m[i, j], m[j, i] = TAIL, ARROW
            elif constraints.forbidden[i, j] and m[j, i] == CIRCLE:
                m[i, j] = ARROW

    known(m)
    _apply_pattern(m, pattern)
    _fci_colliders(m, sepsets, ambiguous)
    if dsep:
        for x, y in combinations(range(test.d), 2):
            if not m[x, y] or constraints.keep[x, y]:
                continue
            tried = set()
            for a, b in ((x, y), (y, x)):
                near = sorted(possible_dsep(m, a) - {b})
                done = False
                for size in range(1, min(len(near), max_depth if max_depth is not None else len(near)) + 1):
                    sets = [s for s in combinations(near, size) if s not in tried]
                    tried.update(sets)
                    for s, p in zip(sets, test.many([(x, y, s) for s in sets]), strict=True):
                        if p > alpha:
                            m[x, y] = m[y, x] = 0
                            sepsets[x, y] = set(s)
                            done = True
                            break
                    if done:
                        break
                if done:
                    break
        m = _circles(m != 0)
        known(m)
        _apply_pattern(m, pattern)
        _fci_colliders(m, sepsets, ambiguous)
    return fci_rules(m, sepsets, ambiguous, test, alpha, selection_bias)


def _apply_pattern(m, pattern):
    """Unshielded colliders of a score-based pattern, where both edges are still there."""
    if pattern is None:
        return
    to = orient.directed(pattern)
    for b in range(len(m)):
        for a, c in combinations(np.flatnonzero(to[:, b]).tolist(), 2):
            if not pattern[a, c] and m[a, b] and m[c, b] and not m[a, c]:
                m[b, a] = m[b, c] = ARROW


def fci(df: DataFrame, *, alpha: float = 0.05, indep_test=None, collider_rule="sepsets", columns=None, categorical=None, max_depth=None, knowledge=None, test=None, **options) -> Graph:
    """The PAG that FCI learns."""
    test = test or make_test(df, indep_test, columns, categorical, **options)
    constraints = resolved(knowledge, test.names)
    adj, sepsets, _ = skeleton(test, alpha, max_depth=max_depth, constraints=constraints)
    return Graph(fci_from(test, adj, sepsets, alpha, constraints=constraints, collider_rule=collider_rule, max_depth=max_depth), "pag", test.names)


def after_score(test: Test, pattern: np.ndarray, alpha: float, *, dsep=False, max_depth=None, constraints=None) -> np.ndarray:
    """The PAG from a score-based pattern: its adjacencies tested, its colliders kept."""
    start = pattern != 0
    adj, sepsets, _ = skeleton(test, alpha, max_depth=max_depth, constraints=constraints, start=start)
    for x, y in combinations(range(test.d), 2):
        if not start[x, y] and (x, y) not in sepsets:
            for v in (x, y):
                found = first_separating(test, x, y, sorted(np.flatnonzero(orient.directed(pattern)[:, v] | orient.lines(pattern)[v]).tolist()), alpha, max_depth)
                if found is not None:
                    sepsets[x, y] = set(found)
                    break
    return fci_from(test, adj, sepsets, alpha, constraints=constraints, dsep=dsep, max_depth=max_depth, pattern=pattern)


# environments


def _with_index(df: DataFrame, env: str) -> tuple[DataFrame, list]:
    """The environment column as codes 0..k-1 of its sorted labels."""
    labels = sorted(r[0] for r in df.select(env).distinct().collect())
    return df.withColumn(env, F.array_position(F.lit([str(x) for x in labels]), F.col(env).cast("string")).cast("double") - 1), labels


def cdnod(df: DataFrame, env: str, *, alpha=0.05, indep_test=None, collider_rule="sepsets", columns=None, categorical=None, max_depth=None, knowledge=None, **options) -> Graph:
    """PC with the environment index as a variable that nothing causes; the index isn't in the result, its arrows are in meta."""
    columns = [c for c in (columns or df.columns) if c != env] + [env]
    coded, _ = _with_index(df, env)
    if indep_test in ("chisq", "gsq"):
        coded = coded.withColumn(env, F.col(env).cast("string"))
    test = make_test(coded, indep_test or "fisherz", columns, categorical if categorical is not None else ([*columns] if indep_test in ("chisq", "gsq") else []), **options)
    d = test.d
    m, _, _ = _pc_marks(test, alpha, _padded(knowledge, test.names), collider_rule, max_depth, sources=[test.names.index(env)])
    e = test.names.index(env)
    keep = [v for v in range(d) if v != e]
    return Graph(m[np.ix_(keep, keep)], "cpdag", [test.names[v] for v in keep], meta={"changing": [test.names[v] for v in keep if m[e, v]]})


def _padded(knowledge, names):
    return resolved(knowledge, names)


def fci_jci(df: DataFrame, env: str, *, alpha=0.05, indep_test=None, columns=None, categorical=None, max_depth=None, knowledge=None, **options) -> Graph:
    """FCI with the environment index as a context variable: out of it, never into it; no selection bias."""
    columns = [c for c in (columns or df.columns) if c != env] + [env]
    coded, _ = _with_index(df, env)
    test = make_test(coded, indep_test or "fisherz", columns, categorical or [], **options)
    constraints = resolved(knowledge, test.names)
    adj, sepsets, _ = skeleton(test, alpha, max_depth=max_depth, constraints=constraints)
    return Graph(fci_from(test, adj, sepsets, alpha, constraints=constraints, max_depth=max_depth, sources=[test.names.index(env)], selection_bias=False), "pag", test.names)


def invariance_pvalue(groups: list, target: int, predictors: tuple[int, ...], method: str = "approximate") -> float:
    """Whether the regression of the target is the same in each group as in the others: from the groups' moments."""
    out, k = 1.0, len(groups)

    def fit(m):
        p = list(predictors)
        b = np.linalg.solve(m.cov[np.ix_(p, p)], m.cov[p, target]) if p else np.zeros(0)
        rss = (m.n - 1) * float(m.cov[target, target] - m.cov[p, target] @ b)
        return rss, m.n - len(p) - 1

    for e in range(k if k > 2 or method == "exact" else 1):
        a, rest = groups[e], pooled([g for i, g in enumerate(groups) if i != e])
        whole = pooled([a, rest])
        q = len(predictors) + 1
        if method == "exact":
            r0, d0 = fit(rest)
            ra, _ = fit(whole)
            na = a.n
            f = max(0.0, ra - r0) / na / (r0 / d0)
            p = float(special.f_sf(f, na, d0))
        else:
            p0 = list(predictors)
            b = np.linalg.solve(whole.cov[np.ix_(p0, p0)], whole.cov[p0, target]) if p0 else np.zeros(0)
            w = np.zeros(whole.d)
            w[target], w[p0] = 1.0, -b
            (ma, va, na), (mb, vb, nb) = ((float(w @ g.mean), float(w @ g.cov @ w), g.n) for g in (a, rest))
            se = va / na + vb / nb
            dof = se**2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1))
            pt = float(special.t_two_sided((ma - mb) / np.sqrt(se), dof))
            f = va / vb
            pf = float(special.f_sf(f, na - 1, nb - 1))
            p = min(1.0, 2 * min(pt, 2 * min(pf, 1 - pf)))
        del q
        out = min(out, p * (1 if k == 2 and method != "exact" else k))
    return min(1.0, out)


def indicator_pvalue(df: DataFrame, env: str, columns: list[str], target: int, predictors: tuple[int, ...], indep_test: str = "fisherz", **options) -> float:
    """Whether the target is independent of each environment's 0/1 indicator given the predictors, by any registered test.

    Each environment meets all others; the least p-value counts times their number (once for two).
    """
    labels = sorted(r[0] for r in df.select(env).distinct().collect())
    if len(labels) < 2:
        raise DataError("at least two environments are needed")
    chosen, out = [columns[target], *(columns[v] for v in predictors)], 1.0
    for label in labels[: 1 if len(labels) == 2 else None]:
        marked = df.select(*chosen, F.when(F.col(env) == F.lit(label), 1.0).otherwise(0.0).alias("__in"))
        test = make_test(marked, indep_test, [*chosen, "__in"], [], **options)
        out = min(out, test.pvalue(0, len(chosen), tuple(range(1, len(chosen)))) * (1 if len(labels) == 2 else len(labels)))
    return min(1.0, out)


def icp(df: DataFrame, env: str, *, target: str, alpha=0.05, invariance_test="approximate", max_parents=None, columns=None) -> Graph:
    """The target's parents: what all accepted predictor sets share. meta: accepted sets and p-values."""
    columns = [c for c in (columns or df.columns) if c != env]
    by = moments_by(df, columns, env)
    if len(by) < 2:
        raise DataError("at least two environments are needed")
    groups, t = list(by.values()), columns.index(target)
    others = [v for v in range(len(columns)) if v != t]
    most = len(others) if max_parents is None else max_parents
    sets = chain.from_iterable(combinations(others, k) for k in range(most + 1))
    if invariance_test == "indicator":
        p = {s: indicator_pvalue(df, env, columns, t, s) for s in sets}
    else:
        p = {s: invariance_pvalue(groups, t, s, invariance_test) for s in sets}
    accepted = [set(s) for s, v in p.items() if v > alpha]
    parents = set.intersection(*accepted) if accepted else set()
    m = np.zeros((len(columns),) * 2, np.int8)
    for v in parents:
        orient.arrow(m, v, t)
    per = {columns[v]: max((q for s, q in p.items() if v not in s), default=1.0) if accepted else 1.0 for v in others}
    return Graph(m, "dag", columns, meta={"accepted": [[columns[v] for v in sorted(s)] for s in accepted], "pvalues": per})


# Markov blankets


def markov_blanket(test: Test, target: int, alpha: float, interleaved: bool = False) -> list[int]:
    """Grow by the strongest dependent candidate, shrink by what turns independent."""
    members, seen = [], set()

    def shrink():
        for v in list(members):
            if test.pvalue(target, v, tuple(u for u in members if u != v)) > alpha:
                members.remove(v)

    while True:
        rest = [v for v in range(test.d) if v != target and v not in members]
        p = test.many([(target, v, tuple(members)) for v in rest])
        dependent = [(round(-test.strength(target, v, tuple(members)), 9), v) for v, q in zip(rest, p, strict=True) if q <= alpha]
        if not dependent:
            break
        members.append(min(dependent)[1])
        if interleaved:
            shrink()
            if frozenset(members) in seen:
                break
            seen.add(frozenset(members))
    shrink()
    return sorted(members)


def parents_children(test: Test, target: int, alpha: float, max_depth=None) -> list[int]:
    """MMPC: add the candidate whose weakest association over subsets is strongest, then test each member again."""
    members: list[int] = []
    out = {target}

    def weakest(v, others):
        best = (0.0, float("inf"))
        for size in range(min(len(others), max_depth if max_depth is not None else 3) + 1):
            for s in combinations(others, size):
                p = test.pvalue(target, v, s)
                best = max(best, (p, -test.strength(target, v, s)))
                if p > alpha:
                    return best
        return best

    while True:
        found = {v: weakest(v, members) for v in range(test.d) if v not in out and v not in members}
        out |= {v for v, (p, _) in found.items() if p > alpha}
        left = [(p, s, v) for v, (p, s) in found.items() if p <= alpha]
        if not left:
            break
        members.append(min(left)[2])
    return sorted(v for v in members if weakest(v, [u for u in members if u != v])[0] <= alpha)


def _both(neighbours: dict[int, list[int]], d: int) -> np.ndarray:
    a = np.zeros((d, d), bool)
    for v, near in neighbours.items():
        a[v, near] = True
    return a & a.T


def blanket(df: DataFrame, *, method="iamb", target=None, structure="cpdag", alpha=0.05, indep_test=None, columns=None, categorical=None, knowledge=None, test=None, **options) -> Graph | list[str]:
    """iamb, inter_iamb or mmpc. With a target its blanket (or neighbours); else a graph of the whole."""
    test = test or make_test(df, indep_test, columns, categorical, **options)
    find = {"iamb": lambda v: markov_blanket(test, v, alpha), "inter_iamb": lambda v: markov_blanket(test, v, alpha, True), "mmpc": lambda v: parents_children(test, v, alpha)}[method]
    if target is not None:
        return [test.names[v] for v in find(test.names.index(target))]
    a = _both({v: find(v) for v in range(test.d)}, test.d)
    if structure in ("moral", "skeleton") and method == "mmpc" or structure == "moral":
        return Graph(np.where(a, TAIL, 0), "undirected", test.names)
    adj, sepsets, pvalues = skeleton(test, alpha, constraints=resolved(knowledge, test.names), start=a)
    for x, y in combinations(range(test.d), 2):
        if not a[x, y] and (x, y) not in sepsets:
            found = first_separating(test, x, y, sorted(set(np.flatnonzero(a[x]).tolist())), alpha)
            if found is not None:
                sepsets[x, y] = set(found)
    if structure == "skeleton":
        return Graph(np.where(adj, TAIL, 0), "undirected", test.names)
    m = orient.undirect_conflicts(orient.meek(orient.colliders(np.where(adj, TAIL, 0).astype(np.int8), sepsets, pvalues)))
    return Graph(m, "cpdag", test.names)
