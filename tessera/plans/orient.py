"""Orientation rules and class conversions over mark matrices."""

from __future__ import annotations

from itertools import combinations

import numpy as np

from tessera.plans.graph import ARROW, TAIL, has_cycle, order_of, reach


def directed(m: np.ndarray) -> np.ndarray:
    return (m == TAIL) & (m.T == ARROW)


def lines(m: np.ndarray) -> np.ndarray:
    return (m == TAIL) & (m.T == TAIL)


def arrow(m: np.ndarray, i: int, j: int) -> None:
    m[i, j], m[j, i] = TAIL, ARROW


def _implied(m: np.ndarray, rule4: bool, ambiguous) -> set[tuple[int, int]]:
    """Lines that one round of the rules turns into arrows."""
    to, line, adj = directed(m), lines(m), m != 0
    d, out = len(m), set()
    triple = lambda a, b, c: (min(a, c), b, max(a, c)) not in ambiguous
    for b, c in zip(*np.nonzero(line), strict=True):
        b, c = int(b), int(c)
        into_b = np.flatnonzero(to[:, b])
        if any(not adj[a, c] and triple(int(a), b, c) for a in into_b if a != c):
            out.add((b, c))  # a -> b - c, a and c apart
        elif (to[b] & to[:, c]).any():
            out.add((b, c))  # b -> a -> c
        elif any(not adj[x, y] and triple(int(x), b, int(y)) for x, y in combinations(np.flatnonzero(line[b] & to[:, c]), 2)):
            out.add((b, c))  # b - x -> c and b - y -> c, x and y apart
        elif rule4:
            # b - x, x -> y -> c, b and y joined, x and c apart
            for y in np.flatnonzero(to[:, c] & adj[b]):
                if any(line[b, x] and to[x, y] and not adj[x, c] and triple(int(x), b, c) for x in range(d)):
                    out.add((b, c))
                    break
    return out


def meek(m: np.ndarray, *, rule4: bool = False, ambiguous=frozenset()) -> np.ndarray:
    """Rounds of the rules until nothing changes; what a round would orient both ways or into a cycle stays a line."""
    m = m.copy()
    while True:
        new = _implied(m, rule4, ambiguous)
        new = {(a, b) for a, b in new if (b, a) not in new}
        to = directed(m)
        trial = to.copy()
        for a, b in new:
            trial[a, b] = True
        closing = {(a, b) for a, b in new if a in reach([b], trial)}
        new -= closing
        if not new:
            return m
        for a, b in new:
            arrow(m, a, b)


def extension(m: np.ndarray) -> np.ndarray:
    """A DAG (adjacency) of the class of a partly directed graph, by peeling sinks; ValueError if there is none."""
    m = np.array(m, np.int8)
    to, line, left = directed(m), lines(m), list(range(len(m)))
    out = to.copy()
    while left:
        for x in left:
            if to[x, left].any():
                continue
            near = [y for y in left if line[x, y]]
            adj = [y for y in left if line[x, y] or to[y, x]]
            if all(z == y or line[y, z] or to[y, z] or to[z, y] for y in near for z in adj):
                for y in near:
                    out[y, x] = True
                left.remove(x)
                line[x, :] = line[:, x] = False
                break
        else:
            raise ValueError("no directed acyclic graph extends it")
    return out


def dag_to_cpdag(a: np.ndarray) -> np.ndarray:
    """Marks of the class of a DAG: its unshielded colliders and what the rules imply."""
    a = np.asarray(a) != 0
    if has_cycle(a):
        raise ValueError("the graph has a cycle")
    adj = a | a.T
    m = np.where(adj, TAIL, 0).astype(np.int8)
    for y in range(len(a)):
        for x, z in combinations(np.flatnonzero(a[:, y]), 2):
            if not adj[x, z]:
                arrow(m, x, y)
                arrow(m, z, y)
    return meek(m)


def cpdag_of(m: np.ndarray) -> np.ndarray:
    """The class of a partly directed graph that has an extension."""
    return dag_to_cpdag(extension(m))


def apply_knowledge(m: np.ndarray, required: np.ndarray, forbidden: np.ndarray) -> np.ndarray:
    """Lines that knowledge decides become arrows; then the rules, the fourth included."""
    m = m.copy()
    for i, j in zip(*np.nonzero(lines(m)), strict=True):
        if required[i, j] or (forbidden[j, i] and not forbidden[i, j]):
            arrow(m, i, j)
    return meek(m, rule4=True)


def orient_out_of(m: np.ndarray, sources) -> np.ndarray:
    m = m.copy()
    for s in sources:
        for j in np.flatnonzero(lines(m)[s]):
            arrow(m, s, j)
    return meek(m)


def colliders(m: np.ndarray, sepsets: dict, pvalues: dict | None = None, ambiguous=frozenset(), fixed=None) -> np.ndarray:
    """Unshielded triples whose middle isn't in the separating set become colliders, surest (largest p) first.

    Triples of the same p-value to nine places are decided together; an edge that two colliders claim both ways is
    marked with two arrowheads.
    """
    m = m.copy()
    adj = m != 0
    found = []
    for b in range(len(m)):
        for a, c in combinations(np.flatnonzero(adj[b]), 2):
            a, c = int(a), int(c)
            s = sepsets.get((a, c))
            if not adj[a, c] and s is not None and b not in s and (a, b, c) not in ambiguous:
                found.append((-round((pvalues or {}).get((a, c), 0.0), 9), a, b, c))
    blocked = directed(m)
    for p in sorted({f[0] for f in found}):
        now = directed(m)
        batch = [(a, b, c) for q, a, b, c in found if q == p]
        batch = [(a, b, c) for a, b, c in batch if not (blocked[b, a] or blocked[b, c]) and not ((now[b, a] or now[b, c]) and pvalues is not None)]
        for a, b, c in batch:
            for x in (a, c):
                if any(t[1] == x and b in (t[0], t[2]) for t in batch):
                    m[x, b] = m[b, x] = ARROW
                elif m[x, b] != ARROW or m[b, x] != ARROW:
                    arrow(m, x, b)
    return m


def undirect_conflicts(m: np.ndarray) -> np.ndarray:
    m = m.copy()
    both = (m == ARROW) & (m.T == ARROW)
    m[both] = TAIL
    return m


__all__ = ["apply_knowledge", "arrow", "colliders", "cpdag_of", "dag_to_cpdag", "directed", "extension", "lines", "meek", "order_of", "orient_out_of", "undirect_conflicts"]


def meek_in_order(m: np.ndarray, *, rule4: bool = False, ambiguous=frozenset()) -> np.ndarray:
    """The rules one line at a time, in the order of the columns, each seeing what came before it.

    Where the rules conflict, the line of the earlier columns wins; `meek` leaves such lines undecided.
    """
    m = m.copy()
    while True:
        for a, b in sorted(_implied(m, rule4, ambiguous)):
            if lines(m)[a, b] and a not in reach([b], directed(m)):
                arrow(m, a, b)
                break
        else:
            return m


def admits(m: np.ndarray, constraints) -> bool:
    """Whether a DAG of the class has all required edges and none of the forbidden ones."""
    m = m.copy()
    for i, j in zip(*np.nonzero(constraints.required), strict=True):
        if not m[i, j] or directed(m)[j, i]:
            return False
        if lines(m)[i, j]:
            arrow(m, int(i), int(j))
    for i, j in zip(*np.nonzero(constraints.forbidden), strict=True):
        if directed(m)[i, j]:
            return False
        if lines(m)[i, j]:
            if constraints.forbidden[j, i]:
                return False
            arrow(m, int(j), int(i))
    try:
        found = extension(meek(m, rule4=True))
    except ValueError:
        return False
    return not constraints.violated_by(found)


def critical_set(m: np.ndarray, x: int, y: int) -> set[int]:
    """Neighbours of x on a chordless path to y that no edge points back along: x is an ancestor of y in every DAG of the
    class if and only if these are two that aren't adjacent, or one that x points to."""
    adj, into = m != 0, directed(m)
    found: set[int] = set()
    todo = [(x, int(s), int(s)) for s in np.flatnonzero(adj[x]) if not into[s, x]]
    seen = set()
    while todo:
        before, now, first = todo.pop()
        if (before, now, first) in seen:
            continue
        seen.add((before, now, first))
        if now == y:
            found.add(first)
            continue
        for w in np.flatnonzero(adj[now]):
            w = int(w)
            # chordless: the next node isn't adjacent to the one before, nor to x
            if w not in (before, x) and not into[w, now] and not adj[before, w] and not adj[x, w]:
                todo.append((now, w, first))
    return found


def surely_ancestor(m: np.ndarray, x: int, y: int) -> bool:
    """Whether x is an ancestor of y in every DAG of the class."""
    c = critical_set(m, x, y)
    to, adj = directed(m), m != 0
    return any(to[x, v] for v in c) or any(not adj[a, b] for a, b in combinations(sorted(c), 2))


def restricted_to_ancestors(m: np.ndarray, required: list[tuple[int, int]], forbidden: list[tuple[int, int]]) -> np.ndarray:
    """The class with what ancestors' knowledge orients: a line is directed where the other way breaks a required or
    makes a forbidden path in every member."""
    m = meek(m, rule4=True)
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(np.triu(lines(m))), strict=True):
            for i, j in ((int(a), int(b)), (int(b), int(a))):
                trial = m.copy()
                arrow(trial, i, j)
                trial = meek(trial, rule4=True)
                to = directed(trial)
                bad = has_cycle(to) or any(x in reach([y], to) for x, y in required) or any(surely_ancestor(trial, x, y) for x, y in forbidden)
                bad = bad or any(not _possible(trial, x, y) for x, y in required)
                if bad:
                    arrow(m, j, i)
                    m = meek(m, rule4=True)
                    changed = True
                    break
            if changed:
                break
    return m


def _possible(m: np.ndarray, x: int, y: int) -> bool:
    """Whether a path from x to y has no edge that points back."""
    return y in reach([x], (m != 0) & ~directed(m).T)
