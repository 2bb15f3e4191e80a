"""Graphs as small matrices of endpoint marks, and as edge DataFrames.

M[i, j] is the mark at i on the edge between i and j: so i -> j has a tail at i and an arrowhead at j.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

NULL, TAIL, ARROW, CIRCLE = 0, 1, 2, 3
KINDS = ("dag", "cpdag", "pag", "mag", "digraph", "undirected")
ALLOWED = {"dag": {(1, 2)}, "cpdag": {(1, 2), (1, 1)}, "undirected": {(1, 1)}, "digraph": {(1, 2), (2, 2)}, "mag": {(1, 2), (2, 2), (1, 1)}, "pag": {(1, 2), (2, 2), (1, 1), (3, 3), (2, 3), (1, 3)}}
TYPES = {(1, 2): "directed", (3, 2): "partially_directed", (3, 1): "partially_undirected", (1, 1): "undirected", (2, 2): "bidirected", (3, 3): "circle"}
EDGES = "i int, j int, mark_i byte, mark_j byte, source string, target string, type string"


def from_adjacency(a: np.ndarray) -> np.ndarray:
    """Marks of a directed graph where a[i, j] says i -> j."""
    a = np.asarray(a) != 0
    return (a * TAIL + a.T * ARROW).astype(np.int8) if not (a & a.T).any() else np.where(a & a.T, ARROW, a * TAIL + a.T * ARROW).astype(np.int8)


def has_cycle(directed: np.ndarray) -> bool:
    return order_of(directed) is None


def order_of(directed: np.ndarray) -> list[int] | None:
    """A topological order, least index first; None if there is a cycle."""
    left, into, out = set(range(len(directed))), directed.sum(axis=0).astype(int), []
    ready = sorted(v for v in left if not into[v])
    while ready:
        v = ready.pop(0)
        out.append(v)
        for w in np.flatnonzero(directed[v]):
            into[w] -= 1
            if not into[w]:
                ready.append(int(w))
        ready.sort()
    return out if len(out) == len(directed) else None


def reach(start, succ: np.ndarray) -> set[int]:
    """What directed paths reach from the nodes, themselves included."""
    seen, queue = set(start), deque(start)
    while queue:
        for w in np.flatnonzero(succ[queue.popleft()]):
            if int(w) not in seen:
                seen.add(int(w))
                queue.append(int(w))
    return seen


@dataclass(frozen=True)
class Graph:
    """Marks, kind and labels of a causal graph."""

    marks: np.ndarray
    kind: str
    labels: tuple[str, ...] = ()
    latent: frozenset = frozenset()
    meta: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        m = np.array(self.marks, np.int8)
        m.setflags(write=False)
        object.__setattr__(self, "marks", m)
        object.__setattr__(self, "labels", tuple(self.labels) or tuple(f"X{k}" for k in range(len(m))))

    @classmethod
    def of_dag(cls, adjacency, labels=()) -> Graph:
        return cls(from_adjacency(adjacency), "dag", labels)

    @classmethod
    def from_edges(cls, edges, n: int, kind: str, labels=()) -> Graph:
        m = np.zeros((n, n), np.int8)
        for i, j, a, b in edges:
            m[i, j], m[j, i] = a, b
        return cls(m, kind, labels)

    @classmethod
    def from_pcalg(cls, amat, kind: str, labels=()) -> Graph:
        """pcalg's matrices: dag and cpdag have a[i, j] = 1 for j -> i; pag has 1 circle, 2 arrow, 3 tail, at j."""
        a = np.asarray(amat)
        if kind in ("dag", "cpdag"):
            to = a.T != 0
            return cls(np.where(to & to.T, TAIL, to * TAIL + to.T * ARROW), kind, labels)
        return cls(np.array([NULL, CIRCLE, ARROW, TAIL], np.int8)[a.T], kind, labels)

    def to_pcalg(self) -> np.ndarray:
        if self.kind in ("dag", "cpdag"):
            return ((self.marks == TAIL).T).astype(int)
        return np.array([0, 3, 2, 1])[self.marks.T]

    @property
    def d(self) -> int:
        return len(self.marks)

    @property
    def directed(self) -> np.ndarray:
        """[i, j]: i -> j."""
        return (self.marks == TAIL) & (self.marks.T == ARROW)

    def index(self, x) -> int:
        return x if isinstance(x, (int, np.integer)) else self.labels.index(x)

    def edges(self) -> list[tuple[int, int, int, int]]:
        return [(int(i), int(j), int(self.marks[i, j]), int(self.marks[j, i])) for i, j in zip(*np.nonzero(np.triu(self.marks, 1)), strict=True)]

    def oriented_edges(self) -> list[tuple[str, str, str]]:
        """(source, target, type), the source at the tail or circle end."""
        out = []
        for i, j, a, b in self.edges():
            if (a, b) not in TYPES:
                i, j, a, b = j, i, b, a
            out.append((self.labels[i], self.labels[j], TYPES[a, b]))
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """The edges as a DataFrame."""
        rows = [(i, j, a, b, *t) for (i, j, a, b), t in zip(self.edges(), self.oriented_edges(), strict=True)]
        return spark.createDataFrame(rows, EDGES)

    @classmethod
    def of_frame(cls, edges: DataFrame, labels, kind: str) -> Graph:
        return cls.from_edges([tuple(r) for r in edges.select("i", "j", "mark_i", "mark_j").collect()], len(labels), kind, labels)

    def dot(self) -> str:
        ends = {TAIL: "none", ARROW: "normal", CIRCLE: "odot"}
        lines = [f'  "{x}";' for x in self.labels]
        lines += [f'  "{self.labels[i]}" -> "{self.labels[j]}" [dir=both, arrowtail={ends[a]}, arrowhead={ends[b]}];' for i, j, a, b in self.edges()]
        return "\n".join(["digraph {", *lines, "}"])

    def svg(self, size: int = 480) -> str:
        """A drawing with the nodes on a circle."""
        angle = 2 * np.pi * np.arange(self.d) / max(self.d, 1)
        at = size / 2 + (size / 2 - 50) * np.stack([np.sin(angle), -np.cos(angle)], axis=1)
        out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {size} {size}">']
        for i, j, a, b in self.edges():
            u = (at[j] - at[i]) / max(1e-9, np.linalg.norm(at[j] - at[i]))
            p, q = at[i] + 24 * u, at[j] - 24 * u
            out.append(f'<line x1="{p[0]:.1f}" y1="{p[1]:.1f}" x2="{q[0]:.1f}" y2="{q[1]:.1f}" stroke="black"/>')
            for mark, tip, v in ((a, p, -u), (b, q, u)):
                side = np.array([-v[1], v[0]])
                if mark == ARROW:
                    pts = [tip, tip - 9 * v + 4 * side, tip - 9 * v - 4 * side]
                    out.append(f'<polygon points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in pts)}"/>')
                elif mark == CIRCLE:
                    out.append(f'<circle cx="{tip[0]:.1f}" cy="{tip[1]:.1f}" r="4" fill="white" stroke="black"/>')
        out += [f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="middle">{label}</text>' for (x, y), label in zip(at, self.labels, strict=True)]
        return "\n".join([*out, "</svg>"])

    def validate(self) -> Graph:
        bad = [e for e in self.edges() if (e[2], e[3]) not in ALLOWED[self.kind] and (e[3], e[2]) not in ALLOWED[self.kind]]
        if bad:
            raise ValueError(f"marks that a {self.kind} can't have: {bad}")
        if self.kind in ("dag", "cpdag", "mag", "pag") and has_cycle(self.directed):
            raise ValueError("the directed edges have a cycle")
        return self

    def parents(self, x) -> list[str]:
        return [self.labels[i] for i in np.flatnonzero(self.directed[:, self.index(x)])]

    def children(self, x) -> list[str]:
        return [self.labels[i] for i in np.flatnonzero(self.directed[self.index(x)])]

    def neighbors(self, x) -> list[str]:
        return [self.labels[i] for i in np.flatnonzero(self.marks[self.index(x)])]

    def ancestors(self, x) -> list[str]:
        i = self.index(x)
        return [self.labels[k] for k in sorted(reach([i], self.directed.T) - {i})]

    def descendants(self, x) -> list[str]:
        i = self.index(x)
        return [self.labels[k] for k in sorted(reach([i], self.directed) - {i})]

    def markov_blanket(self, x) -> list[str]:
        """Neighbours, and what paths of colliders connect."""
        i = self.index(x)
        found, queue = set(np.flatnonzero(self.marks[i]).tolist()), deque()
        seen = set()
        queue.extend(int(k) for k in np.flatnonzero(self.marks[:, i] == ARROW))
        while queue:
            k = queue.popleft()
            if k in seen:
                continue
            seen.add(k)
            for w in np.flatnonzero(self.marks[k] == ARROW):
                if w != i:
                    found.add(int(w))
                    if self.marks[w, k] == ARROW:
                        queue.append(int(w))
        return [self.labels[k] for k in sorted(found - {i})]

    def separated(self, x, y, given=()) -> bool:
        """d- or m-separation, by reachability over (node, whether an arrowhead led in)."""
        x, y, z = self.index(x), self.index(y), {self.index(g) for g in given}
        m = self.marks
        above = reach(z, self.directed.T)
        queue, seen = deque((int(w), m[w, x] == ARROW) for w in np.flatnonzero(m[x])), set()
        while queue:
            state = v, into = queue.popleft()
            if state in seen:
                continue
            seen.add(state)
            if v == y:
                return False
            for w in np.flatnonzero(m[v]):
                collider = into and m[v, w] == ARROW
                if (v in above) if collider else (v not in z):
                    queue.append((int(w), m[w, v] == ARROW))
        return True

    def to_dag(self) -> Graph:
        from tessera.plans.orient import extension

        return Graph.of_dag(extension(self.marks), self.labels)

    def to_cpdag(self) -> Graph:
        from tessera.plans.orient import dag_to_cpdag

        return Graph(dag_to_cpdag(self.directed), "cpdag", self.labels)

    def to_mag(self, latent=(), selection=()) -> Graph:
        """The projection of a DAG over its other nodes: edges where an inducing path leads."""
        hidden, chosen = {self.index(v) for v in latent} | set(self.latent), {self.index(v) for v in selection}
        seen = [v for v in range(self.d) if v not in hidden | chosen]
        up = [reach([v], self.directed.T) for v in range(self.d)]
        over_selection = set().union(*(up[s] for s in chosen)) if chosen else set()
        out = np.zeros((len(seen), len(seen)), np.int8)
        for (a, u), (b, v) in combinations(enumerate(seen), 2):
            if self._inducing(u, v, hidden, up[u] | up[v] | over_selection):
                out[a, b] = TAIL if u in up[v] | over_selection else ARROW
                out[b, a] = TAIL if v in up[u] | over_selection else ARROW
        return Graph(out, "mag", [self.labels[v] for v in seen])

    def to_pag(self, latent=(), selection=()) -> Graph:
        """The class of the projection: FCI with separation in it as the test."""
        from tessera.operators.ci import Oracle
        from tessera.plans.constraint import fci

        return fci(None, test=Oracle(self if self.kind == "mag" and not latent and not selection else self.to_mag(latent, selection)))

    def _inducing(self, x: int, y: int, hidden: set, above: set) -> bool:
        m = self.marks
        queue, seen = deque((int(w), m[w, x] == ARROW) for w in np.flatnonzero(m[x])), set()
        while queue:
            state = v, into = queue.popleft()
            if v == y:
                return True
            if state in seen:
                continue
            seen.add(state)
            for w in np.flatnonzero(m[v]):
                collider = into and m[v, w] == ARROW
                if (v in above) if collider else (v in hidden):
                    queue.append((int(w), m[w, v] == ARROW))
        return False


@dataclass(frozen=True)
class TemporalGraph:
    """Marks per lag: marks[k][i, j] is about i at t - k and j at t; weights likewise."""

    marks: np.ndarray
    labels: tuple[str, ...]
    weights: np.ndarray | None = None
    meta: dict = field(default_factory=dict, compare=False)

    def lag(self, k: int) -> np.ndarray:
        return self.marks[k]

    def links(self) -> list[tuple[str, str, int]]:
        """(cause, effect, lag) of directed links."""
        out = []
        for k, m in enumerate(self.marks):
            for i, j in zip(*np.nonzero(m), strict=True):
                if k or (m[i, j] == TAIL and m[j, i] == ARROW):
                    out.append((self.labels[i], self.labels[j], k))
        return out

    def summary(self, include_lag0: bool = True) -> dict[tuple[str, str], list[int]]:
        """Links merged over lags, with their lags."""
        out: dict = {}
        for a, b, k in self.links():
            if k or include_lag0:
                out.setdefault((a, b), []).append(k)
        return {e: sorted(v) for e, v in out.items()}

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(a, b, k, float(self.weights[k][self.labels.index(a), self.labels.index(b)]) if self.weights is not None else None) for a, b, k in self.links()]
        return spark.createDataFrame(rows, "cause string, effect string, lag int, weight double")
