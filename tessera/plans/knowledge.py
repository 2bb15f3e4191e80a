"""Background knowledge as matrices over the variables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from tessera.plans.graph import has_cycle, reach


@dataclass(frozen=True)
class Knowledge:
    """Pairs (cause, effect) that are required or forbidden, the only ones allowed, tiers (causes not after effects),
    required and forbidden directed paths, and confounded pairs. Variables by label."""

    required: tuple = ()
    forbidden: tuple = ()
    allowed: tuple | None = None
    tiers: tuple = ()
    required_paths: tuple = ()
    forbidden_paths: tuple = ()
    confounded: tuple = ()

    def resolve(self, labels) -> Constraints:
        labels = list(labels)
        d = len(labels)

        def at(x):
            if x not in labels:
                raise ValueError(f"knowledge names {x}, which isn't a variable")
            return labels.index(x)

        required, forbidden = np.zeros((d, d), bool), np.zeros((d, d), bool)
        for a, b in self.required:
            required[at(a), at(b)] = True
        for a, b in self.forbidden:
            forbidden[at(a), at(b)] = True
        if self.allowed is not None:
            ok = np.zeros((d, d), bool)
            for a, b in self.allowed:
                ok[at(a), at(b)] = ok[at(b), at(a)] = True
            forbidden |= ~ok
        tier = {at(v): k for k, vs in enumerate(self.tiers) for v in vs}
        for a in tier:
            for b in tier:
                if tier[a] > tier[b]:
                    forbidden[a, b] = True
        for a, b in self.required_paths:
            forbidden[at(b), at(a)] = True
        for a, b in self.forbidden_paths:
            forbidden[at(a), at(b)] = True
        if has_cycle(required):
            raise ValueError("required edges have a cycle")
        if (required & forbidden).any():
            raise ValueError("an edge is required and forbidden")
        for j in range(d):
            for i in reach([j], required) - {j}:
                forbidden[i, j] = True
        pairs = [(at(a), at(b)) for a, b in self.required_paths], [(at(a), at(b)) for a, b in self.forbidden_paths]
        return Constraints(required, forbidden, *pairs)

    @classmethod
    def from_skeleton(cls, graph, **more) -> Knowledge:
        return cls(allowed=tuple((graph.labels[i], graph.labels[j]) for i, j, _, _ in graph.edges()), **more)


@dataclass(frozen=True)
class Constraints:
    required: np.ndarray
    forbidden: np.ndarray
    paths: list = field(default_factory=list)
    no_paths: list = field(default_factory=list)

    @property
    def keep(self) -> np.ndarray:
        """Pairs that stay adjacent."""
        return self.required | self.required.T

    @property
    def apart(self) -> np.ndarray:
        """Pairs that can't be adjacent."""
        return self.forbidden & self.forbidden.T

    def violated_by(self, directed: np.ndarray) -> bool:
        if (directed & self.forbidden).any() or (self.required & ~directed).any():
            return True
        return any(b not in reach([a], directed) for a, b in self.paths) or any(b in reach([a], directed) for a, b in self.no_paths)


def none(d: int) -> Constraints:
    return Constraints(np.zeros((d, d), bool), np.zeros((d, d), bool))


def resolved(knowledge, labels) -> Constraints:
    return knowledge.resolve(labels) if knowledge is not None else none(len(labels))


@dataclass(frozen=True)
class LaggedConstraints:
    """required[k], forbidden[k]: of the arrows from a variable k steps back to another now."""

    required: np.ndarray
    forbidden: np.ndarray

    def allows(self, cause: int, effect: int, lag: int) -> bool:
        return not self.forbidden[lag, cause, effect]

    def banned(self) -> frozenset:
        """(cause, effect, lag) of the forbidden arrows."""
        return frozenset((int(i), int(j), int(k)) for k, i, j in zip(*np.nonzero(self.forbidden), strict=True))


def resolve_lagged(knowledge: Knowledge | None, labels, tau_max: int, *, contemporaneous: bool = True) -> LaggedConstraints:
    """Knowledge over series: pairs (cause, effect) hold at every lag, triples (cause, effect, lag) at one.

    Tiers bind at lag 0 only, as a later tier's past may cause an earlier tier's present.
    """
    labels, d = list(labels), len(labels)
    required, forbidden = np.zeros((tau_max + 1, d, d), bool), np.zeros((tau_max + 1, d, d), bool)
    if knowledge is None:
        return LaggedConstraints(required, forbidden)
    every = range(0 if contemporaneous else 1, tau_max + 1)

    def cells(pairs):
        for a, b, *lag in pairs:
            if a not in labels or b not in labels:
                raise ValueError(f"knowledge names {a if a not in labels else b}, which isn't a variable")
            if lag and not 0 <= lag[0] <= tau_max:
                raise ValueError(f"lag {lag[0]} isn't one from 0 to {tau_max}")
            for k in lag or every:
                yield k, labels.index(a), labels.index(b)

    for at in cells(knowledge.forbidden):
        forbidden[at] = True
    for at in cells([p for p in knowledge.required if len(p) == 3]):
        required[at] = True
    if knowledge.allowed is not None:
        ok = np.zeros_like(forbidden)
        for at in cells(knowledge.allowed):
            ok[at] = True
        forbidden |= ~ok
    now = Knowledge(tiers=knowledge.tiers, required=tuple(p for p in knowledge.required if len(p) == 2)).resolve(labels)
    forbidden[0] |= now.forbidden
    required[0] |= now.required
    if (required & forbidden).any():
        raise ValueError("an arrow is required and forbidden")
    return LaggedConstraints(required, forbidden)
