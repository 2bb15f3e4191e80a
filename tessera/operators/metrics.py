"""Comparison of learned and true graphs, on the driver for graphs and on Spark for edge tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.graph import ARROW, Graph


def _ratio(a: float, b: float) -> float:
    return a / b if b else 1.0


def shd(estimated: Graph, true: Graph, endpoint_aware: bool = False) -> int:
    """Pairs whose marks differ (a reversal is one), or marks that differ (a reversal is two)."""
    a, b = estimated.marks, true.marks
    upper = np.triu(np.ones_like(a, bool), 1)
    if endpoint_aware:
        return int((a != b).sum())  # each mark has one place in the matrix
    return int((((a != b) | (a.T != b.T)) & upper).sum())


def _prf(tp: int, fp: int, fn: int) -> dict:
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": _ratio(2 * p * r, p + r) if p + r else 0.0}


def skeleton_scores(estimated: Graph, true: Graph) -> dict:
    a, b = np.triu(estimated.marks != 0, 1), np.triu(true.marks != 0, 1)
    return _prf(int((a & b).sum()), int((a & ~b).sum()), int((~a & b).sum()))


def arrow_scores(estimated: Graph, true: Graph) -> dict:
    """Arrowheads."""
    a, b = estimated.marks == ARROW, true.marks == ARROW
    return _prf(int((a & b).sum()), int((a & ~b).sum()), int((~a & b).sum()))


def direction_accuracy(estimated: Graph, true: Graph) -> float:
    """Of true arrows found as adjacencies, the share with the right direction."""
    t = true.directed & (estimated.marks != 0)
    return _ratio(int((t & estimated.directed).sum()), int(t.sum()))


def order_agreement(order: list, true: Graph) -> float:
    """Share of true arrows that the order doesn't contradict."""
    at = {v: k for k, v in enumerate(order)}
    edges = [(a, b) for a, b, t in true.oriented_edges() if t == "directed"]
    return _ratio(sum(at[a] < at[b] for a, b in edges), len(edges))


def markov_equivalent(a: Graph, b: Graph) -> bool:
    return (a.to_dag().to_cpdag().marks == b.to_dag().to_cpdag().marks).all()


def weight_error(estimated: np.ndarray, true: np.ndarray) -> float:
    return float(np.sqrt(((estimated - true) ** 2).mean()))


def adjusted_rand(a: list, b: list) -> float:
    """Agreement of two clusterings, corrected for chance."""
    _, x = np.unique(np.asarray(a, str), return_inverse=True)
    _, y = np.unique(np.asarray(b, str), return_inverse=True)
    t = np.zeros((x.max() + 1, y.max() + 1))
    np.add.at(t, (x, y), 1)
    c = lambda v: (v * (v - 1) / 2).sum()
    total, rows, cols, both = c(np.array([len(x)])), c(t.sum(axis=1)), c(t.sum(axis=0)), c(t)
    expected = rows * cols / total if total else 0
    top = (rows + cols) / 2
    return float((both - expected) / (top - expected)) if top != expected else 1.0


def adjusted_rand_of(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ari): agreement of two groupings of the rows, corrected for chance, from one contingency table."""
    t = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    sums = [t.groupBy(c).agg(F.sum("n").alias("s")).agg(pairs("s")).head()[0] or 0.0 for c in "ab"]
    one = t.agg(pairs("n").alias("both"), (F.sum("n") * (F.sum("n") - 1) / 2.0).alias("total"))
    expected, top = sums[0] * sums[1] / F.col("total"), sum(sums) / 2
    return one.select(F.when(F.lit(top) == expected, 1.0).otherwise(F.try_divide(F.col("both") - expected, F.lit(top) - expected)).alias("ari"))


def direction_counts(estimated: DataFrame, true: DataFrame) -> DataFrame:
    """(found, correct): true arrows of an edge table that the other has as adjacencies, and those it directs alike."""
    arrow = F.least("ti", "tj") + F.greatest("ti", "tj") == 3
    e = estimated.select("i", "j", F.col("mark_i").alias("ei"), F.col("mark_j").alias("ej"))
    both = true.select("i", "j", F.col("mark_i").alias("ti"), F.col("mark_j").alias("tj")).where(arrow).join(e, ["i", "j"])
    return both.agg(F.count("*").alias("found"), F.coalesce(F.sum(((F.col("ti") == F.col("ei")) & (F.col("tj") == F.col("ej"))).cast("long")), F.lit(0)).alias("correct"))


def temporal_shd(a: np.ndarray, b: np.ndarray) -> int:
    """Marks that differ, lag by lag."""
    return int((a != b).sum())


def edge_differences(estimated: DataFrame, true: DataFrame) -> DataFrame:
    """(i, j, same) of all pairs that either edge table (i, j, mark_i, mark_j; i < j) has."""
    e = estimated.select("i", "j", F.col("mark_i").alias("ei"), F.col("mark_j").alias("ej"))
    t = true.select("i", "j", F.col("mark_i").alias("ti"), F.col("mark_j").alias("tj"))
    return e.join(t, ["i", "j"], "full_outer").select("i", "j", (F.col("ei").eqNullSafe(F.col("ti")) & F.col("ej").eqNullSafe(F.col("tj"))).alias("same"), F.col("ei").isNotNull().alias("found"), F.col("ti").isNotNull().alias("real"))


def varsortability(variances: np.ndarray, adjacency: np.ndarray, tol: float = 1e-9) -> float:
    """Share of directed paths whose end has the larger value; a tie counts half."""
    a = (adjacency != 0).astype(float)
    paths, good, total = a.copy(), 0.0, 0.0
    v = np.asarray(variances, float)
    ratio = v[None, :] / v[:, None]
    for _ in range(len(a)):
        total += paths.sum()
        good += (paths * ((ratio > 1 + tol) + 0.5 * (np.abs(ratio - 1) <= tol))).sum()
        paths = paths @ a
    return _ratio(good, total)


def r2_sortability(corr: np.ndarray, adjacency: np.ndarray) -> float:
    return varsortability(1 - 1 / np.diag(np.linalg.inv(corr)), adjacency, 0.0)




def confounder_pair_scores(estimated: Graph, true: Graph) -> dict:
    """Pairs with an arrowhead at either end (<->)."""
    a, b = ((g.marks == ARROW) & (g.marks.T == ARROW) & np.triu(np.ones_like(g.marks, bool), 1) for g in (estimated, true))
    return _prf(int((a & b).sum()), int((a & ~b).sum()), int((~a & b).sum()))


def clusters_of(graph: Graph, observed: list[str]) -> list:
    """Each observed variable's cluster: its hidden parents by name, or itself if it has none."""
    hidden = {graph.labels[v] for v in graph.latent}
    return [",".join(sorted(set(graph.parents(v)) & hidden)) or f"={v}" for v in observed]


def latent_cluster_ari(estimated: Graph, true: Graph) -> float:
    """Agreement of the clusterings of the observed variables by their hidden parents, corrected for chance."""
    observed = [v for k, v in enumerate(true.labels) if k not in true.latent]
    return adjusted_rand(clusters_of(estimated, observed), clusters_of(true, observed))


def decision_rate(decisions, weights=None) -> float:
    """The (weighted) share of pairs that were decided: decisions are 1, -1, or 0 for none."""
    p = np.asarray(decisions) != 0
    w = np.ones(len(p)) if weights is None else np.asarray(weights, float)
    return _ratio(float(w[p].sum()), float(w.sum()))


def pairwise_accuracy(decisions, truth, weights=None) -> float:
    """The (weighted) share of the decided pairs whose direction is right."""
    p, t = np.asarray(decisions), np.asarray(truth)
    w = np.ones(len(p)) if weights is None else np.asarray(weights, float)
    return _ratio(float(w[(p != 0) & (p == t)].sum()), float(w[p != 0].sum()))


def score(estimated, true) -> dict:
    """All the measures that apply to two results of one kind: graphs by marks, temporal graphs by lags."""
    if isinstance(true, Graph):
        if set(estimated.labels) != set(true.labels) and not true.latent:
            raise ValueError("the graphs have other variables")
        out = {}
        if estimated.labels == true.labels:
            out = {"shd": shd(estimated, true), "skeleton": skeleton_scores(estimated, true), "arrowheads": arrow_scores(estimated, true), "direction_accuracy": direction_accuracy(estimated, true)}
        if true.kind in ("mag", "pag") or estimated.kind in ("mag", "pag"):
            out["confounders"] = confounder_pair_scores(estimated, true)
        if true.latent:
            out["latent_cluster_ari"] = latent_cluster_ari(estimated, true)
        return out
    a, b = estimated.marks, true.marks
    k = min(len(a), len(b))
    lagged = _prf(*(int(x.sum()) for x in ((a[1:k] != 0) & (b[1:k] != 0), (a[1:k] != 0) & (b[1:k] == 0), (a[1:k] == 0) & (b[1:k] != 0))))
    return {"shd": temporal_shd(a[:k], b[:k]), "lagged": lagged}
