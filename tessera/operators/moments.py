"""Means and covariances: one scan of the rows, whatever is asked of them later.

Up to `WIDE` columns, sums of all products are one aggregation of Column expressions (partial sums per task, one row
of shuffle per task). Beyond that, each task multiplies Arrow batches into one matrix of partial sums.
Products are taken of values less a pilot mean, so large offsets don't cost precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.blas import one_thread
from tessera.operators.ordered import with_lags

WIDE = 40


@dataclass(frozen=True)
class Moments:
    """n, means and sample covariance (ddof 1) of named columns."""

    names: tuple[str, ...]
    n: int
    mean: np.ndarray
    cov: np.ndarray

    @property
    def corr(self) -> np.ndarray:
        s = np.sqrt(np.diag(self.cov))
        c = self.cov / np.outer(s, s)
        np.fill_diagonal(c, 1.0)
        return c

    @property
    def d(self) -> int:
        return len(self.names)

    def at(self, columns: list[int]) -> Moments:
        return Moments(tuple(self.names[i] for i in columns), self.n, self.mean[columns], self.cov[np.ix_(columns, columns)])


def of_matrix(x: np.ndarray, names=None) -> Moments:
    x = np.asarray(x, float)
    return Moments(tuple(names or (str(j) for j in range(x.shape[1]))), len(x), x.mean(axis=0), np.cov(x, rowvar=False).reshape(x.shape[1], -1))


def _from_sums(names, n: int, shift: np.ndarray, s: np.ndarray, p: np.ndarray) -> Moments:
    n = int(n)
    cov = (p - np.outer(s, s) / max(n, 1)) / max(n - 1, 1)
    return Moments(tuple(names), n, shift + s / max(n, 1), (cov + cov.T) / 2)


def _pilot(df: DataFrame, columns: list[str]) -> np.ndarray:
    """A rough centre of each column, from one row: any fixed numbers near the data serve."""
    row = df.select(columns).where(" and ".join(f"`{c}` is not null" for c in columns)).head()
    return np.array([float(v) for v in row] if row else [0.0] * len(columns))


def sums(columns: list[str], shift: np.ndarray) -> list:
    """Aggregates of the upper triangle of products and of the sums."""
    x = [F.col(c) - float(s) for c, s in zip(columns, shift, strict=True)]
    return [F.sum(v) for v in x] + [F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]


def _unpack(values, names, shift, n: int) -> Moments:
    d = len(names)
    s, p = np.array([v or 0.0 for v in values[:d]]), np.zeros((d, d))
    p[np.triu_indices(d)] = [v or 0.0 for v in values[d:]]
    return _from_sums(names, n, shift, s, p + np.triu(p, 1).T)


def moments(df: DataFrame, columns: list[str]) -> Moments:
    """Moments of the rows that have all columns."""
    rows = df.select(columns).dropna()
    shift = _pilot(rows, columns)
    if len(columns) <= WIDE:
        row = rows.agg(F.count("*"), *sums(columns, shift)).head()
        return _unpack(row[1:], columns, shift, row[0])
    d = len(columns)

    def partial(batches):
        n, s, p = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) - shift
            with one_thread():
                n, s, p = n + len(x), s + x.sum(axis=0), p + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tobytes()], pa.binary()), pa.array([p.tobytes()], pa.binary())], names=["n", "s", "p"])

    def add(key, batches):
        n, s, p = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            for k, v, w in zip(*(c.to_pylist() for c in b.select(["n", "s", "p"]).columns), strict=True):
                n, s, p = n + k, s + np.frombuffer(v), p + np.frombuffer(w).reshape(d, d)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tobytes()], pa.binary()), pa.array([p.tobytes()], pa.binary())], names=["n", "s", "p"])

    schema = "n long, s binary, p binary"
    each = rows.select([F.col(c).cast("double") for c in columns]).mapInArrow(partial, schema)
    # a reduction tree: groups of 32 tasks' matrices, until few are left for the driver
    width = rows.rdd.getNumPartitions()
    while width > 32:
        width = -(-width // 32)
        each = each.repartition(width).mapInArrow(lambda bs: add(None, bs), schema)
    n, s, p = 0, np.zeros(d), np.zeros((d, d))
    for r in each.toLocalIterator():
        n, s, p = n + r["n"], s + np.frombuffer(r["s"]), p + np.frombuffer(r["p"]).reshape(d, d)
    return _from_sums(columns, n, shift, s, p)


def moments_by(df: DataFrame, columns: list[str], group: str) -> dict:
    """Moments of each group of rows, from one aggregation."""
    rows = df.select(*columns, group).dropna()
    shift = _pilot(rows, columns)
    found = rows.groupBy(group).agg(F.count("*"), *sums(columns, shift)).collect()
    return {r[0]: _unpack(r[2:], columns, shift, r[1]) for r in sorted(found, key=lambda r: r[0])}


def pooled(parts: list[Moments]) -> Moments:
    """Moments of the union of disjoint samples of the same columns."""
    n = sum(m.n for m in parts)
    mean = sum(m.n * m.mean for m in parts) / n
    p = sum((m.n - 1) * m.cov + m.n * np.outer(m.mean - mean, m.mean - mean) for m in parts)
    return Moments(parts[0].names, n, mean, p / (n - 1))


def pairwise_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, n, r): correlations of each pair over the rows that have both, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    aggs = []
    for k, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [F.count(F.when(both, 1)).alias(f"n{k}"), F.corr(F.when(both, F.col(a)), F.when(both, F.col(b))).alias(f"r{k}")]
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"n{k}").alias("n"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))).alias("p")).select("p.*")


def lagged(df: DataFrame, columns: list[str], order: str, lags: int, series: str | None = None, first: int = 0) -> DataFrame:
    """Each row with the rows 1..lags steps before it (column c at lag k: c__k), rows without all lags left out."""
    return with_lags(df, columns, order, lags, series, first)


def dummies(df: DataFrame, levels: dict[str, int]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Indicator columns (one less than categories, the last left out) of coded columns, others as they are."""
    made = {c: [f"{c}__is{k}" for k in range(n - 1)] for c, n in levels.items()}
    return df.select(*(c for c in df.columns if c not in levels), *((F.col(c) == k).cast("double").alias(name) for c, names in made.items() for k, name in enumerate(names))), made | {c: [c] for c in df.columns if c not in levels}
