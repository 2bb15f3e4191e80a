"""Refits over resamples: edge frequencies, and a check of a graph's implied independences."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.cells import Cells, cells
from tessera.operators.ci import FisherZ
from tessera.operators.moments import Moments, _pilot, _unpack
from tessera.operators.ordered import arranged, with_running_sum
from tessera.operators.profile import checked, numeric_columns
from tessera.operators.rowwise import row_sums
from tessera.plans.graph import Graph, has_cycle


@dataclass
class Resampled:
    """Graphs of all fits; frequencies count each pair's marks."""

    fits: list[Graph]

    @property
    def labels(self):
        return self.fits[0].labels

    def counts(self) -> Counter:
        return Counter((i, j, a, b) for g in self.fits for i, j, a, b in g.edges())

    def table(self, min_frequency: float = 0.0) -> list[tuple]:
        """(x, y, mark_x, mark_y, frequency), most frequent first."""
        rows = [(self.labels[i], self.labels[j], a, b, n / len(self.fits)) for (i, j, a, b), n in self.counts().items()]
        return sorted((r for r in rows if r[4] >= min_frequency), key=lambda r: (-r[4], r))

    def frequency(self, x: str, y: str) -> float:
        """Share of fits in which the two are adjacent."""
        i, j = self.labels.index(x), self.labels.index(y)
        return float(np.mean([g.marks[i, j] != 0 for g in self.fits]))

    def average(self, threshold: float = 0.5) -> Graph:
        """Each pair's most frequent marks, where the pair is adjacent in more than the threshold; cycles lose their weakest arrow."""
        d, n = len(self.labels), len(self.fits)
        m, weight = np.zeros((d, d), np.int8), np.zeros((d, d))
        for i, j in combinations(range(d), 2):
            votes = Counter((int(g.marks[i, j]), int(g.marks[j, i])) for g in self.fits)
            present = n - votes.get((0, 0), 0)
            if present / n > threshold:
                (a, b), k = max(((v, k) for v, k in votes.items() if v != (0, 0)), key=lambda z: (z[1], z[0]))
                m[i, j], m[j, i] = a, b
                weight[i, j] = weight[j, i] = k
        g = Graph(m, self.fits[0].kind, self.labels)
        while has_cycle(g.directed):
            i, j = min(zip(*np.nonzero(g.directed), strict=True), key=lambda e: weight[e])
            m[i, j] = m[j, i] = 0
            g = Graph(m, self.fits[0].kind, self.labels)
        return g


#: Upper ends of Poisson(1): a uniform number above k of them is the count k.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
#: Numbers of a weight matrix that a task holds at once.
AT_ONCE = 1 << 20


def resampled_moments(df: DataFrame, columns: list[str], n_resamples: int, *, resampling: str = "subsample", fraction: float = 0.5, seed: int = 0) -> list[Moments]:
    """Moments of every resample from one scan: each row has a weight in each resample, whatever its values are.

    A subsample takes a row with probability `fraction`; a bootstrap gives it a Poisson count. A row's key is its place
    in its partition of the table: a task draws its rows' weights in order from a generator of (seed, partition), so the
    same files in the same splits give the same resamples, also after a lost executor. A task multiplies the matrix of
    weights with that of the rows' products, so that no table is copied and a row costs one draw a resample.
    """
    data = checked(df, columns)
    shift = _pilot(data, columns)
    d = len(columns)
    upper = np.triu_indices(d)

    class Draws:
        """Weighted sums of a batch: a generator for each task, whose batches come in order."""

        rng = None

        def __call__(self, x):
            if self.rng is None:
                context = TaskContext.get()
                self.rng = np.random.default_rng([seed, context.partitionId() if context else 0])
            out, step = 0.0, max(1, AT_ONCE // n_resamples)
            for at in range(0, len(x), step):
                z = x[at : at + step] - shift
                u = self.rng.random((len(z), n_resamples))
                w = (u < fraction).astype(float) if resampling == "subsample" else np.searchsorted(POISSON, u.ravel(), side="right").reshape(u.shape).astype(float)
                out = out + w.T @ np.concatenate([np.ones((len(z), 1)), z, z[:, upper[0]] * z[:, upper[1]]], axis=1)
            return out

    _, sums = row_sums(data, columns, Draws())
    size = 1 + d + len(upper[0])
    sums = sums.reshape(n_resamples, size) if np.size(sums) > 1 else np.zeros((n_resamples, size))
    return [_unpack(r[1:], columns, shift, int(r[0])) for r in sums]


def resampled_cells(table: Cells, n_resamples: int, *, resampling: str = "subsample", fraction: float = 0.5, seed: int = 0) -> list[Cells]:
    """Joint cells of every resample of categorical data: a cell's count is drawn for all its rows at once, which is the same as drawing each."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n_resamples):
        n = rng.binomial(table.counts.astype(int), fraction) if resampling == "subsample" else rng.poisson(table.counts)
        out.append(Cells(table.names, table.levels, table.codes[n > 0], n[n > 0].astype(float)))
    return out


def _fitted(spark, fit: Callable, statistics: list) -> list:
    """fit of each, side by side on executors."""
    rows = spark.createDataFrame([(b, cloudpickle.dumps((fit, s))) for b, s in enumerate(statistics)], "b int, image binary")

    def run(batches):
        for batch in batches:
            for b, image in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f, s = cloudpickle.loads(image)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([cloudpickle.dumps(f(s))], pa.binary())], names=["b", "image"])

    found = rows.repartition(min(len(statistics), 4 * spark.sparkContext.defaultParallelism), "b").mapInArrow(run, "b int, image binary").collect()
    return [cloudpickle.loads(bytes(r["image"])) for r in sorted(found, key=lambda r: r["b"])]


def bootstrap(df: DataFrame, fit: Callable[[Moments], Graph], *, n_resamples=100, columns=None, resampling="subsample", sample_fraction=0.5, seed=0) -> Resampled:
    """Refits of a method that works from moments."""
    columns = columns or numeric_columns(df)
    ms = resampled_moments(df, columns, n_resamples, resampling=resampling, fraction=sample_fraction, seed=seed)
    return Resampled(_fitted(df.sparkSession, fit, ms))


def bootstrap_cells(df: DataFrame, fit: Callable[[Cells], Graph], columns: list[str], *, n_resamples=100, resampling="subsample", sample_fraction=0.5, seed=0) -> Resampled:
    """Refits of a method that works from joint cells of categories."""
    drawn = resampled_cells(cells(df, columns), n_resamples, resampling=resampling, fraction=sample_fraction, seed=seed)
    return Resampled(_fitted(df.sparkSession, fit, drawn))


def resample_rows(df: DataFrame, b: int, *, resampling="subsample", fraction=0.5, seed=0, order: str | None = None, block: int = 1, unit: str | None = None) -> DataFrame:
    """The rows of resample b for methods that need them: single rows, blocks of a series, or whole units.

    The key of a row is its number (partition and place in it), of a block its place in the order, of a unit its value.
    """
    if unit:
        df = df.withColumn("__key", F.xxhash64(unit))
    elif order:
        df = with_running_sum(arranged(df.withColumn("__one", F.lit(1)), order), "__one", "__below").withColumn("__key", F.floor(F.col("__below") / block)).drop("__one", "__below")
    else:
        df = df.withColumn("__key", F.monotonically_increasing_id())
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit(b), "__key"), F.lit(1 << 40)) / float(1 << 40)
    if resampling == "subsample":
        return df.where(u < fraction).drop("__key")
    copies = sum(((u >= float(q)).cast("int") for q in POISSON), F.lit(0))
    return df.withColumn("__n", copies).where("__n > 0").withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n", "__c", "__key")


def bootstrap_rows(df: DataFrame, fit: Callable[[DataFrame], Graph], *, n_resamples=20, at_once=4, **options) -> Resampled:
    """Refits of a method that needs rows: each reads the table as often as the method does; `at_once` run side by side."""
    with ThreadPoolExecutor(at_once) as pool:
        return Resampled(list(pool.map(lambda b: fit(resample_rows(df, b, **options)), range(n_resamples))))


def anderson_darling(p: np.ndarray) -> tuple[float, float]:
    """(statistic, p-value) of uniform p-values, by the limiting distribution and its small-sample correction; one value exactly."""
    u = np.clip(np.sort(np.asarray(p, float)), 1e-300, 1 - 2.0**-53)
    n = len(u)
    i = np.arange(1, n + 1)
    z = float(-n - ((2 * i - 1) * (np.log(u) + np.log1p(-u[::-1]))).mean())
    return z, anderson_darling_p(n, z)


def anderson_darling_p(n: int, z: float) -> float:
    """The probability of a statistic of z or more from n uniform values."""
    if n == 1:  # u (1 - u) = exp(-1 - z) has two roots, and what lies outside them is as extreme
        return 1 - math.sqrt(max(0.0, 1 - 4 * math.exp(-1 - z)))
    # Marsaglia and Marsaglia's approximations: fixed values
    if z < 2:
        x = math.exp(-1.2337141 / z) / math.sqrt(z) * (2.00012 + (0.247105 - (0.0649821 - (0.0347962 - (0.011672 - 0.00168691 * z) * z) * z) * z) * z) if z > 0 else 0.0
    else:
        x = math.exp(-math.exp(1.0776 - (2.30695 - (0.43424 - (0.082433 - (0.008056 - 0.0003146 * z) * z) * z) * z) * z))
    if x > 0.8:
        fix = (-130.2137 + (745.2337 - (1705.091 - (1950.646 - (1116.360 - 255.7844 * x) * x) * x) * x) * x) / n
    else:
        c = 0.01265 + 0.1757 / n
        if x < c:
            t = x / c
            fix = math.sqrt(t) * (1 - t) * (49 * t - 102) * (0.0037 / n**3 + 0.00078 / n**2 + 0.00006 / n)
        else:
            t = (x - c) / (0.8 - c)
            fix = (-0.00022633 + (6.54034 - (14.6538 - (14.458 - (8.259 - 1.91864 * t) * t) * t) * t) * t) * (0.04213 / n + 0.01365 / n**2)
    return float(min(1.0, max(0.0, 1 - (x + fix))))


def markov_check(df: DataFrame, graph: Graph, *, alpha=0.05, seed=0, fraction=0.5) -> dict:
    """Non-adjacent pairs tested given the later one's parents, each on its own half of the rows; their p-values should be uniform.

    All halves' moments come from one scan.
    """
    columns = list(graph.labels)
    dag = graph if graph.kind == "dag" else graph.to_dag()
    from tessera.plans.graph import order_of

    order = order_of(dag.directed)
    at = {v: k for k, v in enumerate(order)}
    queries = []
    for x, y in combinations(range(graph.d), 2):
        if not graph.marks[x, y]:
            late, early = (x, y) if at[x] > at[y] else (y, x)
            queries.append((early, late, tuple(np.flatnonzero(dag.directed[:, late]).tolist())))
    if not queries:
        return {"n_tests": 0, "dependent": 0.0, "p_value": 1.0, "pvalues": []}
    ms = resampled_moments(df, columns, len(queries), fraction=fraction, seed=seed)
    p = np.array([FisherZ(m).pvalue(*q) for m, q in zip(ms, queries, strict=True)])
    stat, pv = anderson_darling(p)
    return {"n_tests": len(p), "dependent": float((p <= alpha).mean()), "statistic": stat, "p_value": pv, "pvalues": p.tolist()}


