"""Joint cells of categorical variables, with counts and moments of the continuous ones: one scan.

The joint table of all categorical columns has at most as many rows as the data, mostly far fewer. Up to `MOST`
cells it comes to the driver, and every table over fewer columns is a sum of its cells. Beyond that, Spark is asked for
just the tables that a batch of queries needs, by GROUPING SETS, with the same results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.profile import DataError, encoded

MOST = 200_000


@dataclass(frozen=True)
class Cells:
    """codes[c, j]: category of column j in cell c; per cell: count, sums and products of the continuous columns."""

    names: tuple[str, ...]
    levels: dict[str, list]
    codes: np.ndarray
    counts: np.ndarray
    continuous: tuple[str, ...] = ()
    sums: np.ndarray | None = None
    products: np.ndarray | None = None

    @property
    def n(self) -> int:
        return int(self.counts.sum())

    def sizes(self) -> list[int]:
        return [len(self.levels[c]) for c in self.names]

    def keys(self, columns: list[int]) -> tuple[np.ndarray, int]:
        """A number for each cell's categories over some columns, and how many there are."""
        if not columns:
            return np.zeros(len(self.counts), int), 1
        _, key = np.unique(self.codes[:, columns], axis=0, return_inverse=True)
        key = key.ravel()
        return key, int(key.max(initial=-1)) + 1

    def table(self, x: int, y: int, given: list[int]) -> np.ndarray:
        """Counts [stratum, x, y] over the strata that occur."""
        own = self.over([x, y, *given])
        key, k = own.keys(list(given))
        sizes = self.sizes()
        out = np.zeros((k, sizes[x], sizes[y]))
        np.add.at(out, (key, own.codes[:, x], own.codes[:, y]), own.counts)
        return out

    def family(self, node: int, parents: list[int]) -> np.ndarray:
        """Counts [parent configuration that occurs, value]."""
        own = self.over([node, *parents])
        key, k = own.keys(list(parents))
        out = np.zeros((k, self.sizes()[node]))
        np.add.at(out, (key, own.codes[:, node]), own.counts)
        return out

    def over(self, columns: list[int]) -> Cells:
        """Cells that tell the counts over some of the columns."""
        return self


class TableCells(Cells):
    """Cells of a table with too many joint ones: those over the columns of a query are counted by Spark, and kept.

    A query's own cells may be at most `MOST`, as they come to the driver.
    """

    def __init__(self, names, levels, rows: DataFrame, n: int):
        super().__init__(names, levels, np.zeros((0, len(names)), int), np.zeros(0))
        object.__setattr__(self, "_rows", rows)
        object.__setattr__(self, "_n", n)
        object.__setattr__(self, "_known", {})

    @property
    def n(self) -> int:
        return self._n

    def prefetch(self, column_sets: list[list[int]]) -> None:
        """Count several column sets in one Expand and one shuffle."""
        wanted = [s for s in dict.fromkeys(tuple(sorted(set(c))) for c in column_sets) if s not in self._known]
        if not wanted:
            return
        every = sorted({self.names[v] for s in wanted for v in s})
        found: dict = {}
        for r in counts_for(self._rows, [[self.names[v] for v in s] for s in wanted]).limit(len(wanted) * MOST + 1).collect():
            found.setdefault(r["gid"], []).append(r)
        for s in wanted:
            bits = sum(1 << (len(every) - 1 - k) for k, c in enumerate(every) if c not in {self.names[v] for v in s})
            rows = found.get(bits, [])
            if len(rows) > MOST:
                raise DataError(f"more than {MOST} joint categories of {', '.join(self.names[v] for v in s)}")
            codes = np.zeros((len(rows), len(self.names)), int)
            for v in s:
                codes[:, v] = [r[self.names[v]] for r in rows]
            self._known[s] = Cells(self.names, self.levels, codes, np.array([r["n"] for r in rows], float))

    def over(self, columns: list[int]) -> Cells:
        key = tuple(sorted(set(columns)))
        self.prefetch([list(key)])
        return self._known[key]


def cells(df: DataFrame, categorical: list[str], continuous: list[str] = ()) -> Cells:
    """The joint cells of the rows that have all columns; of categories alone, those that a query needs where there are too many."""
    rows, levels = encoded(df.select(*categorical, *continuous).dropna(), categorical)
    x = [F.col(c) for c in continuous]
    aggs = [F.count("*").alias("n"), *(F.sum(v) for v in x), *(F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x)))]
    table = rows.groupBy(*categorical).agg(*aggs)
    found = table.limit(MOST + 1).collect()
    if len(found) > MOST:
        if continuous:
            raise DataError(f"more than {MOST} joint categories beside continuous columns")
        return TableCells(tuple(categorical), levels, rows, rows.count())
    k, d = len(categorical), len(continuous)
    raw = np.array([[v if v is not None else 0.0 for v in r] for r in sorted(found, key=lambda r: r[:k])], float).reshape(len(found), -1)
    products = np.zeros((len(raw), d, d))
    if d:
        upper = np.triu_indices(d)
        products[:, upper[0], upper[1]] = raw[:, k + 1 + d :]
        products[:, upper[1], upper[0]] = raw[:, k + 1 + d :]
    return Cells(tuple(categorical), levels, raw[:, :k].astype(int), raw[:, k], tuple(continuous), raw[:, k + 1 : k + 1 + d], products)


def counts_for(df: DataFrame, column_sets: list[list[str]]) -> DataFrame:
    """Counts for many column sets in one Expand and one shuffle: the columns, gid (bits of those left out) and n."""
    every = sorted({c for s in column_sets for c in s})
    return df.groupingSets([[F.col(c) for c in s] for s in column_sets], *(F.col(c) for c in every)).agg(F.grouping_id().alias("gid"), F.count("*").alias("n")).select(*every, "gid", "n")
