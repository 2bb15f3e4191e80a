"""Checks of sample tables before a search: categories, environments, copies and collinear columns, seeds and warnings."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.moments import Moments
from tessera.operators.profile import DataError, categorical_columns, numeric_columns

#: Squared correlations this near to one make copies; smaller eigenvalue ratios make columns dependent.
COPY, DEPENDENT = 1e-12, 1e-12


def check_categories(df: DataFrame, columns: list[str]) -> None:
    """Numbers that are to be categories must be whole; one aggregation over all columns."""
    types = {f.name: f.dataType for f in df.schema.fields}
    fractional = [c for c in columns if isinstance(types[c], (T.FractionalType, T.DecimalType))]
    if not fractional:
        return
    row = df.agg(*(F.count(F.when(F.col(c).isNotNull() & (F.col(c) != F.floor(c)), 1)).alias(c) for c in fractional)).head()
    if bad := [c for c in fractional if row[c]]:
        raise DataError(f"categories must be whole numbers or text: {', '.join(bad)}")


def check_environments(df: DataFrame, environment: str, columns: list[str], *, min_rows: int = 2) -> dict:
    """Rows of each environment, once each has enough and no column is constant in one; one aggregation."""
    aggs = [F.count("*").alias("__n"), *(F.min(c).alias(f"{c}__low") for c in columns), *(F.max(c).alias(f"{c}__high") for c in columns)]
    rows = df.groupBy(environment).agg(*aggs).collect()
    if few := [f"{r[environment]} ({r['__n']})" for r in rows if r["__n"] < min_rows]:
        raise DataError(f"environments of fewer than {min_rows} rows: {', '.join(sorted(few))}")
    if bad := [f"{c} in {r[environment]}" for r in rows for c in columns if r[f"{c}__low"] == r[f"{c}__high"]]:
        raise DataError(f"constant within an environment: {', '.join(sorted(bad))}")
    if len(rows) < 2:
        raise DataError("at least two environments are needed")
    return {r[environment]: r["__n"] for r in rows}


def copy_groups(m: Moments) -> list[list[str]]:
    """Groups of columns that repeat one another up to scale and shift."""
    same = 1 - m.corr**2 <= COPY
    group = list(range(m.d))
    for i, j in zip(*np.nonzero(np.triu(same, 1)), strict=True):
        a, b = group[i], group[j]
        if a != b:
            group = [min(a, b) if g in (a, b) else g for g in group]
    found: dict = {}
    for v, g in enumerate(group):
        found.setdefault(g, []).append(m.names[v])
    return [names for names in found.values() if len(names) > 1]


def check_columns(m: Moments) -> None:
    """Refuses constant columns, copies, and columns that the others determine."""
    if flat := [c for c, v in zip(m.names, np.diag(m.cov), strict=True) if not v > 0]:
        raise DataError(f"columns with one value only: {', '.join(flat)}")
    if copies := copy_groups(m):
        raise DataError("columns that repeat one another up to scale and shift: " + "; ".join(", ".join(g) for g in copies))
    vals, vecs = np.linalg.eigh(m.corr)
    if vals[0] <= DEPENDENT * max(1.0, vals[-1]):
        names = [c for c, w in zip(m.names, vecs[:, 0], strict=True) if abs(w) > 1e-3]
        raise DataError(f"columns that are linearly dependent: {', '.join(names)}")


def take_columns(df: DataFrame, names: list[str], role: str) -> list[str]:
    """The columns left once those of a role (environment, targets, time) are taken out; all of these must be there."""
    if missing := [c for c in names if c not in df.columns]:
        raise DataError(f"no column {', '.join(missing)} for the {role}")
    return [c for c in df.columns if c not in names]


def settings(df: DataFrame, columns: list[str] | None = None, categorical: list[str] | None = None) -> tuple[list[str], list[str], str]:
    """(columns, categories among them, kind): continuous, categorical or mixed data."""
    own = categorical_columns(df) if categorical is None else list(categorical)
    columns = columns or [c for c in df.columns if c in own or c in numeric_columns(df)]
    own = [c for c in columns if c in own]
    check_categories(df, own)
    return columns, own, "categorical" if len(own) == len(columns) else "mixed" if own else "continuous"


#: Variables up to which the searches were measured: beyond, a warning says that run time and memory are untested.
BOUNDARIES = {"exact_search": 20, "gin": 30, "rcd": 30, "camuv": 20, "resit": 30, "kci": 15, "lpcmci": 30, "fci": 400, "pc": 1000, "ges": 400, "boss": 400, "grasp": 100, "direct_lingam": 400}


def past_boundary(method: str, d: int) -> int | None:
    """The number of variables up to which a method was measured, if there are more."""
    top = BOUNDARIES.get(method)
    return top if top is not None and d > top else None


class SizeWarning(UserWarning):
    """More variables than a method was measured with."""


class DroppedWarning(UserWarning):
    """Rows or columns are left out."""


_SAID: set = set()


def warn_once(message: str, category: type[Warning] = UserWarning, *, key=None) -> bool:
    """Warns at the caller's line the first time the process sees the message (or key); whether it did."""
    mark = (category, message if key is None else key)
    if mark in _SAID:
        return False
    _SAID.add(mark)
    warnings.warn(message, category, stacklevel=3)
    return True


def warn_past_boundary(method: str, d: int) -> None:
    if (top := past_boundary(method, d)) is not None:
        warn_once(f"{method} was measured with up to {top} variables; {d} may take long", SizeWarning, key=method)


def resolve_seed(spark: SparkSession | None = None, seed: int | None = None) -> int:
    """An explicit seed, else the session's tessera.seed, else 0."""
    if seed is not None:
        return int(seed)
    return int(spark.conf.get("tessera.seed", "0")) if spark is not None else 0


def select_engine(n: int, d: int, *, cells: int = 5_000_000) -> str:
    """driver for a table small enough to be fetched whole (n d numbers), spark beyond."""
    return "driver" if n * d <= cells else "spark"
