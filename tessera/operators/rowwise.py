"""Expectations of any function of the rows: each task sums over its Arrow batches, sums are added in a tree."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.blas import one_thread

FAN_IN = 64


#: Numbers of a table that are fetched once where a search would scan it again and again.
FETCH = 5_000_000


class Fetched:
    """The complete rows of a small table, in this process; `row_sums` takes it in a table's place."""

    def __init__(self, x: np.ndarray, columns: list[str]):
        self.x, self.columns = x, list(columns)


def fetched(df: DataFrame, columns: list[str], n: int) -> DataFrame | Fetched:
    """The table, or its rows where n rows of the columns are at most FETCH numbers."""
    if isinstance(df, Fetched) or n * len(columns) > FETCH:
        return df
    table = df.select([F.col(c).cast("double") for c in columns]).dropna().toArrow()
    return Fetched(np.stack([table[k].to_numpy() for k in range(len(columns))], axis=1), columns)


def row_sums(df: DataFrame | Fetched, columns: list[str], f: Callable[[np.ndarray], np.ndarray]) -> tuple[int, np.ndarray]:
    """(n, sum over rows of f): f maps a batch (n, d) to a vector of sums, of the same length for every batch."""
    if isinstance(df, Fetched):
        x = df.x if df.columns == list(columns) else df.x[:, [df.columns.index(c) for c in columns]]
        with one_thread():
            parts = [np.asarray(f(x[at : at + 10_000]), float).ravel() for at in range(0, len(x), 10_000)]
        return len(x), np.sum(parts, axis=0) if parts else np.asarray(0.0)
    schema = "n long, v binary"
    out_schema = pa.schema([("n", pa.int64()), ("v", pa.binary())])

    def one(n, v):
        return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([v.tobytes()], pa.binary())], schema=out_schema)

    def partial(batches):
        n, v = 0, None
        for batch in batches:
            if batch.num_rows:
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
                with one_thread():
                    s = np.asarray(f(x), float).ravel()
                n, v = n + len(x), s if v is None else v + s
        if v is not None:
            yield one(n, v)

    def add(batches):
        n, v = 0, None
        for batch in batches:
            for k, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(s)
                n, v = n + k, s if v is None else v + s
        if v is not None:
            yield one(n, v)

    rows = df.select([F.col(c).cast("double") for c in columns]).dropna()
    parts, width = rows.mapInArrow(partial, schema), rows.rdd.getNumPartitions()
    while width > FAN_IN:
        width = -(-width // FAN_IN)
        parts = parts.repartition(width).mapInArrow(add, schema)
    n, v = 0, 0.0
    for r in parts.collect():
        n, v = n + r["n"], v + np.frombuffer(r["v"])
    return n, np.asarray(v)


def row_sums_by(df: DataFrame, columns: list[str], group: str, f: Callable[[object, np.ndarray], np.ndarray]) -> dict:
    """{group: (n, sum over its rows of f(group, rows))}, all groups in one scan: tasks sum per group, then groups add up."""
    data = [F.col(c).cast("double").alias(f"__x{k}") for k, c in enumerate(columns)]
    rows = df.select(F.col(group).alias("__g"), *data).dropna()
    kind = rows.schema["__g"].dataType
    schema = T.StructType([T.StructField("g", kind), T.StructField("n", T.LongType()), T.StructField("v", T.BinaryType())])

    def emitted(found):
        keys = list(found)
        return pa.RecordBatch.from_arrays([pa.array(keys, to_arrow_type(kind)), pa.array([found[k][0] for k in keys], pa.int64()), pa.array([found[k][1].tobytes() for k in keys], pa.binary())], names=["g", "n", "v"])

    def partial(batches):
        found: dict = {}
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            at, labels = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            for k, label in enumerate(labels):
                own = x[at == k]
                with one_thread():
                    v = np.asarray(f(label, own), float).ravel()
                n, s = found.get(label, (0, 0.0))
                found[label] = n + len(own), s + v
        if found:
            yield emitted(found)

    def add(batches):
        found: dict = {}
        for batch in batches:
            for g, k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, s = found.get(g, (0, 0.0))
                found[g] = n + k, s + np.frombuffer(v)
        if found:
            yield emitted(found)

    parts = rows.mapInArrow(partial, schema).repartition("g").mapInArrow(add, schema)
    return {r["g"]: (r["n"], np.frombuffer(r["v"])) for r in parts.collect()}
