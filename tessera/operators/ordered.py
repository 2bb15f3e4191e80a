"""Global order without a global window: ranks, running sums and lags over a range-partitioned table.

`arranged` sorts a table by ranges and cuts its lineage with a checkpoint, so that what reads it again sees the same
rows in the same partitions and order. A task then knows what lies before it from one small row of each partition.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cut(df: DataFrame) -> DataFrame:
    """The table without its lineage: a reliable checkpoint in the folder of spark.checkpoint.dir.

    Where that is unset, a session that is one process makes a folder of its own; any other is refused.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoints-"))
    return df.checkpoint(eager=True)


def arranged(df: DataFrame, *order) -> DataFrame:
    """The rows in ranges of the order, each range sorted; equal rows by the order share a range."""
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order))


def _before(parts: list[tuple[int, float]]) -> dict[int, float]:
    """What lies before each partition, from (partition, amount)."""
    out, total = {}, 0
    for part, amount in sorted(parts):
        out[part] = total
        total += amount
    return out


def _appended(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in fields)])


def _amounts(rows: DataFrame, amount: Callable[[pa.RecordBatch], float]) -> list[tuple[int, float]]:
    """(partition, amount) of each partition that has rows: as many small rows as partitions."""

    def run(batches):
        n, total = 0, 0.0
        for batch in batches:
            n, total = n + batch.num_rows, total + amount(batch)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([float(total)])], names=["part", "amount"])

    return [tuple(r) for r in rows.mapInArrow(run, "part int, amount double").collect()]


def with_running_sum(rows: DataFrame, column: str, out: str) -> DataFrame:
    """An arranged table with `out`: the sum of a column over all rows before, as a double."""
    spark, at = rows.sparkSession, rows.columns.index(column)
    start = spark.sparkContext.broadcast(_before(_amounts(rows.select(F.col(column).cast("double")), lambda b: np.nansum(b.column(0).to_numpy(zero_copy_only=False)))))

    def run(batches):
        total = None
        for batch in batches:
            if total is None:
                total = start.value.get(TaskContext.get().partitionId(), 0.0)
            x = np.nan_to_num(batch.column(at).cast(pa.float64()).to_numpy(zero_copy_only=False))
            up = total + np.cumsum(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(up - x)], names=[*batch.schema.names, out])
            total = up[-1] if len(up) else total

    return rows.mapInArrow(run, _appended(rows.schema, (out, T.DoubleType())))


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, n, rank): distinct values with their counts and the average rank of the rows that have each.

    Values are grouped first, so that rows are never sorted; nulls have no rank.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    below = with_running_sum(arranged(values, "value"), "n", "below")
    return below.select("value", "n", (F.col("below") + (F.col("n") + 1) / 2).alias("rank"))


def benjamini_hochberg(df: DataFrame, p: str, out: str) -> DataFrame:
    """The table with adjusted p-values: p m / rank, the least from above, at most 1; for tables of any size."""
    rows = arranged(df.withColumn("__one", F.lit(1)), F.col(p).desc())
    m = rows.count()
    raw = with_running_sum(rows, "__one", "__above").withColumn(out, F.col(p) * m / (m - F.col("__above"))).drop("__one", "__above")
    at, schema = raw.columns.index(out), raw.schema

    def lows(batches):
        least = [np.min(b.column(at).to_numpy(zero_copy_only=False), initial=np.inf) for b in batches]
        if least:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([float(min(least))])], names=["part", "least"])

    before, least = {}, 1.0
    for part, low in sorted(tuple(r) for r in raw.mapInArrow(lows, "part int, least double").collect()):
        before[part], least = least, min(least, low)
    shared = df.sparkSession.sparkContext.broadcast(before)

    def run(batches):
        low = None
        for batch in batches:
            if low is None:
                low = shared.value.get(TaskContext.get().partitionId(), 1.0)
            q = np.minimum(np.minimum.accumulate(batch.column(at).to_numpy(zero_copy_only=False)), low)
            low = q[-1] if len(q) else low
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(q), *batch.columns[at + 1 :]], names=batch.schema.names)

    return raw.mapInArrow(run, schema)


def anderson_darling(df: DataFrame, p: str) -> tuple[int, float]:
    """(n, statistic) of the uniformity of a column of p-values, of tables of any size: ranks from one sort of the values."""
    ranks = with_running_sum(arranged(df.where(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("u")).agg(F.count("*").alias("k")), "u"), "k", "below")
    n = ranks.agg(F.sum("k")).head()[0] or 0
    if not n:
        return 0, 0.0
    # the i-th least has weight 2 i - 1 for ln u and 2 (n - i) + 1 for ln(1 - u); equal values take the sum of their ranks
    up = F.col("k") * (2 * F.col("below") + F.col("k"))
    down = F.col("k") * (2 * n - 2 * F.col("below") - F.col("k"))
    u = F.least(F.greatest(F.col("u"), F.lit(1e-300)), F.lit(1 - 2.0**-53))
    return int(n), float(-n - ranks.agg(F.sum(up * F.ln(u) + down * F.log1p(-u))).head()[0] / n)


def with_lags(df: DataFrame, columns: list[str], order: str, lags: int, series: str | None = None, first: int = 0) -> DataFrame:
    """Each row with the rows 1..lags steps before it in its series (column c at lag k: c__k).

    Rows without `max(first, lags)` rows before them are left out. Rows are ordered by ranges of (series, order); a
    range takes the last rows before it from the ends of the ranges, of which so many rows each come to the driver.
    """
    keys = [*([series] if series else []), order]
    need = max(first, lags)
    rows = arranged(df.select(*keys, *(c for c in columns if c not in keys)), *keys)
    names = rows.columns
    out = _appended(rows.schema, *((f"{c}__{k}", rows.schema[c].dataType) for k in range(1, lags + 1) for c in columns))
    if not need:
        return rows

    def tails(batches):
        tail = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if tail is None else [*tail.to_batches(), batch])
            tail = table.slice(max(0, table.num_rows - need))
        if tail is not None and tail.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, tail.schema) as writer:
                writer.write_table(tail)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "tail"])

    before, last = {}, None
    for part, image in sorted(tuple(r) for r in rows.mapInArrow(tails, "part int, tail binary").collect()):
        tail = pa.ipc.open_stream(bytes(image)).read_all()
        if last is not None:
            before[part] = last
            tail = pa.concat_tables([last, tail])
        last = tail.slice(max(0, tail.num_rows - need)).combine_chunks()
    shared = df.sparkSession.sparkContext.broadcast(before)

    def run(batches):
        tail, started = None, False
        for batch in batches:
            if not started:
                tail, started = shared.value.get(TaskContext.get().partitionId()), True
            old = tail.num_rows if tail is not None else 0
            table = pa.Table.from_batches([batch]) if not old else pa.concat_tables([tail.cast(batch.schema), pa.Table.from_batches([batch])])
            table = table.combine_chunks()
            at = np.arange(old, table.num_rows)
            at = at[at >= need]
            if series:
                code = table[series].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                at = at[code[at] == code[at - need]]
            now = table.take(pa.array(at))
            lagged = [table[c].take(pa.array(at - k)) for k in range(1, lags + 1) for c in columns]
            found = pa.table([*now.columns, *lagged], names=[f.name for f in out.fields])
            yield from found.to_batches()
            tail = table.slice(max(0, table.num_rows - need))

    return rows.select(names).mapInArrow(run, out)


def row_pattern(df: DataFrame, columns: list[str], order: str, series: str | None = None) -> DataFrame:
    """Whether each column rises (1), falls (-1) or stays (0) from the row before; the first row of a series has none."""
    rows = with_lags(df, columns, order, 1, series)
    return rows.select(*([series] if series else []), order, *(F.signum(F.col(c) - F.col(f"{c}__1")).cast("int").alias(c) for c in columns))
