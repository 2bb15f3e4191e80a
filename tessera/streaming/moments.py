"""Running statistics of a stream: each micro-batch adds its sums to a table, moments are read from the table.

A batch's sums replace those of the same batch number, so a repeated batch after a failure counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.moments import Moments, _unpack, sums


def window_statistics(stream: DataFrame, time: str, key: str, value: str, *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, sum and sum of squares of a value by key and event-time window; late rows within the watermark count."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.sum(F.col(value) * F.col(value)).alias("squares"))


def accumulate(stream: DataFrame, columns: list[str], path: str, checkpoint: str, shift=None):
    """A query that keeps each micro-batch's sums in `path`/batch=<number>."""
    shift = [0.0] * len(columns) if shift is None else shift

    def add(batch: DataFrame, number: int) -> None:
        row = batch.dropna(subset=columns).agg(F.count("*").alias("n"), *(s.alias(f"s{k}") for k, s in enumerate(sums(columns, shift))))
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def current(spark, columns: list[str], path: str, shift=None) -> Moments:
    """Moments of all batches so far."""
    shift = [0.0] * len(columns) if shift is None else shift
    k = len(columns) * (len(columns) + 3) // 2
    row = spark.read.parquet(path).agg(F.sum("n"), *(F.sum(f"s{i}") for i in range(k))).head()
    return _unpack(row[1:], columns, shift, row[0])
