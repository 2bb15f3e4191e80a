"""Validation of a sample table and encoding of its categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DataError(ValueError):
    """The table can't be used as it is; the message names every column concerned."""


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Columns that are categories by type: text and booleans; never by their values."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def as_doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles, with NaN as null; nested columns are refused."""
    nested = [f.name for f in df.schema.fields if f.name in columns and isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if nested:
        raise DataError(f"nested columns can't be variables: {', '.join(nested)}")
    return df.select([F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: name, n, n_null, n_distinct, least, greatest, mean; one aggregation of one scan."""
    aggs = []
    for k, c in enumerate(columns):
        x = F.col(c)
        aggs += [F.count(x).alias(f"n{k}"), F.sum(x.isNull().cast("long")).alias(f"u{k}"), F.min(x).alias(f"a{k}"), F.max(x).alias(f"b{k}"), F.avg(x).alias(f"m{k}")]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"n{k}").alias("n"), F.col(f"u{k}").alias("n_null"), F.col(f"a{k}").cast("double").alias("least"), F.col(f"b{k}").cast("double").alias("greatest"), F.col(f"m{k}").alias("mean")) for k, c in enumerate(columns)))
    return one.select(F.explode(rows).alias("p")).select("p.*")


def checked(df: DataFrame, columns: list[str], *, min_rows: int = 2, missing: bool = False) -> DataFrame:
    """The columns as doubles, after one job that finds constant, infinite, null-holding columns and too few rows."""
    if len(set(columns)) < len(columns):
        raise DataError("column names must be unique")
    out = as_doubles(df, columns)
    rows = {r["name"]: r for r in profile(out, columns).collect()}
    n = max((r["n"] + (r["n_null"] or 0) for r in rows.values()), default=0)
    if n < min_rows:
        raise DataError(f"{n} rows; at least {min_rows} are needed")
    for what, bad in {
        "infinite values": [c for c, r in rows.items() if r["n"] and abs(r["least"]) == float("inf") or r["n"] and abs(r["greatest"]) == float("inf")],
        "one value only": [c for c, r in rows.items() if not r["n"] or r["least"] == r["greatest"]],
        "missing values": [] if missing else [c for c, r in rows.items() if r["n_null"]],
    }.items():
        if bad:
            raise DataError(f"columns with {what}: {', '.join(bad)}")
    return out


#: Categories up to this many are looked up in an expression; more are joined.
FEW = 64


def encoded(df: DataFrame, columns: list[str], most: int = 10_000) -> tuple[DataFrame, dict[str, list]]:
    """Categories as codes 0..k-1 by sorted value, and each column's categories in that order.

    Values are compared as what they are, not as text. One job counts the distinct values of all columns roughly, so
    that a column of too many is refused before its values come to the driver; one job gets them. NaN is no category.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    values = {c: F.nullif(F.col(c), F.lit(float("nan")).cast(types[c])) if isinstance(types[c], (T.FloatType, T.DoubleType)) else F.col(c) for c in columns}
    rough = df.agg(*(F.approx_count_distinct(values[c], 0.02).alias(c) for c in columns)).head() if columns else []
    many = [c for c, n in zip(columns, rough, strict=True) if n > 1.1 * most]
    found = df.agg(*(F.collect_set(values[c]).alias(c) for c in columns)).head() if columns and not many else [[]] * len(columns)
    many += [c for c, v in zip(columns, found, strict=True) if len(v) > most]
    if many:
        raise DataError(f"more than {most:,} categories in {', '.join(many)}")
    levels = {c: sorted(v) for c, v in zip(columns, found, strict=True)}
    out = df
    for c in columns:
        known = levels[c]
        if len(known) <= FEW:
            code = F.coalesce(F.array_position(F.array(*(F.lit(v).cast(types[c]) for v in known)), values[c]), F.lit(0)) - 1 if known else F.lit(-1)
            out = out.withColumn(c, F.when(values[c].isNotNull(), F.when(code >= 0, code).otherwise(F.raise_error(F.lit(f"{c} has a value that it hadn't before")))).cast("int"))
        else:
            table = df.sparkSession.createDataFrame([(v, k) for k, v in enumerate(known)], T.StructType([T.StructField("__v", types[c]), T.StructField("__k", T.IntegerType())]))
            out = out.join(F.broadcast(table), values[c] == F.col("__v"), "left").withColumn(c, F.col("__k")).drop("__v", "__k")
    return out.select(df.columns), levels


#: Distinct values up to this many are broadcast with their ranks.
MOST_RANKS = 100_000


def normal_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column as the normal quantile of its average rank / (n + 1); missing values stay missing.

    Ranks are those of a column's distinct values, sorted by ranges, so ties share a rank and no task gets all values.
    They are broadcast where they are few and joined otherwise.
    """
    from tessera.functions.columns import normal_quantile
    from tessera.operators.ordered import average_ranks, cut

    out = df
    for c in columns:
        ranks = cut(average_ranks(df, c).withColumnsRenamed({"value": "__v", "rank": "__r", "n": "__k"}))
        values, n = ranks.agg(F.count("*"), F.sum("__k")).head()
        ranks = ranks.select("__v", normal_quantile(F.col("__r") / ((n or 0) + 1)).alias("__r"))
        out = out.join(F.broadcast(ranks) if values <= MOST_RANKS else ranks, F.col(c) == F.col("__v"), "left").withColumn(c, F.col("__r")).drop("__v", "__r")
    return out.select(columns)
