"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Targets: sources in code-point order weigh 3, 1, 2, repeating, and share `share` times all words; a target stops at
`most` times its source's words, the excess going to the others by weight. With r = most * words / weight, a source
is capped exactly where all targets at level r would not exceed the whole, so two window sums over the sources give
all targets at once.

Rounding: a source's documents are to be taken target / words times each; the whole part is taken as it is, and the
fraction becomes 0 or 1 by pairs. In a pair, words move from one document to the other until one fraction is integral;
the direction is random with the odds that keep each document's expectation, and the words of the two together stay
as they were. Folding that over a chunk of at most `chunk` documents leaves one fractional document; the fractional
ones of all chunks form the next level of a reduction tree, until a source has one. It is taken in part (its first
words), so that the source's words meet the target to a word.

All random numbers are hashes of (seed, level, key, size), where key is a hash of the row's id and text, and chunks
follow their order: reruns agree, and rows without an id or with the same one are dealt to chunks like others. Rows
of the same id and text are one another's equals: which of them is taken isn't defined, how many is.

Sources: their number is a row count of one small table that one task orders. Up to `BROADCAST_SOURCES` of them the
table is broadcast; of more, those with a share of the rows of 1 / BROADCAST_SOURCES or more are (so many there can be
at most), and the others, none of them large, are joined by a shuffle.

Edge cases: a null or empty text has size 0 and isn't taken; a null source is the last source; null and repeated
ids are kept, each row for itself; sources without words have target 0; a very long text is one document, which may be
the one taken in part; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, stage, words

#: Sources up to this many are broadcast.
BROADCAST_SOURCES = 100_000
ITEM = "struct<doc_id:bigint,key:bigint,size:bigint,whole:int,x:double,u:double>"
FIELDS = ("doc_id", "key", "size", "whole", "x")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n, target) of a table (source, size). One row a source; their order is one small sort."""
    everything = Window.partitionBy(F.lit(0))
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int")))
    by = by.withColumns({"cap": most * F.col("source_size"), "whole": share * F.sum("source_size").over(everything)}).withColumn("r", F.col("cap") / F.col("weight"))
    up_to, above = Window.orderBy("r"), Window.orderBy(F.col("r").desc())
    level = F.sum("cap").over(up_to) + F.col("r") * (F.sum("weight").over(above) - F.sum("weight").over(Window.partitionBy("r")))
    by = by.withColumn("capped", level <= F.col("whole"))
    rest = F.col("whole") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    return by.select("source", "source_size", "n", F.when(F.col("capped"), F.col("cap")).otherwise(rest * F.col("weight") / free).alias("target"))


def _uniform(*columns) -> F.Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) / float(1 << 52)


#: One step of the fold: acc.cur meets d. Whichever becomes integral goes to acc.done, the other stays in acc.cur.
_GAIN, _LOSE = "least((1 - acc.cur.x) * acc.cur.size, d.x * d.size)", "least(acc.cur.x * acc.cur.size, (1 - d.x) * d.size)"
_UP = f"d.u * ({_GAIN} + {_LOSE}) < {_LOSE}"


def _with_x(item: str, x: str) -> str:
    return f"named_struct('doc_id', {item}.doc_id, 'key', {item}.key, 'size', {item}.size, 'whole', {item}.whole, 'x', cast(greatest(0D, least(1D, {x})) as double), 'u', {item}.u)"


def _settled(done: str, x: str, stays: str, y: str) -> str:
    return f"named_struct('cur', {_with_x(stays, y)}, 'done', array_append(acc.done, {_with_x(done, x)}))"


FOLD = f"""aggregate(items, named_struct('cur', cast(null as {ITEM}), 'done', cast(array() as array<{ITEM}>)), (acc, d) -> CASE
  WHEN acc.cur IS NULL THEN named_struct('cur', d, 'done', acc.done)
  WHEN {_UP} THEN CASE
    WHEN (1 - acc.cur.x) * acc.cur.size <= d.x * d.size THEN {_settled("acc.cur", "1D", "d", "d.x - (1 - acc.cur.x) * acc.cur.size / d.size")}
    ELSE {_settled("d", "0D", "acc.cur", "acc.cur.x + d.x * d.size / acc.cur.size")} END
  ELSE CASE
    WHEN acc.cur.x * acc.cur.size <= (1 - d.x) * d.size THEN {_settled("acc.cur", "0D", "d", "d.x + acc.cur.x * acc.cur.size / d.size")}
    ELSE {_settled("d", "1D", "acc.cur", "acc.cur.x - (1 - d.x) * d.size / acc.cur.size")} END
END)"""


def _folded(rows: DataFrame, level: int, seed: int, chunk: int) -> DataFrame:
    """Rows (source, n, item fields) folded in chunks: (source, left, item fields), one row left over from each chunk."""
    h = F.xxhash64(F.lit(seed), F.lit(level), "key", "size")
    rows = rows.withColumn("h", h).withColumn("u", _uniform(F.lit(seed + 1), F.lit(level), "key", "size"))
    rows = rows.withColumn("b", F.pmod("h", F.ceil(F.col("n") / (16 * chunk))))
    number = F.row_number().over(Window.partitionBy("source", "b").orderBy("h", "key", "size", "x"))
    chunks = rows.withColumn("c", F.floor((number - 1) / chunk)).groupBy("source", "b", "c").agg(F.sort_array(F.collect_list(F.struct("h", F.struct(*FIELDS, "u").alias("item")))).alias("items"))
    folded = chunks.withColumn("items", F.col("items.item")).withColumn("acc", F.expr(FOLD))
    every = F.concat(F.transform("acc.done", lambda d: F.struct(F.lit(False).alias("left"), d.alias("d"))), F.array(F.struct(F.lit(True).alias("left"), F.col("acc.cur").alias("d"))))
    return folded.select("source", F.explode(every).alias("e")).select("source", "e.left", *(f"e.d.{c}" for c in FIELDS))


def _of_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The rows with their source's row of a (checkpointed) table that has a source's number of rows, n."""
    def joined(rows, some):
        return rows.join(some.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")

    sources, n = table.agg(F.count("*"), F.sum("n")).head()
    if sources <= BROADCAST_SOURCES:
        return joined(rows, F.broadcast(table))
    large = table.where(F.col("n") * BROADCAST_SOURCES >= n)
    others = rows.join(F.broadcast(large.select(F.col("source").alias("of"))), F.col("source").eqNullSafe(F.col("of")), "left_anti")
    return joined(rows, F.broadcast(large)).unionByName(joined(others, table))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 9, chunk: int = 256, key: F.Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, whole (copies), x (a further copy's share).

    x is 0 or 1 but for one document a source at most. key: a number to draw by instead of the hash of id and text, for
    ids that another run may give to other rows.
    """
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)) if key is None else key
    sizes = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")), "sizes")
    goal = checkpoint(targets(sizes, weights, share, most))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = _of_source(sizes, goal).withColumn("times", times).withColumn("whole", F.floor("times").cast("int")).withColumn("x", F.col("times") - F.col("whole"))
    still = (F.col("size") > 0) & (F.col("x") > 0)
    plain = rows.where(~still).withColumn("x", F.lit(0.0)).select("source", *FIELDS)
    level, left, done = 0, rows.where(still).select("source", "n", *FIELDS), [plain]
    while True:
        folded = stage(_folded(left, level, seed, chunk), f"rounded{level}")
        done.append(folded.where(~F.col("left")).drop("left"))
        left = folded.where("left").drop("left")
        n = checkpoint(left.groupBy("source").agg(F.count("*").alias("n")))
        if (n.agg(F.max("n")).head()[0] or 0) <= 1:
            done.append(left)
            break
        left = _of_source(left, n).select("source", "n", *FIELDS)
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return _of_source(out.drop("key"), goal.select("source", "source_size", "target", "n")).drop("n")


def taken(mixed: DataFrame) -> F.Column:
    """Words that the mix takes from a document, repeats counted."""
    return (mixed["whole"] * mixed["size"] + F.round(mixed["x"] * mixed["size"])).cast("long")
