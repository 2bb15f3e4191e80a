"""Document fingerprints by winnowing, in DataFrame operations only.

Words (runs other than space and \\x09-\\x0D, long ones in pieces of `PIECE` characters) are hashed; the k-gram hash
is the rolling polynomial of k word hashes modulo 2^31 - 1, computed for all positions by shifted sums, so that it
equals what rolling gives. Of each window of w k-grams the least hash is chosen, the rightmost of equals, by one
number that holds the hash above the negated position. A run of k + w - 1 equal words in two texts so always gives
a common fingerprint, and its position is kept.

Edge cases: a very long text is one row of arrays, which its task holds; null text is empty and has no fingerprints; with fewer than k words, one hash of all; with fewer than w
k-grams, their least; two empty fingerprints are alike (1.0), an empty and another aren't (0.0); equal texts have
equal fingerprints; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_partitions

PIECE = 24
K, W = 5, 8
PRIME, BASE = (1 << 31) - 1, 1_000_003
POSITION = (1 << 31) - 1


def _shifted(a, b, by: int, f) -> F.Column:
    """f(a[i], b[i + by]) for all i that both have."""
    n = F.greatest(F.size(b) - by, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, by + 1, n), f)


def _poly(factor: int):
    return lambda a, b: (a * factor + b) % PRIME


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """The table with `out`: packed fingerprints (hash << 31 | 2^31 - 1 - position) of a text column, by position."""
    h, g2, g4, grams, m2, m4, short = (f"__{x}" for x in ("h", "g2", "g4", "grams", "m2", "m4", "short"))
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))
    df = df.withColumn(h, F.transform(pieces, lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME))))
    df = df.withColumn(g2, _shifted(F.col(h), F.col(h), 1, _poly(BASE)))
    df = df.withColumn(g4, _shifted(F.col(g2), F.col(g2), 2, _poly(BASE * BASE % PRIME)))
    short_hash = F.when(F.size(h) > 0, F.array(F.pmod(F.xxhash64(h), F.lit(PRIME)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(grams, F.when(F.size(h) >= K, _shifted(F.col(g4), F.col(h), 4, _poly(BASE))).otherwise(short_hash)).drop(h, g2, g4)
    df = df.withColumn(grams, F.transform(grams, lambda x, i: F.shiftleft(x, 31) + (F.lit(POSITION).cast("long") - i)))
    df = df.withColumn(m2, _shifted(F.col(grams), F.col(grams), 1, lambda a, b: F.least(a, b)))
    df = df.withColumn(m4, _shifted(F.col(m2), F.col(m2), 2, lambda a, b: F.least(a, b)))
    few = F.when(F.size(grams) > 0, F.array(F.array_min(grams))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.when(F.size(grams) >= W, F.array_distinct(_shifted(F.col(m4), F.col(m4), 4, lambda a, b: F.least(a, b)))).otherwise(few)).drop(grams, m2, m4)


def shown(packed) -> F.Column:
    """Fingerprints as hash:position, comma-joined."""
    return F.array_join(F.transform(packed, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 31))), F.lit(":"), (F.lit(POSITION).cast("long") - x.bitwiseAND(F.lit(POSITION).cast("long"))).cast("string"))), ",")


def hashes(packed) -> F.Column:
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, 31)))


def likeness(a, b) -> F.Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common / union).otherwise(1.0)


def _bucket(bounds: list[int]) -> F.Column:
    """How many of the ascending bounds are less than the id; null: 0. Two short searches, not one long one."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    heads, parts = bounds[::step], [bounds[k : k + step] for k in range(0, len(bounds), step)]
    block = F.size(F.filter(F.lit(heads), lambda q: q < F.col("id")))
    inner = F.size(F.filter(F.element_at(F.lit(parts), F.greatest(block, F.lit(1))), lambda q: q < F.col("id")))
    return F.when(F.col("id").isNull() | (block == 0), 0).otherwise((block - 1) * step + inner)


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """(id, text, next, ghost) where next is the text after it by descending id (after the last: the first).

    One shuffle of the texts by id ranges. Each range also gets the next range's first row as a ghost, and the
    lowest one the very first row, so that no range needs another. The ranges' bounds are ids of the table; as
    many come to the driver as there are ranges. Returns the window of a range too: later steps need no shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = 4 * shuffle_partitions(docs.sparkSession)
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    bounds, top = ids.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 10 * n), F.max("id")).head()
    bounds = sorted({x for x in bounds or [] if x < top})
    at = _bucket(bounds)
    is_bound = F.array_contains(F.lit(bounds), F.col("id")) if bounds else F.lit(False)
    place = lambda b, ghost, last: F.struct(b.cast("int").alias("b"), F.lit(ghost).alias("ghost"), F.lit(last).alias("last"))
    places = F.filter(F.array(place(F.col("at"), False, False), F.when(is_bound, place(F.col("at") + 1, True, False)), F.when(F.col("id").eqNullSafe(F.lit(top)), place(F.lit(0), True, True))), lambda p: p.isNotNull())
    rows = rows.withColumn("at", at).withColumn("p", F.explode(places)).select("id", "text", "p.*").withColumn("th", F.xxhash64("text"))
    window = Window.partitionBy("b").orderBy("last", F.col("id").desc_nulls_last(), "th")
    return rows.withColumn("next", F.lead("text").over(window)), window


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how near these and the next document's are."""
    rows, window = with_next(docs, id_col=id_col, text_col=text_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half)))
    rows = rows.select("id", "b", "last", "th", "ghost", "text", F.when(~F.col("ghost"), F.col("edited")).otherwise("").alias("edited"))
    rows = with_fingerprint(with_fingerprint(rows, "text", "f"), "edited", "e")
    rows = rows.select("id", "b", "last", "th", "ghost", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "f", "e", hashes("f").alias("fh"), hashes("e").alias("eh"))
    rows = rows.withColumn("nh", F.lead("fh").over(window)).where(~F.col("ghost"))
    return rows.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", shown("f").alias("fingerprint"), shown("e").alias("edited_fingerprint"), likeness("fh", "eh").alias("near_edited"), likeness("fh", "nh").alias("near_next"))
