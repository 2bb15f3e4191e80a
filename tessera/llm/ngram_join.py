"""N-gram Jaccard join: exact near-duplicate components of word-shingle sets.

1. One pass turns each document into its shingle set's id, size and parity bitmap, and counts shingles in a table
   of fixed size (`slots`), from whose counts all tasks take one order of shingles, rare ones first.
2. A second pass gives each set's prefix in that order: n - ceil(t n) + 1 shingles. Sets with Jaccard t or more
   share a prefix shingle, whatever the order is; the counts only keep the groups small. Groups with the same
   members count once.
3. In each group all members are compared with one of them (a star). Links found so join most of a group of near
   copies, in as many rows as members.
4. What a star leaves apart is compared in size-banded tiles: bands of a factor 1/t, so that only equal and
   neighbouring bands meet, dealt by hash to blocks of about `block` members. In a tile, bit counts of bitmap differences bound
   each pair's overlap from above; pairs within the bound, in different components so far, are kept. Two rounds keep
   each member's nearest pair only, in `few_groups` groups of its own, which joins most of what belongs together;
   the last keeps every pair of every group.
5. Each kept pair is decided by the intersection of the two sorted arrays. Components follow by contraction.

Documents with equal sets are one member throughout, so exact copies never meet one another. What a group needs
(its size, first member, components, blocks) is aggregated before the shuffle and joined to its members. The members of
a group that may have BIG members or more, by the counts of its shingle, are salted; so are those of a group with at
least 1 / LARGE of all rows in a join, of which there are LARGE at most. No task gets a large group whole.

Edge cases: a null or empty text, or one without words, has no shingles and links with nothing; the ids of a
repeated row are joined as any copies; rows with a null id are compared and link like others, and have a null
component where no row of it has an id; shingles of equal counts are ordered by their hash; a very long text is one
set, which its task holds whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, id_and_text, released, shuffle_partitions, sliced, stage, texts, unstage
from tessera.llm.components import components
from tessera.llm.shingles import Shingler, bitmap, folded, set_id, width_of

#: Blocks of the table of counts that travel as one row.
PARTS = 64
#: A shingle that occurs so often may have a group too large for one task; at most what a task counts exactly.
BIG = 1 << 12
#: Where in a shingle's hash its salt goes.
SALT = 40
#: A group of at least this part of all rows is salted in joins.
LARGE = 1_000
#: The bitmap of wanted ids has so many bits for each.
BITS = 16


def needed(na, nb, t: tuple[int, int]):
    """The smallest overlap with overlap / union >= t[0] / t[1]."""
    return -(-(t[0] * (na + nb)) // (t[0] + t[1]))


def _described(rows: DataFrame, k: int, slots: int):
    """Staged rows (kind 0: id, s, n, bm of a document; kind 1: part, counts)."""

    def run(batches):
        shingler, seen, table, pending, size = Shingler(k), set(), np.zeros(slots, np.int64), [], 0
        for ids, batch in texts(batches):
            out = []
            for doc, text in zip(ids, batch, strict=True):
                x = shingler(text)
                if not len(x):
                    out.append((doc, None, 0, None))
                    continue
                s = set_id(x)
                out.append((doc, s, len(x), bitmap(x)))
                if s not in seen:
                    seen.add(s)
                    pending.append((x & np.uint64(slots - 1)).astype(np.int64))
                    size += len(x)
            if len(seen) > 200_000:
                seen.clear()
            if size > slots:
                table += np.bincount(np.concatenate(pending), minlength=slots)
                pending, size = [], 0
            a, b, c, d = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.binary())], names=["id", "s", "n", "bm"])
        if pending:
            table += np.bincount(np.concatenate(pending), minlength=slots)
        if table.any():
            counts = np.minimum(table, (1 << 16) - 1).astype("<u2").reshape(PARTS, -1)
            yield pa.RecordBatch.from_arrays([pa.nulls(PARTS, pa.int64()), pa.array(range(PARTS), pa.int64()), pa.array([-1] * PARTS, pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary())], names=["id", "s", "n", "bm"])

    return stage(rows.mapInArrow(released(run), "id long, s long, n int, bm binary"), "sets")


def _order(described: DataFrame, slots: int) -> np.ndarray:
    """Counts by slot: PARTS rows come to the driver, of `slots` numbers together."""

    def add(batches):
        total = {}
        for batch in batches:
            for part, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(image, image_type(image)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.astype("<u8").tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])

    def image_type(image):
        return "<u2" if len(image) == 2 * slots // PARTS else "<u8"

    kept = described.where("n = -1").select(F.col("s").alias("part"), F.col("bm").alias("counts"))
    summed = kept.mapInArrow(released(add), "part long, counts binary").repartition(PARTS, "part").mapInArrow(released(add), "part long, counts binary")
    out = np.zeros((PARTS, slots // PARTS), np.uint64)
    for part, counts in summed.collect():
        out[part] = np.frombuffer(counts, "<u8")
    return np.minimum(out.ravel(), (1 << 32) - 1).astype(np.uint32)


def _prefixes(rows: DataFrame, k: int, slots: int, counts: np.ndarray, t: tuple[int, int], big: int) -> DataFrame:
    """(g, s, n): the prefix of each set, once for each task that has it; g: the shingle.

    Where the shingle may occur `big` times, n is negative and g has a salt, which follows from s, in its upper bits.
    """
    parts = shuffle_partitions(rows.sparkSession)
    order = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        shingler, seen, table = Shingler(k), set(), order.value
        for _, batch in texts(batches):
            h, s, n = [], [], []
            for text in batch:
                x = shingler(text)
                if not len(x) or (one := set_id(x)) in seen:
                    continue
                seen.add(one)
                p = len(x) - -(-(t[0] * len(x)) // t[1]) + 1
                rank = table[(x & np.uint64(slots - 1)).astype(np.int64)]
                first = np.lexsort((x, rank))[:p]
                often = rank[first] >= big
                h.append(np.where(often, x[first] ^ np.uint64(one % parts << SALT), x[first]))
                s.append(np.full(p, one, np.int64))
                n.append(np.where(often, -len(x), len(x)).astype(np.int32))
            if len(seen) > 200_000:
                seen.clear()
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(s)), pa.array(np.concatenate(n))], names=["g", "s", "n"])

    return rows.mapInArrow(released(run), "g long, s long, n int")


def _with_group(rows: DataFrame, groups: DataFrame, size: str, key: str = "h", spread: str = "s") -> DataFrame:
    """The rows (key, spread, ..) with their group's row of a checkpointed table (key, ..).

    size: its column of the number of members; those of a large group are dealt by `spread`.
    """
    parts = F.lit(shuffle_partitions(rows.sparkSession))
    n = groups.agg(F.sum(size)).head()[0] or 0
    large = F.col(key).isin([r[0] for r in groups.where(F.col(size) * LARGE >= n).select(key).collect()])
    rows = rows.withColumn("salt", F.when(large, F.pmod(F.xxhash64(spread), parts)).otherwise(0).cast("int"))
    groups = groups.withColumn("salt", F.explode(F.when(large, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))))
    return rows.join(groups, [key, "salt"]).drop("salt")


def _verified(pairs: DataFrame, sets: DataFrame, k: int, t: tuple[int, int], at_once: int = 1024) -> DataFrame:
    """The pairs (a, b) whose texts' sets have the similarity. Pairs of one a are dealt in lots of about `at_once`."""
    lots = checkpoint(pairs.groupBy("a").agg(F.count("*").alias("m")))
    pairs = _with_group(pairs, lots, "m", "a", "b").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / at_once)).alias("lot"))
    firsts = pairs.select("a", "lot").distinct().join(sets.select(F.col("s").alias("a"), "text"), "a").select("a", "lot", F.lit(None).cast("long").alias("b"), "text")
    seconds = pairs.join(sets.select(F.col("s").alias("b"), "text"), "b").select("a", "lot", "b", "text")

    def run(batches):
        shingler, now, mine = Shingler(k), None, None
        for batch in sliced(batches):
            a, b = [], []
            for first, lot, second, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if second is None:
                    now, mine = (first, lot), shingler(text)
                    continue
                assert now == (first, lot)
                other = shingler(text)
                if len(np.intersect1d(mine, other, assume_unique=True)) >= needed(len(mine), len(other), t):
                    a.append(first)
                    b.append(second)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = firsts.unionByName(seconds).repartition("a", "lot").sortWithinPartitions("a", "lot", F.col("b").asc_nulls_first())
    return rows.mapInArrow(released(run), "a long, b long")


def _tiles(members: DataFrame, t: tuple[int, int], block: int) -> DataFrame:
    """Members (h, s, n, component) once for each tile (h, ka, kb, ca, cb) that they belong to, but for groups of one component."""
    band = F.floor(F.ln("n") / math.log(t[1] / t[0])).cast("int")
    rows = members.withColumn("k", band)
    # members of a band are dealt to blocks by their hash, about `block` to each
    blocks = F.ceil(F.col("m") / block).cast("int")
    bands = rows.groupBy("h", "k").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    bands = bands.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("k", blocks.alias("m")))).alias("m"), F.sum("m").alias("all"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rows = _with_group(rows, checkpoint(bands.where("lo < hi").drop("lo", "hi")), "all").withColumn("c", F.pmod(F.xxhash64("s", "h"), F.element_at("m", F.col("k"))).cast("int"))

    def tiles(k, other, make):
        blocks = F.coalesce(F.try_element_at("m", other), F.lit(0))
        return F.when(blocks > 0, F.transform(F.sequence(F.lit(0), blocks - 1), make)).otherwise(F.array().cast("array<struct<ka:int,kb:int,ca:int,cb:int>>"))

    def tile(ka, kb, ca, cb):
        return F.struct(ka.cast("int").alias("ka"), kb.cast("int").alias("kb"), ca.cast("int").alias("ca"), cb.cast("int").alias("cb"))

    k, c = F.col("k"), F.col("c")
    own = tiles(k, k, lambda x: tile(k, k, F.least(c, x), F.greatest(c, x)))
    up = tiles(k, k + 1, lambda x: tile(k, k + 1, c, x))
    down = tiles(k, k - 1, lambda x: tile(k - 1, k, x, c))
    return rows.withColumn("t", F.explode(F.concat(own, up, down))).select("h", "t.*", "k", "c", "s", "n", "component")


def _compared(tiles: DataFrame, t: tuple[int, int], nearest: bool) -> DataFrame:
    """Pairs (a, b) of a tile, in different components, that their sizes and bitmaps don't rule out.

    nearest: of each member's pairs only the one of the greatest bound, so that a tile gives no more pairs than it
    has members.
    """

    def pairs(key, rows):
        _, ka, kb, ca, cb = key
        k, c, s, n, comp, bm = zip(*rows, strict=True)
        left = [i for i in range(len(s)) if (k[i], c[i]) == (ka, ca)]
        right = [i for i in range(len(s)) if (k[i], c[i]) == (kb, cb)]
        if not left or not right or len(s) < 2:
            return
        width = min(width_of(x) for x in n)
        maps = np.stack([folded(x, width) for x in bm])
        n, comp = np.array(n, np.int64), np.array(comp)
        other = np.array(right)
        for i in left:
            j = other[comp[other] != comp[i]] if nearest or left != right else other[(comp[other] != comp[i]) & (other > i)]
            if len(j):
                apart = np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1, dtype=np.int64)
                bound = np.minimum((n[j] + n[i] - apart) // 2, np.minimum(n[j], n[i]))
                fits = bound >= needed(n[j], n[i], t)
                j, bound = j[fits], bound[fits]
                if nearest and len(j) > 1:
                    j = j[[np.argmax(bound / (n[j] + n[i] - bound))]]
                for x in j:
                    yield min(s[i], s[x]), max(s[i], s[x])

    def run(batches):
        now, rows, a, b = None, [], [], []
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if row[:5] != now:
                    if len(rows) > 1:
                        for x, y in pairs(now, rows):
                            a.append(x)
                            b.append(y)
                    now, rows = row[:5], []
                rows.append(row[5:])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
        if len(rows) > 1:
            for x, y in pairs(now, rows):
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    key = ["h", "ka", "kb", "ca", "cb"]
    tiles = tiles.select(*key, "k", "c", "s", "n", "component", "bm")
    return tiles.repartition(*key).sortWithinPartitions(*key).mapInArrow(released(run), "a long, b long").distinct()


def _bounded(pairs: DataFrame, sets: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that their sets' sizes and bitmaps don't rule out."""
    of = lambda x: sets.select(F.col("s").alias(x), F.col("n").alias(f"n{x}"), F.col("bm").alias(f"m{x}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "na", "nb", "ma", "mb")

    def run(batches):
        for batch in sliced(batches, 1024):
            keep = []
            for i, (na, nb, ma, mb) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True)):
                width = min(width_of(na), width_of(nb))
                apart = int(np.bitwise_count(folded(ma, width) ^ folded(mb, width)).sum())
                if min((na + nb - apart) // 2, na, nb) >= needed(na, nb, t):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select([0, 1])

    return both.mapInArrow(released(run), "a long, b long")


def _texts_of(pairs: DataFrame, rows: DataFrame, sets: DataFrame, k: int, most_bits: int) -> DataFrame:
    """(s, text) of the pairs' sets, staged: each from its representative document, or from rows without an id.

    A bitmap of the wanted ids (of sets, where rows have none), BITS for each but `most_bits` at most, goes to all tasks,
    so that few other texts are shuffled.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct().join(sets.select("s", "rep"), "s")
    wanted = checkpoint(wanted.select("s", F.coalesce("rep", "s").alias("key"), F.col("rep").isNotNull().alias("known")))
    bits = min(most_bits, max(1 << 10, 1 << (BITS * wanted.count()).bit_length()))
    at = F.pmod("key", F.lit(bits))
    words = wanted.select(F.shiftright(at, 5).alias("w"), F.expr("shiftleft(1L, cast(pmod(key, 32) as int))").alias("v"), "known").groupBy("w").agg(F.bit_or("v").alias("v"), F.bool_and("known").alias("known")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[words["w"].to_numpy()] = words["v"].to_numpy().astype(np.uint32)
    without = not all(words["known"].to_pylist())
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def sieve(batches):
        shingler, seen = Shingler(k), set()

        def hit(key):
            return (shared.value[key % bits >> 5] >> (key % bits & 31).astype(np.uint32)) & 1 > 0

        for batch in batches:
            has = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            key = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).copy()
            keep = hit(key) & has
            for i in np.flatnonzero(~has) if without else ():
                x = shingler(batch.column(1)[int(i)].as_py())
                if len(x) and (one := set_id(x)) not in seen and hit(np.int64(one)):
                    seen.add(one)
                    key[i], keep[i] = one, True
            if len(seen) > 200_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(has), batch.column(1)], names=["key", "known", "text"]).filter(pa.array(keep))

    def matching(batches):
        shingler, seen = Shingler(k), set()  # ids may repeat: a text counts where it has the wanted set
        for batch in sliced(batches):
            s, text = (batch.column(c).to_pylist() for c in range(2))
            keep = []
            for i in range(len(s)):
                if s[i] not in seen and len(x := shingler(text[i])) and set_id(x) == s[i]:
                    keep.append(i)
                    seen.add(s[i])
            if len(seen) > 200_000:
                seen.clear()
            yield batch.take(pa.array(keep, pa.int64()))

    some = rows.mapInArrow(released(sieve), "key long, known boolean, text string")
    return stage(some.join(wanted, ["key", "known"]).select("s", "text").mapInArrow(released(matching), "s long, text string"), "texts")


def _decided(pairs: DataFrame, rows: DataFrame, sets: DataFrame, k: int, t: tuple[int, int], bits: int) -> DataFrame:
    """Those of the (checkpointed) pairs that are links, by their sets' intersections; a checkpoint."""
    found = _texts_of(pairs, rows, sets, k, bits)
    links = checkpoint(_verified(pairs, found, k, t).distinct())
    unstage(found)
    return links


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components (s, component) once more links (a, b) are known: only the components that links touch are contracted."""
    of = lambda x: labels.select(F.col("s").alias(x), F.col("component").alias(f"c{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    ends = checkpoint(ends)
    merged = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("to"))
    every = labels.unionByName(ends.select(F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("ca").alias("component")), F.struct(F.col("b").alias("s"), F.col("cb").alias("component")))).alias("e")).select("e.*")).distinct()
    return checkpoint(every.join(merged, "component", "left").select("s", F.coalesce("to", "component").alias("component")))


def _grouped(rows: DataFrame, k: int, slots: int, t: tuple[int, int], big: int = BIG) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (id, s, n), their distinct sets (s, n, rep, bm), and groups (h, s, n) of sets that share a prefix shingle."""
    described = _described(rows, k, slots)
    documents = described.where("n >= 0")
    sets = stage(documents.where("n > 0").groupBy("s", "n").agg(F.min("id").alias("rep"), F.first("bm").alias("bm")), "distinct")

    # groups of sets that share a prefix shingle: whole in one partition, but for those that may be big
    prefixes = _prefixes(rows, k, slots, _order(described, slots), t, big).repartition("g").groupBy("g", "s", "n").agg(F.lit(1).alias("one"))
    about = {"m": F.count("*"), "x": F.bit_xor("s"), "y": F.bit_xor(F.xxhash64("s"))}
    whole, salt = Window.partitionBy("g"), F.shiftleft(F.pmod("s", F.lit(shuffle_partitions(rows.sparkSession))), SALT)
    shared = prefixes.withColumns({c: f.over(whole) for c, f in about.items()}).where("m > 1 or n < 0")
    shared = stage(shared.select(F.when(F.col("n") < 0, F.col("g").bitwiseXOR(salt)).otherwise(F.col("g")).alias("h"), "s", F.abs("n").alias("n"), (F.col("n") < 0).alias("big"), *about), "shared")
    large = shared.where("big").groupBy("h").agg(*(f.alias(c) for c, f in about.items())).where("m > 1")

    # of groups with the same members, the one of the least shingle
    groups = shared.where("not big").select("h", *about).unionByName(large).groupBy(*about).agg(F.min("h").alias("h")).select("h", "m")
    groups = stage(_with_group(shared.select("h", "s", "n"), checkpoint(groups), "m").select("h", "s", "n"), "groups")
    unstage(shared)
    return documents, sets, groups


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (3, 4), slots: int = 1 << 20, block: int = 256, few_groups: int = 4, filter_bits: int = 1 << 26, big: int = BIG) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id that links reach, its own included).

    threshold: the least Jaccard similarity as a fraction. slots and filter_bits bound tables that every task gets,
    whatever the corpus; larger ones keep groups small and fewer texts on the move. Neither these nor block, few_groups
    and big (see BIG) change the result.
    """
    rows, t = id_and_text(docs, id_col, text_col), threshold
    documents, sets, groups = _grouped(rows, k, slots, t, big)

    # stars
    first = checkpoint(groups.groupBy("h").agg(F.min(F.struct("s", "n")).alias("p"), F.count("*").alias("m")))
    stars = _with_group(groups, first, "m").where("s <> p.s").where((t[1] * F.least("n", "p.n")) >= (t[0] * F.greatest("n", "p.n"))).select(F.col("p.s").alias("a"), F.col("s").alias("b")).distinct()
    links = _decided(checkpoint(_bounded(stars, sets, t)), rows, sets, k, t, filter_bits)
    labels = components(links).select(F.col("node").alias("s"), "component")

    # what is left: nearest pairs in a few groups of each member first, then all pairs in all groups
    few = stage(groups.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("h"))).where(F.col("r") <= few_groups).drop("r"), "few")
    for some, nearest in ((few, True), (few, True), (groups, False)):
        members = some.join(labels, "s", "left").withColumn("component", F.coalesce("component", "s"))
        tiles = _tiles(members, t, block).join(sets.select("s", "bm"), "s")
        pairs = checkpoint(_compared(tiles, t, nearest))
        if not pairs.isEmpty():
            labels = _joined(labels, _decided(pairs, rows, sets, k, t, filter_bits))

    classes = sets.select("s", "rep").join(labels, "s", "left").withColumn("component", F.coalesce("component", "s"))
    least = checkpoint(classes.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("m")))
    classes = checkpoint(_with_group(classes, least, "m", "component").select("s", "component_id"))
    for x in (groups, few, sets):
        unstage(x)
    out = documents.select("id", "s", "n").join(classes, "s", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def link_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (3, 4), slots: int = 1 << 20, block: int = 256, filter_bits: int = 1 << 26, big: int = BIG) -> DataFrame:
    """One row per document: doc_id, n_shingles, n_links (the other rows of the similarity or more, copies included).

    All pairs of all tiles that bitmaps don't rule out are verified, whatever components they are in; each pair of
    sets counts for as many rows as have the other set.
    """
    rows, t = id_and_text(docs, id_col, text_col), threshold
    documents, sets, groups = _grouped(rows, k, slots, t, big)
    tiles = _tiles(groups.withColumn("component", F.col("s")), t, block).join(sets.select("s", "bm"), "s")
    links = _decided(checkpoint(_compared(tiles, t, False)), rows, sets, k, t, filter_bits)
    copies = documents.where("n > 0").groupBy("s").agg(F.count("*").alias("copies"))
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.join(copies.withColumnRenamed("s", "b"), "b").groupBy(F.col("a").alias("s")).agg(F.sum("copies").alias("near"))
    counts = checkpoint(copies.join(near, "s", "left").select("s", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")))
    for x in (groups, sets):
        unstage(x)
    out = documents.select("id", "s", "n").join(counts, "s", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
