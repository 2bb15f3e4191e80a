"""Token-id files with Elias-Fano document boundaries.

A shard is one self-contained byte image: a header, the concatenated ids (two bytes each where the largest id
allows it, else four), and two Elias-Fano sequences with their select positions: the document ends within the shard
and the document ids. Opening one reads headers only; a document costs two selects, a document's place a binary
search by select.
Shards are the rows of a written table, in ascending document order, so any store that Spark reaches can hold
them: executors have no other writer for a remote store. `export` copies them to plain files, which `open_shard`
maps without Spark.

Edge cases: null text is empty (its document is the end id alone); null ids come first; repeated ids and rows are
kept in the order of their text's hash; a very long text is one document of one shard, however large that gets;
an empty table gives an empty file; other columns are ignored.
"""

from __future__ import annotations

import mmap
import os
import struct
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import Encoder
from tessera.llm.common import id_and_text, released, shared_dir, shuffle_partitions, texts

MAGIC = b"TSEF0002"
HEAD = struct.Struct("<8sQQQqQI")  # magic, documents, ids, null document ids, least document id, bytes of the ids, bytes per id
SEQ = struct.Struct("<QQBBQQ")  # values, largest value, low bits, bytes of a kept position, bytes of the low part, bytes of the high part
#: One position of every so many set bits is kept for select.
STRIDE = 128
#: A row for each shard; before: ids of the shards before it in its range partition.
TABLE = "part int, before long, n_docs long, n_tokens long, image binary"
ARROW = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("image", pa.binary())])


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class EliasFano:
    """A nondecreasing sequence of n values up to u in about n * (2 + log2(u / n)) bits.

    `select(i)` finds value i from the nearest kept position of a set bit and a popcount over the bytes from there.
    The kept positions, one for every STRIDE values, are part of the image: 32 bits each, or 64 where the high part
    has 2^32 bits or more.
    """

    def __init__(self, n: int, top: int, width: int, kept: np.ndarray, low, high):
        self.n, self.top, self.width, self.kept, self.low, self.high = n, top, width, kept, low, high
        self._bits = np.frombuffer(high, np.uint8)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        high = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(int(high[-1]) + 1) // 8) * 8 if n else 0, np.uint8)
        bits[high] = 1
        kept = high[::STRIDE].astype("<u4" if len(bits) < 1 << 32 else "<u8")
        low = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, top, width, kept, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes())

    def _low(self, i: int) -> int:
        value = 0
        at = i * self.width
        for k in range(self.width):
            value |= (self.low[(at + k) >> 3] >> ((at + k) & 7) & 1) << k
        return value

    def select(self, i: int) -> int:
        """Value i, without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.kept[i // STRIDE])
        left = i % STRIDE
        byte, value = at >> 3, int(self._bits[at >> 3]) >> (at & 7) << (at & 7)
        while (ones := value.bit_count()) <= left:
            left -= ones
            byte += 1
            value = int(self._bits[byte])
        for _ in range(left):
            value &= value - 1
        return 8 * byte + (value & -value).bit_length() - 1 - i << self.width | self._low(i)

    def values(self) -> np.ndarray:
        """All values, by the same positions at once."""
        high = np.flatnonzero(np.unpackbits(self._bits, bitorder="little"))[: self.n].astype(np.uint64) - np.arange(self.n, dtype=np.uint64)
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.width].reshape(self.n, self.width).astype(np.uint64)
        return (high << np.uint64(self.width)) + (low << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def dump(self) -> bytes:
        return SEQ.pack(self.n, self.top, self.width, self.kept.itemsize, len(self.low), len(self.high)) + self.kept.tobytes() + self.low + self.high

    @classmethod
    def load(cls, image, at: int) -> tuple[EliasFano, int]:
        """The sequence at a place of an image, of which nothing is copied, and where it ends."""
        n, top, width, item, low, high = SEQ.unpack_from(image, at)
        view = memoryview(image)
        at += SEQ.size
        kept = np.frombuffer(view, f"<u{item}", -(-n // STRIDE), at)
        at += kept.nbytes
        return cls(n, top, width, kept, view[at : at + low], view[at + low : at + low + high]), at + low + high


def write_shard(ids: list, counts: list[int], data: bytes) -> bytes:
    """The image of documents with these ids (nulls first, then ascending), lengths and concatenated 32-bit ids."""
    nulls = sum(x is None for x in ids)
    known = np.array([x for x in ids if x is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    tokens = np.frombuffer(data, "<u4")
    width = 2 if not len(tokens) or int(tokens.max()) < 1 << 16 else 4
    body = tokens.astype(f"<u{width}").tobytes()
    offsets = (known.astype(np.uint64) - np.uint64(least % (1 << 64))) if len(known) else np.zeros(0, np.uint64)
    return HEAD.pack(MAGIC, len(ids), len(tokens), nulls, least, len(body), width) + body + EliasFano.of(np.cumsum(np.array(counts, np.uint64))).dump() + EliasFano.of(offsets).dump()


class Shard:
    """Random access to a shard's documents by select: nothing of the image is copied or decoded but what is asked for."""

    def __init__(self, image):
        magic, self.n, self.tokens, self.nulls, self.least, size, width = HEAD.unpack_from(image, 0)
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.ids = np.frombuffer(image, f"<u{width}", self.tokens, HEAD.size)
        self.ends, at = EliasFano.load(image, HEAD.size + size)
        self.offsets, at = EliasFano.load(image, at)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.offsets.select(i - self.nulls) + self.least

    def find(self, doc_id: int) -> int | None:
        """The first place of a document id, by binary search over select."""
        lo, hi = 0, self.offsets.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.offsets.select(mid) + self.least < doc_id else (lo, mid)
        return self.nulls + lo if lo < self.offsets.n and self.offsets.select(lo) + self.least == doc_id else None

    def bounds(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.ids[a:b]


def write(docs: DataFrame, tokenizer: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_ids: int = 1 << 18, partitions: int | None = None) -> None:
    """Write the shards to `path`: one range shuffle by id, then each task writes shards of about `shard_ids` ids."""
    end = int(end_id).to_bytes(4, "little")

    def shards(batches):
        part, coder = TaskContext.get().partitionId(), encoder(tokenizer)
        ids, counts, data, size, before = [], [], [], 0, 0

        def image():
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, before, len(ids), size, write_shard(ids, counts, b"".join(data))), ARROW, strict=True)], schema=ARROW)

        for some, batch in texts(batches):
            for doc, x in zip(some, coder.encode(batch), strict=True):
                ids.append(doc)
                data += (x, end)
                counts.append(len(x) // 4 + 1)
                size += counts[-1]
                if size >= shard_ids:
                    yield image()
                    ids, counts, data, size, before = [], [], [], 0, before + size
        if ids:
            yield image()

    rows = id_and_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions or shuffle_partitions(docs.sparkSession), F.col("id").asc_nulls_first(), "h").sortWithinPartitions(F.col("id").asc_nulls_first(), "h")
    rows.select("id", "text").mapInArrow(released(shards), TABLE).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of written shards: doc_id, start (ids of all documents before), ids (binary, 32 bits each).

    Only each range partition's total comes to the driver (as many rows as `write` had partitions).
    """
    table = spark.read.schema(TABLE).parquet(path)
    base, bases = 0, []
    for part, n in table.groupBy("part").agg(F.sum("n_tokens")).orderBy("part").collect():
        bases.append((part, base))
        base += n
    placed = table.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def documents(batches):
        for batch in batches:
            for start, image in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                shard, begin = Shard(image), 0
                offsets = shard.offsets.values().astype(np.int64) + shard.least
                for at in range(0, shard.n, 1024):
                    rows = []
                    for i in range(at, min(at + 1024, shard.n)):
                        end = shard.ends.select(i)
                        rows.append((None if i < shard.nulls else int(offsets[i - shard.nulls]), start + begin, shard.ids[begin:end].astype("<u4").tobytes()))
                        begin = end
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return placed.select(F.col("base") + F.col("before"), "image").mapInArrow(released(documents), "doc_id long, start long, ids binary")


def export(spark: SparkSession, path: str, folder: str) -> list[str]:
    """Copy the shards of `path` to plain files of a folder that this process sees; their names, in document order.

    One shard at a time is held here, as the files are one after another on one disk.
    """
    os.makedirs(folder, exist_ok=True)
    names = []
    for row in spark.read.schema(TABLE).parquet(path).orderBy("part", "before").toLocalIterator():
        names.append(os.path.join(folder, f"{row['part']:06d}-{row['before']:015d}.tsef"))
        with open(names[-1], "wb") as f:
            f.write(row["image"])
    return names


def open_shard(name: str) -> Shard:
    """A shard of a plain file, mapped: pages are read as documents are asked for."""
    with open(name, "rb") as f:
        return Shard(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write all documents, read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, tokenizer, path, **options)
    return read(spark, path).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
