"""Packing: bounded-space online best-fit packing of token ids into fixed windows.

Each task keeps `open_windows` windows. A document's ids (with the end id) are cut into full windows and a rest;
the rest goes to the open window that it fills best. When none has room, the fullest is completed by a cut of the
rest where its gap is worth a cut (`min_cut`), and emitted. Windows that are open at the end of a task are merged
in a tree: groups of `fan_in` tasks pack the pieces of their open windows by the same rule, until one group is left.

Edge cases: null or empty text is the end id alone; a null id is kept; repeated rows are packed each for itself;
an empty table gives no rows; other columns are ignored; a very long text is cut into full windows as it is read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import Encoder
from tessera.llm.common import id_and_text, released, stage, texts

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, open boolean, ids binary"
ARROW = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")), ("open", pa.bool_()), ("ids", pa.binary())])
#: A sequence's id is level << 56 | task << 32 | number in the task.
LEVEL, TASK = 56, 32


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Best-fit packing with a fixed number of open windows; `rows` gets finished pieces."""

    def __init__(self, window: int, open_windows: int, min_cut: int, first_id: int):
        self.window, self.most, self.min_cut, self.next = window, open_windows, min_cut, first_id
        self.free: list[tuple[int, int]] = []  # (room, window), sorted
        self.pieces: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _emit(self, k: int, still_open: bool) -> None:
        offset = 0
        for doc, start, ids, tokens in self.pieces.pop(k):
            n = len(ids) // 4
            self.rows.append((doc, start, n, tokens, self.next, offset, still_open, ids))
            offset += n
        self.next += 1

    def _put(self, at: int, piece: tuple) -> None:
        room, k = self.free.pop(at)
        self.pieces[k].append(piece)
        room -= len(piece[2]) // 4
        if room:
            insort(self.free, (room, k))
        else:
            self._emit(k, False)

    def add(self, doc, start: int, ids: bytes, tokens: int) -> None:
        step = 4 * self.window
        at = 0
        while len(ids) - at >= step:
            self.pieces[-1] = [(doc, start + at // 4, ids[at : at + step], tokens)]
            self._emit(-1, False)
            at += step
        start, ids = start + at // 4, ids[at:]
        while ids:
            n = len(ids) // 4
            if (at := bisect_left(self.free, (n, -1))) < len(self.free):
                return self._put(at, (doc, start, ids, tokens))
            if len(self.free) < self.most:
                k = 1 + max(self.pieces, default=0)
                self.pieces[k] = []
                insort(self.free, (self.window, k))
            elif (gap := self.free[0][0]) >= self.min_cut and n - gap >= self.min_cut:
                self._put(0, (doc, start, ids[: 4 * gap], tokens))
                start, ids = start + gap, ids[4 * gap :]
            else:
                self._emit(self.free.pop(0)[1], False)

    def leave_open(self) -> None:
        for _, k in self.free:
            self._emit(k, True)
        self.free = []

    def close(self) -> None:
        """Fill the fullest windows with what the emptiest hold, then emit all."""
        left = [self.pieces.pop(k) for _, k in self.free]
        self.free, self.most, self.min_cut = [], 1, 1
        for doc, start, ids, tokens in (x for pieces in left for x in pieces):
            self.add(doc, start, ids, tokens)
        for _, k in self.free:
            self._emit(k, False)
        self.free = []

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(ARROW), ARROW, strict=True)], schema=ARROW)


def _run(packer: Packer, pieces: Iterator[tuple], last: bool) -> Iterator[pa.RecordBatch]:
    size = 0
    for piece in pieces:
        packer.add(*piece)
        size += len(piece[2])
        if size > 4_000_000:
            yield packer.batch()
            size = 0
    packer.close() if last else packer.leave_open()
    yield packer.batch()


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, open_windows: int = 64, min_cut: int = 8, end_id: int = 0, fan_in: int = 64) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of all documents in windows of `window` ids.

    The plan is one scan without a shuffle, a written table, and one small shuffle per level of open windows
    (at most `open_windows` windows per task of the level below). ids: little-endian unsigned 32-bit integers.
    """
    end = int(end_id).to_bytes(4, "little")

    def leaf(batches):
        part = TaskContext.get().partitionId()
        coder = encoder(tokenizer)

        def pieces():
            for ids, batch in texts(batches):
                for doc, x in zip(ids, coder.encode(batch), strict=True):
                    yield doc, 0, x + end, len(x) // 4 + 1

        yield from _run(Packer(window, open_windows, min_cut, part << TASK), pieces(), False)

    packed = stage(id_and_text(docs, id_col, text_col).mapInArrow(released(leaf), SCHEMA), "packed")
    done, level, behind = [packed.where(~F.col("open"))], 1, packed
    task = F.shiftrightunsigned("sequence_id", TASK).bitwiseAND(F.lit((1 << LEVEL - TASK) - 1))
    tasks = (behind.where("open").agg(F.max(task)).head()[0] or 0) + 1
    while True:
        groups = -(-tasks // fan_in)
        last = groups == 1

        def merge(batches, level=level, last=last, fan_in=fan_in):
            rows = (r for b in batches for r in b.to_pylist())
            packer, now = None, None
            for group, r in ((r["grp"], r) for r in rows):
                if group != now:
                    if packer:
                        yield from _run(packer, iter(()), last)
                    packer, now = Packer(window, open_windows, min_cut, level << LEVEL | group << TASK), group
                packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
                if len(packer.rows) > 4096:
                    yield packer.batch()
            if packer:
                yield from _run(packer, iter(()), last)

        left = behind.where("open").withColumn("grp", F.floor(task / fan_in)).repartition(groups, "grp").sortWithinPartitions("grp", "sequence_id", "offset")
        behind = stage(left.mapInArrow(released(merge), SCHEMA), f"packed{level}")
        done.append(behind.where(~F.col("open")))
        if last:
            break
        tasks, level = groups, level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.drop("open")

