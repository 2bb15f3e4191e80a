"""Quality classifier by co-training of a text view and a page-metadata view.

The text view sees hashed words and how many words have which shape. The metadata view sees what a crawler records
about a page: language, source, length, and layout (lines, their lengths and repetition, shares of capitals, digits
and marks). Each view's classifier is fitted on the labelled sample; then, round by round, each labels every document
outside that sample that it is sure of, and of these a lot of distinct ones, drawn by their hash from the whole
table, teaches the other. Both are calibrated on labelled rows kept apart, and a document's quality is the mean of
the calibrated log odds.

Bounds: the labelled sample has about `rows` rows (by a hash of the id), a round's lot `lot` pseudo-labelled documents
for each view; only these rows' slots come to the driver. Texts are read once, when the slots of every document are
written; each round labels all documents from these, and so does the score.

Edge cases: null text, language and source count as empty; without labels of both classes every document is good if
the labels are or if there are none, and bad if they are; repeated labels of an id count once, as good if any is, and
repeated rows of an id once; equal documents are one candidate of a lot; scores don't depend on other rows, so ties
are equal scores; very long texts are read whole, one at a time; an empty table gives an empty table; other columns
are ignored (`kept` returns them).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import release, released
from tessera.llm.toxicity import Machine, _sigmoid, fit, labelled_sample

#: Upper bounds of the classes of a share: fixed values.
SHARES = (0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
TEXT_SLOTS, META_SLOTS = 1 << 18, 1 << 12
SHAPES = ("capital", "shout", "bare", "digit", "link")
#: Classes of a character, as bits: capital, mark (not of a word, nor space, dot or comma), digit.
UPPER, MARK, DIGIT = 1, 2, 4
ALNUM, NUMERAL = re.compile(r"[^\W_]"), re.compile(r"\d")


@lru_cache(1 << 16)
def _slot(name: str, slots: int) -> int:
    return xxhash.xxh3_64_intdigest(name) % slots


def _share(name: str, part: float, whole: float) -> str:
    x = part / whole if whole else 0.0
    return f"{name}:{sum(x > b for b in SHARES)}"


def _slots(names, slots: int) -> list[int]:
    return sorted({_slot(x, slots) for x in names})


class _Words(dict):
    """A word's slot, and above it which of the shapes the word has, as bits."""

    def __missing__(self, w: str) -> int:
        if len(self) > 100_000:
            self.clear()
        has = w.isupper() and len(w) > 1
        if not w.isalpha():  # letters alone are none of the other shapes
            has |= w.endswith("!") << 1 | (not ALNUM.search(w)) << 2 | bool(NUMERAL.search(w)) << 3 | ("://" in w or "www." in w) << 4
        self[w] = found = xxhash.xxh3_64_intdigest(w.lower()) % TEXT_SLOTS | has * TEXT_SLOTS
        return found


#: Rows of slots: all slots, row after row, each row's ascending; and each row's number of them.
Rows = tuple[np.ndarray, np.ndarray]
VIEWS = T.StructType([T.StructField(x, T.ArrayType(T.IntegerType())) for x in ("text", "meta")])


def _rows(slots: np.ndarray, row: np.ndarray, n: int, bits: int) -> Rows:
    """The distinct slots of each of n rows."""
    both = np.unique(row << bits | slots)
    return both & (1 << bits) - 1, np.bincount(both >> bits, minlength=n)


def text_views(texts: list[str], known: _Words | None = None) -> Rows:
    """Slots of the content: distinct words, and the shares of words by shape. known: what a task knows of words."""
    known = _Words() if known is None else known
    found, counts, sizes, extra, of = [], [], [], [], []
    for text in texts:
        distinct = Counter(text.split())
        found += map(known.__getitem__, distinct)
        counts += distinct.values()
        sizes.append(len(distinct))
    found, counts, sizes = np.array(found, np.int64), np.array(counts, np.int64), np.array(sizes, np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    n = np.bincount(row, counts, len(texts)).astype(int)
    shapes = [np.bincount(row[hit], counts[hit], len(texts)).astype(int) for hit in (np.flatnonzero(found & TEXT_SLOTS << k) for k in range(len(SHAPES)))]
    for i in range(len(texts)):
        names = [_share(f"#{s}", k[i], n[i]) for s, k in zip(SHAPES, shapes, strict=True)]
        extra += [_slot(x, TEXT_SLOTS) for x in (*names, _share("#distinct", sizes[i], n[i]), f"#words:{int(n[i]).bit_length()}")]
        of += [i] * (len(SHAPES) + 2)
    return _rows(np.concatenate([found & TEXT_SLOTS - 1, np.array(extra, np.int64)]), np.concatenate([row, np.array(of, np.int64)]), len(texts), TEXT_SLOTS.bit_length() - 1)


def _class(c: str) -> int:
    return UPPER * c.isupper() | MARK * (not (c.isalnum() or c.isspace() or c in "_.,")) | DIGIT * c.isdecimal()


@cache
def _classes() -> np.ndarray:
    """Classes of the first 2^16 code points."""
    return np.fromiter((_class(chr(c)) for c in range(1 << 16)), np.uint8, 1 << 16)


def counted(text: str) -> tuple[int, int, int]:
    """Capitals, marks and digits of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    far = codes >= 1 << 16
    by = np.bincount(_classes()[codes if not far.any() else codes[~far]], minlength=8)
    for c in codes[far].tolist():
        by[_class(chr(c))] += 1
    return tuple(int(sum(by[k] for k in range(8) if k & bit)) for bit in (UPPER, MARK, DIGIT))


def meta_view(text: str, lang: str, source: str) -> list[int]:
    """Slots of a page's record: language, source, length and layout."""
    lines = text.split("\n")
    n = len(text)
    upper, marks, digits = counted(text)
    names = [f"lang:{lang}", f"source:{source}", f"chars:{n.bit_length()}", f"lines:{len(lines).bit_length()}", f"line:{(n // len(lines)).bit_length()}"]
    names += [_share("repeated", len(lines) - len(set(lines)), len(lines)), _share("upper", upper, n), _share("marks", marks, n), _share("digits", digits, n), _share("blank", text.count(" ") + len(lines) - 1, n)]
    return _slots(names, META_SLOTS)


def meta_views(texts: list[str], langs: list[str], sources: list[str]) -> Rows:
    rows = [meta_view(*r) for r in zip(texts, langs, sources, strict=True)]
    return flattened(rows)


def flattened(rows: list) -> Rows:
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.int64, int(n.sum())), n


@dataclass
class View:
    machine: Machine
    slots: int
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        self.table = np.zeros(self.slots)
        self.table[self.machine.slots] = self.machine.weights

    def logits(self, rows: Rows) -> np.ndarray:
        """Log odds of rows of slots, as the classifier has them."""
        flat, n = rows
        return self.machine.bias + np.bincount(np.repeat(np.arange(len(n)), n), self.table[flat], minlength=len(n))

    def calibrated(self, rows: Rows) -> np.ndarray:
        return self.slope * self.logits(rows) + self.shift

    def calibrate(self, rows: list, y: np.ndarray) -> None:
        """Platt's two numbers by Newton steps, with his targets, which aren't quite 0 and 1."""
        if not len(y) or y.min() == y.max():
            return
        x = self.logits(flattened(rows))
        up, down = y.sum(), len(y) - y.sum()
        t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
        w = np.array([1.0, 0.0])
        a = np.stack([x, np.ones(len(x))], axis=1)
        for _ in range(50):
            p = _sigmoid(a @ w)
            h = (a * (p * (1 - p))[:, None]).T @ a + 1e-6 * np.eye(2)
            step = np.linalg.solve(h, a.T @ (p - t))
            w -= step * min(1.0, 2 / max(1e-12, np.abs(step).max()))
        if w[0] > 0:
            self.slope, self.shift = float(w[0]), float(w[1])


#: What a view teaches the other in a round: (label, its slots in the other view).
Lesson = tuple[int, np.ndarray]


def co_train(text: list, meta: list, y: np.ndarray, exchange: Callable[[tuple[View, View], float], tuple[list[Lesson], list[Lesson]]], *, rounds: int = 3, apart: float = 0.25, seed: int = 3) -> tuple[View, View]:
    """Both views' classifiers after `rounds` of exchange.

    exchange(views, share of class 1) gives the lessons for the text view and for the metadata view.
    """
    rng = np.random.default_rng(seed)
    keep = rng.random(len(y)) >= apart
    if not len(y) or len(set(y[keep])) < 2:
        keep[:] = True
    share = y[keep].mean() if len(y) else 1.0
    if not 0 < share < 1:
        constant = Machine(40.0 if share else -40.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)))
        return View(constant, TEXT_SLOTS), View(constant, META_SLOTS)
    options = [{"slots": TEXT_SLOTS, "rank": 0, "least": 5, "z": 4.0}, {"slots": META_SLOTS, "rank": 0, "least": 5, "z": 0.0}]
    rows = [[r for r, k in zip(v, keep, strict=True) if k] for v in (text, meta)]
    ys = [list(y[keep]), list(y[keep])]

    def fitted():
        return tuple(View(fit(r, np.array(t), **o), o["slots"]) for r, t, o in zip(rows, ys, options, strict=True))

    views = fitted()
    for _ in range(rounds):
        lessons = exchange(views, share)
        if not any(lessons):
            break
        for own, target, taught in zip(rows, ys, lessons, strict=True):
            own += [r for _, r in taught]
            target += [t for t, _ in taught]
        views = fitted()
    for view, v in zip(views, (text, meta), strict=True):
        view.calibrate([r for r, k in zip(v, keep, strict=True) if not k], y[~keep])
    return views


def _packed(rows: Rows) -> pa.Array:
    """Rows of slots as lists of differences, which take less space."""
    flat, n = rows
    ends = np.cumsum(n)
    gaps = np.diff(flat, prepend=0)
    first = (ends - n)[n > 0]
    gaps[first] = flat[first]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(gaps, pa.int32()))


def _unpacked(lists: pa.Array) -> Rows:
    """Rows of slots of lists of differences."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    n = np.diff(ends)
    total = np.concatenate([[0], np.cumsum(lists.values.to_numpy()[ends[0] : ends[-1]], dtype=np.int64)])
    return total[1:] - np.repeat(total[ends[:-1] - ends[0]], n), n


@F.arrow_udf(VIEWS)
def _views(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    known = _Words()
    for text, lang, source in batches:
        parts = []
        for at in range(0, len(text), 256):
            some = [c.slice(at, 256).to_pylist() for c in (text, lang, source)]
            parts.append(pa.StructArray.from_arrays([_packed(text_views(some[0], known)), _packed(meta_views(*some))], names=["text", "meta"]))
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("text", pa.list_(pa.int32())), ("meta", pa.list_(pa.int32()))]))
    del known
    release()


def described(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents with __key, a hash of what the views see, and __views, the slots of both.

    Texts are read once if a described table is written before it is used: a few bytes for each distinct word.
    """
    if "__views" in docs.columns:
        return docs
    seen = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, lang_col, source_col)]
    return docs.select("*", F.xxhash64(*seen).alias("__key"), _views(*seen).alias("__views"))


def _collected(rows: DataFrame) -> tuple:
    """(keys, labels, text slots, metadata slots) of a bounded table (key, y, views), by key."""
    table = rows.select("key", "y", "views.text", "views.meta").toArrow().combine_chunks()
    order = np.argsort(table["key"].to_numpy(), kind="stable")
    views = []
    for c in ("text", "meta"):
        flat, n = _unpacked(pa.concat_arrays(table[c].chunks) if table[c].num_chunks else pa.array([], pa.list_(pa.int32())))
        parts = np.split(flat, np.cumsum(n)[:-1]) if len(n) else []
        views.append([parts[i] for i in order])
    keys, y = table["key"].to_numpy()[order], table["y"].to_numpy()[order]
    del table
    release()
    return keys, y, *views


def _sure(pages: DataFrame, views: tuple[View, View], known: np.ndarray, sure: float, most: tuple[int, int]) -> list[tuple[int, int, int]]:
    """(view that is sure, label, key): of each view and label the `most` least keys of the documents it is sure of.

    pages: (key, views) of all documents; known: sorted keys that are left out. Each task keeps its own least keys,
    then one of 16 groups of keys does; what remains, 16 times `most` at most, is settled on the driver.
    """
    shared = pages.sparkSession.sparkContext.broadcast((views, known))

    def run(batches):
        (mine, skip), kept = shared.value, {(v, t): np.zeros(0, np.int64) for v in (0, 1) for t in (0, 1)}
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            rows = [_unpacked(batch.column(c)) for c in ("text", "meta")]
            new = skip[np.minimum(np.searchsorted(skip, keys), len(skip) - 1)] != keys if len(skip) else np.ones(len(keys), bool)
            for v in (0, 1):
                p = _sigmoid(mine[v].logits(rows[v]))
                for t in (0, 1):
                    hit = keys[new & ((p if t else 1 - p) >= sure)]
                    if len(hit):
                        kept[v, t] = np.unique(np.concatenate([kept[v, t], hit]))[: most[t]]
        for (v, t), keys in kept.items():
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, v, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(keys)], names=["view", "y", "key"])

    found = pages.select("key", "views.text", "views.meta").mapInArrow(released(run), "view int, y int, key long").distinct()
    place = F.row_number().over(Window.partitionBy("view", "y", F.pmod("key", F.lit(16))).orderBy("key"))
    found = found.withColumn("r", place).where(F.col("r") <= F.when(F.col("y") == 1, most[1]).otherwise(most[0])).drop("r")
    by: dict = {}
    for view, t, k in sorted(tuple(r) for r in found.collect()):
        by.setdefault((view, t), []).append(k)
    return [(view, t, k) for (view, t), keys in by.items() for k in keys[: most[t]]]


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", rows: int = 10_000, lot: int = 1_000, sure: float = 0.98, **options) -> tuple[View, View]:
    """The two views, co-trained on all documents, which should be a written table of `described` ones."""
    pages = described(docs).select(F.col(id_col), F.col("__key").alias("key"), F.col("__views").alias("views"))
    known, y, text, meta = _collected(labelled_sample(pages, labels, label, rows, id_col))
    seen = [np.unique(known)]

    def exchange(views, share):
        most = int(lot * (1 - share)), int(lot * share)
        found = _sure(pages, views, seen[0], sure, most)
        wanted = sorted({k for _, _, k in found})
        if not wanted:
            return [], []
        seen[0] = np.union1d(seen[0], np.array(wanted, np.int64))
        keys, _, a, b = _collected(pages.where(F.col("key").isin(wanted)).groupBy("key").agg(F.min("views").alias("views"), F.lit(-1).alias("y")))
        place = {int(k): i for i, k in enumerate(keys)}
        lessons = [], []
        for view, t, k in sorted(found):
            lessons[1 - view].append((t, (a, b)[1 - view][place[k]]))
        return lessons

    return co_train(text, meta, y, exchange, **options)


def scorer(spark, views: tuple[View, View]):
    """A function of described documents' views: struct of both views' probabilities and the combined quality."""
    shared = spark.sparkContext.broadcast(views)

    @F.arrow_udf("struct<text_score:double,meta_score:double,quality:double>")
    def scores(text: pa.Array, meta: pa.Array) -> pa.Array:
        x, y = (v.calibrated(_unpacked(c)) for v, c in zip(shared.value, (text, meta), strict=True))
        return pa.StructArray.from_arrays([pa.array(_sigmoid(z)) for z in (x, y, (x + y) / 2)], names=["text_score", "meta_score", "quality"])

    return scores("__views.text", "__views.meta")


def score(docs: DataFrame, views: tuple[View, View], *, id_col: str = "doc_id") -> DataFrame:
    """doc_id, text_score, meta_score, quality of every document: one scan, no shuffle."""
    rows = described(docs).select(F.col(id_col).cast("long").alias("doc_id"), "__views")
    return rows.select("doc_id", scorer(docs.sparkSession, views).alias("q")).select("doc_id", "q.*")


def kept(docs: DataFrame, views: tuple[View, View], *, threshold: float = 0.5) -> DataFrame:
    """The documents of at least that quality, with their columns as they were."""
    return described(docs).where(scorer(docs.sparkSession, views)["quality"] >= threshold).drop("__key", "__views")
