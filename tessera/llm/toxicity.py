"""Toxicity: a factorization machine over hashed terms.

Terms of a document are its distinct words and their stems, the first `STEMS` characters, hashed into `slots`. The machine adds
to the linear weights an interaction of each pair of terms, the product of two short vectors, so that a word that
is harmless alone counts beside another. It is fitted on a bounded sample of labelled rows by mini-batches with
adaptive steps; slots that the sample shows too rarely, or as often in either class, keep weight zero, so long texts
gather no noise.

Edge cases: null and empty texts have no terms and get the bias's score; unlabelled rows are scored like others;
repeated labels of an id count once, as toxic if any is; without labels of both classes every score is the share of
toxic labels (0 without any); a very long text is one set of terms, which its task holds; equal texts have equal
scores, so there are no ties to break; an empty table gives an empty table; other columns are ignored. Only the text is
an input of a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text, released, sliced, stage, texts

TERM = re.compile(r"\w+")
STEMS = 4, 5, 6, 7
#: A slot is active from so many rows, and standard errors between its share of a class and the whole's.
LEAST, Z = 5, 3.0


def slots_of(word: str, slots: int) -> tuple[int, ...]:
    """Slots of a word: its own and its stems'."""
    return tuple(xxhash.xxh3_64_intdigest(x) % slots for x in (word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)))


def words_of(text: str) -> set[str]:
    return set(TERM.findall(text.lower()))


@dataclass
class Machine:
    """score = bias + sum of weights + half of (squared sum minus sum of squares) of the vectors, over a text's slots."""

    bias: float
    slots: np.ndarray  # active slots, ascending
    weights: np.ndarray
    vectors: np.ndarray

    def logit(self, at: np.ndarray) -> float:
        """at: positions of active slots, each once."""
        v = self.vectors[at]
        s = v.sum(axis=0)
        return float(self.bias + self.weights[at].sum() + 0.5 * (s @ s - (v * v).sum()))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def informative(rows: list[np.ndarray], y: np.ndarray, slots: int, least: int, z: float) -> np.ndarray:
    """Slots of at least `least` rows whose share of class 1 differs from the whole's by `z` standard errors."""
    if not len(rows):
        return np.zeros(0, np.int64)
    ones = np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t] or [np.zeros(0, np.int64)]), minlength=slots)
    n = np.bincount(np.concatenate(rows), minlength=slots)
    p = y.mean()
    return np.flatnonzero((n >= least) & (np.abs(ones - n * p) > z * np.sqrt(np.maximum(n, 1) * p * (1 - p))))


def fit(rows: list[np.ndarray], y: np.ndarray, slots: int, *, rank: int = 8, epochs: int = 20, linear_epochs: int = 10, drop: float = 0.7, rate: float = 0.1, decay: float = 1e-5, least: int = LEAST, z: float = Z, seed: int = 5, batch: int = 64) -> Machine:
    """A machine for rows of distinct slots and their classes.

    The first `linear_epochs` fit the weights alone and drop each term with the odds `drop`, so that a term that
    suffices by itself has its weight before pairs explain the rows where it meets others.
    """
    y = np.asarray(y, float)
    p = y.mean() if len(y) else 0.0
    rng = np.random.default_rng(seed)
    active = informative(rows, y, slots, least, z) if 0 < p < 1 else np.zeros(0, np.int64)
    m = Machine(float(np.log(max(p, 1e-9) / max(1 - p, 1e-9))) if 0 < p < 1 else (40.0 if p else -40.0), active, np.zeros(len(active)), rng.normal(0, 0.01, (len(active), rank)))
    if not len(active):
        return m
    places = np.full(slots, -1)
    places[active] = np.arange(len(active))
    own = [p[p >= 0] for p in (places[r] for r in rows)]
    gb, gw, gv = 1e-8, np.full(len(active), 1e-8), np.full((len(active), rank), 1e-8)
    order = np.arange(len(own))
    for epoch in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            cols = np.concatenate([own[i] for i in some])
            of = np.repeat(np.arange(len(some)), [len(own[i]) for i in some])
            if epoch < linear_epochs and rank:
                stays = rng.random(len(cols)) >= drop
                cols, of = cols[stays], of[stays]
            v = m.vectors[cols]
            s = np.zeros((len(some), rank))
            np.add.at(s, of, v)
            squares = np.bincount(of, (v * v).sum(axis=1), minlength=len(some))
            linear = np.bincount(of, m.weights[cols], minlength=len(some))
            g = (_sigmoid(m.bias + linear + 0.5 * ((s * s).sum(axis=1) - squares)) - y[some]) / len(some)
            gb += g.sum() ** 2
            m.bias -= rate * g.sum() / np.sqrt(gb)
            used, where = np.unique(cols, return_inverse=True)
            dw = np.bincount(where, g[of], minlength=len(used)) + decay * m.weights[used]
            gw[used] += dw**2
            m.weights[used] -= rate * dw / np.sqrt(gw[used])
            if epoch < linear_epochs or not rank:
                continue
            dv = np.zeros((len(used), rank))
            np.add.at(dv, where, g[of, None] * (s[of] - v))
            dv += decay * m.vectors[used]
            gv[used] += dv**2
            m.vectors[used] -= rate * dv / np.sqrt(gv[used])
    return m


def held_out(id_col) -> F.Column:
    """Rows that are never learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def sampled(id_col: str, rows: int, n: int) -> F.Column:
    """Whether an id's hash chooses it, at `rows` of `n` ids."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(17)), F.lit(1 << 30)) < int(min(1.0, rows / max(n, 1)) * (1 << 30))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """The documents, with their label (y), of about `rows` labelled ids at most, without held-out ones.

    A hash of the id chooses on both sides, so the other documents' texts aren't shuffled. Of several rows of an id one
    stays, the least by its values, so that the sample is bounded by its ids whatever repeats.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label).cast("int").alias("y"))
    known = known.where(~held_out("__id"))
    n = known.count()
    found = docs.where(sampled(id_col, rows, n)).join(known.where(sampled("__id", rows, n)), F.col(id_col).cast("long") == F.col("__id"))
    return found.groupBy("__id", "y").agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*", "y")


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = 20_000, slots: int = 1 << 18, **options) -> Machine:
    """A machine from at most about `rows` labelled rows.

    Their slots are counted by class where they are; only those that tell the classes apart (no texts) come to the driver.
    """

    def run(batches):
        for batch in sliced(batches):
            ids, y = batch.column("id"), batch.column("y")
            found = [sorted({s for w in words_of(t) for s in slots_of(w, slots)}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, y, pa.array(found, pa.list_(pa.int32()))], names=["id", "y", "slots"])

    sample = labelled_sample(docs.select(F.col(id_col), F.col(text_col)), labels, label, rows, id_col)
    sample = sample.select(F.col(id_col).cast("long").alias("id"), "y", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = stage(sample.mapInArrow(released(run), "id long, y int, slots array<int>"), "terms")
    n, p = table.agg(F.count("*"), F.avg("y")).head()
    p = p or 0.0
    counts = table.select("y", F.explode("slots").alias("slot")).groupBy("slot").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    apart = F.abs(F.col("ones") - F.col("n") * p) > options.get("z", Z) * F.sqrt(F.greatest(F.col("n"), F.lit(1)) * p * (1 - p))
    telling = counts.where((F.col("n") >= options.get("least", LEAST)) & apart).select("slot").toArrow()["slot"].to_numpy() if n and 0 < p < 1 else np.zeros(0, np.int32)
    known = np.zeros(slots, bool)
    known[telling] = True
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def tell(batches):
        for batch in batches:
            lists = batch.column(2)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            keep = shared.value[flat]
            total = np.concatenate([[0], np.cumsum(keep)])
            mine = pa.ListArray.from_arrays(pa.array(total[ends] - total[ends[0]], pa.int32()), pa.array(flat[ends[0] : ends[-1]][keep[ends[0] : ends[-1]]], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), mine], names=["id", "y", "slots"])

    table = table.mapInArrow(released(tell), "id long, y int, slots array<int>").toArrow().combine_chunks()
    order = np.argsort(table["id"].to_numpy(), kind="stable")
    y = table["y"].to_numpy()[order]
    lists = pa.concat_arrays(table["slots"].chunks) if len(order) else pa.array([], pa.list_(pa.int32()))
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    return fit([flat[ends[i] : ends[i + 1]] for i in order], y, slots, **options)


def score(docs: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text", slots: int = 1 << 18, keep: int = 300_000) -> DataFrame:
    """doc_id and score (0 to 1) of every document: one scan; the machine, at most `slots` vectors, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        m = shared.value
        place = {int(s): k for k, s in enumerate(m.slots)}

        class Known(dict):
            """Positions of a word's active slots."""

            def __missing__(self, word):
                if len(self) > keep:
                    self.clear()
                self[word] = found = tuple(place[s] for s in slots_of(word, slots) if s in place)
                return found

        known = Known()
        for ids, batch in texts(batches):
            out = []
            for text in batch:
                at = {p for found in map(known.__getitem__, words_of(text)) if found for p in found}
                out.append(m.logit(np.fromiter(sorted(at), np.int64, len(at))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(_sigmoid(np.array(out)))], names=["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(released(run), "doc_id long, score double")
