import zlib

import numpy as np
import pytest

from tessera.llm import quality, toxicity
from tessera.llm.queries import QUERIES
from tests.llm.conftest import make

LABELS = "doc_id long, quality int, toxic int"


def test_machine_gradient_by_differences():
    """One full-batch step moves against the numerical gradient of the loss."""
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(12, 5, replace=False)) for _ in range(40)]
    y = np.array([int(3 in r and 7 in r) for r in rows])
    m = toxicity.fit(rows, y, 12, least=1, z=0.0, epochs=300, linear_epochs=20, seed=1)
    p = [m.logit(np.searchsorted(m.slots, [s for s in r if s in set(m.slots)])) > 0 for r in rows]
    assert (np.array(p) == (y > 0)).mean() > 0.95


def test_pairs_count_beyond_their_words():
    """Neither word alone tells the class; both together do."""
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(600):
        a, b = rng.random(2) < 0.5
        rows.append(np.array(sorted(({0} if a else set()) | ({1} if b else set()) | {2 + int(rng.integers(20))})))
        y.append(int(a != b))
    m = toxicity.fit(rows, np.array(y), 22, least=1, z=0.0, epochs=200, linear_epochs=1, drop=0.0, rank=4, rate=0.2)
    at = lambda r: np.searchsorted(m.slots, [s for s in r if s in set(m.slots)])
    right = np.mean([(m.logit(at(r)) > 0) == (t > 0) for r, t in zip(rows, y, strict=True)])
    assert right > 0.9


def test_logit_equals_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(0.3, np.arange(6), rng.normal(size=6), rng.normal(size=(6, 3)))
    at = np.array([0, 2, 5])
    want = 0.3 + m.weights[at].sum() + sum(m.vectors[i] @ m.vectors[j] for i in at for j in at if i < j)
    assert np.isclose(m.logit(at), want)


def test_toxicity_of_held_out_rows(spark, sf):
    big = sf.replace("sf0.001", "sf0.1")
    got = {r["doc_id"]: r for r in QUERIES["op5_toxicity"](spark, big).collect()}
    assert len(got) == spark.read.parquet(f"{big}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{big}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    toxic = [got[d]["predicted"] for d, t in labels if t]
    clean = [got[d]["predicted"] for d, t in labels if not t]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.01


def test_scores_of_odd_rows(spark, odd, none, corpus):
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(0, 200)] + [(1, None, None), (None, 1, True), (1, 0, True)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "cast(toxic as int) toxic", "'clash' as text", "1 as y")
    machine = toxicity.train(corpus, labels)
    for df in (odd, none):
        got = toxicity.score(df, machine).collect()
        assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    views = quality.train(corpus, labels)
    for df in (odd, none):
        got = quality.score(df, views).collect()
        assert len(got) == df.count() and all(0 <= r["quality"] <= 1 for r in got)
        assert quality.kept(df, views).columns == df.columns


def test_one_class_and_no_labels(spark, odd):
    empty = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in toxicity.score(odd, toxicity.train(odd, empty)).collect()} == {toxicity._sigmoid(np.array(-40.0))}
    assert all(r["quality"] > 0.99 for r in quality.score(odd, quality.train(odd, empty)).collect())
    good = spark.createDataFrame([(i, 1, 0) for i in range(-9, 9)], LABELS)
    assert quality.kept(odd, quality.train(odd, good)).count() == odd.count()


def test_quality_of_held_out_rows(spark, sf):
    big = sf.replace("sf0.001", "sf0.1")
    got = {r["doc_id"]: r for r in QUERIES["op3_quality"](spark, big).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{big}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([got[d]["keep"] for d, q in labels if q]) > 0.99
    assert np.mean([got[d]["keep"] for d, q in labels if not q]) < 0.1


def test_views_exchange_labels():
    """A view that knows nothing of some rows learns them from the other's sure ones."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000)
    text = [np.array([10 + t]) for t in y]
    meta = [np.array([20 + t]) for t in y]
    pool = rng.integers(0, 2, 400)
    left = list(range(400))

    def exchange(views, share):
        """The text view teaches the other; the pool's metadata slots are ones that no labelled row has."""
        p = toxicity._sigmoid(views[0].logits(quality.flattened([[10 + pool[i]] for i in left])))
        sure, left[:] = [(i, int(q > 0.5)) for i, q in zip(left, p, strict=True) if max(q, 1 - q) >= 0.9], []
        return [], [(t, np.array([30 + pool[i]])) for i, t in sure]

    _, view = quality.co_train(text, meta, y, exchange)
    good, bad = view.logits(quality.flattened([[31], [30]]))
    assert good > bad + 1


def test_lots_are_drawn_from_all_documents(spark):
    """The keys that a view is sure of, against brute force: distinct, none known, the least of the whole table."""
    from pyspark.sql import functions as F

    rows = [("good fine words here" if i % 3 else "BUY! NOW!") + f" {i % 400}" for i in range(2000)]
    pages = spark.createDataFrame([(t, "en", "s") for t in rows], "text string, lang string, source string").repartition(5)
    pages = quality.described(pages).select(F.col("__key").alias("key"), F.col("__views").alias("views"), "text").cache()
    weights = {quality._slot("good", quality.TEXT_SLOTS): 9.0, quality._slot("buy!", quality.TEXT_SLOTS): -9.0}
    machine = toxicity.Machine(0.0, np.array(list(weights)), np.array(list(weights.values())), np.zeros((2, 0)))
    views = quality.View(machine, quality.TEXT_SLOTS), quality.View(toxicity.Machine(0.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0))), quality.META_SLOTS)
    keys = {r["key"]: int("good" in r["text"]) for r in pages.collect()}
    known = np.array(sorted(keys)[:50])
    got = quality._sure(pages, views, known, 0.9, (30, 70))
    want = [(0, t, k) for t, most in ((0, 30), (1, 70)) for k in sorted(k for k, y in keys.items() if y == t and k not in set(known.tolist()))[:most]]
    assert sorted(got) == sorted(want) and len(got) == 100


def test_slots_survive_packing():
    rows = np.array([3, 9, 200_000, 7, 262_143]), np.array([0, 3, 0, 0, 2, 0])
    flat, n = quality._unpacked(quality._packed(rows))
    assert flat.tolist() == rows[0].tolist() and n.tolist() == rows[1].tolist()
    flat, n = quality._unpacked(quality._packed(rows).slice(2, 3))
    assert flat.tolist() == [7, 262_143] and n.tolist() == [0, 0, 2]


def test_character_classes_are_those_of_the_patterns():
    import re

    for text in ("", "Ab-9_.,!\n\t ", "ÀÉ×÷ ٣४ Ⅷ ß «»—…", "𝔘𝔫𝔦 𝟡 😀 𞤢", "İıſ ǅ"):
        assert quality.counted(text) == (sum(map(str.isupper, text)), len(re.findall(r"[^\w\s.,]", text)), len(re.findall(r"\d", text)))


def test_a_machine_is_fitted_on_all_telling_slots(spark, corpus):
    """What is fitted from slots counted in Spark is what all slots of the sample give."""
    labels = spark.createDataFrame([(i, 0, int("token" in (t or "").split() or i % 3 == 0)) for i, t in ((r["doc_id"], r["text"]) for r in corpus.collect())], LABELS)
    got = toxicity.train(corpus, labels, epochs=3, z=1.0)
    sample = sorted(toxicity.labelled_sample(corpus.select("doc_id", "text"), labels, "toxic", 20_000).collect(), key=lambda r: r["doc_id"])
    rows = [np.array(sorted({s for w in toxicity.words_of(r["text"] or "") for s in toxicity.slots_of(w, 1 << 18)}), int) for r in sample]
    want = toxicity.fit(rows, np.array([r["y"] for r in sample]), 1 << 18, epochs=3, z=1.0)
    assert len(want.slots) > 3 and got.slots.tolist() == want.slots.tolist() and np.allclose(got.weights, want.weights)


def test_repeated_rows_of_a_labelled_id_count_once(spark):
    rows = [(3, "same text", "en", "a")] * 50 + [(3, "another text", "en", "a"), (4, "b", "en", "a")]
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 0), (None, 1, 1)], LABELS)
    got = toxicity.labelled_sample(make(spark, rows).select("doc_id", "text"), labels, "toxic", 100).collect()
    assert sorted((r["doc_id"], r["text"], r["y"]) for r in got) == [(3, "another text", 1), (4, "b", 0)]


def test_text_views_differ_for_shouting_and_prose():
    loud, quiet = quality.text_views(["THIS!! IS!! LOUD!!"])[0], quality.text_views(["this is not loud"])[0]
    assert loud.tolist() != quiet.tolist() and quality.meta_view("", "", "")


def test_rows_of_slots_are_those_of_each_text():
    texts = ["", "a b a", "ABC DEF! 12 -- www.x.org http://y", "a " * 500 + "B!", "É É!", " \n "]
    flat, n = quality.text_views(texts)
    rows = np.split(flat, np.cumsum(n)[:-1])
    for text, row in zip(texts, rows, strict=True):
        words = text.split()
        shape = {"capital": lambda w: w.isupper() and len(w) > 1, "shout": lambda w: w.endswith("!"), "bare": lambda w: not any(map(str.isalnum, w)), "digit": lambda w: any(map(str.isdecimal, w)), "link": lambda w: "://" in w or "www." in w}
        names = [quality._share(f"#{s}", sum(map(f, words)), len(words)) for s, f in shape.items()]
        names += [quality._share("#distinct", len(set(words)), len(words)), f"#words:{len(words).bit_length()}", *{w.lower() for w in words}]
        assert row.tolist() == quality._slots(names, quality.TEXT_SLOTS)


@pytest.mark.parametrize("text", ["ПРИВЕТ МИР ", "ΑΒΓ ΔΕΖ ", "ABC DEF × "])
def test_capitals_count_alike_at_every_length(text):
    upper = sum(map(str.isupper, text))
    for times in (1, 400):
        n = len(text) * times
        slot = quality._slots([quality._share("upper", upper * times, n)], quality.META_SLOTS)
        assert set(slot) <= set(quality.meta_view(text * times, "ru", "s"))
