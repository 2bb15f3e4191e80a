import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import ngram_join, shingles, winnowing
from tests.llm.conftest import make, texts_of


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs):
    """Component of each distinct text, by all pairs."""
    texts = sorted({t for _, t in docs})
    sets = [shingle_set(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 75 * (len(sets[i]) + len(sets[j]) - inter):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    of = {t: (len(s), g, bool(s)) for t, s, g in zip(texts, sets, group, strict=True)}
    least: dict = {}
    for d, t in docs:
        if d is not None:
            least[of[t][1]] = min(d, least.get(of[t][1], d))
    return Counter((d, of[t][0], least.get(of[t][1]) if of[t][2] else d) for d, t in docs)


@pytest.mark.parametrize("which", ["corpus", "odd", "none"])
def test_components(request, which):
    df = request.getfixturevalue(which)
    assert Counter(tuple(r) for r in ngram_join.near_duplicates(df, block=4).collect()) == brute(texts_of(df))


@pytest.mark.parametrize(("slots", "big"), [(64, 4096), (1 << 16, 4096), (1 << 16, 5), (64, 1)])
def test_chains_and_dense_groups(spark, slots, big):
    """Copies edited again and again link in chains; copies edited once are dense around one text."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows, w = [], list(base)
    for i in range(25):
        rows.append((100 - i, " ".join(w), "en", "a"))
        w[rng.randrange(60)] = f"c{i}"
    for i in range(40):
        v = list(base)
        v[rng.randrange(60)] = f"d{i}"
        v[rng.randrange(60)] = f"e{i}"
        rows.append((200 + i, " ".join(v), "en", "a"))
    common = " ".join(f"p{k}" for k in range(30))
    rows += [(300 + i, common + " " + " ".join(f"r{rng.randrange(10**6)}" for _ in range(rng.choice((5, 12, 40)))), "en", "a") for i in range(30)]
    df = make(spark, rows).repartition(5)
    assert Counter(tuple(r) for r in ngram_join.near_duplicates(df, slots=slots, block=8, filter_bits=1 << 10, big=big).collect()) == brute(texts_of(df))


def brute_links(docs):
    """Each row's number of similar rows, by all pairs."""
    sets = [shingle_set(t) for _, t in docs]
    out = Counter()
    for i, (d, _) in enumerate(docs):
        n = 0
        for j in range(len(docs)):
            inter = len(sets[i] & sets[j])
            n += i != j and bool(sets[i]) and 100 * inter >= 75 * (len(sets[i]) + len(sets[j]) - inter) > 0
        out[(d, len(sets[i]), n)] += 1
    return out


@pytest.mark.parametrize("which", ["corpus", "odd", "none"])
def test_links_of_each_document(request, which):
    df = request.getfixturevalue(which)
    assert Counter(tuple(r) for r in ngram_join.link_counts(df, block=4).collect()) == brute_links(texts_of(df))


def test_links_of_a_dense_group_with_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(40):
        v = list(base)
        v[rng.randrange(60)] = f"d{i}"
        rows += [(i if i % 5 else None, " ".join(v), "en", "a")] * rng.choice((1, 1, 3))
    df = make(spark, rows).repartition(3)
    got = ngram_join.link_counts(df, block=8).collect()
    assert Counter(tuple(r) for r in got) == brute_links(texts_of(df)) and max(r["n_links"] for r in got) > 30


@pytest.mark.parametrize("seed", range(3))
def test_a_near_copy_without_an_id_links(spark, seed):
    """Two texts that only link through a row with a null id; among several sets, such rows come first and second in a pair."""
    rng, rows = random.Random(seed), []
    for i in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        left, right = list(base), list(base)
        left[20], right[60], left[75], right[5] = "l", "r", "l2", "r2"
        rows += [(2 * i, " ".join(left), "en", "a"), (2 * i + 1, " ".join(right), "en", "a"), (None, " ".join(base), "en", "a")]
        if i % 2:
            rows.append((None, " ".join(base), "en", "a"))
    rows.append((None, "x " + " ".join(f"n{k}" for k in range(60)), "en", "a"))
    rows.append((None, "y " + " ".join(f"n{k}" for k in range(60)), "en", "a"))
    df = make(spark, rows).repartition(3)
    want = brute(texts_of(df))
    assert want[(1, 76, 0)] == 1
    assert Counter(tuple(r) for r in ngram_join.near_duplicates(df, block=4).collect()) == want


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(0)
    for _ in range(200):
        both = rng.integers(0, 1 << 63, rng.integers(1, 80)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, rng.integers(0, 300)).astype(np.uint64)])) for _ in range(2))
        width = min(shingles.width_of(len(a)), shingles.width_of(len(b)))
        apart = int(np.bitwise_count(shingles.folded(shingles.bitmap(a), width) ^ shingles.folded(shingles.bitmap(b), width)).sum())
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - apart) // 2


def test_needed_overlap_is_the_threshold():
    for a in range(1, 40):
        for b in range(1, 40):
            k = ngram_join.needed(a, b, (3, 4))
            assert 100 * k >= 75 * (a + b - k) and not 100 * (k - 1) >= 75 * (a + b - k + 1)


# fingerprints


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]{1,24}", text)


def winnow(h, k=winnowing.K, w=winnowing.W):
    """Rolling hashes and the rightmost least of each window, as the definition has it."""
    p, b = winnowing.PRIME, winnowing.BASE
    grams = []
    for i in range(len(h) - k + 1):
        g = 0
        for x in h[i : i + k]:
            g = (g * b + x) % p
        grams.append(g)
    if len(grams) < w:
        return [min((g, -i) for i, g in enumerate(grams))] if grams else None
    out = []
    for i in range(len(grams) - w + 1):
        best = min((grams[j], -j) for j in range(i, i + w))
        if best not in out:
            out.append(best)
    return out


def test_winnowing_matches_its_definition(spark, corpus):
    from pyspark.sql import functions as F

    df = corpus.where("length(text) < 3000").limit(60)
    rows = winnowing.with_fingerprint(df.select("text"), "text", "f").withColumn("h", F.transform(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]{1,24}"), F.lit(0)), lambda w: F.pmod(F.xxhash64(w), F.lit(winnowing.PRIME)))).collect()
    for r in rows:
        want = winnow(r["h"])
        got = [(x >> 31, -(winnowing.POSITION - (x & winnowing.POSITION))) for x in r["f"]]
        if want is None:
            assert len(got) == (len(r["h"]) > 0)
        else:
            assert sorted(got) == sorted(want)


def test_a_common_run_gives_a_common_fingerprint(spark):
    rng = random.Random(2)
    run = [f"x{rng.randrange(10**6)}" for _ in range(winnowing.K + winnowing.W - 1)]
    rows = [(i, " ".join([f"a{rng.randrange(10**6)}" for _ in range(rng.randrange(30))] + run + [f"b{rng.randrange(10**6)}" for _ in range(rng.randrange(30))])) for i in range(12)]
    found = [set(r["k"]) for r in winnowing.with_fingerprint(spark.createDataFrame(rows, "i int, text string"), "text", "f").select(winnowing.hashes("f").alias("k")).collect()]
    assert all(a & b for a in found for b in found)


@pytest.mark.parametrize("which", ["corpus", "odd"])
def test_edited_texts(request, which):
    df = request.getfixturevalue(which)
    got = winnowing.fingerprints(df).collect()
    docs = texts_of(df)
    assert len(got) == len(docs)
    known = [(d, t) for d, t in docs if sum(e == d for e, _ in docs) == 1 and d is not None]
    rows = {r["doc_id"]: r for r in got}
    ids = sorted({d for d, _ in docs if d is not None}, reverse=True)
    text = {}
    for d, t in docs:
        text.setdefault(d, set()).add(t)
    for d, t in known:
        at = ids.index(d)
        following = text[ids[at + 1]] if at + 1 < len(ids) else text.get(None) or text[ids[0]]
        m = len(t) // 2
        assert rows[d]["n_chars"] == len(t)
        assert rows[d]["edited_sha256"] in {hashlib.sha256((t[: len(t) - m] + n[:m]).encode()).hexdigest() for n in following}
        assert 0 <= rows[d]["near_edited"] <= 1 and 0 <= rows[d]["near_next"] <= 1
    same: dict = {}
    for r in got:
        for t in text[r["doc_id"]]:
            if len(text[r["doc_id"]]) == 1:
                assert same.setdefault(t, r["fingerprint"]) == r["fingerprint"]


def test_fingerprints_of_small_tables(spark, none):
    assert winnowing.fingerprints(none).count() == 0
    one = winnowing.fingerprints(make(spark, [(5, "alone in the table here today", "en", "a")])).collect()
    text = "alone in the table here today"
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert one[0]["edited_sha256"] == hashlib.sha256((text[: 29 - 14] + text[:14]).encode()).hexdigest()
    nulls = winnowing.fingerprints(make(spark, [(None, "a b", "en", "a"), (None, None, "en", "a")])).collect()
    assert len(nulls) == 2
