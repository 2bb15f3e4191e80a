import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, packing, piececount, tokenfile
from tests.llm.conftest import texts_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OURS = bpe.Encoder(PATH, keep=50)


def ids_of(text):
    return np.array([*LIBRARY.encode(text, add_special_tokens=False).ids, 0], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Word", "é", "ß", "'s", " ", "  ", "\n", "\t", "1", "²", "_", "!", " ", "\x1c", "日本", "Ⅷ", "\0", "don't", "<|endoftext|>", "́"]), max_size=14).map("".join))
def test_encoder_equals_the_library(text):
    assert OURS.encode([text])[0] == ids_of(text)[:-1].tobytes()


def check_packing(df, window=1024, **options):
    rows = [r.asDict() for r in packing.pack(df, PATH, window=window, **options).collect()]
    whole = Counter((d, ids_of(t).tobytes()) for d, t in texts_of(df))
    pieces: dict = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    # every id lies in exactly one piece: as many ids, and the pieces of ids that occur once join to the document
    assert sum(r["length"] for r in rows) == sum(len(t) // 4 * k for (_, t), k in whole.items())
    for (d, t), k in whole.items():
        if k == 1 and sum(1 for e, u in whole if e == d) == 1:
            assert b"".join(x for _, x in sorted(pieces[d, len(t) // 4])) == t
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    sizes = []
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= window
        sizes.append(end)
    return sizes


def test_packing_of_a_corpus(corpus):
    sizes = check_packing(corpus)
    assert sum(1024 - s for s in sizes) / sum(sizes) < 0.01
    assert check_packing(corpus, window=64, open_windows=4, fan_in=2)


def test_packing_of_odd_rows(odd, none):
    check_packing(odd)
    check_packing(odd, window=4)
    assert packing.pack(none, PATH).count() == 0


def test_packer_is_best_fit_and_bounded():
    p = packing.Packer(10, 2, 99, 0)
    for n in (6, 7, 3, 4, 5):
        p.add(n, 0, bytes(4 * n), n)
    assert len(p.free) <= 2
    p.close()
    together = {}
    for doc, _, _, _, seq, *_ in p.rows:
        together.setdefault(seq, []).append(doc)
    assert [7, 3] in together.values() and [6, 4] in together.values()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=400))
def test_elias_fano_round_trip(values):
    values = np.sort(np.array(values, np.uint64))
    e, end = tokenfile.EliasFano.load(b"xy" + tokenfile.EliasFano.of(values).dump(), 2)
    assert end == 2 + len(e.dump())
    assert (e.values() == values).all()
    assert [e.select(i) for i in range(len(values))] == values.tolist()


def test_elias_fano_is_near_the_minimum():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 30, 10_000))
    e = tokenfile.EliasFano.of(values)
    bits = 8 * len(e.dump())
    assert bits < 10_000 * (2 + np.log2((1 << 30) / 10_000) + 0.6)


@pytest.mark.parametrize("which", ["corpus", "odd", "none"])
def test_files_round_trip(spark, request, which):
    df = request.getfixturevalue(which)
    got = tokenfile.round_trip(df, PATH, shard_ids=500, partitions=3).collect()
    docs = texts_of(df)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, len(ids_of(t)), zlib.crc32(ids_of(t).tobytes())) for d, t in docs)
    end = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == end
        end += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d))


def test_shards_in_plain_files(spark, odd, tmp_path):
    """Documents by place and by id from mapped files, without Spark; opening reads nothing but headers."""
    path = f"{tmp_path}/table"
    tokenfile.write(odd, PATH, path, shard_ids=20, partitions=2)
    names = tokenfile.export(spark, path, f"{tmp_path}/files")
    shards = [tokenfile.open_shard(n) for n in names]
    got = [(s.doc_id(i), s.document(i).tolist()) for s in shards for i in range(s.n)]
    assert Counter((d, tuple(x)) for d, x in got) == Counter((d, tuple(ids_of(t).tolist())) for d, t in texts_of(odd))
    for s in shards:
        known = [s.doc_id(i) for i in range(s.n)]
        assert all(s.find(d) == known.index(d) for d in known if d is not None) and s.find(10**9) is None


def greedy(word, tokens):
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in tokens), 0)
        if not k:
            return 0
        word, n = word[k:], n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5).map(str.encode), max_size=25), st.text("abc", max_size=14).map(str.encode))
def test_automaton_counts_greedy_pieces(tokens, word):
    tokens |= {b" ", b" a", b" ab"}
    assert piececount.Automaton(sorted(tokens)).pieces(word) == greedy(b" " + word, tokens)


@pytest.mark.parametrize("which", ["corpus", "odd", "none"])
def test_counts_of_documents(request, which):
    df = request.getfixturevalue(which)
    tokens = set(piececount.byte_tokens(PATH))
    got = Counter(tuple(r) for r in piececount.count_tokens(df, PATH).collect())
    known: dict = {}
    want = Counter()
    for d, t in texts_of(df):
        words = t.encode().split()
        n = [known.setdefault(w, greedy(b" " + w, tokens)) for w in words]
        want[d, len(n), sum(n) + n.count(0), n.count(0)] += 1
    assert got == want
