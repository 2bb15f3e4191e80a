import re

import numpy as np
import pytest

from tessera.llm import mixing
from tests.llm.conftest import make


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    names = sorted(sizes, key=lambda x: (x is None, x))
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(out.values())) / sum(weight[n] for n in free)
        over = {n for n in free if level * weight[n] > 2 * sizes[n]}
        if not over:
            return out | {n: level * weight[n] for n in free}
        out |= {n: 2 * sizes[n] for n in over}
        free -= over
    return out


@pytest.mark.parametrize("which", ["corpus", "odd"])
def test_targets_and_taken_words(request, which):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text", "source").collect()
    sizes: dict = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
    want = targets(sizes)
    mixed = mixing.mix(df, chunk=8)
    got = mixed.select("*", mixing.taken(mixed).alias("taken")).collect()
    assert len(got) == len(rows)
    assert sorted(r["size"] for r in got) == sorted(size(r["text"]) for r in rows)
    taken: dict = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert np.isclose(r["target"], want[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    for s in want:
        assert sum(0 < r["x"] < 1 for r in got if r["source"] == s) <= 1
    again = mixing.mix(df.repartition(7), chunk=8)
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in got) == sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in again.select("*", mixing.taken(again).alias("taken")).collect())


def test_expectation_is_kept(spark):
    """Over many seeds each document is taken about as often as its share says."""
    df = make(spark, [(i, "w " * (1 + i % 7), "en", "abc"[i % 3]) for i in range(60)]).cache()
    total: dict = {}
    n = 12
    for seed in range(n):
        for r in mixing.mix(df, seed=100 + 2 * seed, chunk=16).collect():
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["whole"] + r["x"]
            share = r["target"] / r["source_size"]
            assert r["whole"] <= share + 1e-9 and r["whole"] + r["x"] <= np.ceil(share) + 1e-9
    mean = np.mean([v / n for v in total.values()])
    assert abs(mean - 1.5) < 0.2


def test_empty_tables_and_texts(spark, none):
    assert mixing.mix(none).count() == 0
    got = mixing.mix(make(spark, [(1, None, "en", None), (2, "", "en", "a")])).collect()
    assert {(r["doc_id"], r["target"], r["whole"], r["x"]) for r in got} == {(1, 0.0, 0, 0.0), (2, 0.0, 0, 0.0)}


def test_many_sources_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    df = make(spark, [(i, "a b c", "en", f"s{i % 9}") for i in range(40)])
    assert mixing.mix(df).count() == 40


def test_many_sources_and_rows_without_ids(spark, monkeypatch):
    """Sources beyond the broadcast bound, of which one has a third of the rows, all without ids; reruns agree."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 5)
    rows = [(None, f"w{i} " * (1 + i % 9), "en", "big") for i in range(300)] + [(i if i % 7 else None, "x " * (1 + i % 5), "en", f"s{i % 40}" if i % 40 else None) for i in range(600)]
    df = make(spark, rows).repartition(4)
    sizes: dict = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = targets(sizes)
    runs = []
    for df in (df, df.repartition(7)):
        mixed = mixing.mix(df, chunk=16)
        got = mixed.select("*", mixing.taken(mixed).alias("taken")).collect()
        taken: dict = {}
        for r in got:
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert len(got) == 900 and all(abs(taken[s] - want[s]) <= 1 for s in want)
        runs.append(sorted((str(r["doc_id"]), r["size"], str(r["source"]), r["taken"]) for r in got))
    assert runs[0] == runs[1]
