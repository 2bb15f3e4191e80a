import pytest

import corpus_pipeline
from tests.llm.conftest import make

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    corpus.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(200)], LABELS).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
@pytest.mark.parametrize("which", ["odd", "none"])
def test_stages_take_odd_rows(spark, request, folder, name, stage, which):
    docs = request.getfixturevalue(which)
    out = stage(spark, docs, folder)
    rows = out.collect()
    if name != "packing":
        assert out.columns == docs.columns
    if which == "none":
        assert rows == []
    if name == "near_duplicates" and which == "odd":
        ids = [r["doc_id"] for r in rows]
        assert ids.count(7) == 2 and 8 not in ids and ids.count(None) == 2


def test_a_rejected_document_goes_and_copies_stay_once(spark, folder):
    near = dict(corpus_pipeline.STAGES)["near_duplicates"]
    docs = make(spark, [(3, "a b c d e f g h", "en", "s"), (2, "a b c d e f g h", "en", "s"), (9, "x y z u v w q r", "en", "s")])
    assert sorted(r["doc_id"] for r in near(spark, docs, folder).collect()) == [2, 9]


def test_a_near_copy_with_a_repeated_id_goes(spark, folder):
    near = dict(corpus_pipeline.STAGES)["near_duplicates"]
    a = [f"w{i}" for i in range(60)]
    b = [*a[:30], "other", *a[31:]]
    docs = make(spark, [(1, " ".join(a), "en", "s"), (2, " ".join(b), "en", "s"), (2, "a text of its own with nine words", "de", "s"), (None, " ".join(a), "en", "s"), (None, " ".join(b[::-1]), "en", "s")])
    rows = near(spark, docs, folder).collect()
    assert sorted((str(r["doc_id"]), r["text"][:6]) for r in rows) == [("1", "w0 w1 "), ("2", "a text"), ("None", "w59 w5")]


def test_sources_of_rows_without_ids_meet_their_targets(spark, folder):
    """1,000 equal documents in three sources, those of one without ids: 1.5 times all words by weights 3, 1, 2."""
    mixing_stage = dict(corpus_pipeline.STAGES)["mixing"]
    docs = make(spark, [(None if i % 3 == 1 else i, "ten words are in each of these one thousand texts", "en", "abc"[i % 3]) for i in range(999)])
    found = dict(mixing_stage(spark, docs, folder).groupBy("source").count().collect())
    n = 999 * 1.5
    want = {"a": 666, "b": (n - 666) / 3, "c": (n - 666) * 2 / 3}
    assert all(abs(found[s] - want[s]) <= 1 for s in want)


def test_the_whole_run(spark, folder, corpus):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in corpus.collect()}
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024
