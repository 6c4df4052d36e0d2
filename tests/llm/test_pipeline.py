"""The corpus pipeline: stages in order, each decision in effect."""

import collections
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from edge import documents  # noqa: E402


def test_stages_on_edge_cases(spark):
    import corpus_pipeline as C
    assert [n for n, _ in C.STAGES] == ["language_id", "near_duplicates", "repeated_substrings", "decontamination", "packing"]
    for docs in (documents(spark), documents(spark, [])):
        rows = docs
        for i, (_, stage) in enumerate(C.STAGES):
            out = stage(spark, rows, "/root/testdata/sf0.001")
            if i < len(C.STAGES) - 1:
                assert out.columns == docs.columns
            rows = out.checkpoint()
        assert "sequence_id" in rows.columns


def test_run(spark):
    import corpus_pipeline as C
    from prefspark.session import ensure_checkpoint_dir
    folder = os.path.join(ensure_checkpoint_dir(spark), "tables").removeprefix("file:")
    before = set(os.listdir(folder))
    got = C.run(spark, "/root/testdata/sf0.001")
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"pipeline"}
    ids = {r["doc_id"] for r in got.select("doc_id").distinct().collect()}
    from prefspark.llm.jaccard_join import jaccard_components
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = {r["doc_id"] for r in jaccard_components(docs).where("doc_id = component_id").collect()}
    from prefspark.llm.decontaminate import find_leaks
    leaks = {r["doc_id"] for r in find_leaks(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")).collect()}
    assert ids <= first and leaks & first
    assert len(ids) >= 0.8 * len(first)


def test_repeated_passages_are_caught(spark):
    """Passages of over 50 words that stand in other documents too go; documents that repeat neither others nor themselves stay."""
    import corpus_pipeline as C

    def windows(text, n):
        w = (text or "").split()
        return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)}

    docs = C.near_duplicates(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "").checkpoint()
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r["text"] for r in C.repeated_substrings(spark, docs, "").collect()}
    assert set(before) == set(after)
    holders = collections.Counter(w for t in before.values() for w in windows(t, 51))
    planted = {(i, w) for i, t in before.items() for w in windows(t, 51) if holders[w] > 1}
    left = {(i, w) for i, t in after.items() for w in windows(t, 51)}
    assert len(planted) > 200
    assert len(planted & left) <= 0.1 * len(planted)
    some = collections.Counter(w for t in before.values() for w in windows(t, 25))
    # what a document repeats of itself goes by the stage's definition
    own = lambda t: len(t.split()) - 11 > len(windows(t, 12)) > 0
    clean = [i for i, t in before.items() if not any(some[w] > 1 for w in windows(t, 25)) and not own(t or "")]
    assert len(clean) > 500
    assert sum(before[i] == after[i] for i in clean) >= 0.95 * len(clean)


def test_packing_of_emptied_texts(spark):
    """A text that a stage has emptied, or a null one, is packed as its end token."""
    import corpus_pipeline as C
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "two words"), (4, " \n")], "doc_id long, text string")
    got = {r["doc_id"]: (r["piece"], r["start"], r["length"]) for r in C.packing(spark, docs, "").collect()}
    assert got[1] == got[2] == got[4] == (0, 0, 1) and got[3][2] > 1 and len(got) == 4


@pytest.mark.parametrize("name", ["op%d_" % i for i in range(1, 14)] + ["pipeline"])
def test_registered(name):
    import __spark_entry__ as E
    assert [q for q in E.queries() if q.startswith(name)]
