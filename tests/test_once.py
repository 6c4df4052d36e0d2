"""Work done once: texts by document, costly columns by row, inputs by write; scores and passages in bounded pieces."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prefspark.functions import text as T
from prefspark.functions import vectors as V
from prefspark.operators import joins as J
from prefspark.operators import select as L
from prefspark.plans import comparisons as CP
from prefspark.plans import fixtures as FX


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture()
def small(spark, tmp_path):
    docs = [(i, None if i == 3 else " ".join(["w"] * (i + 1)), "en", "s", 1) for i in range(8)] + [(4, "twice", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    events = [(i, i % 3, "click" if i % 2 else "view") for i in range(40)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_tokens_of_documents(spark, small):
    rows = FX.f1_comparisons(spark, small, {"tokens": T.word_count}).withColumns({f"n{k}": T.word_count(F.col(f"text_{k}")) for k in (0, 1)}).collect()
    # pair 2 has two rows of its first document
    assert len(rows) == 50 and all(r[f"n{k}"] == r[f"tokens_{k}"] for r in rows for k in (0, 1))
    got = {r.cmp_id for r in CP.p09(spark, small).collect()}
    assert got == {r.cmp_id for r in CP.normalized(spark, small).collect()}
    assert "text" not in plan(CP.p09(spark, small)).split("Join")[0]


def test_lengths_of_documents(spark, small):
    from prefspark.operators import project as P
    read = lambda name: spark.read.parquet(f"{small}/{name}.parquet")
    c = CP.p20(spark, small)
    # a text is seen where its length is taken and no join moves it
    assert all("length(text" in x or "Relation" in x for x in plan(c).splitlines() if "text" in x)
    sides = [(0, 1), (2, 3), (4, 5), (6, 7)]
    docs = [(r.doc_id, r.text) for r in read("documents").collect()]
    texts = lambda i: [t for d, t in docs if d == i]
    want = []
    for e in read("events").collect():
        a, b = sides[e.event_id % 4]
        for x in texts(a):
            for y in texts(b):
                known = x is not None and y is not None
                want.append((e.event_id, int(known and (len(y) > len(x) if e.user_id % 2 == 0 else len(y) < len(x)))))
    assert sorted(tuple(r) for r in c.collect()) == sorted(want) and {x for _, x in want} == {0, 1}
    # texts themselves, a user of unknown type, a user without type and a row without user
    rows = [(0, 1, "a", "bbb"), (1, 2, "a", "bbb"), (2, 2, "aaa", "b"), (3, 1, "a", None), (4, 3, "a", "bb"), (5, 9, "a", "bb"), (6, None, "a", "bb")]
    types = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "worker long, preference int")
    d = P.length_preference(spark.createDataFrame(rows, "cmp_id long, worker long, text_0 string, text_1 string"), types)
    assert d.columns == ["worker", "cmp_id", "text_0", "text_1", "choice"]
    assert sorted((r.cmp_id, r.choice) for r in d.collect()) == [(0, 1), (1, 0), (2, 1), (3, 0), (4, 0)]
    assert all("text" not in x for x in plan(d.select("cmp_id", "choice")).split("Join")[:1])


def test_space_of_all_documents(spark, monkeypatch):
    from prefspark.llm import decontaminate as D
    seen = []
    fitted = D.latent_space

    def noted(passages, items, share, weights, rank, **kw):
        seen.append(sum(len(r["sizes"]) for r in passages.collect()))
        both = []
        for most in (D.GRAM_TERMS, 0):
            with monkeypatch.context() as m:
                m.setattr(D, "GRAM_TERMS", most)
                s = fitted(passages, items, share, weights, rank, **kw)
                both.append(s @ s.T)
        assert np.allclose(*both, atol=1e-4)
        return fitted(passages, items, share, weights, rank, **kw)
    monkeypatch.setattr(D, "latent_space", noted)
    words = [f"w{i}x" for i in range(60)]
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice(words, 20))) for i in range(4000)] + [(9999, " ".join(words[:30]))]
    items = [(0, " ".join(words[:30])), (1, " ".join(words[30:]))]
    got = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), rank=8).collect()
    assert seen == [4001] and (9999, 0) in {(r.doc_id, r.item_id) for r in got}


def test_scores_in_tiles():
    rng = np.random.default_rng(2)
    q, d = rng.standard_normal((50, 8)), rng.standard_normal((300, 8))
    d[7] = d[9]
    whole = J.best_of_cell(q, d, 4, 64)
    tiles = J.best_of_cell(q, d, 4, 64, scores_at_once=100)
    assert (whole[1] == tiles[1]).all() and np.allclose(whole[0], tiles[0])


def test_labels_once(spark, sf_small):
    from prefspark.operators import project as P
    from prefspark.plans import ratings as RT
    # a coin a user type, and a rating's pattern on either side
    text = plan(P.controversial_only(RT.typed(spark, sf_small)).select("pair_id", "data_subset"))
    assert text.count("md5(") == 4 and text.count("RLIKE") == 8


def test_softmax_once(spark):
    d = spark.createDataFrame([([0.0, 1.0, 2.0], [1.0, 1.0, 0.0]), (None, [1.0]), ([], [])], "c array<double>, r array<double>")
    df = d.select(V.categorical_loss("c", "r").alias("loss"))
    assert plan(df).lower().count("exp(") == 2
    c, r = (np.exp(np.array(x)) / np.exp(np.array(x)).sum() for x in ([0.0, 1.0, 2.0], [1.0, 1.0, 0.0]))
    want = -np.log(sum(c[i] * (r[:i].sum() + 0.5 * r[i]) for i in range(3)))
    got = [x.loss for x in df.collect()]
    assert abs(got[0] - want) < 1e-12 and got[1] is None


def test_draws_once(spark):
    rows = spark.range(20).select(F.col("id").alias("Index"), F.concat(F.lit("p"), F.col("id") % 5).alias("prompt"))
    c = L.random_contexts(rows, rows, n=2, seed=3, fields=())
    assert plan(c).count("conv(") == 1
    assert all(len(r.contexts) == 2 and all(x.original_id % 5 != r.Index % 5 for x in r.contexts) for r in c.collect())


def test_cap_reads_its_input_once(spark):
    rows = spark.range(30).select((F.col("id") % 3).alias("data_subset"), F.col("id").alias("pair_id"))
    c = L.cap_per_subset(rows, 9, order="pair_id")
    assert "Range" not in plan(c)
    assert sorted(r.pair_id for r in c.collect()) == list(range(9))


def test_batch_loss_has_no_null_group(spark):
    from prefspark.operators import aggregate as G
    d = spark.createDataFrame([(0, [1.0, 0.0], [0.0, 1.0]), (None, [1.0, 0.0], [0.0, 1.0]), (1, None, [0.0])], "g int, c array<double>, r array<double>")
    assert [r.g for r in G.categorical_batch_loss(d, "c", "r", by=["g"]).collect()] == [0]


def test_rows_of_the_space_are_bounded(spark):
    from types import SimpleNamespace as Of

    from prefspark.llm import decontaminate as D
    rng = np.random.default_rng(2)
    d = 1200
    rows = [np.sort(rng.choice(d, int(rng.integers(8, 33)), replace=False)).astype(np.int32) for _ in range(900)]
    batch = lambda rr: pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in rr], pa.binary()),
                                                   pa.array([bytes([len(x)]) for x in rr], pa.binary())], names=["ids", "sizes"])
    w = rng.random(d) + 0.1
    a = np.zeros((len(rows), d))
    for i, r in enumerate(rows):
        a[i, r] = w[r] / np.linalg.norm(w[r])
    # a sliced batch too: its offsets do not begin at 0
    given = [batch(rows[:300]), batch([*rows[:5], *rows[300:]]).slice(5)]
    got = [x for b in D._stripes(Of(value=w))[0](given) for x in b.to_pylist()]
    assert max(len(x["blob"]) for x in got) <= 1 << 19 and sum(len(x["blob"]) for x in got) == 8 * d * (d + 1) // 2
    q = rng.standard_normal((d, 24))
    stripes = [pa.RecordBatch.from_pylist(got)]
    for run in (D._times_stripes(Of(value=q))[0](stripes), D._products(Of(value=w), Of(value=q))[0](given)):
        parts = [x for b in run for x in b.to_pylist()]
        assert max(len(x["blob"]) for x in parts) <= 1 << 19
        assert np.allclose(np.concatenate([np.frombuffer(x["blob"]).reshape(-1, 24) for x in parts]), a.T @ (a @ q))


def test_products_are_added_before_the_driver(spark, monkeypatch):
    from prefspark.llm import decontaminate as D
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(300, int(rng.integers(8, 33)), replace=False)).astype(np.int32) for _ in range(400)]
    df = spark.createDataFrame([(bytearray(x.tobytes()), bytearray([len(x)])) for x in rows], "ids binary, sizes binary").repartition(4)
    got, whole = [], type(df).collect

    def noted(self):
        out = whole(self)
        got.append(len(out))
        return out
    monkeypatch.setattr(type(df), "collect", noted)
    for most in (D.GRAM_TERMS, 0):
        monkeypatch.setattr(D, "GRAM_TERMS", most)
        D.latent_space(df, [np.arange(40)], 2.0, rng.random(300) + 0.1, 8)
    # one row an iteration, not one for each task
    assert got == [1] * 6


def test_pairs_are_added_with_the_plain_dtype(monkeypatch):
    import pickle
    from types import SimpleNamespace as Of

    from prefspark.llm import decontaminate as D
    seen, scaled = [], D.scaled

    def noted(flat, n, w):
        seen.append(w.dtype is np.dtype(np.float64))
        return scaled(flat, n, w)
    monkeypatch.setattr(D, "scaled", noted)
    given = pa.RecordBatch.from_arrays([pa.array([np.arange(9, dtype=np.int32).tobytes()], pa.binary()), pa.array([bytes([9])], pa.binary())], names=["ids", "sizes"])
    # a broadcast value comes pickled; np.add.at is some ten times slower with the dtype object that it brings
    list(D._stripes(Of(value=pickle.loads(pickle.dumps(np.ones(9)))))[0]([given]))
    assert seen == [True]


@pytest.mark.parametrize("mode", ["84", "single"])
def test_survey_is_computed_once_and_steps_are_columns(spark, monkeypatch, mode):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def types(i):
        calls.add(1)
        return ["8", "4"] if i % 3 else ["2"]
    df = spark.range(200).select(F.col("id").alias("Index"))
    survey = spark.range(7).select(F.col("id").alias("Index"), types("id").alias("satisfied_subset"))
    c = L.survey_contexts(df, survey, 4, seed=3, mode=mode, hash_kind="md5")
    got = {r.Index: [x.original_id for x in r.contexts] for r in c.collect()}
    assert calls.value == 7 and len(got) == 200
    assert all(len(set(x)) == len(x) <= 4 and set(x) <= set(range(7)) for x in got.values())
    assert "aggregate(" not in plan(c)
    if mode == "84":
        assert {len(x) for x in got.values()} == {1, 2, 3, 4}
        monkeypatch.setattr(L, "UNROLLED", 0)
        folded = L.survey_contexts(df, survey, 4, seed=3, mode=mode, hash_kind="md5")
        assert {r.Index: [x.original_id for x in r.contexts] for r in folded.collect()} == got
