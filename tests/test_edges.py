"""NULL / empty / tie rows per operator."""

import pytest
from pyspark.sql import functions as F

from prefspark.functions import labels as LB
from prefspark.functions import text as TX
from prefspark.functions import vectors as V
from prefspark.operators import aggregate as G
from prefspark.operators import joins as J
from prefspark.operators import project as P
from prefspark.operators import select as L
from prefspark.operators import sets as U
from prefspark.operators import window as W


def test_majority_vote_tie_goes_to_first_seen(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, "a", "b"), (4, "b", "a")],
                               "cmp_id long, chosen_only string, rejected_only string")
    out = G.majority_vote(df).collect()
    assert [(r.cmp_id, r.votes, r.pair_votes) for r in out] == [(1, 2, 4)]


def test_majority_vote_no_join_string_collision(spark):
    # ' '.join(sorted(...)) would merge these two pairs; the struct/hash key does not
    df = spark.createDataFrame([(1, "a b", "c"), (2, "a", "b c")], "cmp_id long, chosen_only string, rejected_only string")
    assert G.majority_vote(df).count() == 2


def test_accuracy_tie_is_wrong_and_empty_user(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 1.0)], "uid long, reward_chosen double, reward_rejected double")
    assert G.accuracy_by_user(df).collect()[0].accuracy == 0.5


def test_win_lose_tie_missing_annotation_keeps_user(spark):
    df = spark.createDataFrame([(1, None, 1), (2, 3, 1), (2, 1, 1), (2, 2, 1)], "user_id long, preference int, label int")
    got = {r.user_id: (r.wins, r.losses, r.ties) for r in G.win_lose_tie_by_user(df).collect()}
    assert got == {1: (0, 0, 0), 2: (1, 1, 1)}
    wr = G.win_rate(G.win_lose_tie_by_user(df.filter("user_id = 1")), "psoups").collect()[0]
    assert wr.pooled_win_rate is None and wr.mean_user_win_rate is None


def test_macro_average_skips_nan_null_and_user0(spark):
    df = spark.createDataFrame([("r", 0, "accuracy", 9.0), ("r", 1, "accuracy", 0.5), ("r", 2, "accuracy", float("nan")),
                                ("r", 3, "accuracy", None)], "run string, uid long, metric string, value double")
    assert G.macro_average(df).collect()[0].macro_avg == 0.5


def test_similar_user_no_positive_total_gives_no_row(spark):
    df = spark.createDataFrame([(5, 1, 0, 1, 10), (6, 0, 2, 1, 11)],
                               "worker long, agree long, disagree long, first_new long, cmp_id long")
    got = G.similar_user(df).collect()
    assert [(r.similar_uid, r.score) for r in got] == [(5, 1)]
    assert G.similar_user(df.filter("worker = 6")).count() == 0


def test_best_of_n_first_on_ties(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0), (1, 2, 1.0)], "prompt_id long, sample_no int, score double")
    r = L.best_of_n(df, payload=()).collect()[0]
    assert r.best_sample == 0 and r.scores == [2.0, 2.0, 1.0]


def test_rerank_top_k(spark):
    df = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate([3, 5, 5, 1])], "group_id long, sample_no int, score double")
    r = L.rerank_top_k(df, 2).collect()[0]
    assert r.top_indices == [1, 2] and r.top_scores == [5.0, 5.0]


def test_top_workers_ties_by_first_seen(spark):
    df = spark.createDataFrame([(1, "w2"), (2, "w1"), (3, "w1"), (4, "w2"), (5, "w3")], "cmp_id long, worker string")
    got = [(r.worker, r.uid) for r in L.top_workers(df, k=2).orderBy("uid").collect()]
    assert got == [("w2", 1), ("w1", 2)]


def test_head_then_user_order(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "cmp_id long, uid long")
    assert P.load_for_user(df, 4, 1).count() == 2  # the limit applies before the user filter


def test_drop_identical_and_missing(spark):
    df = spark.createDataFrame([("p", "a", "a"), ("p", "a", "b"), (None, "a", "b"), ("p", None, None)],
                               "prompt string, chosen string, rejected string")
    assert P.drop_identical(df).count() == 2
    assert P.drop_missing(df).count() == 2


def test_response_after_marker_missing(spark):
    df = spark.createDataFrame([("no marker",), (None,)], "chosen string")
    assert [r.chosen for r in P.response_after_marker(df).collect()] == [None, None]


def test_completion_of_wrong(spark):
    df = spark.createDataFrame([("A:x", "A:q A:")], "output string, input string")
    assert P.completion_of(df, marker="A:").collect()[0].completion == "Wrong completion."


def test_reuse_annotations_null_safe_keys(spark):
    todo = spark.createDataFrame([("i", None, "a", "b", "x")], "instruction string, input string, output_1 string, output_2 string, annotator string")
    done = spark.createDataFrame([("i", None, "a", "b", "x", 2, "why")],
                                 "instruction string, input string, output_1 string, output_2 string, annotator string, preference int, chain_of_thoughts string")
    r = J.reuse_annotations(todo, done).collect()[0]
    assert r.preference == 2 and r.chain_of_thoughts == "why"


def test_merge_store_old_wins_noisy_not_stored(spark):
    old = spark.createDataFrame([("k1", 1)], "k string, preference int")
    new = spark.createDataFrame([("k1", 2, False), ("k2", 1, True), ("k3", 2, False)], "k string, preference int, is_noisy_label boolean")
    store, result = U.merge_store(old, new, ["k"])
    assert sorted((r.k, r.preference) for r in result.collect()) == [("k1", 1), ("k2", 1), ("k3", 2)]
    assert sorted(r.k for r in store.collect()) == ["k1", "k3"]


def test_positive_counter_diff(spark):
    a = spark.createDataFrame([("u", 3), ("v", 1)], "k string, n long")
    b = spark.createDataFrame([("u", 1), ("v", 1), ("w", 5)], "k string, n long")
    assert [(r.k, r.n) for r in U.positive_counter_diff(a, b, "k").collect()] == [("u", 2)]


def test_common_subsets_single(spark):
    df = spark.createDataFrame([([(["8", "4"],), (["4", "2"],)],)], "ctx array<struct<satisfied_subset: array<string>>>")
    assert df.select(U.identifies_user(F.col("ctx")).alias("x")).collect()[0].x is True


def test_user_type_labels_tie_coin_is_deterministic(spark):
    df = spark.createDataFrame([(1, 3, 3)], "pair_id long, c int, r int")
    lab = LB.user_type_labels({a: F.col("c") for a in LB.ATTRIBUTES}, {a: F.col("r") for a in LB.ATTRIBUTES}, 0, F.col("pair_id"))
    a = df.select(lab.alias("l")).collect()[0].l
    b = df.repartition(3).select(lab.alias("l")).collect()[0].l
    assert a == b and all(x.is_equal for x in a)


def test_segment_softmax_sums_to_one(spark):
    df = spark.createDataFrame([(1, 1000.0), (1, 1001.0), (2, -5.0)], "q long, s double")
    got = {}
    for r in W.segment_softmax(df, "s", "q").collect():
        got[r.q] = got.get(r.q, 0) + r.prob
    assert abs(got[1] - 1) < 1e-12 and abs(got[2] - 1) < 1e-12


def test_segment_offsets(spark):
    df = spark.createDataFrame([(0, 2), (1, 0), (2, 3)], "Index long, context_length long")
    got = [(r.start, r.end) for r in W.segment_offsets(df).orderBy("Index").collect()]
    assert got == [(0, 2), (2, 2), (2, 5)]


def test_vector_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], [0.0, 1.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(V.argmax("a").alias("am"), V.dot("a", "b").alias("d"), V.pair_diff("a", "b").alias("pd"),
                  V.kl_normal(F.array(F.lit(0.0)), F.array(F.lit(0.0))).alias("kl")).collect()[0]
    assert r.am == 2 and r.d == 3.0 and r.pd == [1.0, 2.0, 3.0] and r.kl == 0.0


def test_word_count_blank(spark):
    df = spark.createDataFrame([("",), ("  a  b ",), (None,)], "t string")
    # a NULL text has no length (NULL), so a length filter drops it
    assert [r.n for r in df.select(TX.word_count(F.col("t")).alias("n")).collect()] == [0, 2, None]


def test_similarity_top_k_matches_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    Q, D = rng.normal(size=(7, 5)), rng.normal(size=(40, 5))
    q = spark.createDataFrame([(i, Q[i].tolist()) for i in range(7)], "qid long, qvec array<double>")
    d = spark.createDataFrame([(j, D[j].tolist()) for j in range(40)], "did long, dvec array<double>")
    got = {(r.qid, r.rank): r.did for r in J.similarity_top_k(q, d, 3, block_rows=8).collect()}
    S = Q @ D.T
    for i in range(7):
        order = sorted(range(40), key=lambda j: (-S[i, j], j))[:3]
        assert [got[(i, k + 1)] for k in range(3)] == order


def test_agreement_with_first_n_user_rows(spark):
    # a "new user" known by its first rows only: agreement counts come from those rows
    df = spark.createDataFrame(
        [(1, 7, "a", "b"), (2, 7, "c", "d"), (3, 7, "d", "c"),     # user 7: a>b, c>d, then d>c
         (4, 8, "a", "b"), (5, 8, "d", "c"), (6, 9, "b", "a")],
        "cmp_id long, worker long, chosen_only string, rejected_only string")
    full = {r.cmp_id: (r.agree, r.disagree) for r in J.agreement_join(df, 7, uid="worker").collect()}
    first2 = {r.cmp_id: (r.agree, r.disagree) for r in J.agreement_join(df, 7, uid="worker", n=2).collect()}
    assert full == {4: (1, 0), 5: (1, 1), 6: (0, 1)}
    assert first2 == {4: (1, 0), 5: (0, 1), 6: (0, 1)}
    best = G.similar_user(J.agreement_join(df, 7, uid="worker"), other="worker").collect()
    assert [(r.similar_uid, r.score) for r in best] == [(8, 1)]
    # from the first two rows only, user 8 agrees once and disagrees once: no positive total
    assert G.similar_user(J.agreement_join(df, 7, uid="worker", n=2), other="worker").count() == 0


def test_similarity_top_k_chunked_with_ties(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    Q = rng.integers(-2, 3, size=(9, 4)).astype(float)
    D = rng.integers(-2, 3, size=(50, 4)).astype(float)  # many equal scores: ties by doc id
    q = spark.createDataFrame([(i, Q[i].tolist(), i % 2) for i in range(9)], "qid long, qvec array<double>, g int")
    d = spark.createDataFrame([(j, D[j].tolist(), j % 2) for j in range(50)], "did long, dvec array<double>, g int")
    for grp in (None, "g"):
        got = {(r.qid, r.rank): r.did for r in J.similarity_top_k(
            q, d, 4, group=grp, block_rows=5, chunk_rows=3).collect()}
        S = Q @ D.T
        for i in range(9):
            cand = [j for j in range(50) if grp is None or j % 2 == i % 2]
            order = sorted(cand, key=lambda j: (-S[i, j], j))[:4]
            assert [got[(i, r + 1)] for r in range(4)] == order


def test_augment_counters_paths_agree_with_absent_types(spark, sf_small):
    from prefspark.operators import labels as LO
    from prefspark.plans import ratings as RT
    rows = LO.label_user_types(RT.matched(spark, sf_small), seed=0, filter_equal=True)
    a = sorted(tuple(r) for r in LO.augment_counters(rows).collect())
    b = sorted(tuple(r) for r in LO.augment_counters(rows.drop("present_types")).collect())
    assert a == b and len(a) == 4


def test_categorical_batch_loss_global_equals_grouped(spark):
    df = spark.createDataFrame([([0.1, 0.5, -1.0], [0.0, 0.2, 0.3]), ([1.0, 0.0, 0.0], [0.5, 0.5, 0.5])],
                               "lc array<double>, lr array<double>")
    a = G.categorical_batch_loss(df, "lc", "lr", 0.1).collect()[0]
    b = G.categorical_batch_loss(df.withColumn("g", F.lit(1)), "lc", "lr", 0.1, by=["g"]).collect()[0]
    assert abs(a.loss - b.loss) < 1e-12 and a.neg_entropy < 0


def test_long_dialog_in_bounded_memory(spark):
    """A dialog of 100,000 turns streams through small batches; its history is that of a plain loop."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        t = spark.range(0, 100_000, 1, 4).select((F.col("id") % 100 == 7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                                F.concat(F.lit("q"), F.col("id")).alias("user_text"),
                                                F.when(F.col("id") % 11 != 0, F.concat(F.lit("a"), F.col("id"))).alias("chosen"),
                                                F.when(F.col("id") % 13 != 0, F.lit("no")).alias("rejected"))
        plan = W.dialog_history(t, 60, 10, 20)
        assert "collect_list" not in plan._jdf.queryExecution().toString() and "ObjectHashAggregate" not in plan._jdf.queryExecution().toString()
        got = {(r.conv_id, r.turn): r.history for r in plan.collect()}
        tail = {(r.conv_id, r.turn): r.history for r in W.running_history(t, 30, text="user_text").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want, tails, h, run = {}, {}, {0: "", 1: ""}, {0: "", 1: ""}
    for i in range(100_000):
        d, u, c = int(i % 100 == 7), f"q{i}", f"a{i}" if i % 11 else None
        h[d] += u
        if c is not None and len(u) + len(c) < 20:
            h[d] = h[d][-50:]
            if i % 13:
                want[d, i] = h[d]
        h[d] += c or ""
        run[d] = (run[d] + "|" + u if run[d] else u)[-30:]
        tails[d, i] = run[d]
    assert got == want and tail == tails


def test_discounted_sums():
    import numpy as np
    rnd = np.random.default_rng(5)
    for lens in ([1], [128], [129, 1, 300], [1000, 5, 128, 256], rnd.integers(1, 400, 50).tolist()):
        x = rnd.normal(size=sum(lens))
        starts = np.cumsum([0, *lens[:-1]])
        got, at = W.discounted_sums(x, starts, 0.97), 0
        for n in lens:
            later = 0.0
            for i in range(at + n - 1, at - 1, -1):
                later = x[i] + 0.97 * later
                assert abs(got[i] - later) < 1e-9
            at += n


def test_gae_of_null_and_empty_arrays(spark):
    rows = [(1, [1.0, 2.0, 3.0], [0.5, 0.5, 0.5]), (2, None, None), (3, [], []), (4, [1.0, None, 2.0, 4.0], [1.0, 1.0, 1.0, 1.0]), (5, [2.0], [1.0])]
    df = spark.createDataFrame(rows, "id int, rewards array<double>, values array<double>")
    got = {r.id: r.advantages for r in W.gae(df, 0.5, 0.5).collect()}
    assert got[2] is None and got[3] == [] and got[5] == [1.0]
    d = [1 + 0.25 - 0.5, 2 + 0.25 - 0.5, 3 - 0.5]
    assert got[1] == pytest.approx([d[0] + 0.25 * (d[1] + 0.25 * d[2]), d[1] + 0.25 * d[2], d[2]])
    assert got[4][1] is None and got[4][0] == pytest.approx(1 + 0.5 - 1) and got[4][2:] == pytest.approx([2 + 0.5 - 1 + 0.25 * 3.0, 3.0])


def test_head2head_hot_key_and_repeats(spark, monkeypatch):
    """Distinct pairs per key with repeats, NULL outputs and a key that holds most rows of both sides; ordered mode by rank."""
    monkeypatch.setattr(J, "HOT_KEYS", 7)
    a = [("hot", f"a{i % 40}") for i in range(90)] + [("k", "x"), ("k", "x"), ("n", None), ("only", "z"), (None, "q")]
    b = [("hot", f"b{i % 30}") for i in range(70)] + [("k", "y"), ("n", "w"), ("n", None), (None, "q")]
    da, db = (spark.createDataFrame(x, "k string, output string").repartition(3) for x in (a, b))
    got = sorted(map(str, (tuple(r) for r in J.head2head(da, db, ["k"]).collect())))
    want = {(k, x, y) for k, x in a for j, y in b if k == j and k is not None}
    assert got == sorted(map(str, want))
    na, nb = (d.withColumn("pos", F.monotonically_increasing_id()) for d in (da, db))
    ranked = {}
    for d, side in ((na, 0), (nb, 1)):
        for r in d.collect():
            ranked.setdefault(r.k, ([], []))[side].append((r.pos, r.output))
    want = [(k, x[1], y[1]) for k, (p, q) in ranked.items() if k is not None for x, y in zip(sorted(p), sorted(q))]
    # positions of a written table stay: the two sides are numbered by their own order column
    na, nb = na.checkpoint(), nb.checkpoint()
    got = J.head2head(na, nb, ["k"], ordered=True, order="pos").collect()
    assert len(got) == len(want) and sum(r.k == "hot" for r in got) == 70


def test_guided_disagreement_by_cells(spark):
    import itertools
    import random

    from prefspark.operators import labels as LO
    fields = LO.RATING_FIELDS
    rnd = random.Random(2)
    rows = [(i, c, *[rnd.choice(["1", "2", "3", "4", "5", "N/A", None]) for _ in fields]) for i in range(150) for c in range(rnd.randint(1, 4))]
    rows += [(900, 0, *["3"] * len(fields)), (901, 0, *["N/A"] * len(fields))]
    df = spark.createDataFrame(rows, "instruction_id long, completion_no int, " + ", ".join(f"{f} string" for f in fields))
    num = lambda v: int(v) if v and v.isdigit() else None

    def differs(group):
        return any(x[p] is not None and y[p] is not None and x[q] is not None and y[q] is not None and x[p] > y[p] and x[q] < y[q]
                   for x, y in itertools.permutations(group, 2) for p in range(4) for q in range(4))
    groups = {}
    for i, _, *r in rows:
        groups.setdefault(i, []).append([num(v) for v in r])
    plan = LO.guided_disagreement(df)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Sort" not in text
    assert {r.instruction_id: r.guided_disagreement for r in plan.collect()} == {i: differs(g) for i, g in groups.items()}
    with pytest.raises(Exception, match="outside 1..5"):
        LO.guided_disagreement(df.withColumn(fields[0], F.lit("9"))).collect()


def test_evaluation_split(spark):
    train = spark.createDataFrame([(u, 100 * u + i) for u in (1, 2, 3) for i in range(50 if u == 1 else 5)], "uid long, qkey long")
    test = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "uid long, qkey long")
    got = [tuple(r) for r in L.evaluation_split(train, test, 5, seed=3).collect()]
    assert sorted(r[:2] for r in got if r[2] == "target") == [(1, 1), (1, 2), (2, 3)]
    context = [r for r in got if r[2] == "context"]
    assert sorted(u for u, _, _ in context) == [1] * 5 + [2] * 5 and len(set(context)) == 10
    assert {q for u, q, _ in context if u == 1} != {q for u, q, r in [tuple(x) for x in L.evaluation_split(train, test, 5, seed=4).collect()] if u == 1 and r == "context"}
    for short in (6,):
        with pytest.raises(Exception, match="fewer than 6"):
            L.evaluation_split(train, test, short, seed=3).collect()
    with pytest.raises(Exception, match="fewer than 2"):
        L.evaluation_split(train, test.union(spark.createDataFrame([(9, 9)], test.schema)), 2).collect()


def test_token_length_of_contexts(spark):
    rows = [(1, "a b", "c", [("x y z", "w")]), (2, "a b c d", None, None), (3, "", "", []), (4, "a", "b", [("x", None), (None, "1 2 3 4 5")])]
    df = spark.createDataFrame(rows, "id int, chosen string, rejected string, contexts array<struct<chosen:string,rejected:string>>")
    seen = []

    def counter(texts):
        assert all(isinstance(t, str) for t in texts)
        return [len(t.split()) for t in texts]
    for kw in ({}, {"counter": counter}):
        got = {r.id: r.n for r in df.select("id", P.largest_token_count(contexts="contexts", **kw).alias("n")).collect()}
        assert got == {1: 3, 2: 4, 3: 0, 4: 5}
        assert sorted(r.id for r in P.max_token_length(df, 3, contexts="contexts", **kw).collect()) == [1, 3]
    assert sorted(r.id for r in P.max_token_length(df, 3).collect()) == [1, 3, 4] and not seen


def test_upsampling_is_shuffled(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(30)], "cmp_id long, controversial boolean")
    got = L.upsample_controversial(df, seed=1).collect()
    assert sorted(r.place for r in got) == list(range(70)) and sum(r.controversial for r in got) == 50
    order = [(r.cmp_id, r.copy_no) for r in sorted(got, key=lambda r: r.place)]
    assert order != sorted(order) and order != [(r.cmp_id, r.copy_no) for r in sorted(L.upsample_controversial(df, seed=2).collect(), key=lambda r: r.place)]


def test_question_groups_whole_or_in_chunks(spark):
    df = spark.createDataFrame([(u, q, f"p{q}") for u in (1, 2) for q in range(7)], "uid long, qkey long, prompt string")
    whole = {r.uid: [x.qkey for x in r.questions] for r in G.question_groups(df, max_group=None).collect()}
    assert whole == {1: list(range(7)), 2: list(range(7))}
    parts = sorted((r.uid, r.chunk_no, len(r.questions)) for r in G.question_groups(df, max_group=3).collect())
    assert parts == [(u, c, n) for u in (1, 2) for c, n in ((0, 3), (1, 3), (2, 1))]
