"""Context draws: exact counts, no repeated survey row, refusal where no choice exists; numbering with NULL and equal keys."""

import pytest
from pyspark.sql import functions as F

from prefspark.operators import annotate as A
from prefspark.operators import project as P
from prefspark.operators import select as L
from prefspark.operators import window as W


def test_random_contexts_are_exact_on_a_lopsided_pool(spark):
    pool = spark.createDataFrame([(i, "same" if i < 95 else f"p{i}", f"c{i}") for i in range(100)], "Index long, prompt string, chosen string")
    df = spark.createDataFrame([(i, "same") for i in range(200)] + [(500, "p99"), (501, None)], "Index long, prompt string")
    got = L.random_contexts(df, pool, n=8).collect()
    assert all(len(r.contexts) == 8 for r in got)
    own = {f"p{i}": i for i in range(95, 100)}
    for r in got:
        ids = [c.original_id for c in r.contexts]
        assert all(i >= 95 for i in ids) if r.prompt == "same" else own.get(r.prompt) not in ids
    with pytest.raises(Exception, match="no pool row of another prompt"):
        L.random_contexts(df.filter("Index = 0"), pool.filter("prompt = 'same'"), n=2).collect()


def _drawn(rows, pool, n, seed):
    """(key, prompt, ids) of every row by brute force: equal keys have all their draws, a NULL key has none."""
    import hashlib
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    first = lambda x: (x is not None, x)
    order = sorted(((i, p) for i, p in pool), key=lambda r: (first(r[1] and md5(r[1])), first(r[0])))
    draws = {}
    for k, p in rows:
        own = [j for j, r in enumerate(order) if p is not None and r[1] == p]
        lo, size = (own[0], len(own)) if own else (0, 0)
        for d in range(n):
            x = int(md5(f"{seed}:{k}:{d}")[:15], 16) % (len(order) - size)
            draws.setdefault(k, []).append((d, order[x + size if x >= lo else x][0]))
    return sorted((repr(k), repr(p), None if k is None else [i for _, i in sorted(draws[k])]) for k, p in rows)


@pytest.mark.parametrize("blocks", [False, True])
def test_draws_move_packed(spark, monkeypatch, blocks):
    if blocks:
        for name, most in (("DRAWS_PER_BLOCK", 64), ("TEXT_DRAWS_PER_BLOCK", 64), ("ROWS_PER_RANGE", 30), ("DRAWS_PER_RANGE", 200)):
            monkeypatch.setattr(L, name, most)
    pool = [(i, f"p{i % 11}" if i % 5 else "hot") for i in range(200)] + [(300, None), (301, None)]
    rows = [(i % 90, f"p{i % 13}") for i in range(150)] + [(None, "p1"), (None, "hot"), (400, "hot"), (401, None), (402, "nowhere")]
    df = spark.createDataFrame([(k, p, i) for i, (k, p) in enumerate(rows)], "Index long, prompt string, more long")
    dp = spark.createDataFrame(pool, "Index long, prompt string").withColumn("body", F.concat(F.lit("t"), F.col("Index").cast("string")))
    c = L.random_contexts(df, dp, n=4, seed=7, fields=("body",))
    got = c.collect()
    ids = lambda r: None if r.contexts is None else [x.original_id for x in r.contexts]
    assert c.columns == ["Index", "prompt", "more", "contexts"]
    assert sorted((repr(r.Index), repr(r.prompt), ids(r)) for r in got) == _drawn(rows, pool, 4, 7)
    assert all(x.body == f"t{x.original_id}" for r in got for x in r.contexts or [])
    # no row for each draw, and what is not asked for does not come
    c = L.random_contexts(df, dp, n=4, seed=7, fields=(), columns=("Index",))
    text = c._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text and "body" not in text and c.columns == ["Index", "contexts"]
    assert sorted((repr(r.Index), ids(r)) for r in c.collect()) == sorted((k, i) for k, _, i in _drawn(rows, pool, 4, 7))


def test_gaps_of_positions():
    import numpy as np
    rnd = np.random.default_rng(4)
    for most, n in ((300, 250), (10**4, 3000), (10**6, 300), (1 << 24, 3), (1, 1)):
        x = np.unique(np.append(rnd.integers(0, most, n), most - 1))
        units = L._gaps(x)
        assert (L._of_gaps(units) == x).all() and units.nbytes <= 2.5 * len(x) + 2 * most / 65535 + 2
    assert L._of_gaps(L._gaps(np.array([0, 255, 510, 511]))).tolist() == [0, 255, 510, 511]


def test_numbering_keeps_one_copy(spark):
    import os

    from prefspark.session import ensure_checkpoint_dir
    at = os.path.join(ensure_checkpoint_dir(spark), "tables")
    os.makedirs(at, exist_ok=True)
    before = set(os.listdir(at))
    got = W.dense_position(spark.range(100).select((F.col("id") * 7 % 100).alias("k")), "k", n_buckets=4)
    assert [x.split("-")[0] for x in set(os.listdir(at)) - before] == ["ordered"]
    assert sorted((r.k, r.pos) for r in got.collect()) == [(i, i) for i in range(100)]


def test_survey_contexts_until_found(spark):
    survey = spark.createDataFrame([(i, ["8", "4", "2", "1"][: 1 + i % 4] if i else ["1"]) for i in range(30)], "Index long, satisfied_subset array<string>")
    df = spark.createDataFrame([(i,) for i in range(500)], "Index long")
    sets = {r.Index: set(r.satisfied_subset) for r in survey.collect()}
    for r in L.survey_contexts(df, survey, 4, mode="single").collect():
        ids = [c.original_id for c in r.contexts]
        assert r.identified and 2 <= len(ids) <= 4 and len(set(ids)) == len(ids)
        assert len(set.intersection(*(sets[i] for i in ids))) == 1
    with pytest.raises(ValueError):
        L.survey_contexts(df, survey.filter("size(satisfied_subset) = 4"), 4, mode="single")
    copies = L.replicate_with_new_contexts(df, survey, k=3, max_len=4).collect()
    assert len(copies) == 1500 and len({tuple(c.original_id for c in r.contexts) for r in copies if r.Index == 1}) > 1


def test_accepted_choices_follow_repeated_draws():
    """Sizes and sets have the distribution of uniform draws repeated until one type is common; every order comes up."""
    import collections
    import itertools
    import math

    import numpy as np
    rnd = np.random.default_rng(11)
    word = lambda k: rnd.integers(0, 1 << 60, k)
    for masks, lo, hi in (([1, 3, 6, 2, 7, 4, 12], 2, 4), ([15, 15, 1], 1, 3), ([1, 2, 4, 8], 1, 2), ([5, 5, 3, 9, 0], 2, 5)):
        good = {s: 1 / math.comb(len(masks), n) for n in range(lo, hi + 1) for s in itertools.combinations(range(len(masks)), n)
                if (c := int(np.bitwise_and.reduce([masks[i] for i in s]))) > 0 and c & (c - 1) == 0}
        choices, k = L.AcceptedChoices(masks, lo, hi), 40_000
        got = choices.choose(word(k), np.stack([word(k), word(k)], axis=1), word(k))
        seen = collections.Counter(tuple(sorted(x.tolist())) for x in got)
        assert set(seen) <= set(good)
        chi = sum((seen[s] - k * p / sum(good.values())) ** 2 / (k * p / sum(good.values())) for s, p in good.items())
        assert chi < len(good) + 6 * math.sqrt(2 * len(good))
        orders = collections.Counter(tuple(np.argsort(x)) for x in got if len(x) == lo)
        assert len(orders) in (0, math.factorial(lo)) and all(c > 0.8 * sum(orders.values()) / len(orders) for c in orders.values())
    assert not L.AcceptedChoices([3, 3, 3], 1, 3)


def test_accepted_choices_beyond_64_bits():
    import numpy as np
    choices = L.AcceptedChoices([1 << i % 4 for i in range(1200)], 2, 14)
    assert choices.kind is object
    rnd = np.random.default_rng(1)
    got = choices.choose(rnd.integers(0, 1 << 60, 500), rnd.integers(0, 1 << 60, (500, 2)), rnd.integers(0, 1 << 60, 500))
    assert all(len(set(x.tolist())) == len(x) and len({i % 4 for i in x.tolist()}) == 1 for x in got)


@pytest.mark.parametrize("buckets", [None, 7])
def test_numbering_with_null_and_equal_keys(spark, buckets):
    df = spark.createDataFrame([(None,), (None,), (3,), (1,), (3,), (2,)] * 20, "k long")
    got = W.dense_position(df, "k", n_buckets=buckets).collect()
    assert sorted(r.pos for r in got) == list(range(120))
    assert [r.k for r in sorted(got, key=lambda r: r.pos)] == [None] * 40 + [1] * 20 + [2] * 20 + [3] * 40


def test_noise_and_draws_reach_reused_rows(spark):
    rows = [(f"i{i}", "", f"a{i}", f"a{i}" if i % 10 == 0 else f"longer{i}") for i in range(300)]
    pairs = spark.createDataFrame(rows, "instruction string, input string, output_1 string, output_2 string")
    store, _ = A.annotate_with(pairs, noise_p=0.0)
    store = store.drop("is_noisy_label").filter("output_1 != output_2").withColumn("chain_of_thoughts", F.lit("stored"))
    calls = {"a1": lambda d: d.withColumn("preference", F.lit(1)), "a2": lambda d: d.withColumn("preference", F.lit(2))}
    got, new_store = A.annotate_with(pairs, judge=calls, store=store, noise_p=0.25)
    got = got.collect()
    assert len(got) == 300 and 100 < sum(r.is_noisy_label for r in got) < 200
    assert all(r.preference == 0 for r in got if r.output_1 == r.output_2)
    kept = new_store.filter("chain_of_thoughts = 'stored'").collect()
    assert len(kept) == 270 and {r.preference for r in kept} == {2}
    one = [r.annotator for r in got]
    fresh, _ = A.annotate_with(pairs, judge=calls, noise_p=0.0)
    assert all(r.preference == (0 if r.output_1 == r.output_2 else {"a1": 1, "a2": 2}[r.annotator]) for r in fresh.collect())
    assert set(one) == {"a1", "a2"}


def test_batches_come_back_to_rows(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "row_id long, text string")
    b = W.pack_batches(df, 3, "{text}|{text}|{text}", ["text"])
    b = b.withColumn("labels", F.when(F.col("batch_no") != 1, F.array(F.lit("x"), F.lit("y"), F.lit("z"))))
    got = [(int(r.id), r.position, r.label) for r in W.unpack_batches(b, 3).orderBy("position").collect()]
    assert got == [(0, 0, "x"), (1, 1, "y"), (2, 2, "z"), (3, 3, None), (4, 4, None), (5, 5, None), (6, 6, "x")]


def test_rag_prompt(spark):
    q = spark.createDataFrame([(1, "Q?", 'u\nAssistant: "yes" ', "no")], "qid long, prompt string, chosen string, rejected string")
    shots = spark.createDataFrame([(1, 1, "best", "c1", "r1"), (1, 2, "next", "c2", "r2")],
                                  "qid long, rank int, prompt string, chosen string, rejected string")
    r = P.rag_prompt(q, shots, seed=1).collect()[0]
    text = r.rag_prompt
    assert text.startswith("The examples next\n\n") and text.index("next") < text.index("best") < text.index("Prompt: Q?")
    assert ("Response A: yes\n\nResponse B: no" in text) == (r.answer == "A")
    assert text.endswith("Which response do you prefer?\nResponse ") and '"' not in text


def test_rag_prompts_hold_whole_documents(spark, sf_small):
    from __spark_entry__ import queries
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    rows = queries()["p38_rag_prompt_whole"](spark, sf_small).collect()
    pair = lambda d, k: docs[2 * (d % (len(docs) // 2)) + k]
    assert rows and max(len(docs[r.qid]) for r in rows) > 160
    for r in rows:
        whole = [docs[r.qid], *(pair(r.qid, k).split("\nAssistant: ")[-1].replace('"', "").strip() for k in (0, 1))]
        assert r.n_chars > sum(map(len, whole))


def test_checkpoint_folder_is_required_on_a_cluster():
    from prefspark.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
