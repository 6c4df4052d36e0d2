"""Property tests (hypothesis) on the operators' invariants."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefspark.functions import labels as LB
from prefspark.functions import text as TX
from prefspark.operators import aggregate as G
from prefspark.operators import project as P
from prefspark.operators import select as L

SETTINGS = dict(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 10 ** 6)), min_size=1, max_size=40, unique_by=lambda t: t[1]))
def test_derangement_has_no_fixed_point(spark, rows):
    df = spark.createDataFrame(rows, "k int, row_id long").withColumn("v", F.col("row_id"))
    out = L.derangement(df, ["k"], "v", seed=3, id_col="row_id").collect()
    sizes = {}
    for k, _ in rows:
        sizes[k] = sizes.get(k, 0) + 1
    assert len(out) == len(rows)
    for r in out:
        if sizes[r.k] >= 2:
            assert r.paired_value != r.v
        else:
            assert r.paired_value == r.v
    # a permutation within each group
    for k in sizes:
        assert sorted(r.paired_value for r in out if r.k == k) == sorted(r.v for r in out if r.k == k)


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.sampled_from([0, 1, 2, 3]), st.booleans()), min_size=1, max_size=30))
def test_swap_twice_is_identity(spark, rows):
    df = spark.createDataFrame(rows, "p int, f boolean")
    once = LB.swap_preference(F.col("p"), F.col("f"))
    twice = LB.swap_preference(once, F.col("f"))
    assert all(r.a == r.b for r in df.select(F.col("p").alias("a"), twice.alias("b")).collect())


@settings(**SETTINGS)
@given(st.lists(st.floats(0, 4, allow_nan=False), min_size=1, max_size=30))
def test_ordinal_to_binary_range(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert all(r.b in (0, 1, 2) for r in df.select(LB.ordinal_to_binary(F.col("x")).alias("b")).collect())


@settings(**SETTINGS)
@given(st.lists(st.integers(0, 10 ** 9), min_size=1, max_size=20), st.integers(0, 4))
def test_user_prompt_roundtrip(spark, uids, n):
    df = spark.createDataFrame([(u, "question?") for u in uids], "uid long, prompt string")
    out = P.parse_user_identifier(P.user_prompt(df, sep="|", n_tokens=n), out="back").collect()
    assert [r.back for r in out] == uids


@settings(**SETTINGS)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=40))
def test_duplicate_generic_counts(spark, uids):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(uids)], "cmp_id long, uid long")
    out = P.duplicate_generic(df, train=True)
    assert out.count() == 2 * sum(1 for u in uids if u != 0)
    assert out.filter("uid = 0").count() == sum(1 for u in uids if u != 0)


@settings(**SETTINGS)
@given(st.integers(1, 200), st.floats(0.0, 1.0))
def test_holdout_disjoint_complete(spark, n, frac):
    df = spark.range(n).withColumnRenamed("id", "cmp_id")
    s = L.holdout_split(df, frac, seed=5)
    test = s.filter("is_test").count()
    assert test == int(n * frac) or abs(test - n * frac) < 1
    assert s.count() == n and s.select("cmp_id").distinct().count() == n


@settings(**SETTINGS)
@given(st.lists(st.integers(-1, 5), min_size=1, max_size=60))
def test_head2head_counts_sum(spark, prefs):
    df = spark.createDataFrame([(p,) for p in prefs], "preference int")
    r = G.head2head_metrics(df).collect()
    kept = [p for p in prefs if p in (0, 1, 2)]
    if not kept:
        assert not r or r[0].n_total == 0
        return
    r = r[0]
    assert r.n_wins + r.n_wins_base + r.n_draws == r.n_total == len(kept)


@settings(**SETTINGS)
@given(st.text(max_size=30))
def test_pystrip_matches_python(spark, s):
    df = spark.createDataFrame([(s,)], "s string")
    got = df.select(TX.pystrip(F.col("s")).alias("t")).collect()[0].t
    assert got == s.strip()


def test_cells_are_pruned_exactly():
    """Pruned search gives the places of a full one, ties, infinite and missing values included, and scores fewer pairs when norms differ."""
    import numpy as np

    from prefspark.operators.joins import best_of_cell
    rnd = np.random.default_rng(4)
    for n, k, spread in ((500, 5, 2.0), (500, 5, 0.0), (3, 5, 1.0), (400, 1, 3.0)):
        d = rnd.integers(-3, 4, size=(n, 8)).astype(float) * np.exp(rnd.normal(size=(n, 1)) * spread)
        q = rnd.integers(-3, 4, size=(40, 8)).astype(float)
        vectors = np.empty(n, dtype=object)
        vectors[:] = list(d)
        done: list = []
        s, i = best_of_cell(q, vectors, k, 16, done)
        full = q @ d.T
        want = np.array([np.lexsort((np.arange(n), -row))[:k] for row in full])
        m = min(n, k)
        assert (i[:, :m] == want[:, :m]).all() and (i[:, m:] == -1).all()
        assert spread < 2 or sum(done) < 0.5 * full.size
    odd = np.empty(4, dtype=object)
    odd[:] = [np.array([np.inf, 0.0]), np.array([1.0, 1.0]), np.array([-np.inf, 1.0]), np.array([2.0, 0.0])]
    s, i = best_of_cell(np.array([[1.0, 1.0]]), odd, 2, 1)
    assert i.tolist() == [[0, 1]]
