"""UDF-surface operators: scorer hook, embedding hook, distributed per-user fit."""

import numpy as np
from pyspark.sql import functions as F

from prefspark.operators import hooks as X


def test_fit_matches_single_machine_newton(spark):
    rng = np.random.default_rng(1)
    w_true = rng.normal(size=4)
    rows = []
    for u in range(3):
        for _ in range(600 if u == 0 else 100):  # user 0 is hot
            x = rng.normal(size=4)
            y = 1 if x @ w_true + rng.normal() * 0.3 > 0 else -1
            rows.append((u, (y * x).tolist()))
    df = spark.createDataFrame(rows, "uid long, diff array<double>").repartition(5)
    fit = {r.uid: r for r in X.fit_linear_preference(df, "diff", group="uid").collect()}
    for u in range(3):
        D = np.array([d for g, d in rows if g == u])
        w = np.zeros(4)
        for _ in range(40):
            z = D @ w
            p = 1 / (1 + np.exp(-z))
            g = -(D.T @ (1 - p)) / len(D) + 1e-3 * w
            H = (D.T * (p * (1 - p))) @ D / len(D) + 1e-3 * np.eye(4)
            w = w - np.linalg.solve(H, g)
        assert np.allclose(fit[u].weights, w, atol=1e-6) and fit[u].n == len(D)


def test_score_with_equals_expression(spark):
    w = [0.5, -1.0, 2.0]
    df = spark.createDataFrame([(i, [float(i), 1.0, -1.0]) for i in range(20)], "id long, e array<float>")
    a = X.score_with(df, X.LinearScorer(w), "e", "s").select("id", "s")
    b = df.select("id", X.linear_score_expr("e", w).alias("s"))
    assert sorted(a.collect()) == sorted(b.collect())


def test_embed_with_unit_norm(spark):
    df = spark.createDataFrame([("a b c",), ("",)], "text string")
    rows = X.embed_with(df, dim=16).collect()
    assert abs(sum(x * x for x in rows[0].embedding) - 1.0) < 1e-9 and sum(rows[1].embedding) == 0.0


def test_text_scorer_and_encoder_keep_nulls(spark):
    class _Lengths:  # local, so that it travels with the UDF
        def load(self):
            return self

        def score(self, texts):
            return [len(t) for t in texts]

        def encode(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id long, text string")
    assert [r.s for r in X.score_with(df, _Lengths(), "text", "s").orderBy("id").collect()] == [3.0, None, 0.0]
    got = [r.embedding for r in X.embed_with(df, encoder=_Lengths()).orderBy("id").collect()]
    assert got == [[3.0, 1.0], None, [0.0, 1.0]]
    assert [r.embedding is None for r in X.embed_with(df, dim=8).orderBy("id").collect()] == [False, True, False]


def test_fit_without_convergence_is_an_error(spark):
    import pytest
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [-1.0, 0.5])], "uid long, diff array<double>")
    with pytest.raises(RuntimeError):
        X.fit_linear_preference(df, group="uid", max_steps=1)
