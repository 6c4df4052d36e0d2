"""UDF surface.

Column expressions come first; user Python runs in Arrow batches
(``mapInPandas`` / iterator ``pandas_udf``) with its model loaded once per
task, never per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V


# X01 / X02 / X03 ------------------------------------------------------------
def map_columns(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """Row map expressed as column expressions (the fast path)."""
    return df.withColumns(dict(exprs))


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema, drop: tuple = ()) -> DataFrame:
    """Batched map: ``fn`` gets Arrow-backed pandas batches (``map(batched=True)``)."""
    src = df.drop(*drop) if drop else df

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)
    return src.mapInPandas(run, schema)


def filter_with_index(df: DataFrame, predicate: Callable[[Column], Column], order: str = "cmp_id",
                      index: str = "Index") -> DataFrame:
    """``filter(fn, with_indices=True)``: the predicate sees the dense index column."""
    from .project import add_index
    d = add_index(df, order, index)
    return d.filter(predicate(F.col(index)))


def post_process(df: DataFrame, fn: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    return df if fn is None else df.transform(fn)


# X04 ------------------------------------------------------------------------
class LinearScorer:
    """Default scorer: reward = w . x (no model files, so tests need none)."""

    def __init__(self, weights):
        self.w = np.asarray(weights, dtype=np.float64)

    def load(self):  # a real scorer would load its model here, once per task
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w


def _batches_through(column_type: str, model, method: str, to_rows):
    """An iterator Pandas UDF: ``model.load()`` once per task, then one call of ``method`` per Arrow batch on
    its non-NULL values; NULL stays NULL."""
    @F.pandas_udf(column_type)
    def _apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = getattr(model.load() if hasattr(model, "load") else model, method)
        for s in batches:
            some = s.notna().to_numpy()
            got = iter(to_rows(call(_as_input(s[some]))) if some.any() else ())
            yield pd.Series([next(got) if x else None for x in some], dtype=object)
    return _apply


def _as_input(s: pd.Series):
    """A matrix for vectors, the list of texts (or other values) else."""
    first = s.iloc[0]
    return list(s) if isinstance(first, str) or np.ndim(first) == 0 else np.vstack([np.asarray(v, dtype=np.float64) for v in s])


def score_with(df: DataFrame, scorer, col: str = "embedding", out: str = "score") -> DataFrame:
    """Score a vector or text column with ``scorer.score`` (loaded once per task); NULL gives NULL."""
    run = _batches_through("double", scorer, "score", lambda got: [float(v) for v in got])
    return df.withColumn(out, run(F.col(col)))


def linear_score_expr(col: str, weights) -> Column:
    """The default scorer as a pure column expression (same result, stays in codegen)."""
    return V.dot(col, F.array(*[F.lit(float(w)) for w in weights]))


# X05 ------------------------------------------------------------------------
def embed_with(df: DataFrame, text: str = "text", out: str = "embedding", dim: int = 64,
               encoder=None) -> DataFrame:
    """Text -> vector for a whole table.  Default encoder: hashing term frequencies
    (``pyspark.ml`` ``Tokenizer`` + ``HashingTF``), L2-normalised, as ``array<double>``.  Another
    ``encoder`` (``encode``: list of texts -> matrix) is loaded once per task.  NULL text gives NULL."""
    if encoder is not None:
        run = _batches_through("array<double>", encoder, "encode", lambda got: [np.asarray(v, dtype=np.float64) for v in got])
        return df.withColumn(out, run(F.col(text)))
    from pyspark.ml.feature import HashingTF, RegexTokenizer
    from pyspark.ml.functions import vector_to_array
    tok = RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"\W+", toLowercase=True)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    filled = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    d = tf.transform(tok.setInputCol("_text").transform(filled)).drop("_text").withColumn("_arr", vector_to_array("_tf"))
    n = V.norm("_arr")
    unit = F.when(n > 0, V.scale("_arr", 1.0 / n)).otherwise(F.col("_arr"))
    return d.withColumn(out, F.when(F.col(text).isNotNull(), unit)) \
        .drop("_tok", "_tf", "_arr")


# X08 ------------------------------------------------------------------------
def _partial_newton_sums(group: str, it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per partition (sorted by group): gradient, Hessian, count and loss of each group's rows.  Batches are
    Arrow-sized, so memory is bounded by a batch plus one group's d x d matrix."""
    key, acc = None, None

    def row():
        g, h, n, loss, w = acc
        return pd.DataFrame({group: [key], "g": [g.tolist()], "h": [h.ravel().tolist()], "n": [n], "loss": [loss], "_w": [w.tolist()]})

    for pdf in it:
        for k, sub in pdf.groupby(group, sort=False):
            x = np.vstack([np.asarray(v, dtype=np.float64) for v in sub["_x"]])
            w = np.asarray(sub["_w"].iloc[0], dtype=np.float64)
            z = x @ w
            p = 1.0 / (1.0 + np.exp(-z))
            new = [-(x.T @ (1.0 - p)), (x.T * (p * (1.0 - p))) @ x, len(x), float(np.sum(np.logaddexp(0.0, -z))), w]
            if acc is not None and k == key:
                acc = [a + b for a, b in zip(acc[:4], new[:4])] + [w]
                continue
            if acc is not None:
                yield row()
            key, acc = k, new
    if acc is not None:
        yield row()


def fit_linear_preference(df: DataFrame, diff: str = "diff", group: str | None = None,
                          l2: float = 1e-3, tol: float = 1e-8, max_steps: int = 100) -> DataFrame:
    """Fit w minimising mean -log sigma(w . d) + l2/2 |w|^2 (logistic regression without intercept
    on (d, 1) and (-d, 0)).

    Pooled: ``pyspark.ml`` ``LogisticRegression``.  Per group: distributed
    Newton steps.  Each step joins the rows with the current weights (a keyed
    join; AQE splits a hot group's partition), sums gradient and Hessian per
    group *inside each partition* (``mapInPandas``), and combines those
    partial sums per group -- at most one d x d matrix per partition and
    group, whatever the group's size -- before solving for the new weights.
    The weights table is written to the checkpoint folder after each step.  Steps go on until no
    group's gradient exceeds ``tol``; a fit that has not got there after ``max_steps`` is an error."""
    if group is None:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import array_to_vector, vector_to_array
        pos = df.select(array_to_vector(F.col(diff).cast("array<double>")).alias("features"),
                        F.lit(1.0).alias("label"))
        neg = df.select(array_to_vector(V.scale(diff, -1.0)).alias("features"), F.lit(0.0).alias("label"))
        lr = LogisticRegression(fitIntercept=False, regParam=l2, maxIter=max_steps, tol=tol, standardization=False)
        model = lr.fit(pos.unionByName(neg))
        if model.summary.totalIterations >= max_steps:
            raise RuntimeError(f"no convergence in {max_steps} steps")
        spark = df.sparkSession
        w = model.coefficients.toArray().tolist()
        return spark.createDataFrame([(w,)], "weights array<double>")

    from ..session import materialize
    gtype = dict(df.dtypes)[group]
    d = materialize(df.select(group, F.col(diff).cast("array<double>").alias("_x")))  # read once per step
    dim = d.select(F.max(F.size("_x"))).first()[0]
    w = materialize(d.select(group).distinct().withColumn("_w", F.array_repeat(F.lit(0.0), F.lit(dim))))
    part_schema = f"{group} {gtype}, g array<double>, h array<double>, n long, loss double, _w array<double>"

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        n = float(pdf["n"].sum())
        g = np.sum(np.vstack([np.asarray(v) for v in pdf["g"]]), axis=0) / n
        H = np.sum(np.vstack([np.asarray(v) for v in pdf["h"]]), axis=0).reshape(dim, dim) / n
        w0 = np.asarray(pdf["_w"].iloc[0], dtype=np.float64)
        w1 = w0 - np.linalg.solve(H + l2 * np.eye(dim), g + l2 * w0)
        # a group that has converged keeps its weights
        size = float(np.abs(g + l2 * w0).max())
        return pd.DataFrame({group: [pdf[group].iloc[0]], "_w": [(w1 if size > tol else w0).tolist()], "_g": [size]})

    for _ in range(max_steps):
        joined = d.join(w, group)
        # sorted by group, so a partition holds one group's sums at a time
        partial = joined.sortWithinPartitions(group).mapInPandas(lambda it: _partial_newton_sums(group, it), part_schema)
        w = materialize(partial.groupBy(group).applyInPandas(step, f"{group} {gtype}, _w array<double>, _g double"))
        worst = w.agg(F.max("_g")).first()[0]
        w = w.drop("_g")
        if worst is None or worst <= tol:
            break
    else:
        raise RuntimeError(f"no convergence in {max_steps} steps")
    fit = d.join(w, group).groupBy(group).agg(
        F.first("_w").alias("weights"),
        F.avg((V.dot("_x", "_w") > 0).cast("double")).alias("train_accuracy"),
        F.count(F.lit(1)).alias("n"))
    return fit


# X09 ------------------------------------------------------------------------
def metric_registry() -> dict[str, Callable[[str, str], Column]]:
    """name -> aggregate Column over (chosen score, rejected score) columns."""
    from .aggregate import correct
    return {
        "accuracy": lambda c, r: F.avg(correct(c, r)),
        "loss": lambda c, r: F.avg(V.log_sigmoid_loss(c, r)),
        "margin": lambda c, r: F.avg(F.col(c) - F.col(r)),
        "mean_chosen": lambda c, r: F.avg(c),
        "mean_rejected": lambda c, r: F.avg(r),
    }


def compute_metrics(df: DataFrame, names, chosen: str = "reward_chosen", rejected: str = "reward_rejected",
                    by=()) -> DataFrame:
    reg = metric_registry()
    return df.groupBy(*list(by)).agg(*[reg[n](chosen, rejected).alias(n) for n in names])
