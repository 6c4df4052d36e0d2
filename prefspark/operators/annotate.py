"""The annotation job as a composition of DataFrame operators.

de-duplicate -> seeded annotator choice (L17) -> reuse stored labels (J04) -> label noise on every row (F16)
-> equal outputs are draws -> each annotator's judge on its rows without a label -> merge into the
store (U02).  Annotator and noise are seeded on instruction and input, so all pairs of one
instruction share them.  A judge is a function ``DataFrame -> DataFrame`` that fills ``preference`` (a
deterministic rule in tests, a model behind an iterator Pandas UDF in production); judged rows are
written once and both results read them, so a judge never runs twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as LB
from ..functions.random import seeded_uniform, weighted_choice
from ..session import materialize
from . import joins as J
from . import select as L
from . import sets as U
from .window import first_by, sample_number

Judge = Callable[[DataFrame], DataFrame]
PAIR_KEYS = ["instruction", "input", "output_1", "output_2"]


SEED_KEYS = ["instruction", "input"]


def seed_key() -> Column:
    return F.concat_ws(":", *[F.col(c) for c in SEED_KEYS])


def longer_output_judge(df: DataFrame) -> DataFrame:
    """Default judge rule: the longer output wins (1 on ties)."""
    return df.withColumn("preference", F.when(F.length("output_1") >= F.length("output_2"), 1).otherwise(2))


def annotate_with(pairs: DataFrame, judge: Judge | dict[str, Judge] = longer_output_judge,
                  store: DataFrame | None = None, annotators=("a1", "a2"), probs=(0.7, 0.3),
                  seed: int = 31, noise_p: float = 0.1, noise_seed: int = 41) -> tuple[DataFrame, DataFrame]:
    """Run the annotation job; returns ``(result, new_store)``.

    ``judge`` is one function for all annotators or one for each.  ``result`` has one row per distinct pair
    that got a label, with ``annotator``, ``preference``, ``is_noisy_label``; ``new_store`` is the old
    store plus the labels not made by noise (a stored label stays as it was).
    """
    d = pairs.select(*PAIR_KEYS).dropDuplicates(PAIR_KEYS)
    d = d.withColumn("annotator", weighted_choice(seeded_uniform(seed, seed_key()), list(annotators), list(probs)))
    if store is not None:
        d = J.reuse_annotations(d, store, PAIR_KEYS + ["annotator"])
    else:
        d = d.withColumn("preference", F.lit(None).cast("int")).withColumn(
            "chain_of_thoughts", F.lit(None).cast("string"))
    same = F.col("output_1") == F.col("output_2")
    label, noisy = LB.label_noise(F.col("preference").cast("int"), noise_p, noise_seed, seed_key(), same)
    d = d.withColumn("is_noisy_label", noisy).withColumn("preference", label.cast("int"))
    open_ = d.filter(F.col("preference").isNull())
    judges = judge if isinstance(judge, dict) else {a: judge for a in annotators}
    done = d.filter(F.col("preference").isNotNull())
    for name in annotators:
        judged = judges[name](open_.filter(F.col("annotator") == name))
        done = done.unionByName(judged.withColumn("preference", F.col("preference").cast("int")), allowMissingColumns=True)
    result = materialize(done.filter(F.col("preference").isNotNull()))
    clean = result.filter(~F.col("is_noisy_label"))
    if store is None:
        return result, clean
    new_store, _ = U.merge_store(store.withColumn("is_noisy_label", F.lit(False)), clean, PAIR_KEYS + ["annotator"])
    return result, new_store


def annotate_samples(outputs: DataFrame, keys=("instruction", "input"), samples: str = "outputs",
                     seed: int = 0, **kw) -> tuple[DataFrame, DataFrame]:
    """Number the samples (W01), keep unique outputs per key, pair each output with a
    different one of the same key (L16), keep one pair per key (first sample), then X06."""
    keys = list(keys)
    s = sample_number(outputs, samples, "output", "sample_no")
    s = first_by(s, keys + ["output"], "sample_no")
    s = s.withColumn("row_id", F.concat_ws(":", *[F.col(k) for k in keys], F.col("sample_no").cast("string")))
    paired = L.derangement(s, keys, "output", seed=seed, id_col="row_id", out="output_2")
    paired = paired.withColumnRenamed("output", "output_1")
    one = first_by(paired, keys, "sample_no")
    return annotate_with(one.select(*keys, "output_1", "output_2"), **kw)
