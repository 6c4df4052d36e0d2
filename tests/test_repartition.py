"""Same result at 1, 4 and 17 partitions (catches order dependence, SURVEY §5 d)."""

import pytest
from pyspark.sql import functions as F

from prefspark.operators import aggregate as G
from prefspark.operators import select as L
from prefspark.operators import window as W
from prefspark.plans import comparisons as CP


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_majority_vote_stable(spark, sf_small, parts):
    n = CP.normalized(spark, sf_small).repartition(parts)
    base = _rows(G.majority_vote(CP.normalized(spark, sf_small)).select("cmp_id", "votes"))
    assert _rows(G.majority_vote(n).select("cmp_id", "votes")) == base


@pytest.mark.parametrize("parts", [1, 4, 17])
@pytest.mark.parametrize("buckets", [None, 1, 7, 64])
def test_dense_position_stable(spark, parts, buckets):
    df = spark.range(0, 997).select((F.col("id") * 7919 % 997).alias("k")).repartition(parts)
    got = _rows(W.dense_position(df, "k", "p", n_buckets=buckets))
    assert got == [(k, k) for k in range(997)]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_group_position_and_derangement_stable(spark, parts):
    df = spark.range(0, 500).select((F.col("id") % 3).alias("g"), F.col("id").alias("row_id")).repartition(parts)
    gp = _rows(W.group_position(df, "g", "row_id", "rk"))
    assert gp == sorted((g, r, r // 3 + 1) for r in range(500) for g in [r % 3])
    d1 = _rows(L.derangement(df.withColumn("v", F.col("row_id")), ["g"], "v", seed=1, id_col="row_id"))
    d2 = _rows(L.derangement(df.coalesce(1).withColumn("v", F.col("row_id")), ["g"], "v", seed=1, id_col="row_id"))
    assert d1 == d2


STABILITY_QUERIES = ["g03_majority_vote", "j07_agreement_join", "g04_similar_user", "f21_explode_user_types",
                     "g15_augment_counters", "l16_derangement", "l14_shuffle", "w02_question_key", "l07_holdout_split",
                     "w04_dialog_history", "x06_annotate_with", "w09_pack_batches", "f30_assemble_run_metrics",
                     "l04_top_k_similar", "l11_random_contexts", "g25_best_worst_by_attribute", "w03_segment_offsets"]


@pytest.mark.parametrize("name", STABILITY_QUERIES)
def test_queries_stable_under_other_partitioning(spark, sf_small, name):
    """The same rows with 64 KB input splits and 17 shuffle partitions (AQE off, so the
    partition counts are really used)."""
    import os
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    import __spark_entry__ as E
    from oracle_check import compare, duck
    conf = {"spark.sql.files.maxPartitionBytes": str(64 * 1024), "spark.sql.shuffle.partitions": "17",
            "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        r = compare(spark, sf_small, name, E.queries()[name], E.oracle_sql().get(name), duck(sf_small))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert r["status"] == "OK", r


def test_hot_key_group_position(spark):
    # one key holds a third of all rows: ranks are still exact and the work is spread by range buckets
    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("g"),
                                      F.col("id").alias("row_id"))
    gp = W.group_position(df, "g", "row_id", "rk", n_buckets=16)
    hot = gp.filter("g = 0")
    assert sorted(r.rk for r in hot.collect()) == list(range(1, 1001))
    # the hot group is spread over several numbering buckets (several window tasks)
    b = W.range_buckets(df, ["g", "row_id"], 16, "_b").filter("g = 0").select("_b").distinct().count()
    assert b >= 4


def test_numbering_computes_its_input_once(spark):
    """Branches and re-reads of a numbered table read what was written, whatever the input does."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    df = spark.range(0, 1000, 1, 7).mapInArrow(count, "id long")
    for buckets in (None, 9):
        seen.value = 0
        p = W.dense_position(df, "id", "p", n_buckets=buckets)
        assert p.join(p.withColumnRenamed("id", "other"), "p").filter("id = other AND id = p").count() == 1000
        assert seen.value == 1000


def test_long_text_keys_are_ordered_beyond_the_bound(spark):
    """Texts with a long common prefix share a bucket and are still in full order; text bounds are short."""
    rows = [("same " * 100 + f"{i * 37 % 101:03d}" if i % 2 else f"{i * 53 % 97:03d}é", i) for i in range(200)] + [(None, 500)]
    df = spark.createDataFrame(rows, "t string, id long").repartition(5)
    got = {r["id"]: r["p"] for r in W.dense_position(df, ["t", "id"], "p", n_buckets=8).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    assert [got[i] for _, i in order] == list(range(201))
    offs = W.segment_offsets(df.withColumn("k", F.lit(3)), "k", ["t", "id"]).collect()
    assert sorted(r["start"] for r in offs) == list(range(0, 603, 3))


def test_void_columns_and_empty_tables_are_numbered(spark):
    df = spark.range(0, 5).withColumn("nothing", F.lit(None))
    assert sorted(r["p"] for r in W.dense_position(df, "id", "p").collect()) == list(range(5))
    assert W.dense_position(df.limit(0), "id", "p").count() == 0
    assert L.holdout_split(df.limit(0), key="id").count() == 0
    with pytest.raises(ValueError):
        L.split_fixed(df, 5, key="id")
