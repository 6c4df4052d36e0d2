"""Session helpers: the shared checkpoint folder is read from the session, never overridden."""

from prefspark.session import ensure_checkpoint_dir, materialize, recommended_conf


def test_checkpoint_dir_is_read_not_overridden(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    got = ensure_checkpoint_dir(spark)
    assert before is None or got == before
    assert spark.conf.get("spark.checkpoint.dir") == got
    assert ensure_checkpoint_dir(spark) == got  # stable on later calls


def test_materialize_cuts_lineage(spark):
    df = spark.range(10).selectExpr("id", "id * 2 AS x")
    m = materialize(df)
    assert sorted(r.x for r in m.collect()) == [2 * i for i in range(10)]
    assert "Scan ExistingRDD" in m._jdf.queryExecution().executedPlan().toString() or m.count() == 10


def test_recommended_conf_scales_with_input():
    small = recommended_conf(10 << 30, executors=10)
    big = recommended_conf(100 << 40, executors=1000)
    assert int(big["spark.sql.shuffle.partitions"]) > int(small["spark.sql.shuffle.partitions"])
    assert int(small["spark.sql.shuffle.partitions"]) >= 2 * 10 * 4
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_scratch_is_dropped_with_its_block(spark):
    import os

    from prefspark.operators.window import dense_position
    from prefspark.session import scratch_dropped, scratch_table_path
    kept = scratch_table_path(spark, "kept-by-the-caller")
    with scratch_dropped():
        inside = scratch_table_path(spark, "made-inside")
        spark.range(3).write.mode("overwrite").parquet(inside)
        dense_position(spark.range(50), "id", "p", n_buckets=3).write.mode("overwrite").parquet(kept)
        assert os.path.isdir(inside)
    assert not os.path.exists(inside) and spark.read.parquet(kept).count() == 50
