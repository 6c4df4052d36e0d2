"""Runtime assertions of the reference become errors here."""

import pytest
from pyspark.sql import functions as F

from prefspark.operators import aggregate as G
from prefspark.operators import project as P
from prefspark.operators import select as L
from prefspark.operators import window as W


def test_whiten_needs_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(3)], "x double")
    with pytest.raises(Exception):
        G.whiten(df, "x").collect()


def test_split_fixed_too_large(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "cmp_id long")
    with pytest.raises(Exception):
        L.split_fixed(df, 5).collect()


def test_flatten_separator_in_name(spark):
    df = spark.createDataFrame([((1, 2),)], "s struct<`a.b`: int, c: int>")
    with pytest.raises(ValueError):
        P.flatten_struct(df, ".")


def test_pack_batches_placeholder_count(spark):
    df = spark.createDataFrame([(0, "x")], "row_id int, instruction string")
    with pytest.raises(ValueError):
        W.pack_batches(df, 2, "{instruction}", ["instruction"], order="row_id")


def test_rebase_out_of_range(spark):
    df = spark.createDataFrame([(0,), (1,), (9,)], "uid long")
    got = [r.uid for r in P.rebase_uid(df, n_users=8).collect()]
    assert got == [None, 0, None]
