"""Sources and sinks round trips on scratch folders."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.sources import readers as RD
from prefspark.sources import writers as WR


def _tmp():
    return tempfile.mkdtemp(prefix="src-", dir="/tmp")


def test_read_comparisons_schema_and_split(spark):
    d = os.path.join(_tmp(), "cmp")
    df = spark.createDataFrame([(1, 1, "p", "a", "b", "a", "b", "train"), (2, 2, "p", "a", "b", "a", "b", "test")],
                               "cmp_id long, uid long, prompt string, chosen string, rejected string, "
                               "chosen_only string, rejected_only string, split string")
    df.write.partitionBy("split").parquet(d)
    from prefspark.schemas import COMPARISON
    got = RD.read_comparisons(spark, d, "test", COMPARISON).collect()
    assert [r.cmp_id for r in got] == [2]
    from prefspark.schemas import check_columns
    narrow = RD.read_comparisons(spark, d, None, T.StructType([T.StructField("cmp_id", T.LongType())]))
    with pytest.raises(ValueError):
        check_columns(narrow, [f.name for f in COMPARISON.fields])  # fails at planning, no job


def test_read_lookup_numbering(spark):
    d = _tmp()
    with open(os.path.join(d, "workers.txt"), "w") as f:
        f.write("w9 1\nw3 0\n\nw7 1\n")
    got = [(r.worker, r.uid, r.preference) for r in RD.read_lookup(spark, d, "worker", "preference").orderBy("uid").collect()]
    assert got == [("w9", 1, "1"), ("w3", 2, "0"), ("w7", 3, "1")]


def test_write_if_absent_skips(spark):
    d = os.path.join(_tmp(), "t")
    assert WR.write_if_absent(spark.range(3), d) is True
    assert WR.write_if_absent(spark.range(10), d) is False
    assert spark.read.parquet(d).count() == 3


def test_keyed_json_and_prompts(spark):
    d = _tmp()
    with open(os.path.join(d, "dialogs.json"), "w") as f:
        f.write('{"d1": {"user_id": "u1", "turns": [{"turn_nb": 0}]}, "d2": {"user_id": "u2", "turns": []}}')
    schema = T.StructType([T.StructField("user_id", T.StringType()),
                           T.StructField("turns", T.ArrayType(T.StructType([T.StructField("turn_nb", T.IntegerType())])))])
    got = sorted((r.id, r.user_id, len(r.turns)) for r in RD.read_keyed_json(spark, d, schema).collect())
    assert got == [("d1", "u1", 1), ("d2", "u2", 0)]
    p = _tmp()
    with open(os.path.join(p, "prompts.json"), "w") as f:
        f.write('["a", "b", "c"]')
    got = [(r.prompt_id, r.prompt) for r in RD.read_prompts(spark, p, "json_list").orderBy("prompt_id").collect()]
    assert got == [(0, "a"), (1, "b"), (2, "c")]


def test_user_partitions_prune(spark):
    d = os.path.join(_tmp(), "parts")
    df = spark.createDataFrame([(i, str(8 >> (i % 4)), "train" if i % 3 else "test") for i in range(40)],
                               "pair_id long, data_subset string, split string")
    WR.write_user_partitions(df, d)
    back = RD.read_jsonl_by_subset(spark, d, ["8"], "train")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "partition" in plan.lower()
    assert back.count() == df.filter("data_subset = '8' AND split = 'train'").count()


def test_annotation_store_unique(spark):
    store = WR.AnnotationStore(spark, os.path.join(_tmp(), "store"), keys=["k"])
    assert store.load() is None
    store.save(spark.createDataFrame([("a", 1, False), ("b", 2, True)], "k string, preference int, is_noisy_label boolean"))
    merged = store.save(spark.createDataFrame([("a", 2, False), ("c", 1, False)], "k string, preference int, is_noisy_label boolean"))
    assert sorted((r.k, r.preference) for r in merged.collect()) == [("a", 1), ("c", 1)]


def test_as_frame(spark):
    import pandas as pd
    df = RD.as_frame(spark, [("x", 1)], "a string, b long")
    assert RD.as_frame(spark, df) is df
    assert RD.as_frame(spark, pd.DataFrame({"a": ["y"], "b": [2]})).count() == 1


def test_json_members_over_blocks(spark, tmp_path):
    """Objects and lists that span many byte blocks: members as a JSON parser gives them, whatever their strings hold."""
    import json
    import random

    from prefspark.sources.json_members import json_members
    rnd = random.Random(3)
    odd = ['a,b', '{', '}', '[', '"', '\\', '\\"', 'é,漢', '\n', ':', '":', '', 'x' * 300, '\\\\,', '{"k": [1, 2]}', "\u0001", " "]

    def value(d):
        k = rnd.randrange(6)
        if k < 2 or d > 3:
            return rnd.choice(odd)
        return rnd.choice([1, -2.5, None, True]) if k == 2 else [value(d + 1) for _ in range(rnd.randrange(4))] if k == 3 \
            else {rnd.choice(odd) + str(i): value(d + 1) for i in range(rnd.randrange(4))}
    objects = {"a.json": {rnd.choice(odd) + str(i): value(0) for i in range(400)}, "b.json": {}, "c.json": {"one": "x,y"}}
    lists = {"a.json": [value(0) for _ in range(300)], "b.json": [], "c.json": ["x,y"]}
    for folder, data in (("obj", objects), ("list", lists)):
        (tmp_path / folder).mkdir()
        for i, (name, x) in enumerate(data.items()):
            (tmp_path / folder / name).write_text(json.dumps(x, ensure_ascii=i == 2, indent=[None, 2, None][i]) + "\n" * i, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("997", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = json_members(spark, str(tmp_path / "obj")).collect()
            assert {(os.path.basename(r.file), r.key): json.loads(r.value) for r in got} == {(f, k): v for f, x in objects.items() for k, v in x.items()}
            assert len(got) == sum(map(len, objects.values()))
            got = json_members(spark, str(tmp_path / "list"), keyed=False).orderBy("file", "place").collect()
            assert [json.loads(r.value) for r in got] == [v for x in lists.values() for v in x]
            assert [r.place for r in got][:300] == list(range(300))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
