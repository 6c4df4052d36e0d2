"""Source/sink round trips: tables derived from the driver data are written to the shared
checkpoint folder with the sinks and read back with the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.random import seeded_uniform, sql_seeded_hash
from ..operators import select as L
from ..sources import readers as RD
from ..sources import writers as WR
from ..streaming.streams import scratch
from . import comparisons as CP
from . import fixtures as FX
from . import ratings as RT
from .registry import query, with_ctes


@query("s01_read_comparisons", with_ctes(FX.SQL_F1) + """
SELECT cmp_id, worker AS uid, pair_no FROM comparisons WHERE split = 'validation'""")
def s01(spark, sf):
    c = FX.f1_comparisons(spark, sf).select("cmp_id", F.col("worker").alias("uid"), "pair_no", "prompt", "split")
    path = scratch(spark, "comparisons")
    c.write.mode("overwrite").partitionBy("split").parquet(path)
    schema = T.StructType([T.StructField("cmp_id", T.LongType()), T.StructField("uid", T.LongType()),
                           T.StructField("pair_no", T.LongType()), T.StructField("prompt", T.StringType()),
                           T.StructField("split", T.StringType())])
    return RD.read_comparisons(spark, path, "validation", schema).select("cmp_id", "uid", "pair_no")


SPLIT_SQL = f"CASE WHEN {sql_seeded_hash(8, 'pair_id')} / 1152921504606846976.0 < 0.1 THEN 'test' ELSE 'train' END"


@query("s08_write_user_partitions", with_ctes(FX.SQL_F2, RT.BIN_SQL, RT.MATCH_SQL, RT.LAB_SQL, RT.TYPED_SQL) + f"""
SELECT data_subset, {SPLIT_SQL} AS split, count(*) AS n FROM typed GROUP BY 1, 2""")
def s08(spark, sf):
    t = RT.typed(spark, sf).withColumn("split", F.when(seeded_uniform(8, "pair_id") < 0.1, "test").otherwise("train"))
    root = scratch(spark, "user-partitions")
    WR.write_user_partitions(t.select("pair_id", "prompt", "chosen", "rejected", "data_subset", "split"), root)
    back = RD.read_jsonl_by_subset(spark, root)
    return back.groupBy(F.col("data_subset").cast("string").alias("data_subset"), "split").agg(
        F.count(F.lit(1)).alias("n"))


@query("s02_read_jsonl_by_subset", with_ctes(FX.SQL_F2, RT.BIN_SQL, RT.MATCH_SQL, RT.LAB_SQL, RT.TYPED_SQL) + f"""
SELECT data_subset, pair_id FROM typed WHERE data_subset IN ('8', '2') AND {SPLIT_SQL} = 'train'""")
def s02(spark, sf):
    t = RT.typed(spark, sf).withColumn("split", F.when(seeded_uniform(8, "pair_id") < 0.1, "test").otherwise("train"))
    root = scratch(spark, "user-partitions")
    WR.write_user_partitions(t.select("pair_id", "data_subset", "split"), root)
    back = RD.read_jsonl_by_subset(spark, root, ["8", "2"], "train")
    return back.select(F.col("data_subset").cast("string").alias("data_subset"), "pair_id")


@query("s03_read_keyed_json", """
SELECT CAST(conv_id AS VARCHAR) AS id, count(*) AS n_turns, md5(string_agg(text, '|' ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id""")
def s03(spark, sf):
    cv = FX.f7_dialogs(spark, sf)
    dialogs = cv.groupBy("conv_id").agg(F.struct(
        F.lit("u").alias("user_id"),
        F.sort_array(F.collect_list(F.struct(F.col("turn").cast("int").alias("turn_nb"),
                                             F.array("text").alias("user_utterance")))).alias("turns")).alias("d"))
    # JSON objects of about 500 dialogs, keyed by dialog id: one folder (and so one file, one object) each
    objects = cv.select(F.ceil(F.countDistinct("conv_id") / 500)).scalar()
    obj = dialogs.groupBy(F.pmod(F.xxhash64("conv_id"), F.greatest(objects, F.lit(1))).alias("_b")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("conv_id").cast("string"), F.col("d"))))).alias("v"))
    path = scratch(spark, "keyed-json")
    obj.write.mode("overwrite").partitionBy("_b").text(path)
    schema = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("turns", T.ArrayType(
        T.StructType([T.StructField("turn_nb", T.IntegerType()),
                      T.StructField("user_utterance", T.ArrayType(T.StringType()))])))])
    back = RD.read_keyed_json(spark, path, schema)
    texts = F.transform("turns", lambda t: F.array_join(t["user_utterance"], "|"))
    return back.select("id", F.size("turns").cast("long").alias("n_turns"), F.md5(F.array_join(texts, "|")).alias("text_md5"))


@query("s04_read_lookup", with_ctes(FX.SQL_F1, CP.NORM_SQL, CP.TOP5_SQL) + """
SELECT CAST(worker AS VARCHAR) AS worker, uid, CAST(worker % 2 AS VARCHAR) AS preference FROM top5""")
def s04(spark, sf):
    _, top = CP.top5_train(spark, sf)
    lines = top.select(F.concat_ws(" ", F.col("worker").cast("string"), (F.col("worker") % 2).cast("string")).alias("l"),
                       "uid")
    path = scratch(spark, "lookup")
    # a k-row list in rank order, one file
    lines.coalesce(1).sortWithinPartitions("uid").select("l").write.mode("overwrite").text(path)
    return RD.read_lookup(spark, path, "worker", "preference").select("worker", "uid", "preference")


@query("s05_read_saved", with_ctes(FX.SQL_F3) + """
SELECT traj_id, pos, uid FROM scored""")
def s05(spark, sf):
    path = scratch(spark, "saved")
    FX.f3_scored(spark, sf).write.mode("overwrite").parquet(path)
    return RD.read_saved(spark, path).select("traj_id", "pos", "uid")


@query("s06_read_prompts", """
SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS prompt_id, md5(text) AS prompt_md5 FROM conversations WHERE role = 'user'""")
def s06(spark, sf):
    cv = FX.f7_dialogs(spark, sf).filter(F.col("role") == "user")
    path = scratch(spark, "prompts")
    cv.select(F.concat_ws("_", "conv_id", "turn").alias("prompt_id"), F.col("text").alias("prompt")) \
        .write.mode("overwrite").json(path)
    p = RD.read_prompts(spark, path)
    return p.select("prompt_id", F.md5("prompt").alias("prompt_md5"))


@query("s09_write_if_absent", """
SELECT count(*) AS n, sum(quality) AS quality_sum FROM labels""")
def s09(spark, sf):
    lab = FX.table(spark, sf, "labels")
    path = scratch(spark, "if-absent")
    WR.write_if_absent(lab, path)
    WR.write_if_absent(lab.limit(1), path)  # second call must not touch the table
    back = spark.read.parquet(path)
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("quality_sum"))


@query("s10_write_report_csv", with_ctes(FX.SQL_F3) + """
SELECT CAST(uid AS VARCHAR) AS uid, CAST(count(*) AS VARCHAR) AS n FROM scored GROUP BY uid""")
def s10(spark, sf):
    rep = FX.f3_scored(spark, sf).groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    path = scratch(spark, "report-csv")
    WR.write_report_csv(rep, path)
    return spark.read.option("header", True).csv(path).select("uid", "n")


@query("s11_annotation_store", """
SELECT DISTINCT 'instruction ' || CAST(conv_id AS VARCHAR) AS instruction, md5(text) AS output_md5 FROM conversations
  WHERE role <> 'system'""")
def s11(spark, sf):
    o = FX.f9_outputs(spark, sf)
    rows = o.select("instruction", "input", F.col("output").alias("output_1"), F.col("output").alias("output_2"),
                    F.lit("a1").alias("annotator"), F.lit(0).alias("preference"),
                    F.lit(False).alias("is_noisy_label"))
    store = WR.AnnotationStore(spark, scratch(spark, "annotations"))
    store.save(rows)
    merged = store.save(rows)  # saving the same rows again keeps the store unique on its keys
    return merged.select("instruction", F.md5("output_1").alias("output_md5"))


@query("s12_write_generations", """
SELECT count(*) AS n, sum(length(text)) AS total_length FROM conversations WHERE role = 'assistant'""")
def s12(spark, sf):
    cv = FX.f7_dialogs(spark, sf).filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("output"))
    path = scratch(spark, "generations")
    WR.write_generations(cv, path)
    back = spark.read.json(path)
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum("output_length").alias("total_length"))


@query("s13_eval_prompt_table", """
SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS prompt_id, md5(text) AS text_md5 FROM conversations""")
def s13(spark, sf):
    cv = FX.f7_dialogs(spark, sf).select(F.concat_ws("_", "conv_id", "turn").alias("prompt_id"), "text")
    path = scratch(spark, "eval-prompts")
    WR.eval_prompt_table(cv, path)
    return spark.read.parquet(path).select("prompt_id", F.md5("text").alias("text_md5"))


@query("s14_cache_embeddings", """
SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 6) AS first_dim FROM embeddings""")
def s14(spark, sf):
    e = FX.f4_embeddings(spark, sf)
    root = scratch(spark, "emb-cache")
    first = WR.cache_embeddings(e, root, "test")
    again = WR.cache_embeddings(e.limit(0), root, "test")  # reused, not rewritten
    return again.select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_dim"))
