"""Deterministic fixture views over the driver tables (FIXTURES.md part B).

Each ``fN_*`` builds the view with the DataFrame API from the parquet tables
in ``sf_dir``; ``SQL_*`` holds the same view as a DuckDB/ANSI CTE so the
oracle queries see identical rows.  Nothing is materialised: the fixture is
part of the query plan, so Catalyst prunes its columns and pushes filters
into the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------------------
# F1 comparisons: summary comparisons from events x documents
# --------------------------------------------------------------------------
SQL_F1 = """
f1_n AS (SELECT CAST(floor(count(*)/2) AS BIGINT) AS n_pairs FROM documents),
f1_e AS (SELECT event_id AS cmp_id, user_id AS worker, event_id % n_pairs AS pair_no,
             CASE WHEN event_type IN ('purchase','click') THEN 0 ELSE 1 END AS choice,
             CASE WHEN CAST(floor(event_id / n_pairs) AS BIGINT) % 10 = 0
                  THEN 'validation' ELSE 'train' END AS split
      FROM events CROSS JOIN f1_n),
comparisons AS (SELECT e.cmp_id, e.worker, e.pair_no,
             'Compare pair ' || CAST(e.pair_no AS VARCHAR) AS prompt,
             a.text AS text_0,
             CASE WHEN e.pair_no % 50 = 7 THEN a.text ELSE b.text END AS text_1, e.choice, e.split
      FROM f1_e e JOIN documents a ON a.doc_id = 2*e.pair_no
             JOIN documents b ON b.doc_id = 2*e.pair_no + 1)
"""


def f1_comparisons(spark: SparkSession, sf_dir: str, of_text: dict | None = None) -> DataFrame:
    """(cmp_id, worker, pair_no, prompt, text_0, text_1, choice, split); for every (name, function of a text) of ``of_text``
    also name_0 and name_1, computed once per document.

    The two texts of a pair meet first, so a text is moved once per document and not once per comparison.
    """
    of_text = of_text or {}
    docs = table(spark, sf_dir, "documents")
    # uncorrelated scalar sub-query: evaluated once, no driver round trip
    n_pairs = docs.select(F.floor(F.count(F.lit(1)) / 2).cast("long")).scalar()
    ev = table(spark, sf_dir, "events")
    e = ev.select(
        F.col("event_id").alias("cmp_id"),
        F.col("user_id").alias("worker"),
        (F.col("event_id") % n_pairs).alias("pair_no"),
        F.when(F.col("event_type").isin("purchase", "click"), 0).otherwise(1).alias("choice"),
        F.when(F.floor(F.col("event_id") / n_pairs).cast("long") % 10 == 0, "validation")
         .otherwise("train").alias("split"))

    def side(k):
        return docs.filter(F.pmod("doc_id", F.lit(2)) == k).select(
            F.expr(f"(doc_id - {k}) div 2").alias("pair_no"), F.col("text").alias(f"_text_{k}"),
            *[f(F.col("text")).alias(f"_{c}_{k}") for c, f in of_text.items()])
    second = lambda c: F.when(F.col("pair_no") % 50 == 7, F.col(f"_{c}_0")).otherwise(F.col(f"_{c}_1")).alias(f"{c}_1")
    pairs = side(0).join(side(1), "pair_no").select(
        "pair_no", *[x for c in ["text", *of_text] for x in (F.col(f"_{c}_0").alias(f"{c}_0"), second(c))])
    return e.join(pairs, "pair_no").select(
        "cmp_id", "worker", "pair_no",
        F.concat(F.lit("Compare pair "), F.col("pair_no").cast("string")).alias("prompt"),
        "text_0", "text_1", "choice", "split", *[f"{c}_{k}" for c in of_text for k in (0, 1)])


def f1_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 in the nested raw shape: ``summaries`` array of two structs."""
    c = f1_comparisons(spark, sf_dir)
    return c.select(
        "cmp_id", "worker", "pair_no", "choice", "split",
        F.struct(F.col("prompt").alias("post"), F.lit(None).cast("string").alias("article"),
                 F.concat(F.lit("pair "), F.col("pair_no").cast("string")).alias("title"),
                 F.lit("tldr").alias("subreddit")).alias("info"),
        F.array(F.struct(F.col("text_0").alias("text"), F.lit("sup1").alias("policy")),
                F.struct(F.col("text_1").alias("text"), F.lit("sup2").alias("policy"))).alias("summaries"))


# --------------------------------------------------------------------------
# F2 ratings / F3 scored: from lineitem with a stable position per order
# --------------------------------------------------------------------------
SQL_LI = """
li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber,
         l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS completion_no FROM lineitem)
"""

SQL_F2 = SQL_LI + """,
ratings AS (SELECT l_orderkey AS instruction_id, CAST(completion_no AS INTEGER) AS completion_no,
  'resp ' || CAST(l_partkey AS VARCHAR) AS response,
  CASE WHEN l_partkey % 40 = 0 THEN 'N/A' ELSE CAST(CAST(l_quantity AS INT) % 5 + 1 AS VARCHAR) END AS helpfulness,
  CAST(CAST(round(l_discount*100) AS INT) % 5 + 1 AS VARCHAR) AS honesty,
  CAST(CAST(round(l_tax*100) AS INT) % 5 + 1 AS VARCHAR) AS instruction_following,
  CAST(l_suppkey % 5 + 1 AS VARCHAR) AS truthfulness FROM li)
"""

SQL_F3 = SQL_LI + """,
scored AS (SELECT l_orderkey AS traj_id, CAST(completion_no AS INTEGER) AS pos, CAST(1 + l_suppkey % 8 AS INT) AS uid,
  CAST(l_partkey % 23 AS INT) AS subset_no, round(l_discount*100) AS reward_chosen,
  round(l_tax*100) AS reward_rejected FROM li)
"""


def _lineitem_positions(spark: SparkSession, sf_dir: str, cols: list[str]) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    order = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_shipdate"]
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    keep = sorted(set(cols) | set(order) | {"l_orderkey"})
    return li.select(*keep).withColumn("completion_no", F.row_number().over(w))


def f2_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instruction_id, completion_no, response, helpfulness, honesty, instruction_following, truthfulness)."""
    li = _lineitem_positions(spark, sf_dir, [])
    return li.select(
        F.col("l_orderkey").alias("instruction_id"),
        F.col("completion_no").cast("int").alias("completion_no"),
        F.concat(F.lit("resp "), F.col("l_partkey").cast("string")).alias("response"),
        F.when(F.col("l_partkey") % 40 == 0, F.lit("N/A"))
         .otherwise((F.col("l_quantity").cast("int") % 5 + 1).cast("string")).alias("helpfulness"),
        (F.round(F.col("l_discount") * 100).cast("int") % 5 + 1).cast("string").alias("honesty"),
        (F.round(F.col("l_tax") * 100).cast("int") % 5 + 1).cast("string").alias("instruction_following"),
        (F.col("l_suppkey") % 5 + 1).cast("string").alias("truthfulness"))


def f3_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(traj_id, pos, uid, subset_no, reward_chosen, reward_rejected)."""
    li = _lineitem_positions(spark, sf_dir, [])
    return li.select(
        F.col("l_orderkey").alias("traj_id"),
        F.col("completion_no").cast("int").alias("pos"),
        (1 + F.col("l_suppkey") % 8).cast("int").alias("uid"),
        (F.col("l_partkey") % 23).cast("int").alias("subset_no"),
        F.round(F.col("l_discount") * 100).alias("reward_chosen"),
        F.round(F.col("l_tax") * 100).alias("reward_rejected"))


# --------------------------------------------------------------------------
# F4 embeddings (as is) / F5 judged pairs / F7 dialogs
# --------------------------------------------------------------------------
def f4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


SQL_F5 = """
h2h AS (SELECT event_id, user_id, CAST(floor(value) AS INT) % 5 AS preference,
               CAST(1 + event_id % 2 AS INT) AS label FROM events)
"""


def f5_h2h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, preference 0..4, label 1|2)."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "user_id",
                     (F.floor("value").cast("int") % 5).alias("preference"),
                     (1 + F.col("event_id") % 2).cast("int").alias("label"))


def f7_dialogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


# --------------------------------------------------------------------------
# F9 outputs: model outputs per instruction (for annotation / head-to-head)
# --------------------------------------------------------------------------
SQL_F9 = """
outputs AS (SELECT 'instruction ' || CAST(conv_id AS VARCHAR) AS instruction,
                   CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'input ' || CAST(conv_id % 7 AS VARCHAR) END AS input,
                   text AS output, 'gen' || CAST(turn % 3 AS VARCHAR) AS generator,
                   conv_id, turn
            FROM conversations WHERE role <> 'system')
"""


def f9_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instruction, input, output, generator, conv_id, turn): outputs of three generators."""
    cv = table(spark, sf_dir, "conversations")
    return cv.filter(F.col("role") != "system").select(
        F.concat(F.lit("instruction "), F.col("conv_id").cast("string")).alias("instruction"),
        F.when(F.col("conv_id") % 3 == 0, F.lit(""))
         .otherwise(F.concat(F.lit("input "), (F.col("conv_id") % 7).cast("string"))).alias("input"),
        F.col("text").alias("output"),
        F.concat(F.lit("gen"), (F.col("turn") % 3).cast("string")).alias("generator"),
        "conv_id", "turn")
