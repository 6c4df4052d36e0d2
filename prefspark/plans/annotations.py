"""Queries over F9 model outputs: head-to-head pairs, the annotation job, batching, parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as LB
from ..functions.random import seeded_bit, sql_seeded_hash
from ..operators import aggregate as G
from ..operators import annotate as A
from ..operators import joins as J
from ..operators import project as P
from ..operators import sets as U
from ..operators import window as W
from ..session import materialize
from . import fixtures as FX
from .registry import query, with_ctes

U60 = "1152921504606846976.0"


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    return FX.f9_outputs(spark, sf)


def h2h_pairs(spark, sf) -> DataFrame:
    o = outputs(spark, sf)
    a = o.filter(F.col("generator") == "gen0")
    b = o.filter(F.col("generator") == "gen1")
    return J.head2head(a, b, ["instruction", "input"])


PAIRS_SQL = """
pairs AS (SELECT DISTINCT a.instruction, a.input, a.output AS output_1, b.output AS output_2
          FROM outputs a JOIN outputs b ON a.instruction = b.instruction AND a.input = b.input
          WHERE a.generator = 'gen0' AND b.generator = 'gen1')
"""
KEY_SQL = "concat_ws(':', instruction, input)"
ANN_SQL = f"""
ann AS (SELECT *, CASE WHEN {sql_seeded_hash(31, KEY_SQL)} / {U60} < 0.7 THEN 'a1' ELSE 'a2' END AS annotator FROM pairs),
store AS (SELECT instruction, input, output_1, output_2, annotator, 1 + length(output_2) % 2 AS preference,
                 'stored' AS chain_of_thoughts FROM ann WHERE length(output_1) % 3 = 0),
reused AS (SELECT a.*, s.preference, s.chain_of_thoughts FROM ann a LEFT JOIN store s
           ON a.instruction = s.instruction AND a.input = s.input AND a.output_1 = s.output_1
              AND a.output_2 = s.output_2 AND a.annotator = s.annotator),
noised AS (SELECT *, {sql_seeded_hash(41, KEY_SQL)} / {U60} < 0.2 AS is_noisy_label FROM reused),
labelled AS (SELECT instruction, input, output_1, output_2, annotator, is_noisy_label,
  CASE WHEN output_1 = output_2 THEN 0
       WHEN is_noisy_label THEN CAST({sql_seeded_hash(42, KEY_SQL)} % 2 + 1 AS INTEGER)
       WHEN preference IS NOT NULL THEN preference
       WHEN length(output_1) >= length(output_2) THEN 1 ELSE 2 END AS preference,
  preference IS NOT NULL AS reused FROM noised)
"""


def store_df(spark, sf):
    from ..functions.random import seeded_uniform, weighted_choice
    p = h2h_pairs(spark, sf)
    p = p.withColumn("annotator", weighted_choice(seeded_uniform(31, A.seed_key()), ["a1", "a2"], [0.7, 0.3]))
    return p.filter(F.length("output_1") % 3 == 0).select(
        *A.PAIR_KEYS, "annotator", (1 + F.length("output_2") % 2).cast("int").alias("preference"),
        F.lit("stored").alias("chain_of_thoughts"))


def md5s(df):
    return [F.md5("output_1").alias("output_1_md5"), F.md5("output_2").alias("output_2_md5")]


@query("j03_head2head", with_ctes(FX.SQL_F9, PAIRS_SQL) + """
SELECT instruction, input, md5(output_1) AS output_1_md5, md5(output_2) AS output_2_md5 FROM pairs""")
def j03(spark, sf):
    p = h2h_pairs(spark, sf)
    return p.select("instruction", "input", *md5s(p))


@query("g27_dedupe_pairs", with_ctes(FX.SQL_F9) + """
SELECT instruction, min(turn) AS turn, md5(output) AS output_md5 FROM outputs GROUP BY instruction, output""")
def g27(spark, sf):
    d = G.dedupe_pairs(outputs(spark, sf), ["instruction", "output"], order="turn")
    return d.select("instruction", "turn", F.md5("output").alias("output_md5"))


@query("w08_first_per_key", with_ctes(FX.SQL_F9) + """
SELECT instruction, min(turn) AS turn FROM outputs GROUP BY instruction""")
def w08(spark, sf):
    return W.first_per_key(outputs(spark, sf), ["instruction"], "turn").select("instruction", "turn")


@query("j04_reuse_annotations", with_ctes(FX.SQL_F9, PAIRS_SQL, ANN_SQL) + """
SELECT instruction, md5(output_1) AS output_1_md5, md5(output_2) AS output_2_md5, annotator, preference,
       chain_of_thoughts FROM reused""")
def j04(spark, sf):
    from ..functions.random import seeded_uniform, weighted_choice
    p = h2h_pairs(spark, sf)
    p = p.withColumn("annotator", weighted_choice(seeded_uniform(31, A.seed_key()), ["a1", "a2"], [0.7, 0.3]))
    r = J.reuse_annotations(p, store_df(spark, sf))
    return r.select("instruction", *md5s(r), "annotator", F.col("preference").cast("int").alias("preference"),
                    "chain_of_thoughts")


@query("x06_annotate_with", with_ctes(FX.SQL_F9, PAIRS_SQL, ANN_SQL) + """
SELECT instruction, md5(output_1) AS output_1_md5, md5(output_2) AS output_2_md5, annotator, preference,
       is_noisy_label FROM labelled""")
def x06(spark, sf):
    res, _ = A.annotate_with(h2h_pairs(spark, sf), store=store_df(spark, sf))
    return res.select("instruction", *md5s(res), "annotator", "preference", "is_noisy_label")


@query("u02_merge_store", with_ctes(FX.SQL_F9, PAIRS_SQL, ANN_SQL) + """
SELECT instruction, md5(output_1) AS output_1_md5, md5(output_2) AS output_2_md5, annotator, CAST(preference AS INTEGER) AS preference,
       true AS from_store FROM store
UNION ALL
SELECT instruction, md5(output_1), md5(output_2), annotator, preference, false FROM labelled WHERE NOT reused AND NOT is_noisy_label""")
def u02(spark, sf):
    _, st = A.annotate_with(h2h_pairs(spark, sf), store=store_df(spark, sf))
    return st.select("instruction", *md5s(st), "annotator", F.col("preference").cast("int").alias("preference"),
                     F.coalesce(F.col("chain_of_thoughts") == "stored", F.lit(False)).alias("from_store"))


@query("x07_annotate_samples", with_ctes(FX.SQL_F9, f"""
s AS (SELECT instruction, input, output, min(turn) AS turn FROM outputs GROUP BY instruction, input, output),
n AS (SELECT *, row_number() OVER (PARTITION BY instruction, input ORDER BY turn) - 1 AS sample_no FROM s),
h AS (SELECT *, instruction || ':' || input || ':' || CAST(sample_no AS VARCHAR) AS row_id FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY instruction, input ORDER BY {sql_seeded_hash(0, 'row_id')}, row_id) AS rk,
             count(*) OVER (PARTITION BY instruction, input) AS cnt FROM h),
pr AS (SELECT a.instruction, a.input, a.output AS output_1, b.output AS output_2, a.sample_no FROM o a JOIN o b
       ON a.instruction = b.instruction AND a.input = b.input AND b.rk = CASE WHEN a.rk < a.cnt THEN a.rk + 1 ELSE 1 END),
pairs AS (SELECT instruction, input, output_1, output_2 FROM pr WHERE sample_no = 0)""", ANN_SQL.replace(
    "WHERE length(output_1) % 3 = 0", "WHERE false")) + """
SELECT instruction, md5(output_1) AS output_1_md5, md5(output_2) AS output_2_md5, annotator, preference, is_noisy_label FROM labelled""")
def x07(spark, sf):
    o = outputs(spark, sf)
    g = o.groupBy("instruction", "input").agg(F.sort_array(F.collect_list(F.struct("turn", "output"))).alias("_s"))
    g = g.select("instruction", "input", F.transform("_s", lambda x: x["output"]).alias("outputs"))
    res, _ = A.annotate_samples(g)
    return res.select("instruction", *md5s(res), "annotator", "preference", "is_noisy_label")


# ---------------------------------------------------------------- W09 / F14 / F15 / P30
TEMPLATE = "## Example 1\nQ: {instruction}\nA: {output}\n## Example 2\nQ: {instruction}\nA: {output}\n" \
           "## Example 3\nQ: {instruction}\nA: {output}\n"
BATCH_SQL = """
b AS (SELECT instruction, output, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 3 AS batch_no,
             row_number() OVER (ORDER BY conv_id, turn) AS pos FROM outputs),
pk AS (SELECT batch_no, string_agg('## Example ' || CAST((pos - 1) % 3 + 1 AS VARCHAR) || chr(10) || 'Q: ' || instruction
                                   || chr(10) || 'A: ' || output || chr(10), '' ORDER BY pos) AS body,
              count(*) AS n, string_agg(CASE WHEN length(output) % 2 = 0 THEN '1' ELSE '2' END, ',' ORDER BY pos) AS labels
       FROM b GROUP BY batch_no)
"""


def batches(spark, sf):
    return W.pack_batches(outputs(spark, sf), 3, TEMPLATE, ["instruction", "output"], order=["conv_id", "turn"],
                          dummy={"instruction": "", "output": ""})


@query("w09_pack_batches", with_ctes(FX.SQL_F9, BATCH_SQL) + """
SELECT batch_no, md5(body || CASE WHEN n = 3 THEN '' WHEN n = 2 THEN '## Example 3' || chr(10) || 'Q: ' || chr(10) || 'A: ' || chr(10)
   ELSE '## Example 2' || chr(10) || 'Q: ' || chr(10) || 'A: ' || chr(10) || '## Example 3' || chr(10) || 'Q: ' || chr(10) || 'A: ' || chr(10) END)
   AS prompt_md5, 3 - n AS n_padded FROM pk""")
def w09(spark, sf):
    b = batches(spark, sf)
    return b.select("batch_no", F.md5("prompt").alias("prompt_md5"), F.col("n_padded").cast("long").alias("n_padded"))


PATTERNS = {"1": r"\n\(a\)", "2": r"\n\(b\)"}


def judged_batches(spark, sf):
    """A rule-based judge completion per batch: one ``(a)``/``(b)`` line per real example."""
    pos = W.dense_position(outputs(spark, sf), ["conv_id", "turn"], "_p")
    pos = pos.withColumn("batch_no", F.floor(F.col("_p") / 3).cast("long"))
    line = F.concat(F.lit("\n### Best output for example:"),
                    F.when(F.length("output") % 2 == 0, F.lit("\n(a)")).otherwise(F.lit("\n(b)")))
    return pos.groupBy("batch_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_p", line.alias("l")))),
                                                                lambda x: x["l"]), "").alias("completion"))


@query("f14_scan_matches", with_ctes(FX.SQL_F9, BATCH_SQL) + """
SELECT batch_no, labels FROM pk""")
def f14(spark, sf):
    j = judged_batches(spark, sf)
    return j.select("batch_no", F.array_join(LB.scan_matches(F.col("completion"), PATTERNS), ",").alias("labels"))


@query("f15_parse_judgement", with_ctes(FX.SQL_F9, BATCH_SQL) + """
SELECT batch_no, CASE WHEN n = 3 THEN labels END AS labels FROM pk""")
def f15(spark, sf):
    j = judged_batches(spark, sf)
    return j.select("batch_no", F.array_join(LB.parse_judgement(F.col("completion"), PATTERNS, 3), ",").alias("labels"))


JUDGE_TEMPLATE = "".join(f"## Example {k}\nQ: {{instruction}}\n# Output (a): {{output_1}}\n# Output (b): {{output_2}}\n" for k in (1, 2, 3))


def longer_is_better(batches, prompt: str = "prompt"):
    """A rule-based judge that sees only the prompt: for each example in it a line for the longer output, (a) on ties."""
    example = r"(?s)# Output \(a\): (.*?)\n# Output \(b\): (.*?)\n(?=## Example |$)"
    outs = F.arrays_zip(*[F.regexp_extract_all(prompt, F.lit(example), F.lit(i)).alias(k) for i, k in ((1, "a"), (2, "b"))])
    line = F.transform(outs, lambda x, i: F.concat(F.lit("\n### Best output for example "), (i + 1).cast("string"), F.lit(":\n"),
                                                  F.when(F.length(x["a"]) >= F.length(x["b"]), "(a)").otherwise("(b)")))
    return batches.withColumn("completion", F.array_join(line, ""))


@query("w09_judge_flow", with_ctes(FX.SQL_F9, PAIRS_SQL) + f"""
SELECT md5(instruction) AS instruction_md5, md5(output_1) AS output_1_md5, md5(output_2) AS output_2_md5, is_switched,
  CASE WHEN length(output_1) > length(output_2) OR (length(output_1) = length(output_2) AND NOT is_switched) THEN 1 ELSE 2 END AS preference
FROM (SELECT *, {sql_seeded_hash(17, 'instruction', 'output_1', 'output_2')} % 2 = 1 AS is_switched FROM pairs)""")
def w09_judge_flow(spark, sf):
    """The judge's way end to end: swap, pack, judge, parse, unpack, swap back (F12 -> W09 -> F15 -> unpack -> F12)."""
    keys = ["instruction", "output_1", "output_2"]
    p = materialize(h2h_pairs(spark, sf).withColumn("is_switched", seeded_bit(17, *keys) == 1))
    first, second = (F.when(F.col("is_switched"), F.col(a)).otherwise(F.col(b)) for a, b in (("output_2", "output_1"), ("output_1", "output_2")))
    shown = p.select("instruction", "is_switched", first.alias("output_1"), second.alias("output_2"))
    shown = materialize(W.dense_position(shown, keys, "row_id"))
    b = W.pack_batches(shown, 3, JUDGE_TEMPLATE, keys, order="row_id")
    b = longer_is_better(b)
    judged = W.unpack_batches(b.withColumn("labels", LB.parse_judgement(F.col("completion"), PATTERNS, 3)), 3)
    j = shown.join(judged.select(F.col("id").cast("long").alias("row_id"), F.col("label").cast("int").alias("label")), "row_id")
    back1, back2 = (F.when(F.col("is_switched"), F.col(a)).otherwise(F.col(b)) for a, b in (("output_2", "output_1"), ("output_1", "output_2")))
    return j.select(F.md5("instruction").alias("instruction_md5"), F.md5(back1).alias("output_1_md5"), F.md5(back2).alias("output_2_md5"),
                    "is_switched", LB.swap_preference(F.col("label"), F.col("is_switched")).alias("preference"))


@query("p30_format_prompt", with_ctes(FX.SQL_F9) + """
SELECT conv_id, turn, md5(CASE WHEN input IS NULL OR length(input) = 0 THEN 'Instruction: ' || instruction || chr(10) || 'Response: '
       ELSE 'Instruction: ' || instruction || chr(10) || 'Input: ' || input || chr(10) || 'Response: ' END || output || '</s>') AS prompt_md5
FROM outputs""")
def p30(spark, sf):
    o = outputs(spark, sf)
    f = P.format_prompt(o, "Instruction: {instruction}\nInput: {input}\nResponse: ",
                        "Instruction: {instruction}\nResponse: ", output="output", eos="</s>")
    return f.select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"))
