"""Queries over F1 comparisons: normalisation, users, majority vote, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as G
from ..operators import joins as J
from ..operators import project as P
from ..operators import select as L
from ..operators import sets as U
from ..operators import window as W
from ..functions import text as T
from ..functions.random import sql_seeded_hash
from ..session import materialize
from . import fixtures as FX
from .registry import query, with_ctes

NORM_SQL = """
norm AS (SELECT cmp_id, worker, pair_no, prompt,
                CASE WHEN choice = 0 THEN text_0 ELSE text_1 END AS chosen_only,
                CASE WHEN choice = 0 THEN text_1 ELSE text_0 END AS rejected_only, split
         FROM comparisons WHERE text_0 <> text_1)
"""

TOP5_SQL = """
wc AS (SELECT worker, count(*) AS n, min(cmp_id) AS first_id FROM norm WHERE split = 'train' GROUP BY worker),
top5 AS (SELECT worker, n, first_id, row_number() OVER (ORDER BY n DESC, first_id) AS uid
         FROM wc ORDER BY n DESC, first_id LIMIT 5)
"""


def normalized(spark: SparkSession, sf: str, of_text: dict | None = None) -> DataFrame:
    """F1 -> P03 -> P01: (cmp_id, worker, pair_no, prompt, chosen_only, rejected_only, split), and chosen_<name> and
    rejected_<name> of every name of ``of_text``.  Which side is chosen does not matter to P03, so it
    looks at a pair once, before the comparisons join it."""
    c = FX.f1_comparisons(spark, sf, of_text)
    c = P.drop_identical(c, "text_0", "text_1")
    c = P.pick_choice_flat(c)
    more = []
    for name in of_text or {}:
        c = P.pick_choice_flat(c, f"{name}_0", f"{name}_1", chosen=f"chosen_{name}", rejected=f"rejected_{name}")
        more += [f"chosen_{name}", f"rejected_{name}"]
    return c.select("cmp_id", "worker", "pair_no", "prompt", "chosen_only", "rejected_only", "split", *more)


def top5_train(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n = normalized(spark, sf)
    top = L.top_workers(n.filter(F.col("split") == "train"), k=5)
    return n, top


def md5(c: str, out: str | None = None):
    return F.md5(F.col(c)).alias(out or f"{c}_md5")


# ---------------------------------------------------------------- P01 / P03 / P04
@query("p01_pick_choice", with_ctes(FX.SQL_F1) + """
SELECT cmp_id, md5(CASE WHEN choice = 0 THEN text_0 ELSE text_1 END) AS chosen_only_md5,
       md5(CASE WHEN choice = 0 THEN text_1 ELSE text_0 END) AS rejected_only_md5 FROM comparisons""")
def p01(spark, sf):
    d = P.pick_choice(FX.f1_summaries(spark, sf))
    return d.select("cmp_id", md5("chosen_only"), md5("rejected_only"))


@query("p03_drop_identical", with_ctes(FX.SQL_F1) + """
SELECT cmp_id, pair_no FROM comparisons WHERE text_0 <> text_1""")
def p03(spark, sf):
    return P.drop_identical(FX.f1_comparisons(spark, sf), "text_0", "text_1").select("cmp_id", "pair_no")


@query("p04_drop_missing", with_ctes(FX.SQL_F1) + """
SELECT cmp_id FROM comparisons WHERE prompt IS NOT NULL AND text_0 IS NOT NULL AND text_1 IS NOT NULL""")
def p04(spark, sf):
    d = FX.f1_summaries(spark, sf).withColumn("text_0", F.col("summaries")[0]["text"]) \
        .withColumn("text_1", F.col("summaries")[1]["text"])
    return P.drop_missing(d, ["info.post", "text_0", "text_1"]).select("cmp_id")


@query("p05_for_user", with_ctes(FX.SQL_F1) + """
SELECT cmp_id FROM (SELECT * FROM comparisons ORDER BY cmp_id LIMIT 5000) h WHERE worker = 7""")
def p05(spark, sf):
    c = FX.f1_comparisons(spark, sf)
    return P.load_for_user(c, 5000, 7, col="worker").select("cmp_id")


@query("p07_all_summaries_match", with_ctes(FX.SQL_F1) + """
SELECT cmp_id FROM comparisons""")
def p07(spark, sf):
    return P.all_summaries_match(FX.f1_summaries(spark, sf), must="sup").select("cmp_id")


@query("p08_max_text_length", with_ctes(FX.SQL_F1, NORM_SQL) + """
SELECT cmp_id FROM norm
WHERE length(prompt) + length(chosen_only) <= 3000 AND length(prompt) + length(rejected_only) <= 3000""")
def p08(spark, sf):
    return P.max_text_length(normalized(spark, sf), 3000, chosen="chosen_only",
                             rejected="rejected_only").select("cmp_id")


@query("p09_max_token_length", with_ctes(FX.SQL_F1, NORM_SQL) + """
SELECT cmp_id FROM norm
WHERE len(regexp_extract_all(chosen_only, '\\S+')) <= 400 AND len(regexp_extract_all(rejected_only, '\\S+')) <= 400""")
def p09(spark, sf):
    n = normalized(spark, sf, {"tokens": T.word_count})
    return P.max_token_length(n, 400, ("chosen_tokens", "rejected_tokens"), P.counted).select("cmp_id")


def _words(c: str) -> str:
    return f"coalesce(len(regexp_extract_all({c}, '\\S+')), 0)"


@query("p09_max_token_length_contexts", with_ctes(FX.SQL_F1, NORM_SQL) + f"""
, tx AS (SELECT cmp_id, md5(prompt) AS ph, greatest({_words("chosen_only")}, {_words("rejected_only")}) AS w FROM norm),
pool AS (SELECT cmp_id, ph, w, row_number() OVER (ORDER BY ph, cmp_id) - 1 AS pidx, count(*) OVER () AS m FROM tx),
span AS (SELECT ph, min(pidx) AS lo, count(*) AS len FROM pool GROUP BY ph),
draws AS (SELECT tx.cmp_id, lo, len, {sql_seeded_hash(9, 'tx.cmp_id', 'r.d')} % ((SELECT max(m) FROM pool) - len) AS p FROM tx JOIN span ON tx.ph = span.ph, range(0, 3) r(d)),
most AS (SELECT d.cmp_id, max(pool.w) AS w FROM draws d JOIN pool ON pool.pidx = CASE WHEN p >= lo THEN p + len ELSE p END GROUP BY d.cmp_id)
SELECT tx.cmp_id, greatest(tx.w, most.w) AS max_length FROM tx JOIN most USING (cmp_id) WHERE greatest(tx.w, most.w) <= 400""".replace("\n, tx AS", ", tx AS", 1))
def p09_contexts(spark, sf):
    # the drawn rows bring their token counts, not their texts
    sides = ("chosen_tokens", "rejected_tokens")
    n = materialize(normalized(spark, sf, {"tokens": T.word_count}).select("cmp_id", "prompt", *sides))
    rows = L.random_contexts(n, n, n=3, seed=9, key="cmp_id", fields=sides)
    kept = P.max_token_length(rows, 400, sides, P.counted, contexts="contexts", context_cols=sides)
    most = P.largest_token_count(sides, P.counted, contexts="contexts", context_cols=sides)
    return kept.select("cmp_id", most.cast("long").alias("max_length"))


# ---------------------------------------------------------------- P10 / P14-P19
@query("p10_rename_roles", with_ctes(FX.SQL_F1, NORM_SQL) + """
SELECT cmp_id, md5(chosen_only) AS rejected_md5, md5(rejected_only) AS chosen_md5 FROM norm""")
def p10(spark, sf):
    d = P.rename_roles(normalized(spark, sf), {"chosen_only": "rejected", "rejected_only": "chosen"},
                       drop=["prompt"])
    return d.select("cmp_id", md5("chosen"), md5("rejected"))


@query("p14_prepend_user_id", with_ctes(FX.SQL_F1, NORM_SQL) + """
SELECT cmp_id, md5('User ID: ' || CAST(worker AS VARCHAR) || chr(10) || prompt) AS prompt_md5 FROM norm""")
def p14(spark, sf):
    d = P.prepend_user_id(normalized(spark, sf), uid="worker")
    return d.select("cmp_id", md5("prompt"))


@query("p15_plain_text_pair", with_ctes(FX.SQL_F1, NORM_SQL) + """
SELECT cmp_id, md5('Human: ' || prompt || chr(10) || 'Assistant: ' || chosen_only) AS chosen_md5,
       md5(prompt || chr(10) || rejected_only) AS rejected_md5 FROM norm""")
def p15(spark, sf):
    n = normalized(spark, sf).withColumnsRenamed({"chosen_only": "chosen", "rejected_only": "rejected"})
    a = P.plain_text_pair(n, sides=("chosen",), style="dialog")
    b = P.plain_text_pair(a, sides=("rejected",), style="summary")
    return b.select("cmp_id", md5("chosen"), md5("rejected"))


@query("p16_message_pair", with_ctes(FX.SQL_F1, NORM_SQL) + """
SELECT cmp_id, 2 AS n_messages, 'user' AS first_role, 'assistant' AS second_role,
       md5(chosen_only) AS reply_md5 FROM norm""")
def p16(spark, sf):
    n = normalized(spark, sf).withColumnRenamed("chosen_only", "chosen")
    m = P.message_pair(n, sides=("chosen",))
    return m.select("cmp_id", F.size("chosen").alias("n_messages"),
                    F.col("chosen")[0]["role"].alias("first_role"), F.col("chosen")[1]["role"].alias("second_role"),
                    F.md5(F.col("chosen")[1]["content"]).alias("reply_md5"))


@query("p17_user_prompt", with_ctes(FX.SQL_F1, NORM_SQL) + """
SELECT cmp_id, 'USER: ' || CAST(worker AS VARCHAR) || ' </s> </s> ASSISTANT: ' || prompt AS prompt FROM norm""")
def p17(spark, sf):
    d = P.user_prompt(normalized(spark, sf), uid="worker", sep="ASSISTANT:", n_tokens=2, eos="</s>", blanks=True)
    return d.select("cmp_id", "prompt")


@query("p18_parse_user_identifier", with_ctes(FX.SQL_F1, NORM_SQL) + """
SELECT cmp_id, worker AS uid FROM norm""")
def p18(spark, sf):
    d = P.user_prompt(normalized(spark, sf), uid="worker", sep="|", n_tokens=3, eos="<|endoftext|>")
    return P.parse_user_identifier(d, "prompt").select("cmp_id", "uid")


@query("p19_duplicate_generic", with_ctes(FX.SQL_F1, NORM_SQL) + """
SELECT cmp_id, u AS uid, CASE WHEN u = 0 THEN 'generic' ELSE 'individual' END AS user_kind
FROM (SELECT cmp_id, worker FROM norm WHERE split = 'train' AND worker <> 0) t,
     (SELECT unnest([1, 0]) AS k) k2, LATERAL (SELECT CASE WHEN k2.k = 1 THEN t.worker ELSE 0 END AS u) x""")
def p19(spark, sf):
    n = normalized(spark, sf).filter(F.col("split") == "train").select("cmp_id", F.col("worker").alias("uid"))
    return P.duplicate_generic(n, train=True).select("cmp_id", "uid", "user_kind")


@query("p20_length_preference", with_ctes(FX.SQL_F1) + """
SELECT cmp_id, CASE WHEN worker % 2 = 0 THEN (CASE WHEN length(text_1) > length(text_0) THEN 1 ELSE 0 END)
                    ELSE (CASE WHEN length(text_1) < length(text_0) THEN 1 ELSE 0 END) END AS choice
FROM comparisons""")
def p20(spark, sf):
    # a length is taken once a document: comparisons bring lengths, not texts
    c = FX.f1_comparisons(spark, sf, {"length": F.length})
    types = c.select("worker").distinct().withColumn("preference", (F.col("worker") % 2).cast("int"))
    return P.length_preference(c.drop("choice"), types, text0="length_0", text1="length_1", length=P.counted).select("cmp_id", "choice")


@query("p21_tldr_query", with_ctes(FX.SQL_F1) + """
SELECT cmp_id, 'SUBREDDIT: r/tldr' || chr(10) || 'TITLE: pair ' || CAST(pair_no AS VARCHAR) || chr(10) ||
       'POST: ' || prompt || chr(10) || 'TL;DR:' AS query FROM comparisons""")
def p21(spark, sf):
    return P.tldr_query(FX.f1_summaries(spark, sf)).select("cmp_id", "query")


@query("p22_paired_text", with_ctes(FX.SQL_F1, NORM_SQL) + """
SELECT cmp_id, md5('Prompt: ' || prompt || chr(10) || 'Chosen response: ' || chosen_only || chr(10) ||
                   'Rejected response: ' || rejected_only) AS paired_md5 FROM norm""")
def p22(spark, sf):
    d = P.paired_text(normalized(spark, sf), chosen="chosen_only", rejected="rejected_only")
    return d.select("cmp_id", F.md5("paired_text").alias("paired_md5"))


@query("p24_ab_position", with_ctes(FX.SQL_F1, NORM_SQL) + """
SELECT cmp_id, CASE WHEN CAST(('0x' || substr(md5(concat_ws(':', '11', CAST(cmp_id AS VARCHAR))), 1, 15)) AS BIGINT) % 2 = 0
                    THEN 'A' ELSE 'B' END AS answer FROM norm""")
def p24(spark, sf):
    n = normalized(spark, sf)
    return P.ab_position(n, 11, chosen="chosen_only", rejected="rejected_only").select("cmp_id", "answer")


# ---------------------------------------------------------------- L01 / L03 / L14
@query("l01_head", with_ctes(FX.SQL_F1) + """
SELECT cmp_id, worker FROM comparisons ORDER BY cmp_id LIMIT 1000""")
def l01(spark, sf):
    return L.head(FX.f1_comparisons(spark, sf).select("cmp_id", "worker"), 1000)


@query("l03_top_workers", with_ctes(FX.SQL_F1, NORM_SQL, TOP5_SQL) + """
SELECT worker, uid, n, first_id FROM top5""")
def l03(spark, sf):
    _, top = top5_train(spark, sf)
    return top.select("worker", "uid", "n", "first_id")


@query("l07_holdout_split", with_ctes(FX.SQL_F1) + """
SELECT cmp_id, row_number() OVER (ORDER BY CAST(('0x' || substr(md5(concat_ws(':', '3', CAST(cmp_id AS VARCHAR))), 1, 15)) AS BIGINT), cmp_id)
         <= floor(count(*) OVER () * 0.1) AS is_test FROM comparisons""")
def l07(spark, sf):
    return L.holdout_split(FX.f1_comparisons(spark, sf).select("cmp_id"), 0.1, seed=3).select("cmp_id", "is_test")


@query("l14_shuffle", with_ctes(FX.SQL_F1) + """
SELECT cmp_id, row_number() OVER (ORDER BY CAST(('0x' || substr(md5(concat_ws(':', '5', CAST(cmp_id AS VARCHAR))), 1, 15)) AS BIGINT), cmp_id) AS shuffled_pos
FROM comparisons""")
def l14(spark, sf):
    c = FX.f1_comparisons(spark, sf).select("cmp_id")
    from ..functions.random import seeded_hash
    return W.dense_position(c.withColumn("_h", seeded_hash(5, "cmp_id")), ["_h", "cmp_id"],
                            "shuffled_pos", base=1).drop("_h")


# ---------------------------------------------------------------- G03 / G05 / G14
MV_SQL = """
mv_in AS (SELECT n.* , t.uid FROM norm n JOIN top5 t ON n.worker = t.worker WHERE n.split = 'train'),
mv_votes AS (SELECT least(chosen_only, rejected_only) AS lo, greatest(chosen_only, rejected_only) AS hi,
                    chosen_only, count(*) AS n, min(cmp_id) AS first_id
             FROM mv_in GROUP BY 1, 2, 3),
mv_best AS (SELECT lo, hi, first_id, n, sum(n) OVER (PARTITION BY lo, hi) AS pair_votes,
                   row_number() OVER (PARTITION BY lo, hi ORDER BY n DESC, first_id) AS rk FROM mv_votes)
"""


@query("g03_majority_vote", with_ctes(FX.SQL_F1, NORM_SQL, TOP5_SQL, MV_SQL) + """
SELECT m.cmp_id, m.worker, m.uid, m.pair_no, b.n AS votes, b.pair_votes, md5(m.chosen_only) AS chosen_only_md5
FROM mv_best b JOIN mv_in m ON m.cmp_id = b.first_id WHERE b.rk = 1""")
def g03(spark, sf):
    n, top = top5_train(spark, sf)
    # the digest is taken before the vote, so the join back to the kept rows carries 32 bytes
    # instead of the texts (Catalyst prunes the texts from that branch)
    train = L.keep_top_workers(n.filter(F.col("split") == "train"), top).withColumn(
        "chosen_only_md5", F.md5("chosen_only"))
    v = G.majority_vote(train)
    return v.select("cmp_id", "worker", "uid", "pair_no", "votes", "pair_votes", "chosen_only_md5")


@query("g05_unordered_pair_key", with_ctes(FX.SQL_F1, NORM_SQL) + """
SELECT pair_no, md5(least(chosen_only, rejected_only)) AS lo_md5, md5(greatest(chosen_only, rejected_only)) AS hi_md5,
       count(*) AS n FROM norm GROUP BY 1, 2, 3""")
def g05(spark, sf):
    n = normalized(spark, sf)
    lo, hi = G.unordered_pair_key("chosen_only", "rejected_only")
    return (n.select("pair_no", F.md5(lo).alias("lo_md5"), F.md5(hi).alias("hi_md5"))
             .groupBy("pair_no", "lo_md5", "hi_md5").agg(F.count(F.lit(1)).alias("n")))


@query("g14_distinct_users", with_ctes(FX.SQL_F1) + """
SELECT split, count(DISTINCT worker) AS n_users FROM comparisons GROUP BY split""")
def g14(spark, sf):
    c = FX.f1_comparisons(spark, sf)
    return c.groupBy("split").agg(F.countDistinct("worker").alias("n_users"))


# ---------------------------------------------------------------- J05 / J06 / J07 / G04 / U05
NEW_USER = 7
AGREE_SQL = f"""
nu AS (SELECT * FROM norm WHERE split = 'train' AND worker = {NEW_USER}),
nu_keys AS (SELECT DISTINCT least(chosen_only, rejected_only) AS lo, greatest(chosen_only, rejected_only) AS hi FROM nu),
old AS (SELECT n.* FROM norm n WHERE n.split = 'train' AND n.worker <> {NEW_USER}
        AND EXISTS (SELECT 1 FROM nu_keys k WHERE k.lo = least(n.chosen_only, n.rejected_only)
                                            AND k.hi = greatest(n.chosen_only, n.rejected_only))),
nc AS (SELECT chosen_only AS t, count(*) AS m, min(cmp_id) AS first_new FROM nu GROUP BY 1),
ag AS (SELECT o.cmp_id, o.worker, coalesce(a.m, 0) AS agree, coalesce(d.m, 0) AS disagree, a.first_new
       FROM old o LEFT JOIN nc a ON a.t = o.chosen_only LEFT JOIN nc d ON d.t = o.rejected_only)
"""


@query("j05_others_on_same_pairs", with_ctes(FX.SQL_F1, NORM_SQL, AGREE_SQL) + """
SELECT cmp_id, worker FROM old""")
def j05(spark, sf):
    n = normalized(spark, sf).filter(F.col("split") == "train")
    return J.others_on_same_pairs(n, NEW_USER, uid="worker").select("cmp_id", "worker")


@query("j07_agreement_join", with_ctes(FX.SQL_F1, NORM_SQL, AGREE_SQL) + """
SELECT cmp_id, worker, agree, disagree FROM ag""")
def j07(spark, sf):
    n = normalized(spark, sf).filter(F.col("split") == "train")
    return J.agreement_join(n, NEW_USER, uid="worker").select("cmp_id", "worker", "agree", "disagree")


@query("g04_similar_user", with_ctes(FX.SQL_F1, NORM_SQL, AGREE_SQL, """
sc AS (SELECT worker, sum(agree) - sum(disagree) AS score,
              min(CASE WHEN agree > 0 THEN first_new * 10000000000 + cmp_id END) AS f FROM ag GROUP BY worker)""") + """
SELECT worker AS similar_uid, score FROM sc WHERE score > 0 ORDER BY score DESC, f LIMIT 1""")
def g04(spark, sf):
    n = normalized(spark, sf).filter(F.col("split") == "train")
    ag = J.agreement_join(n, NEW_USER, uid="worker")
    return G.similar_user(ag, other="worker")


@query("j06_lookup_user_id", with_ctes(FX.SQL_F1, NORM_SQL, TOP5_SQL) + """
SELECT n.cmp_id, coalesce(t.uid, 0) AS uid FROM norm n LEFT JOIN top5 t ON n.worker = t.worker""")
def j06(spark, sf):
    n, top = top5_train(spark, sf)
    return J.lookup_user_id(n, top.select("worker", "uid"), key="worker").select("cmp_id", "uid")


@query("u05_positive_counter_diff", with_ctes(FX.SQL_F1, NORM_SQL, """
a AS (SELECT worker, count(*) AS n FROM norm WHERE split = 'train' GROUP BY worker),
b AS (SELECT worker, count(*) AS n FROM norm WHERE split = 'validation' GROUP BY worker)""") + """
SELECT a.worker, a.n - coalesce(b.n, 0) AS n FROM a LEFT JOIN b ON a.worker = b.worker
WHERE a.n - coalesce(b.n, 0) > 0""")
def u05(spark, sf):
    n = normalized(spark, sf)
    a = n.filter(F.col("split") == "train").groupBy("worker").agg(F.count(F.lit(1)).alias("n"))
    b = n.filter(F.col("split") == "validation").groupBy("worker").agg(F.count(F.lit(1)).alias("n"))
    return U.positive_counter_diff(a, b, key="worker", count="n")


@query("u01_concat", with_ctes(FX.SQL_F1) + """
SELECT split, count(*) AS n FROM (SELECT cmp_id, split FROM comparisons WHERE split = 'train'
  UNION ALL SELECT cmp_id, split FROM comparisons WHERE split = 'validation') GROUP BY split""")
def u01(spark, sf):
    c = FX.f1_comparisons(spark, sf).select("cmp_id", "split")
    u = U.concat([c.filter(F.col("split") == "train"), c.filter(F.col("split") == "validation")])
    return u.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("w02_question_key", with_ctes(FX.SQL_F1) + """
SELECT cmp_id, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END, cmp_id) AS qkey
FROM comparisons""")
def w02(spark, sf):
    c = FX.f1_comparisons(spark, sf).select("cmp_id", "split")
    return W.question_key(c, split_order=("train", "validation")).select("cmp_id", "qkey")


@query("p13_add_index", with_ctes(FX.SQL_F1) + """
SELECT cmp_id, row_number() OVER (ORDER BY cmp_id) - 1 AS "Index" FROM comparisons""")
def p13(spark, sf):
    return P.add_index(FX.f1_comparisons(spark, sf).select("cmp_id")).select("cmp_id", "Index")


@query("l17_seeded_choice", with_ctes(FX.SQL_F1) + """
SELECT cmp_id, CASE WHEN u < 0.5 THEN 'annotator_a' WHEN u < 0.8 THEN 'annotator_b' ELSE 'annotator_c' END AS choice
FROM (SELECT cmp_id, CAST(('0x' || substr(md5(concat_ws(':', '9', CAST(cmp_id AS VARCHAR))), 1, 15)) AS BIGINT) / 1152921504606846976.0 AS u
      FROM comparisons)""")
def l17(spark, sf):
    c = FX.f1_comparisons(spark, sf).select("cmp_id")
    return L.seeded_choice(c, ["annotator_a", "annotator_b", "annotator_c"], [0.5, 0.3, 0.2], seed=9)
