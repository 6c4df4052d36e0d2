"""Queries over F3 scored pairs / trajectories: accuracy, losses, top-k, rollouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.util import at

from ..functions import vectors as V
from ..operators import aggregate as G
from ..operators import select as L
from ..operators import window as W
from . import fixtures as FX
from .registry import query, with_ctes

R = 6  # decimals kept for double outputs (both engines round the same way)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return FX.f3_scored(spark, sf)


def rd(c, out: str):
    return F.round(c, R).alias(out)


SOFTPLUS_NEG_D = "(greatest(-(reward_chosen - reward_rejected), 0) + ln(1 + exp(-abs(reward_chosen - reward_rejected))))"

CAT_SQL = "cats(subset_no, subset, key) AS (VALUES " + ", ".join(
    f"({i}, '{s}', '{k}')" for i, (s, k) in enumerate(
        (s, k) for k, subs in G.CATEGORY_SUBSETS.items() for s in subs)) + ")"


# ---------------------------------------------------------------- G01 / G02 / G12
@query("g01_accuracy_by_user", with_ctes(FX.SQL_F3) + """
SELECT uid, round(avg(CASE WHEN reward_chosen > reward_rejected THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS n
FROM scored GROUP BY uid""")
def g01(spark, sf):
    a = G.accuracy_by_user(scored(spark, sf))
    return a.select("uid", rd(F.col("accuracy"), "accuracy"), "n")


@query("g02_accuracy_by_category", with_ctes(FX.SQL_F3, CAT_SQL) + """
SELECT c.key, round(avg(CASE WHEN reward_chosen > reward_rejected THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS n
FROM scored s JOIN cats c ON s.subset_no = c.subset_no GROUP BY c.key""")
def g02(spark, sf):
    a = G.accuracy_by_category(scored(spark, sf), G.category_table(spark))
    return a.select("key", rd(F.col("accuracy"), "accuracy"), "n")


@query("g12_macro_micro_accuracy", with_ctes(FX.SQL_F3) + """
, pu AS (SELECT uid, avg(c) AS acc, sum(c) AS s, count(*) AS n FROM
         (SELECT uid, CASE WHEN reward_chosen > reward_rejected THEN 1 ELSE 0 END AS c FROM scored) GROUP BY uid)
SELECT round(sum(s) / sum(n), 6) AS micro_accuracy, round(avg(acc), 6) AS macro_accuracy, count(*) AS n_users FROM pu
""".replace("\n, pu AS", ", pu AS", 1))
def g12(spark, sf):
    d = scored(spark, sf).withColumn("correct", G.correct("reward_chosen", "reward_rejected"))
    m = G.macro_micro_accuracy(d)
    return m.select(rd(F.col("micro_accuracy"), "micro_accuracy"), rd(F.col("macro_accuracy"), "macro_accuracy"),
                    "n_users")


# ---------------------------------------------------------------- G16-G20 / F01 / F02 / F32
@query("g16_pairwise_loss", with_ctes(FX.SQL_F3) + f"""
SELECT uid, round(avg({SOFTPLUS_NEG_D}), 6) AS loss FROM scored GROUP BY uid""")
def g16(spark, sf):
    a = G.pairwise_loss(scored(spark, sf), by=["uid"])
    return a.select("uid", rd(F.col("loss"), "loss"))


@query("g17_user_weighted_loss", with_ctes(FX.SQL_F3) + f"""
SELECT round(0.7 * coalesce(avg(CASE WHEN uid % 8 <> 0 THEN l END), 0)
           + 0.3 * coalesce(avg(CASE WHEN uid % 8 = 0 THEN l END), 0), 6) AS weighted_loss
FROM (SELECT uid, {SOFTPLUS_NEG_D} AS l FROM scored)""")
def g17(spark, sf):
    d = scored(spark, sf).select((F.col("uid") % 8).alias("uid"),
                                 V.log_sigmoid_loss("reward_chosen", "reward_rejected").alias("loss"))
    return G.user_weighted_loss(d, 0.7).select(rd(F.col("weighted_loss"), "weighted_loss"))


@query("g18_user_metric_table", with_ctes(FX.SQL_F3) + """
SELECT CAST(uid % 8 AS VARCHAR) AS "user", round(avg(CASE WHEN reward_chosen > reward_rejected THEN 1 ELSE 0 END), 6) AS accuracy,
       round(avg(reward_chosen), 6) AS mean_chosen, round(avg(reward_rejected), 6) AS mean_rejected
FROM scored GROUP BY uid % 8
UNION ALL
SELECT 'each', round(avg(CASE WHEN reward_chosen > reward_rejected THEN 1 ELSE 0 END), 6),
       round(avg(reward_chosen), 6), round(avg(reward_rejected), 6) FROM scored WHERE uid % 8 <> 0""")
def g18(spark, sf):
    d = scored(spark, sf).withColumn("uid", F.col("uid") % 8)
    t = G.user_metric_table(d)
    return t.select("user", *[rd(F.col(c), c) for c in ("accuracy", "mean_chosen", "mean_rejected")])


@query("g19_accuracy_and_loss", with_ctes(FX.SQL_F3) + f"""
SELECT subset_no, round(avg(CASE WHEN reward_chosen > reward_rejected THEN 1 ELSE 0 END), 6) AS accuracy,
       round(avg({SOFTPLUS_NEG_D}), 6) AS loss FROM scored GROUP BY subset_no""")
def g19(spark, sf):
    a = G.accuracy_and_loss(scored(spark, sf), by=["subset_no"])
    return a.select("subset_no", rd(F.col("accuracy"), "accuracy"), rd(F.col("loss"), "loss"))


@query("g20_reward_margin", with_ctes(FX.SQL_F3) + """
SELECT uid, round(avg(CASE WHEN reward_chosen > reward_rejected THEN 1 ELSE 0 END), 6) AS accuracy,
       round(avg(reward_chosen - reward_rejected), 6) AS margin FROM scored GROUP BY uid""")
def g20(spark, sf):
    a = G.reward_margin(scored(spark, sf), by=["uid"])
    return a.select("uid", rd(F.col("accuracy"), "accuracy"), rd(F.col("margin"), "margin"))


@query("f01_log_sigmoid_loss", with_ctes(FX.SQL_F3) + f"""
SELECT traj_id, pos, round({SOFTPLUS_NEG_D}, 6) AS loss FROM scored""")
def f01(spark, sf):
    s = scored(spark, sf)
    return s.select("traj_id", "pos", rd(V.log_sigmoid_loss("reward_chosen", "reward_rejected"), "loss"))


@query("f32_preference_probability", with_ctes(FX.SQL_F3) + """
SELECT traj_id, pos, round(1 / (1 + exp(-(reward_chosen - reward_rejected))), 6) AS prob FROM scored""")
def f32(spark, sf):
    s = scored(spark, sf)
    return s.select("traj_id", "pos", rd(V.preference_probability("reward_chosen", "reward_rejected"), "prob"))


@query("f02_mean_variance_loss", with_ctes(FX.SQL_F3) + """
, sp AS (SELECT traj_id, pos, reward_chosen / 10 AS mc, reward_rejected / 10 AS mr,
               greatest(uid - 4.0, 0) + ln(1 + exp(-abs(uid - 4.0))) AS sc,
               greatest(subset_no / 10.0 - 1, 0) + ln(1 + exp(-abs(subset_no / 10.0 - 1))) AS sr FROM scored),
z AS (SELECT traj_id, pos, (mc - mr) / sqrt(sc * sc + sr * sr) * sqrt(2 * pi()) AS x FROM sp)
SELECT traj_id, pos, round(greatest(-x, 0) + ln(1 + exp(-abs(x))), 6) AS loss FROM z""".replace("\n, sp AS", ", sp AS", 1))
def f02(spark, sf):
    s = scored(spark, sf)
    loss = V.mean_variance_loss(F.col("reward_chosen") / 10, F.col("uid") - 4.0,
                                F.col("reward_rejected") / 10, F.col("subset_no") / 10.0 - 1)
    return s.select("traj_id", "pos", rd(loss, "loss"))


# ---------------------------------------------------------------- L05 / L06 / W07
@query("l05_best_of_n", with_ctes(FX.SQL_F3) + """
, r AS (SELECT traj_id, pos, reward_chosen - reward_rejected AS score,
              row_number() OVER (PARTITION BY traj_id ORDER BY reward_chosen - reward_rejected DESC, pos) AS rk,
              count(*) OVER (PARTITION BY traj_id) AS n_samples FROM scored)
SELECT traj_id AS prompt_id, pos AS best_sample, score AS best_score, n_samples FROM r WHERE rk = 1
""".replace("\n, r AS", ", r AS", 1))
def l05(spark, sf):
    s = scored(spark, sf).select(F.col("traj_id").alias("prompt_id"), F.col("pos").alias("sample_no"),
                                 (F.col("reward_chosen") - F.col("reward_rejected")).alias("score"))
    b = L.best_of_n(s, payload=())
    return b.select("prompt_id", "best_sample", "best_score", "n_samples")


@query("l06_rerank_top_k", with_ctes(FX.SQL_F3) + """
, r AS (SELECT traj_id, pos, row_number() OVER (PARTITION BY traj_id ORDER BY reward_chosen DESC, pos) AS rk FROM scored)
SELECT traj_id AS group_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY rk) AS top_indices
FROM r WHERE rk <= 2 GROUP BY traj_id""".replace("\n, r AS", ", r AS", 1))
def l06(spark, sf):
    s = scored(spark, sf).select(F.col("traj_id").alias("group_id"), F.col("pos").alias("sample_no"),
                                 F.col("reward_chosen").alias("score"))
    t = L.rerank_top_k(s, 2)
    return t.select("group_id", F.array_join(F.transform("top_indices", lambda x: x.cast("string")), ",")
                    .alias("top_indices"))


@query("w07_segment_softmax", with_ctes(FX.SQL_F3) + """
SELECT traj_id, pos, round(e / sum(e) OVER (PARTITION BY traj_id), 6) AS prob
FROM (SELECT traj_id, pos, exp(reward_chosen - max(reward_chosen) OVER (PARTITION BY traj_id)) AS e FROM scored)""")
def w07(spark, sf):
    s = W.segment_softmax(scored(spark, sf), "reward_chosen", "traj_id")
    return s.select("traj_id", "pos", rd(F.col("prob"), "prob"))


@query("g21_whiten", with_ctes(FX.SQL_F3) + """
SELECT traj_id, pos, round((reward_chosen - avg(reward_chosen) OVER ()) / (stddev_pop(reward_chosen) OVER () + 1e-8)
                           + avg(reward_chosen) OVER (), 6) AS reward_chosen FROM scored""")
def g21(spark, sf):
    s = G.whiten(scored(spark, sf), "reward_chosen", shift_mean=True)
    return s.select("traj_id", "pos", rd(F.col("reward_chosen"), "reward_chosen"))


# ---------------------------------------------------------------- rollouts: W06 / G22 / F23-F27 / F33 / F34
def trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """One row per trajectory with per-step arrays in step order."""
    s = scored(spark, sf)
    st = F.struct("pos", (F.col("reward_chosen") / 7).alias("r"), (F.col("reward_rejected") / 13).alias("v"),
                  (F.col("subset_no") / -10.0).alias("lp"), (F.col("uid") / -10.0).alias("ref"),
                  F.col("subset_no").alias("tok"))
    g = s.groupBy("traj_id").agg(F.sort_array(F.collect_list(st)).alias("_s"))
    def field(name):
        return F.transform("_s", lambda x: x.getField(name))
    return g.select("traj_id", *[field(f).alias(n) for f, n in
                                 (("r", "rewards"), ("v", "values"), ("lp", "logprobs"), ("ref", "ref_logprobs"),
                                  ("tok", "tokens"), ("pos", "steps"))])


TRAJ_SQL = """
tr AS (SELECT traj_id, pos, reward_chosen / 7 AS r, reward_rejected / 13 AS v, subset_no / -10.0 AS lp,
              uid / -10.0 AS ref, subset_no AS tok, count(*) OVER (PARTITION BY traj_id) AS n FROM scored)
"""


@query("w06_gae", with_ctes(FX.SQL_F3, TRAJ_SQL, """
d AS (SELECT traj_id, pos, n, r + 0.9 * coalesce(lead(v) OVER (PARTITION BY traj_id ORDER BY pos), 0.0) - v AS delta FROM tr),
rec AS (SELECT traj_id, pos, delta AS a FROM d WHERE pos = n
        UNION ALL
        SELECT d.traj_id, d.pos, d.delta + GL * rec.a FROM d JOIN rec ON d.traj_id = rec.traj_id AND d.pos = rec.pos - 1)
""".replace("GL", repr(0.9 * 0.95))).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT traj_id, pos, round(a + 1e-9, 6) AS advantage FROM rec""")
def w06(spark, sf):
    t = W.gae(trajectories(spark, sf), 0.9, 0.95)
    z = t.select("traj_id", F.posexplode("advantages").alias("i", "a"))
    # sums in another order differ in the last bits: ties of the rounding are moved off by a billionth on both sides
    return z.select("traj_id", (F.col("i") + 1).cast("int").alias("pos"), rd(F.col("a") + 1e-9, "advantage"))


@query("g22_rollout_stats", with_ctes(FX.SQL_F3, TRAJ_SQL) + """
, k AS (SELECT traj_id, sum(greatest(lp - ref, 0)) AS kl, sum(-0.1 * greatest(lp - ref, 0) + CASE WHEN pos = n THEN r ELSE 0 END) AS sr,
               avg(-lp) AS ent FROM tr GROUP BY traj_id)
SELECT round(avg(kl), 6) AS kl_sum_mean, round(avg(sr), 6) AS shaped_reward_sum_mean, round(avg(ent), 6) AS entropy_mean,
       count(*) AS n_sequences FROM k""".replace("\n, k AS", ", k AS", 1))
def g22(spark, sf):
    t = trajectories(spark, sf)
    t = (t.withColumn("kl", F.zip_with(F.col("logprobs").cast("array<double>"), F.col("ref_logprobs").cast("array<double>"),
                                       lambda a, b: F.greatest(a - b, F.lit(0.0))))
          .withColumn("shaped_rewards", V.kl_shaped_reward("logprobs", "ref_logprobs",
                                                           at("rewards", -1), F.size("rewards"), 0.1))
          .withColumn("entropies", F.transform("logprobs", lambda x: -x)))
    s = G.rollout_stats(t)
    return s.select(*[rd(F.col(c), c) for c in ("kl_sum_mean", "shaped_reward_sum_mean", "entropy_mean")],
                    "n_sequences")


@query("f25_kl_shaped_reward", with_ctes(FX.SQL_F3, TRAJ_SQL) + """
SELECT traj_id, pos, round(-0.1 * greatest(lp - ref, 0) + CASE WHEN pos = n THEN r ELSE 0 END, 6) AS shaped FROM tr""")
def f25(spark, sf):
    t = trajectories(spark, sf)
    sh = V.kl_shaped_reward("logprobs", "ref_logprobs", at("rewards", -1), F.size("rewards"), 0.1)
    z = t.select("traj_id", F.posexplode(sh).alias("i", "s"))
    return z.select("traj_id", (F.col("i") + 1).cast("int").alias("pos"), rd(F.col("s"), "shaped"))


@query("f26_ending_penalty", with_ctes(FX.SQL_F3, TRAJ_SQL) + """
SELECT traj_id, round(CASE WHEN bool_or(tok IN (0, 1, 2) AND pos - 1 >= 1) THEN max(CASE WHEN pos = n THEN r END)
                     ELSE -1.0 END, 6) AS reward FROM tr GROUP BY traj_id""")
def f26(spark, sf):
    t = trajectories(spark, sf)
    return t.select("traj_id", rd(V.ending_penalty("tokens", at("rewards", -1), [0, 1, 2], -1.0, 1),
                                  "reward"))


@query("f27_mean_log_likelihood", with_ctes(FX.SQL_F3, TRAJ_SQL) + """
SELECT traj_id, round(avg(lp), 6) AS mean_ll FROM tr GROUP BY traj_id""")
def f27(spark, sf):
    t = trajectories(spark, sf)
    return t.select("traj_id", rd(V.mean_log_likelihood("logprobs"), "mean_ll"))


@query("f33_segment_valid_length", with_ctes(FX.SQL_F3, TRAJ_SQL) + """
SELECT traj_id, count(CASE WHEN tok <> 0 THEN 1 END) AS valid_len FROM tr GROUP BY traj_id""")
def f33(spark, sf):
    t = trajectories(spark, sf)
    return t.select("traj_id", V.segment_valid_length("tokens").alias("valid_len"))


@query("f34_mask_prompt_labels", with_ctes(FX.SQL_F3, TRAJ_SQL) + """
SELECT traj_id, sum(CASE WHEN pos <= 2 THEN -100 ELSE tok END) AS label_sum, count(*) AS n FROM tr GROUP BY traj_id""")
def f34(spark, sf):
    t = trajectories(spark, sf)
    m = V.mask_prompt_labels("tokens", F.lit(2))
    return t.select("traj_id", F.aggregate(m, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("label_sum"),
                    F.size(m).cast("long").alias("n"))


@query("f23_pad", with_ctes(FX.SQL_F3, TRAJ_SQL) + """
, g AS (SELECT traj_id, list(tok ORDER BY pos) AS toks, CAST(ceil(count(*) / 4.0) * 4 AS INTEGER) AS padded_len FROM tr GROUP BY traj_id)
SELECT traj_id, padded_len, len(toks) AS n_real, array_to_string(list_resize(list_transform(toks, lambda x: CAST(x AS VARCHAR)), padded_len, '0'), ',') AS padded FROM g""".replace("\n, g AS", ", g AS", 1))
def f23(spark, sf):
    t = trajectories(spark, sf)
    p = V.pad_multiple("tokens", 4, value=0)
    return t.select("traj_id", F.size(p).alias("padded_len"),
                    F.aggregate(V.pad_mask(V.pad_multiple(F.transform("tokens", lambda x: x + 1), 4)), F.lit(0).cast("bigint"),
                                lambda a, x: a + x).alias("n_real"),
                    F.array_join(F.transform(p, lambda x: x.cast("string")), ",").alias("padded"))


@query("f24_batch_select", with_ctes(FX.SQL_F3, TRAJ_SQL) + """
SELECT traj_id, max(CASE WHEN pos = n THEN tok END) AS last_tok, max(CASE WHEN pos = 1 THEN tok END) AS first_tok
FROM tr GROUP BY traj_id""")
def f24(spark, sf):
    t = trajectories(spark, sf)
    rev_idx = F.reverse(F.sequence(F.lit(0), F.size("tokens") - 1))
    g = V.batch_select("tokens", rev_idx)
    return t.select("traj_id", at(g, 1).alias("last_tok"), at(g, -1).alias("first_tok"))
