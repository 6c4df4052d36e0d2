"""Queries over F5 judged pairs: head-to-head metrics, win rates, label codecs and noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as LB
from ..functions.random import sql_seeded_hash
from ..operators import aggregate as G
from ..operators import project as P
from ..operators import select as L
from . import fixtures as FX
from .registry import query, with_ctes


def h2h(spark: SparkSession, sf: str) -> DataFrame:
    return FX.f5_h2h(spark, sf)


def rd(c, out):
    return F.round(c, 6).alias(out)


# ---------------------------------------------------------------- G06
@query("g06_head2head_metrics", with_ctes(FX.SQL_F5, """
k AS (SELECT 'm' || CAST(user_id % 6 AS VARCHAR) AS method, preference,
             CASE WHEN preference = 0 THEN 0.5 ELSE preference - 1.0 END AS s FROM h2h WHERE preference IN (0, 1, 2))""") + """
SELECT method, round(avg(s) * 100, 6) AS win_rate, round(stddev_samp(s) / sqrt(count(*)) * 100, 6) AS standard_error,
       count(*) FILTER (WHERE preference = 2) AS n_wins, count(*) FILTER (WHERE preference = 1) AS n_wins_base,
       count(*) FILTER (WHERE preference = 0) AS n_draws, count(*) AS n_total FROM k GROUP BY method""")
def g06(spark, sf):
    d = h2h(spark, sf).withColumn("method", F.concat(F.lit("m"), (F.col("user_id") % 6).cast("string")))
    m = G.head2head_metrics(d, by=["method"])
    return m.select("method", rd(F.col("win_rate"), "win_rate"), rd(F.col("standard_error"), "standard_error"),
                    "n_wins", "n_wins_base", "n_draws", "n_total")


# ---------------------------------------------------------------- G07 / G08
WLT_SQL = """
a AS (SELECT user_id, CASE WHEN preference = 4 THEN NULL ELSE preference END AS p, label FROM h2h),
wlt AS (SELECT user_id, count(*) FILTER (WHERE p IS NOT NULL AND p <> 3 AND p = label) AS wins,
               count(*) FILTER (WHERE p IS NOT NULL AND p <> 3 AND p <> label) AS losses,
               count(*) FILTER (WHERE p = 3) AS ties FROM a GROUP BY user_id)
"""


def wlt(spark, sf):
    d = h2h(spark, sf).withColumn("preference", F.when(F.col("preference") != 4, F.col("preference")))
    return G.win_lose_tie_by_user(d)


@query("g07_win_lose_tie_by_user", with_ctes(FX.SQL_F5, WLT_SQL) + "SELECT user_id, wins, losses, ties FROM wlt")
def g07(spark, sf):
    return wlt(spark, sf)


@query("g08_win_rate", with_ctes(FX.SQL_F5, WLT_SQL) + """
SELECT 'prism' AS mode,
       round((sum(wins) + sum(ties)) / (sum(wins) + sum(ties) + sum(losses) + sum(ties)), 6) AS pooled_win_rate,
       round(avg(CASE WHEN wins + ties + losses + ties > 0 THEN (wins + ties) / (wins + ties + losses + ties) END), 6)
         AS mean_user_win_rate, count(*) AS n_users FROM wlt
UNION ALL
SELECT 'psoups', round(sum(wins) / (sum(wins) + sum(losses) + sum(ties)), 6),
       round(avg(CASE WHEN wins + losses + ties > 0 THEN wins / (wins + losses + ties) END), 6), count(*) FROM wlt""")
def g08(spark, sf):
    r = G.win_rates(wlt(spark, sf))
    return r.select("mode", rd(F.col("pooled_win_rate"), "pooled_win_rate"), rd(F.col("mean_user_win_rate"), "mean_user_win_rate"), "n_users")


# ---------------------------------------------------------------- F12 / F13 / F16 / P31 / G26
@query("f12_swap_preference", with_ctes(FX.SQL_F5) + """
SELECT event_id, CASE WHEN event_id % 3 = 0 AND preference IN (1, 2) THEN 3 - preference ELSE preference END AS preference
FROM h2h""")
def f12(spark, sf):
    d = h2h(spark, sf)
    return d.select("event_id", LB.swap_preference(F.col("preference"), F.col("event_id") % 3 == 0).alias("preference"))


@query("f13_ordinal_to_binary", """
SELECT event_id, CAST(floor((round_even(value % 5, 0) - 1) / 2.0) + 1 AS INTEGER) AS label FROM events""")
def f13(spark, sf):
    ev = FX.table(spark, sf, "events")
    return ev.select("event_id", LB.ordinal_to_binary(F.col("value") % 5).alias("label"))


NOISE_SQL = f"""
SELECT event_id,
  CASE WHEN {sql_seeded_hash(13, 'event_id')} / 1152921504606846976.0 < 0.2
       THEN CAST({sql_seeded_hash(14, 'event_id')} % 2 + 1 AS INTEGER) ELSE preference END AS preference,
  {sql_seeded_hash(13, 'event_id')} / 1152921504606846976.0 < 0.2 AS is_noisy_label
FROM h2h"""


@query("f16_label_noise", with_ctes(FX.SQL_F5) + NOISE_SQL)
def f16(spark, sf):
    d = h2h(spark, sf)
    lab, noisy = LB.label_noise(F.col("preference"), 0.1, 13, F.col("event_id"))
    return d.select("event_id", lab.cast("int").alias("preference"), noisy.alias("is_noisy_label"))


@query("p31_choice_index", with_ctes(FX.SQL_F5) + """
SELECT event_id, CASE WHEN preference IN (1, 2) THEN preference - 1 END AS choice FROM h2h""")
def p31(spark, sf):
    return P.choice_index(h2h(spark, sf)).select("event_id", "choice")


@query("g26_mean_choice", with_ctes(FX.SQL_F5) + """
SELECT round(avg(CASE WHEN preference IN (1, 2) THEN preference - 1 END), 6) AS mean_choice FROM h2h""")
def g26(spark, sf):
    m = G.mean_choice(P.choice_index(h2h(spark, sf)))
    return m.select(rd(F.col("mean_choice"), "mean_choice"))


# ---------------------------------------------------------------- L16 / L08 / J09
@query("l16_derangement", with_ctes(FX.SQL_F5, f"""
o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY {sql_seeded_hash(21, 'event_id')}, event_id) AS rk,
             count(*) OVER (PARTITION BY user_id) AS n FROM h2h)""") + """
SELECT a.event_id, b.event_id AS paired_value FROM o a JOIN o b
  ON a.user_id = b.user_id AND b.rk = CASE WHEN a.rk < a.n THEN a.rk + 1 ELSE 1 END""")
def l16(spark, sf):
    d = h2h(spark, sf).select("event_id", "user_id", F.col("event_id").alias("v"))
    r = L.derangement(d, ["user_id"], "v", seed=21, id_col="event_id")
    return r.select("event_id", "paired_value")


@query("l08_split_fixed", with_ctes(FX.SQL_F5, f"""
r AS (SELECT event_id, row_number() OVER (ORDER BY {sql_seeded_hash(4, 'event_id')}, event_id) AS rk FROM h2h)""") + """
SELECT rk <= 500 AS is_eval, count(*) AS n, sum(event_id) AS id_sum FROM r GROUP BY 1""")
def l08(spark, sf):
    d = L.split_fixed(h2h(spark, sf).select("event_id"), 500, seed=4, key="event_id")
    return d.groupBy("is_eval").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


@query("j09_complement", with_ctes(FX.SQL_F5, f"""
r AS (SELECT event_id, row_number() OVER (ORDER BY {sql_seeded_hash(4, 'event_id')}, event_id) AS rk FROM h2h)""") + """
SELECT event_id FROM r WHERE rk > 500""")
def j09(spark, sf):
    d = L.split_fixed(h2h(spark, sf).select("event_id"), 500, seed=4, key="event_id")
    picked = d.filter("is_eval").select("event_id")
    return L.complement(h2h(spark, sf).select("event_id"), picked, key="event_id")


@query("l09_survey_pool", with_ctes(FX.SQL_F5) + f"""
SELECT event_id FROM h2h ORDER BY {sql_seeded_hash(0, 'event_id')}, event_id LIMIT 50""")
def l09(spark, sf):
    return L.survey_pool(h2h(spark, sf).select("event_id"), 50, seed=0, key="event_id")


@query("l19_leaderboard_order", with_ctes(FX.SQL_F5, """
k AS (SELECT 'm' || CAST(user_id % 6 AS VARCHAR) AS method,
             CASE WHEN preference = 0 THEN 0.5 ELSE preference - 1.0 END AS s FROM h2h WHERE preference IN (0, 1, 2)),
lb AS (SELECT method, avg(s) * 100 AS wr FROM k GROUP BY method)""") + """
SELECT method, CAST(row_number() OVER (ORDER BY wr DESC, method) AS INTEGER) AS place FROM lb""")
def l19(spark, sf):
    d = h2h(spark, sf).withColumn("method", F.concat(F.lit("m"), (F.col("user_id") % 6).cast("string")))
    m = G.head2head_metrics(d, by=["method"])
    from pyspark.sql import Window
    # the leaderboard has one row per method: ranking it in one task is bounded by the method count
    ordered = L.leaderboard_order(m)
    return ordered.select("method", F.row_number().over(Window.orderBy(F.desc("win_rate"), "method")).alias("place"))


@query("g14_distinct_keys", with_ctes(FX.SQL_F5) + """
SELECT count(DISTINCT user_id) AS n_distinct_user_id FROM h2h""")
def g14b(spark, sf):
    return G.distinct_keys(h2h(spark, sf), "user_id")
