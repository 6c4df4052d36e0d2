"""Queries over run logs.  The logs are whole texts that Spark writes from the F3 scored table
(one run per ``traj_id % 4``, each run in one of the four log formats), then parses back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import report as R
from ..operators import aggregate as G
from ..operators import report as RP
from . import fixtures as FX
from ..session import materialize
from .registry import query, with_ctes

RUN_FILES = {
    0: "/logs/ft_rm_UID_llama_100000_0.0003_linear_1_personal_llm_default.log",
    1: "/logs/id_rm_UID_rm-mistral_30000_1e-5_2_psoups_default.log",
    2: "/logs/prm_llama_10000_1e-5_2_psoups.log",
    3: "/logs/rag_gemma_1000_3e-4_summarization.log",
}
CATS = list(G.CATEGORY_SUBSETS)  # chat, chat hard, safety, reasoning


def run_stats(spark: SparkSession, sf: str):
    s = FX.f3_scored(spark, sf).withColumn("run", (F.col("traj_id") % 4).cast("int"))
    s = s.join(F.broadcast(G.category_table(spark).select("subset_no", "key")), "subset_no")
    c = G.correct("reward_chosen", "reward_rejected")
    # one scan: the finest grouping, then the coarser ones from its (small) sums and counts
    fine = s.groupBy("run", "uid", "key").agg(F.sum(c).alias("s"), F.count(F.lit(1)).alias("n"))
    fine = materialize(fine)
    user = fine.groupBy("run", "uid").agg((F.sum("s") / F.sum("n")).alias("acc"))
    user_cat = fine.select("run", "uid", "key", (F.col("s") / F.col("n")).alias("acc"))
    run_cat = fine.groupBy("run", "key").agg((F.sum("s") / F.sum("n")).alias("acc"))
    return user, user_cat, run_cat


def cat_no(col="key"):
    e = None
    for i, k in enumerate(CATS):
        e = F.when(F.col(col) == k, i) if e is None else e.when(F.col(col) == k, i)
    return e


def log_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(file, text): one whole log text per run, written from the statistics."""
    user, user_cat, run_cat = run_stats(spark, sf)
    f6 = lambda c: F.format_string("%.6f", c)
    u = F.col("uid")
    # run 0, training format: header, user line, four category lines per user
    r0 = user.filter("run = 0").select("run", (u * 10).alias("ln"), F.concat(
        F.lit("Training and Evaluating for user "), u.cast("string")).alias("line")).unionByName(
        user.filter("run = 0").select("run", (u * 10 + 1).alias("ln"), F.concat(
            F.lit("Metrics for User "), u.cast("string"), F.lit(": "), f6(F.col("acc"))).alias("line"))).unionByName(
        user_cat.filter("run = 0").select("run", (u * 10 + 2 + cat_no()).alias("ln"), F.concat(
            F.lit("Metrics for dataset ['"), F.col("key"), F.lit("']: "), f6(F.col("acc"))).alias("line")))
    # run 1, id format: users 1-4, the category lines, then users 5-8
    r1 = user.filter("run = 1").select("run", F.when(u <= 4, u).otherwise(u + 10).alias("ln"), F.concat(
        F.lit("Metrics for dataset ["), u.cast("string"), F.lit("]: "), f6(F.col("acc"))).alias("line")).unionByName(
        run_cat.filter("run = 1").select("run", (F.lit(5) + cat_no()).alias("ln"), F.concat(
            F.lit("Metrics for dataset ['"), F.col("key"), F.lit("']: "), f6(F.col("acc"))).alias("line")))
    # run 2, prm format
    r2 = user.filter("run = 2").select("run", u.alias("ln"), F.concat(
        F.lit("eval_rewards/user_"), u.cast("string"), F.lit("_accuracies: "), f6(F.col("acc"))).alias("line"))
    # run 3, dictionary format: chat, chat hard, user 1, safety, reasoning, users 2..8
    items = user.filter("run = 3").select(F.when(u == 1, 2).otherwise(u + 3).alias("o"), F.concat(
        u.cast("string"), F.lit(": "), f6(F.col("acc"))).alias("t")).unionByName(
        run_cat.filter("run = 3").select(F.when(cat_no() < 2, cat_no()).otherwise(cat_no() + 1).alias("o"), F.concat(
            F.lit("'"), F.col("key"), F.lit("': "), f6(F.col("acc"))).alias("t")))
    r3 = items.agg(F.concat(F.lit("User accuracy: {"), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), ", "),
        F.lit("} for model gemma")).alias("line")).select(F.lit(3).alias("run"), F.lit(0).alias("ln"), "line")
    lines = r0.unionByName(r1).unionByName(r2).unionByName(r3)
    files = F.create_map(*[x for k, v in RUN_FILES.items() for x in (F.lit(k), F.lit(v))])
    return lines.groupBy("run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln", "line"))),
                                                             lambda x: x["line"]), "\n").alias("text")) \
        .select(files[F.col("run")].alias("file"), "text")


def assembled(spark, sf):
    return RP.assemble_run_metrics(RP.lines_from_text(written_logs(spark, sf)))


def written_logs(spark, sf):
    """The derived log texts, written once to the checkpoint folder (they feed many branches)."""
    from ..session import materialize
    return materialize(log_texts(spark, sf))


FILES_SQL = "files(run, file) AS (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in RUN_FILES.items()) + ")"
CATS_SQL = "cats(subset_no, key) AS (VALUES " + ", ".join(
    f"({i}, '{k}')" for i, k in enumerate(k for k, subs in G.CATEGORY_SUBSETS.items() for _ in subs)) + ")"
CATNO_SQL = "catno(key, metric, no) AS (VALUES " + ", ".join(
    f"('{k}', '{R.CATEGORY_METRIC[k]}', {i})" for i, k in enumerate(CATS)) + ")"
EXPECT_SQL = """
s AS (SELECT traj_id % 4 AS run, uid, key, CASE WHEN reward_chosen > reward_rejected THEN 1 ELSE 0 END AS c
      FROM scored JOIN cats USING (subset_no)),
ua AS (SELECT run, uid, round(avg(c), 6) AS v FROM s GROUP BY run, uid),
uc AS (SELECT run, uid, key, round(avg(c), 6) AS v FROM s GROUP BY run, uid, key),
rc AS (SELECT run, key, round(avg(c), 6) AS v FROM s GROUP BY run, key),
ind AS (
  SELECT run, uid, 'accuracy' AS metric, v FROM ua
  UNION ALL SELECT 0, uc.uid, n.metric, uc.v FROM uc JOIN catno n USING (key) WHERE uc.run = 0
  UNION ALL SELECT 1, ua.uid, n.metric, rc.v FROM ua JOIN rc ON rc.run = ua.run JOIN catno n ON n.key = rc.key
            WHERE ua.run = 1 AND ua.uid <= 4
  UNION ALL SELECT 3, ua.uid, n.metric, rc.v FROM ua JOIN rc ON rc.run = ua.run JOIN catno n ON n.key = rc.key
            WHERE ua.run = 3 AND (n.no < 2 OR ua.uid >= 2)),
expect AS (SELECT f.file, i.uid, i.metric, i.v AS value, 'individual' AS user_kind FROM ind i JOIN files f USING (run)
           UNION ALL
           SELECT f.file, 0, i.metric, avg(i.v), 'average' FROM ind i JOIN files f USING (run) GROUP BY f.file, i.metric)
"""
BASE = with_ctes(FX.SQL_F3, FILES_SQL, CATS_SQL, CATNO_SQL, EXPECT_SQL)


@query("f30_assemble_run_metrics", BASE + """
SELECT file, CAST(uid AS BIGINT) AS uid, metric, round(value, 12) AS value, user_kind FROM expect""")
def f30(spark, sf):
    a = assembled(spark, sf)
    # values are 6-decimal numbers and means of at most 8 of them (then of 4 runs): 12 decimals hold them exactly
    return a.select("file", "uid", "metric", F.round("value", 12).alias("value"), "user_kind")


@query("f29_parse_metric_line", with_ctes(FX.SQL_F3, FILES_SQL) + """
, k AS (SELECT DISTINCT traj_id % 4 AS run, uid FROM scored),
n AS (SELECT run, count(*) AS u FROM k GROUP BY run)
SELECT f.file, x.kind, x.n FROM n JOIN files f USING (run), LATERAL (
  SELECT 'header' AS kind, n.u AS n WHERE n.run = 0 UNION ALL SELECT 'user', n.u WHERE n.run = 0
  UNION ALL SELECT 'dataset_name', n.u * 4 WHERE n.run = 0 UNION ALL SELECT 'dataset_num', n.u WHERE n.run = 1
  UNION ALL SELECT 'dataset_name', 4 WHERE n.run = 1 UNION ALL SELECT 'prm', n.u WHERE n.run = 2
  UNION ALL SELECT 'dict', 1 WHERE n.run = 3) x""".replace("\n, k AS", ", k AS", 1))
def f29(spark, sf):
    ln = RP.lines_from_text(written_logs(spark, sf))
    p = ln.select("file", R.parse_line(F.col("line"))["kind"].alias("kind")).filter(F.col("kind").isNotNull())
    return p.groupBy("file", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("g09_macro_average", BASE + """
SELECT file, metric, round(avg(value), 12) AS macro_avg FROM expect WHERE uid <> 0 GROUP BY file, metric""")
def g09(spark, sf):
    a = assembled(spark, sf)
    m = G.macro_average(a, by=["file", "metric"])
    return m.select("file", "metric", F.round("macro_avg", 12).alias("macro_avg"))


@query("g10_global_stats", BASE + """
SELECT uid, metric, round(avg(value), 12) AS mean_value, count(*) AS n_runs FROM expect GROUP BY uid, metric""")
def g10(spark, sf):
    a = assembled(spark, sf)
    g = G.global_stats(a)
    return g.select("uid", "metric", F.round("mean_value", 12).alias("mean_value"), "n_runs")


def _cfg_sql(field: str) -> str:
    vals = R.RUN_NAME_LISTS[field]
    subj = "lower(file)" if field in R.LOWER_CASE_FIELDS else "file"
    return "CASE " + " ".join(f"WHEN contains({subj}, '{v}') THEN '{v}'" for v in vals) + f" ELSE 'NA' END AS {field}"


USERS = list(range(9))


@query("g23_report_wide", BASE + """
, acc AS (SELECT file, uid, value FROM expect WHERE metric = 'accuracy')
SELECT f.file, """ + ", ".join(_cfg_sql(k) for k in R.RUN_NAME_LISTS) + ", " + ", ".join(
    f"coalesce((SELECT format('{{:.3f}}', round(a.value, 3)) FROM acc a WHERE a.file = f.file AND a.uid = {u}), 'NA') AS "
    + ("average" if u == 0 else f"user_{u}") for u in USERS) + """
FROM files f""".replace("\n, acc AS", ", acc AS", 1))
def g23(spark, sf):
    a = assembled(spark, sf)
    # round half away from zero to 3 places first so the text does not depend on the formatter's tie rule
    a = a.withColumn("value", F.round("value", 3))
    return RP.report_wide(a, "accuracy", users=USERS)


# file names put together from the table's ids: every field's names come up, in either case, and some are missing
_NAME_PARTS = [[*R.RUN_NAME_LISTS["method"], "other"], [*R.RUN_NAME_LISTS["model"], "GEMMA"], [*R.RUN_NAME_LISTS["dataset"], "UltraFeedback", "none"],
               [*R.RUN_NAME_LISTS["train_size"], "77"], [*R.RUN_NAME_LISTS["learning_rate"], "7e-7"], ["_1_", "_20_", "_3", "_50__100_", "_5_"]]


def _run_name(event_id: str, pick, join) -> object:
    parts, div = [], 1
    for names in _NAME_PARTS:
        parts.append(pick(names, event_id, div))
        div *= 3
    return join(parts)


@query("p35_run_config_from_name", "WITH n AS (SELECT event_id, " + _run_name(
    "event_id", lambda v, e, d: "[" + ", ".join(f"'{x}'" for x in v) + f"][(({e} // {d}) % {len(v)}) + 1]",
    lambda p: "'runs/' || " + " || '-' || ".join(p) + " || '.log'") + " AS file FROM events) SELECT event_id, file, "
       + ", ".join(_cfg_sql(k) for k in R.RUN_NAME_LISTS) + " FROM n")
def p35(spark, sf):
    from ..operators.project import run_config_from_name
    name = _run_name("event_id", lambda v, e, d: F.element_at(F.array(*[F.lit(x) for x in v]), (F.floor(F.col(e) / d) % len(v) + 1).cast("int")),
                     lambda p: F.concat(F.lit("runs/"), F.concat_ws("-", *p), F.lit(".log")))
    return run_config_from_name(FX.table(spark, sf, "events").select("event_id", name.alias("file")), "file")


@query("f31_format_metric", BASE + """
SELECT file, CAST(uid AS BIGINT) AS uid, metric, format('{:.3f}', round(value, 3)) AS shown FROM expect""")
def f31(spark, sf):
    a = assembled(spark, sf)
    # round half away from zero to 3 places first so the text does not depend on the formatter's tie rule
    return a.select("file", "uid", "metric", R.format_metric(F.round("value", 3)).alias("shown"))


@query("s07_read_logs", with_ctes(FX.SQL_F3, FILES_SQL) + """
, k AS (SELECT DISTINCT traj_id % 4 AS run, uid FROM scored),
n AS (SELECT run, count(*) AS u FROM k GROUP BY run)
SELECT regexp_extract(f.file, '[^/]+$', 0) AS name,
       CASE n.run WHEN 0 THEN 6 * n.u WHEN 1 THEN n.u + 4 WHEN 2 THEN n.u ELSE 1 END AS n_lines
FROM n JOIN files f USING (run)""".replace("\n, k AS", ", k AS", 1))
def s07(spark, sf):
    from ..streaming.streams import scratch
    texts = log_texts(spark, sf).withColumn("name", F.regexp_extract("file", "[^/]+$", 0))
    d = scratch(spark, "logs-files")
    texts.select("name", "text").write.mode("overwrite").partitionBy("name").text(d)
    lines = RP.read_logs(spark, d + "/*/*")
    return (lines.filter(F.length(F.trim("line")) > 0)
                 .groupBy(F.regexp_extract("file", "name=([^/]+)", 1).alias("name"))
                 .agg(F.count(F.lit(1)).alias("n_lines")))
