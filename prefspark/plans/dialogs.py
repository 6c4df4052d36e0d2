"""Queries over F7 dialogs (conversations) and customer profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import joins as J
from ..operators import project as P
from ..operators import window as W
from . import fixtures as FX
from .registry import query, with_ctes

MAX_PROMPT, PREFIX_LEN, MAX_TEXT = 600, 20, 2000
U_WRAP = ("<|user|>\n", "\n")
A_WRAP = ("<|assistant|>\n", "\n")

TURNS_SQL = """
dt AS (SELECT u.conv_id, u.turn, u.text AS u, a.text AS c, '(no) ' || a.text AS r
       FROM conversations u LEFT JOIN conversations a
         ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
       WHERE u.role = 'user')
"""


def dialog_turns(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, user_text, chosen, rejected): each user turn with the assistant reply after it;
    the rejected reply is the chosen one marked ``(no)``."""
    cv = FX.f7_dialogs(spark, sf)
    u = cv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("user_text"))
    a = cv.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                       F.col("text").alias("chosen"))
    return (u.join(a, ["conv_id", "turn"], "left")
             .withColumn("rejected", F.concat(F.lit("(no) "), F.col("chosen"))))


def _sqlq(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


KEEP = MAX_PROMPT - PREFIX_LEN
W04_SQL = ("WITH RECURSIVE " + TURNS_SQL.strip() + """,
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM dt),
rec AS (
  SELECT conv_id, k, turn, u, c, r, h1, ok, h1 || CASE WHEN c IS NULL THEN '' ELSE CW0 || c || CW1 END AS h_after
  FROM (SELECT t.*, c IS NOT NULL AND length(u) + length(c) < MAXT AS ok,
               CASE WHEN c IS NOT NULL AND length(u) + length(c) < MAXT AND length(UW0 || u || UW1) > KEEP
                    THEN right(UW0 || u || UW1, KEEP) ELSE UW0 || u || UW1 END AS h1 FROM t WHERE k = 1) s
  UNION ALL
  SELECT conv_id, k, turn, u, c, r, h1, ok, h1 || CASE WHEN c IS NULL THEN '' ELSE CW0 || c || CW1 END
  FROM (SELECT t.*, t.c IS NOT NULL AND length(t.u) + length(t.c) < MAXT AS ok,
               CASE WHEN t.c IS NOT NULL AND length(t.u) + length(t.c) < MAXT AND length(rec.h_after || UW0 || t.u || UW1) > KEEP
                    THEN right(rec.h_after || UW0 || t.u || UW1, KEEP) ELSE rec.h_after || UW0 || t.u || UW1 END AS h1
        FROM t JOIN rec ON t.conv_id = rec.conv_id AND t.k = rec.k + 1) s2)
SELECT conv_id, turn, length(h1) AS hist_len, md5(h1) AS hist_md5 FROM rec
WHERE ok AND r IS NOT NULL AND length(u) + length(r) <= MAXT""").replace("UW0", _sqlq(U_WRAP[0])).replace(
    "UW1", _sqlq(U_WRAP[1])).replace("CW0", _sqlq(A_WRAP[0])).replace("CW1", _sqlq(A_WRAP[1])).replace(
    "MAXT", str(MAX_TEXT)).replace("KEEP", str(KEEP))


@query("w04_dialog_history", W04_SQL)
def w04(spark, sf):
    h = W.dialog_history(dialog_turns(spark, sf), MAX_PROMPT, PREFIX_LEN, MAX_TEXT,
                         user_wrap=U_WRAP, chosen_wrap=A_WRAP)
    return h.select("conv_id", "turn", F.length("history").alias("hist_len"), F.md5("history").alias("hist_md5"))


@query("w05_history_tail", """
SELECT conv_id, turn, length(CASE WHEN length(h) > 300 THEN right(h, 300) ELSE h END) AS tail_len,
       md5(CASE WHEN length(h) > 300 THEN right(h, 300) ELSE h END) AS tail_md5
FROM (SELECT conv_id, turn, string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM conversations)""")
def w05(spark, sf):
    cv = FX.f7_dialogs(spark, sf)
    t = W.history_tail(W.running_history(cv, 500), 300, out="tail")
    return t.select("conv_id", "turn", F.length("tail").alias("tail_len"), F.md5("tail").alias("tail_md5"))


def _w10_fmt_sql() -> str:
    return """CASE WHEN o.r IS NULL THEN 'Example ' || CAST(o.i + 1 AS VARCHAR) || ':' || chr(10) || 'Question: ' || o.u
         || chr(10) || 'Answer: ' || o.c || chr(10) || '(no preference)' || chr(10)
       ELSE 'Example ' || CAST(o.i + 1 AS VARCHAR) || ':' || chr(10) || 'Question: ' || o.u || chr(10) || 'A: '
         || CASE WHEN o.i % 2 = 0 THEN o.c ELSE o.r END || chr(10) || 'B: ' || CASE WHEN o.i % 2 = 0 THEN o.r ELSE o.c END
         || chr(10) || 'Preferred: ' || CASE WHEN o.i % 2 = 0 THEN 'A' ELSE 'B' END || chr(10) END"""


@query("w10_previous_choices", with_ctes(TURNS_SQL) + """
, o AS (SELECT x.conv_id, x.turn, y.turn AS ot, y.u, y.c, y.r,
              row_number() OVER (PARTITION BY x.conv_id, x.turn ORDER BY y.turn) - 1 AS i
       FROM dt x JOIN dt y ON x.conv_id = y.conv_id AND x.turn <> y.turn)
SELECT d.conv_id, d.turn, md5(coalesce(e.ex, '')) AS examples_md5, coalesce(e.n, 0) AS n_examples FROM dt d LEFT JOIN
  (SELECT conv_id, turn, string_agg(""" + _w10_fmt_sql() + """, chr(10) ORDER BY ot) AS ex, count(*) AS n
   FROM o GROUP BY conv_id, turn) e ON d.conv_id = e.conv_id AND d.turn = e.turn""".replace("\n, o AS", ", o AS", 1))
def w10(spark, sf):
    t = dialog_turns(spark, sf).withColumn("rejected", F.when(F.col("chosen").isNull(), None)
                                           .otherwise(F.col("rejected")))
    e = W.previous_choices(t)
    return e.select("conv_id", "turn", F.md5("examples").alias("examples_md5"), "n_examples")


@query("w01_sample_number", """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sample_no, md5(text) AS output_md5
FROM conversations""")
def w01(spark, sf):
    cv = FX.f7_dialogs(spark, sf)
    g = cv.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("_s"))
    g = g.select("conv_id", F.transform("_s", lambda x: x["text"]).alias("outputs"))
    s = W.sample_number(g)
    return s.select("conv_id", F.col("sample_no").cast("long").alias("sample_no"), F.md5("output").alias("output_md5"))


# ---------------------------------------------------------------- profiles: P23 / J10
def profiles(spark, sf):
    c = FX.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.struct(
        F.array(F.col("c_mktsegment")).alias("preference"),
        F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("name"), F.col("c_name"))
        .alias("attributes")).alias("demographics"))


@query("p23_profile_text", """
SELECT c_custkey AS user_id, 'preference: ' || c_mktsegment || '; name: ' || c_name || '; nation: '
       || CAST(c_nationkey AS VARCHAR) || '; ' AS profile_text FROM customer""")
def p23(spark, sf):
    return P.profile_text(profiles(spark, sf)).select("user_id", "profile_text")


def n_users(spark, sf):
    """The largest customer id, as a scalar sub-query."""
    return FX.table(spark, sf, "customer").select(F.max("c_custkey")).scalar()


@query("j10_dialog_profile", """
SELECT d.conv_id, d.n_turns, c.c_mktsegment AS segment FROM
  (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id) d
  LEFT JOIN customer c ON c.c_custkey = d.conv_id % (SELECT max(c_custkey) FROM customer) + 1""")
def j10(spark, sf):
    cv = FX.f7_dialogs(spark, sf)
    d = cv.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns")).withColumn(
        "user_id", F.col("conv_id") % n_users(spark, sf) + 1)
    j = J.dialog_profile(d, profiles(spark, sf))
    return j.select("conv_id", "n_turns", j["demographics"]["preference"][0].alias("segment"))


@query("j15_reference_response", with_ctes(TURNS_SQL) + """
SELECT conv_id, turn, md5(c) AS reference_md5 FROM dt""")
def j15(spark, sf):
    t = dialog_turns(spark, sf)
    outputs = t.select(F.col("conv_id").alias("dialog_id"), "turn")
    ds = t.select(F.col("conv_id").alias("dialog_id"), "turn", "chosen")
    r = J.reference_response(outputs, ds)
    return r.select(F.col("dialog_id").alias("conv_id"), "turn", F.md5("reference").alias("reference_md5"))


# ---------------------------------------------------------------- P11 / P28 / P29 / P32 / P37
@query("p11_response_after_marker", with_ctes(TURNS_SQL) + """
SELECT conv_id, turn, md5(regexp_replace(string_split('Human: ' || u || ' Assistant: ' || c, 'Assistant: ')[2],
                                         '^\\s+|\\s+$', '', 'g')) AS response_md5 FROM dt""")
def p11(spark, sf):
    t = dialog_turns(spark, sf).withColumn("text", F.concat(F.lit("Human: "), F.col("user_text"),
                                                            F.lit(" Assistant: "), F.col("chosen")))
    r = P.response_after_marker(t, "text", "Assistant: ", out="response")
    return r.select("conv_id", "turn", F.md5("response").alias("response_md5"))


@query("p28_completion_of", with_ctes(TURNS_SQL) + """
, io AS (SELECT conv_id, turn, 'ASSISTANT:' || u AS inp,
               CASE WHEN turn % 4 = 0 THEN u ELSE 'ASSISTANT:' || u || 'ASSISTANT:' || c END AS outp FROM dt)
SELECT conv_id, turn, md5(CASE WHEN len(string_split(outp, 'ASSISTANT:')) < len(string_split(inp, 'ASSISTANT:'))
                          THEN 'Wrong completion.' ELSE string_split(outp, 'ASSISTANT:')[-1] END) AS completion_md5
FROM io""".replace("\n, io AS", ", io AS", 1))
def p28(spark, sf):
    t = dialog_turns(spark, sf)
    t = t.select("conv_id", "turn", F.concat(F.lit("ASSISTANT:"), F.col("user_text")).alias("input"),
                 F.when(F.col("turn") % 4 == 0, F.col("user_text")).otherwise(F.concat(
                     F.lit("ASSISTANT:"), F.col("user_text"), F.lit("ASSISTANT:"), F.col("chosen"))).alias("output"))
    c = P.completion_of(t)
    return c.select("conv_id", "turn", F.md5("completion").alias("completion_md5"))


@query("p29_split_prompt_id", """
SELECT conv_id % 5 AS user_id, conv_id AS dialog_id, turn FROM conversations WHERE conv_id % 5 <> 0""")
def p29(spark, sf):
    cv = FX.f7_dialogs(spark, sf).select(F.concat_ws("_", (F.col("conv_id") % 5).cast("string"),
                                                     F.col("conv_id").cast("string"),
                                                     F.col("turn").cast("string")).alias("prompt_id"))
    return P.split_prompt_id(cv).select("user_id", "dialog_id", "turn")


@query("p32_chatml_messages", """
SELECT conv_id, count(*) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id""")
def p32(spark, sf):
    cv = FX.f7_dialogs(spark, sf)
    block = F.concat(F.lit("<|im_start|>"), F.col("role"),
                     F.when(F.col("role") == "system", F.lit(" name=setup")).otherwise(F.lit("")),
                     F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n"))
    g = cv.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))),
                                                           lambda x: x["b"]), "").alias("chatml"))
    m = g.select("conv_id", TX.chatml_messages(F.col("chatml")).alias("messages"))
    return m.select("conv_id", F.size("messages").cast("long").alias("n_messages"),
                    F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"))


@query("p37_judge_prompt", with_ctes(TURNS_SQL) + """
SELECT d.conv_id, d.turn, md5('Here is a user profile:' || chr(10) || 'preference: ' || c.c_mktsegment || '; name: ' || c.c_name
  || '; nation: ' || CAST(c.c_nationkey AS VARCHAR) || '; ' || chr(10) || chr(10) || 'Question:' || chr(10) || d.u || chr(10) || chr(10)
  || 'Answer A:' || chr(10) || d.c || chr(10) || chr(10) || 'Answer B:' || chr(10) || d.r || chr(10) || chr(10)
  || 'Which answer does this user prefer? Reply with A or B.') AS prompt_md5
FROM dt d JOIN customer c ON c.c_custkey = d.conv_id % (SELECT max(c_custkey) FROM customer) + 1 WHERE d.c IS NOT NULL""")
def p37(spark, sf):
    t = dialog_turns(spark, sf).filter(F.col("chosen").isNotNull()).withColumn("user_id", F.col("conv_id") % n_users(spark, sf) + 1)
    pr = P.profile_text(profiles(spark, sf), out="profile")
    j = t.join(pr.select("user_id", "profile"), "user_id")
    q = P.judge_prompt(j, "profile", "user_text", "chosen", "rejected")
    return q.select("conv_id", "turn", F.md5("judge_prompt").alias("prompt_md5"))
