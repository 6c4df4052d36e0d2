"""Queries over F2 rated completions: alignment, rating match, user-type labels, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as LB
from ..operators import joins as J
from ..operators import labels as LO
from ..operators import project as P
from ..operators import select as L
from . import fixtures as FX
from .registry import query, with_ctes

SEED = 0
TYPES = list(zip(LB.ATTRIBUTES, LB.USER_TYPES))
INT_RE = r"-?\d+"


def _bad(alias: str) -> str:
    return " OR ".join(f"NOT regexp_full_match(trim({alias}.{a}), '{INT_RE}')" for a in LB.ATTRIBUTES)


BIN_SQL = """
bin AS (SELECT 'instruction ' || CAST(c.instruction_id AS VARCHAR) AS prompt, c.response AS chosen,
               r.response AS rejected, c.instruction_id AS pair_id
        FROM ratings c JOIN ratings r ON c.instruction_id = r.instruction_id
        WHERE c.completion_no = 1 AND r.completion_no = 2)
"""

MATCH_SQL = f"""
mc AS (SELECT b.pair_id, max(x.completion_no) AS last_no, bool_or({_bad('x')}) AS bad
       FROM bin b JOIN ratings x ON x.instruction_id = b.pair_id AND x.response = b.chosen GROUP BY b.pair_id),
mr AS (SELECT b.pair_id, max(x.completion_no) AS last_no, bool_or({_bad('x')}) AS bad
       FROM bin b JOIN ratings x ON x.instruction_id = b.pair_id AND x.response <> b.chosen AND x.response = b.rejected
       GROUP BY b.pair_id),
matched AS (SELECT b.*, {", ".join(f"CAST(trim(c.{a}) AS INT) AS c_{a}, CAST(trim(r.{a}) AS INT) AS r_{a}" for a in LB.ATTRIBUTES)}
            FROM bin b JOIN mc ON mc.pair_id = b.pair_id JOIN mr ON mr.pair_id = b.pair_id
            JOIN ratings c ON c.instruction_id = b.pair_id AND c.completion_no = mc.last_no
            JOIN ratings r ON r.instruction_id = b.pair_id AND r.completion_no = mr.last_no
            WHERE NOT mc.bad AND NOT mr.bad)
"""


def _rev_sql(attr: str, t: str) -> str:
    coin = f"(CAST(('0x' || substr(md5(concat_ws(':', '{SEED}', CAST(pair_id AS VARCHAR), '{t}')), 1, 15)) AS BIGINT) % 2 = 1)"
    return f"CASE WHEN r_{attr} > c_{attr} THEN true WHEN r_{attr} < c_{attr} THEN false ELSE {coin} END"


LAB_SQL = "lab AS (SELECT *, " + ", ".join(f"{_rev_sql(a, t)} AS rev{t}" for a, t in TYPES) + """ FROM matched),
lab2 AS (SELECT *, (rev8 OR rev4 OR rev2 OR rev1) AND NOT (rev8 AND rev4 AND rev2 AND rev1) AS controversial FROM lab)"""


def _one_type(t: str) -> str:
    same = ", ".join(f"CASE WHEN rev{u} = rev{t} THEN '{u}' END" for u in LB.USER_TYPES)
    n_same = " + ".join(f"CASE WHEN rev{u} = rev{t} THEN 1 ELSE 0 END" for u in LB.USER_TYPES)
    human = "'Human: ' || prompt || chr(10) || chr(10) || 'Assistant: '"
    return (f"SELECT pair_id, prompt, '{t}' AS data_subset, rev{t} AS reversed, controversial, "
            f"concat_ws(',', {same}) AS satisfied_subset, controversial AS survey_options, "
            f"{human} || CASE WHEN rev{t} THEN rejected ELSE chosen END AS chosen, "
            f"{human} || CASE WHEN rev{t} THEN chosen ELSE rejected END AS rejected, "
            f"4 AS n_present, {n_same} AS n_same FROM lab2")


TYPED_SQL = "typed AS (" + " UNION ALL ".join(_one_type(t) for t in LB.USER_TYPES) + ")"


def matched(spark: SparkSession, sf: str) -> DataFrame:
    r = FX.f2_ratings(spark, sf)
    comps = LO.completions_table(r)  # one row per instruction: the only pass over the ratings
    # a pair and its completions are one row from the start (J01's join by prompt is for tables that come apart)
    return LO.match_ratings(P.drop_empty_side(LO.binarize_completions(comps, keep=["completions"])))


def typed(spark: SparkSession, sf: str) -> DataFrame:
    return LO.label_user_types(matched(spark, sf), seed=SEED)


# ---------------------------------------------------------------- J01 / P36 / J02
@query("j01_align_by_prompt", with_ctes(FX.SQL_F2, BIN_SQL) + """
SELECT b.pair_id, count(*) AS n_completions FROM bin b JOIN ratings x ON x.instruction_id = b.pair_id GROUP BY b.pair_id""")
def j01(spark, sf):
    r = FX.f2_ratings(spark, sf)
    a = J.align_by_prompt(LO.completions_table(r).withColumn("orig_idx", F.col("instruction_id")), LO.binarize(r))
    return a.select("pair_id", F.size("completions").cast("long").alias("n_completions"))


@query("p36_drop_empty_side", with_ctes(FX.SQL_F2, BIN_SQL) + """
SELECT pair_id FROM bin WHERE length(chosen) > 0 AND length(rejected) > 0""")
def p36(spark, sf):
    return P.drop_empty_side(LO.binarize(FX.f2_ratings(spark, sf))).select("pair_id")


@query("j02_match_completion", with_ctes(FX.SQL_F2, BIN_SQL, MATCH_SQL) + "SELECT pair_id, "
       + ", ".join(f"c_{a}, r_{a}" for a in LB.ATTRIBUTES) + " FROM matched")
def j02(spark, sf):
    m = matched(spark, sf)
    return m.select("pair_id", *[c for a in LB.ATTRIBUTES for c in (f"c_{a}", f"r_{a}")])


# ---------------------------------------------------------------- F17-F22 / L18
@query("f17_user_type_labels", with_ctes(FX.SQL_F2, BIN_SQL, MATCH_SQL, LAB_SQL, TYPED_SQL) + """
SELECT pair_id, data_subset, reversed FROM typed""")
def f17(spark, sf):
    return typed(spark, sf).select("pair_id", "data_subset", "reversed")


@query("f21_explode_user_types", with_ctes(FX.SQL_F2, BIN_SQL, MATCH_SQL, LAB_SQL, TYPED_SQL) + """
SELECT pair_id, data_subset, reversed, controversial, satisfied_subset, survey_options, chosen, rejected FROM typed""")
def f21(spark, sf):
    t = typed(spark, sf)
    return t.select("pair_id", "data_subset", "reversed", "controversial",
                    F.array_join("satisfied_subset", ",").alias("satisfied_subset"), "survey_options",
                    "chosen", "rejected")


@query("f19_controversial", with_ctes(FX.SQL_F2, BIN_SQL, MATCH_SQL, LAB_SQL) + """
SELECT controversial, count(*) AS n FROM lab2 GROUP BY controversial""")
def f19(spark, sf):
    m = matched(spark, sf)
    lab = LB.user_type_labels({a: F.col(f"c_{a}") for a in LB.ATTRIBUTES},
                              {a: F.col(f"r_{a}") for a in LB.ATTRIBUTES}, SEED, F.col("pair_id"))
    return (m.select(LB.controversial(lab).alias("controversial"))
             .groupBy("controversial").agg(F.count(F.lit(1)).alias("n")))


@query("f20_satisfied_subset", with_ctes(FX.SQL_F2, BIN_SQL, MATCH_SQL, LAB_SQL, TYPED_SQL) + """
SELECT satisfied_subset, count(*) AS n FROM typed GROUP BY satisfied_subset""")
def f20(spark, sf):
    t = typed(spark, sf)
    return (t.select(F.array_join("satisfied_subset", ",").alias("satisfied_subset"))
             .groupBy("satisfied_subset").agg(F.count(F.lit(1)).alias("n")))


@query("f18_drop_equal_types", with_ctes(FX.SQL_F2, BIN_SQL, MATCH_SQL) + """
SELECT pair_id, """ + " + ".join(f"CASE WHEN c_{a} <> r_{a} THEN 1 ELSE 0 END" for a in LB.ATTRIBUTES)
       + """ AS n_unequal FROM matched WHERE """ + " + ".join(f"CASE WHEN c_{a} <> r_{a} THEN 1 ELSE 0 END"
                                                               for a in LB.ATTRIBUTES) + " = 2")
def f18(spark, sf):
    rows = LO.label_user_types(matched(spark, sf), seed=SEED, filter_equal=True, mode="84")
    return rows.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_unequal"))


@query("f22_bitmask_type", with_ctes(FX.SQL_F2, BIN_SQL, MATCH_SQL, LAB_SQL) + """
SELECT pair_id, CAST(8 * CAST(rev8 AS INT) + 4 * CAST(rev4 AS INT) + 2 * CAST(rev2 AS INT) + CAST(rev1 AS INT) AS VARCHAR)
       AS reversed_type FROM lab2""")
def f22(spark, sf):
    t = typed(spark, sf)
    g = t.groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct("data_subset", "reversed"))).alias("m"))
    bits = F.array(*[F.col("m")[t_] for t_ in LB.USER_TYPES])
    return g.select("pair_id", LB.bitmask_type(bits).alias("reversed_type"))


@query("l18_random_tie_label", with_ctes(FX.SQL_F2, BIN_SQL, MATCH_SQL) + f"""
SELECT pair_id, CASE WHEN c_helpfulness - r_helpfulness > 0 THEN 1 WHEN c_helpfulness - r_helpfulness < 0 THEN 0
  ELSE CAST(CAST(('0x' || substr(md5(concat_ws(':', '5', CAST(pair_id AS VARCHAR))), 1, 15)) AS BIGINT) % 2 AS INT) END AS label
FROM matched""")
def l18(spark, sf):
    m = matched(spark, sf)
    return m.select("pair_id", L.random_tie_label(F.col("c_helpfulness") - F.col("r_helpfulness"), 5,
                                                  F.col("pair_id")).alias("label"))


@query("l18_random_argmax", with_ctes(FX.SQL_F2, BIN_SQL, MATCH_SQL) + f"""
SELECT pair_id, best[1 + CAST(CAST(('0x' || substr(md5(concat_ws(':', '6', CAST(pair_id AS VARCHAR))), 1, 15)) AS BIGINT) % len(best) AS INT)] AS best_attribute
FROM (SELECT pair_id, list_filter([1, 2, 3, 4], lambda i: vals[i] = list_max(vals)) AS best
      FROM (SELECT pair_id, [{', '.join(f'c_{a}' for a in LB.ATTRIBUTES)}] AS vals FROM matched))""")
def l18_argmax(spark, sf):
    m = matched(spark, sf)
    best = L.random_argmax(F.array(*[F.col(f"c_{a}") for a in LB.ATTRIBUTES]), 6, F.col("pair_id"))
    return m.select("pair_id", best.cast("int").alias("best_attribute"))


# ---------------------------------------------------------------- G15 / G24 / G25
@query("g15_augment_counters", with_ctes(FX.SQL_F2, BIN_SQL, MATCH_SQL, LAB_SQL, TYPED_SQL) + """
SELECT data_subset, count(*) AS n_rows, sum(CAST(reversed AS INT)) AS n_reversed,
       sum(CAST(controversial AS INT)) AS n_controversial, count(*) - sum(CAST(controversial AS INT)) AS n_agreed,
       CAST(sum(n_same) AS DOUBLE) AS guess,
       CAST(sum(CASE WHEN controversial THEN n_same ELSE 0 END) AS DOUBLE) AS guess_controversial
FROM typed GROUP BY data_subset""")
def g15(spark, sf):
    c = LO.augment_counters(typed(spark, sf))
    return c.select("data_subset", "n_rows", "n_reversed", "n_controversial", "n_agreed",
                    F.round("guess", 6).alias("guess"), F.round("guess_controversial", 6).alias("guess_controversial"))


LONG_SQL = "lg AS (" + " UNION ALL ".join(
    f"SELECT instruction_id, completion_no, '{a}' AS attribute, {a} AS rating, "
    f"CASE WHEN regexp_full_match(trim({a}), '{INT_RE}') THEN CAST(trim({a}) AS INT) END AS score FROM ratings"
    for a in LB.ATTRIBUTES) + ")"


@query("g25_best_worst_by_attribute", with_ctes(FX.SQL_F2, LONG_SQL, """
bw AS (SELECT instruction_id, attribute, count(*) FILTER (WHERE score IS NULL) AS bad,
              max(score) AS hi, min(score) AS lo FROM lg GROUP BY instruction_id, attribute),
hi AS (SELECT l.instruction_id, l.attribute, min(l.completion_no) AS chosen_no FROM lg l JOIN bw b
       ON l.instruction_id = b.instruction_id AND l.attribute = b.attribute AND l.score = b.hi GROUP BY 1, 2),
lo AS (SELECT l.instruction_id, l.attribute, min(l.completion_no) AS rejected_no FROM lg l JOIN bw b
       ON l.instruction_id = b.instruction_id AND l.attribute = b.attribute AND l.score = b.lo GROUP BY 1, 2)""") + """
SELECT b.instruction_id, b.attribute, hi.chosen_no, b.hi AS chosen_score, lo.rejected_no, b.lo AS rejected_score
FROM bw b JOIN hi USING (instruction_id, attribute) JOIN lo USING (instruction_id, attribute)
WHERE b.bad = 0 AND b.hi > b.lo AND b.hi > 0""")
def g25(spark, sf):
    return LO.best_worst_by_attribute(FX.f2_ratings(spark, sf))


def _gd_pairs_sql() -> str:
    conds = []
    for i, a in enumerate(LB.ATTRIBUTES):
        for b in LB.ATTRIBUTES[i + 1:]:
            conds.append(f"(x.{a} > y.{a} AND x.{b} < y.{b})")
    return " OR ".join(conds)


@query("g24_guided_disagreement", with_ctes(FX.SQL_F2, """
ri AS (SELECT instruction_id, completion_no, """ + ", ".join(
    f"CASE WHEN regexp_full_match(trim({a}), '{INT_RE}') THEN CAST(trim({a}) AS INT) END AS {a}" for a in LB.ATTRIBUTES)
    + " FROM ratings)") + f"""
SELECT i.instruction_id, coalesce(d.flag, false) AS guided_disagreement
FROM (SELECT DISTINCT instruction_id FROM ri) i LEFT JOIN
     (SELECT x.instruction_id, bool_or(coalesce({_gd_pairs_sql()}, false)) AS flag
      FROM ri x JOIN ri y ON x.instruction_id = y.instruction_id GROUP BY x.instruction_id) d
ON i.instruction_id = d.instruction_id""")
def g24(spark, sf):
    return LO.guided_disagreement(FX.f2_ratings(spark, sf))
