"""Remaining operators: small projections, sampling, context building, set ops, losses, hooks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as LB
from ..functions import vectors as V
from ..functions.random import sql_seeded_hash
from ..operators import aggregate as G
from ..operators import hooks as X
from ..operators import joins as J
from ..operators import project as P
from ..operators import select as L
from ..operators import sets as U
from ..operators import window as W
from . import comparisons as CP
from . import fixtures as FX
from . import ratings as RT
from . import vectors as VQ
from ..session import materialize
from .registry import query, with_ctes

TYPED = with_ctes(FX.SQL_F2, RT.BIN_SQL, RT.MATCH_SQL, RT.LAB_SQL, RT.TYPED_SQL)

# Rating attribute -> user id (the 0..3 map).
ATTRIBUTE_UID = {"instruction_following": 0, "honesty": 1, "truthfulness": 2, "helpfulness": 3}


def rd(c, out, n=6):
    return F.round(c, n).alias(out)


def _attr_col():
    return F.element_at(F.array(*[F.lit(a) for a in LB.ATTRIBUTES]), (F.col("completion_no") % 4 + 1).cast("int"))


def _attr_sql():
    return "[" + ", ".join(f"'{a}'" for a in LB.ATTRIBUTES) + "][completion_no % 4 + 1]"


# ---------------------------------------------------------------- P02 / P06 / P12 / P25
@query("p02_map_attribute_to_uid", with_ctes(FX.SQL_F2) + "SELECT instruction_id, completion_no, CASE "
       + " ".join(f"WHEN {_attr_sql()} = '{k}' THEN {v}" for k, v in ATTRIBUTE_UID.items())
       + " END AS uid FROM ratings")
def p02(spark, sf):
    r = FX.f2_ratings(spark, sf).withColumn("attributes", _attr_col())
    return P.map_attribute_to_uid(r, ATTRIBUTE_UID).select("instruction_id", "completion_no", "uid")


@query("p06_keep_attributes", with_ctes(FX.SQL_F2) + f"""
SELECT {_attr_sql()} AS attributes, count(*) AS n FROM ratings WHERE {_attr_sql()} IN ('honesty', 'truthfulness') GROUP BY 1""")
def p06(spark, sf):
    r = FX.f2_ratings(spark, sf).withColumn("attributes", _attr_col())
    return P.keep_attributes(r, ["honesty", "truthfulness"]).groupBy("attributes").agg(F.count(F.lit(1)).alias("n"))


@query("p12_tag_constant", with_ctes(FX.SQL_F3) + """
SELECT traj_id, pos, 'chat' AS key FROM scored""")
def p12(spark, sf):
    return P.tag_constant(FX.f3_scored(spark, sf), "key", "chat").select("traj_id", "pos", "key")


@query("p25_explode_options", with_ctes(FX.SQL_F1) + """
SELECT cmp_id, 0 AS option_no, md5(text_0) AS option_md5 FROM comparisons
UNION ALL SELECT cmp_id, 1, md5(text_1) FROM comparisons""")
def p25(spark, sf):
    c = FX.f1_comparisons(spark, sf).select("cmp_id", F.array("text_0", "text_1").alias("options"))
    e = P.explode_options(c)
    return e.select("cmp_id", "option_no", F.md5("option").alias("option_md5"))


# ---------------------------------------------------------------- typed pairs: P26 / P27 / L12 / L13 / U04 / W03
@query("p26_controversial_only", TYPED + "SELECT pair_id, data_subset FROM typed WHERE controversial")
def p26(spark, sf):
    return P.controversial_only(RT.typed(spark, sf)).select("pair_id", "data_subset")


@query("p27_one_user", TYPED + "SELECT pair_id, data_subset, controversial FROM typed WHERE data_subset = '8'")
def p27(spark, sf):
    return P.one_user(RT.typed(spark, sf), "8").select("pair_id", "data_subset", "controversial")


@query("l12_upsample_controversial", TYPED + """
SELECT pair_id, data_subset, copy_no, row_number() OVER (ORDER BY """ + sql_seeded_hash(12, "pair_id", "data_subset", "copy_no") + """, pair_id, data_subset, copy_no) - 1 AS place
FROM (SELECT pair_id, data_subset, c.copy_no FROM typed,
  LATERAL (SELECT unnest(range(0, CASE WHEN controversial THEN 5 ELSE 1 END)) AS copy_no) c)""")
def l12(spark, sf):
    t = RT.typed(spark, sf).select("pair_id", "data_subset", "controversial")
    u = L.upsample_controversial(t, seed=12, key=("pair_id", "data_subset"))
    return u.select("pair_id", "data_subset", F.col("copy_no").cast("long").alias("copy_no"), "place")


@query("l13_cap_per_subset", TYPED + """
, r AS (SELECT data_subset, pair_id, row_number() OVER (PARTITION BY data_subset ORDER BY pair_id) AS rn,
              count(*) OVER () AS total, count(DISTINCT data_subset) OVER () AS k FROM typed)
SELECT data_subset, pair_id FROM r WHERE total <= 20000 OR rn <= floor(20000 / k)""".replace("\n, r AS", ", r AS", 1))
def l13(spark, sf):
    return L.cap_per_subset(RT.typed(spark, sf).select("data_subset", "pair_id"), 20000, order="pair_id").select("data_subset", "pair_id")


@query("u04_common_subsets", TYPED + """
, e AS (SELECT pair_id, unnest(string_split(satisfied_subset, ',')) AS typ FROM typed),
n AS (SELECT pair_id, count(*) AS n_rows FROM typed GROUP BY 1),
c AS (SELECT pair_id, typ FROM e JOIN n USING (pair_id) GROUP BY pair_id, typ, n_rows HAVING count(*) = n_rows)
SELECT n.pair_id, coalesce(string_agg(c.typ, ',' ORDER BY c.typ), '') AS common FROM n LEFT JOIN c USING (pair_id) GROUP BY n.pair_id""".replace(
    "\n, e AS", ", e AS", 1))
def u04(spark, sf):
    g = RT.typed(spark, sf).groupBy("pair_id").agg(F.collect_list(F.struct("satisfied_subset")).alias("ctx"))
    return g.select("pair_id", F.array_join(U.common_subsets(F.col("ctx")), ",").alias("common"))


@query("w03_segment_offsets", TYPED + """
SELECT pair_id, data_subset, e - n_same AS start, e AS "end" FROM (SELECT pair_id, data_subset, n_same,
  sum(n_same) OVER (ORDER BY pair_id, data_subset ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM typed)""")
def w03(spark, sf):
    t = RT.typed(spark, sf).select("pair_id", "data_subset", F.col("n_same").cast("long").alias("n_same"))
    s = W.segment_offsets(t, "n_same", ["pair_id", "data_subset"])
    return s.select("pair_id", "data_subset", "start", "end")


# ---------------------------------------------------------------- contexts: L10 / L11 / U06 / U03
def _floyd_sql(keys: list[str], t: str, lo: int, hi: int, m: int, seed: int) -> str:
    """Columns n, x0..x3: the survey positions of one try, as ``survey_contexts`` draws them."""
    plan = L.draw_plan([hi - lo + 1] + [m] * hi)
    part = lambda j: f"({sql_seeded_hash(seed, *keys, t, str(plan[j][0]))} // {plan[j][1]})"
    return ", ".join([f"{lo} + {part(0)} % {hi - lo + 1} AS n"]
                     + [f"{part(k + 1)} % ({m} - n + {k} + 1) AS d{k}" for k in range(hi)]
                     + ["d0 AS x0"]
                     + [f"CASE WHEN d{k} IN ({', '.join(f'x{i}' for i in range(k))}) THEN {m} - n + {k} ELSE d{k} END AS x{k}" for k in range(1, hi)])


def _survey(spark, sf):
    t = RT.typed(spark, sf).select((F.col("pair_id") * 10 + F.col("data_subset").cast("long")).alias("Index"), "satisfied_subset")
    t = materialize(t)  # feeds both the survey draw and the rows: written once
    return t, L.survey_pool(t, 40, seed=1, key="Index").select("Index", "satisfied_subset")


SURVEY_SQL = f"""
, tx AS (SELECT pair_id * 10 + CAST(data_subset AS BIGINT) AS "Index", string_split(satisfied_subset, ',') AS sat FROM typed),
sv AS (SELECT "Index", sat FROM tx ORDER BY {sql_seeded_hash(1, '"Index"')}, "Index" LIMIT 40),
pool AS (SELECT count(*) AS m, list("Index" ORDER BY "Index") AS pid,
         list(list_sum(CAST(sat AS BIGINT[])) ORDER BY "Index") AS mask FROM sv)
"""


def _accepted_sql(n: int) -> str:
    """All sets of n survey rows with one type in common, numbered in order of their positions."""
    t = [f"p{i}" for i in range(n)]
    return (f"SELECT {n} AS n, {' + '.join(f'{x}.id' for x in t)} AS ids, row_number() OVER (ORDER BY {', '.join(f'{x}.p' for x in t)}) - 1 AS k FROM "
            + ", ".join(f"pos {x}" for x in t) + " WHERE " + " AND ".join(f"{x}.p < {y}.p" for x, y in zip(t, t[1:]))
            + f" AND ({' & '.join(f'{x}.mask' for x in t)}) IN (1, 2, 4, 8)")


L10_SQL = f"""
, pos AS (SELECT "Index" AS id, CAST(list_sum(CAST(sat AS BIGINT[])) AS BIGINT) AS mask, row_number() OVER (ORDER BY "Index") - 1 AS p FROM sv),
acc AS ({' UNION ALL '.join(map(_accepted_sql, (2, 3, 4)))}),
m AS (SELECT count(*) AS m FROM pos),
sizes AS (SELECT s.n, count(acc.n) AS t,
  count(acc.n) / CAST(CASE s.n WHEN 2 THEN m * (m - 1) // 2 WHEN 3 THEN m * (m - 1) * (m - 2) // 6 ELSE m * (m - 1) * (m - 2) * (m - 3) // 24 END AS DOUBLE) AS share
  FROM (VALUES (2), (3), (4)) s(n) CROSS JOIN m LEFT JOIN acc ON acc.n = s.n GROUP BY s.n, m),
cum AS (SELECT n, t, sum(share) OVER (ORDER BY n) AS bound, sum(share) OVER () AS whole FROM sizes),
draw AS (SELECT tx."Index", {sql_seeded_hash(2, '"Index"', "'size'")} / {float(1 << 60)!r} AS u, {sql_seeded_hash(2, '"Index"', "'rank'")} AS w FROM tx),
sized AS (SELECT draw."Index", draw.w, least(4, 2 + (SELECT count(*) FROM cum WHERE bound <= draw.u * whole)) AS n FROM draw)
SELECT sized."Index", CAST(sized.n AS INTEGER) AS context_length, true AS identified, CAST(acc.ids AS BIGINT) AS context_id_sum
FROM sized JOIN cum ON cum.n = sized.n JOIN acc ON acc.n = sized.n AND acc.k = sized.w % cum.t"""


@query("l10_survey_contexts", TYPED + SURVEY_SQL.replace("\n, tx AS", ", tx AS", 1) + L10_SQL)
def l10(spark, sf):
    t, survey = _survey(spark, sf)
    c = L.survey_contexts(t.select("Index"), survey, max_len=4, seed=2, mode="single", hash_kind="md5")
    return c.select("Index", "context_length", "identified", _id_sum("contexts"))


def _id_sum(contexts: str):
    return F.aggregate(contexts, F.lit(0).cast("long"), lambda a, x: a + x["original_id"]).alias("context_id_sum")


@query("l11_random_contexts", TYPED + f"""
, tx AS (SELECT pair_id * 10 + CAST(data_subset AS BIGINT) AS "Index", md5(prompt) AS ph, controversial FROM typed),
pool AS (SELECT "Index", ph, row_number() OVER (ORDER BY ph, "Index") - 1 AS pidx, count(*) OVER () AS m FROM tx WHERE controversial),
span AS (SELECT ph, min(pidx) AS lo, count(*) AS len FROM pool GROUP BY ph),
own AS (SELECT tx."Index", coalesce(lo, 0) AS lo, coalesce(len, 0) AS len FROM tx LEFT JOIN span ON tx.ph = span.ph),
draws AS (SELECT own.*, {sql_seeded_hash(3, '"Index"', 'r.d')} % ((SELECT max(m) FROM pool) - len) AS p FROM own, range(0, 8) r(d))
SELECT d."Index", count(*) AS n_contexts, CAST(sum(pool."Index") AS BIGINT) AS context_id_sum FROM draws d
JOIN pool ON pool.pidx = CASE WHEN p >= lo THEN p + len ELSE p END GROUP BY d."Index\"""".replace("\n, tx AS", ", tx AS", 1))
def l11(spark, sf):
    t = RT.typed(spark, sf).withColumn("Index", F.col("pair_id") * 10 + F.col("data_subset").cast("long"))
    # ids are drawn and returned: no text but the prompt is kept, and that as far as its hash
    t = materialize(t.select("Index", "prompt", "controversial"))
    pool = t.filter("controversial").select("Index", "prompt")
    c = L.random_contexts(t.select("Index", "prompt"), pool, seed=3, fields=(), columns=("Index",))
    return c.select("Index", F.coalesce(F.size("contexts"), F.lit(0)).cast("long").alias("n_contexts"), _id_sum("contexts"))


@query("u06_replicate_with_new_contexts", TYPED + SURVEY_SQL.replace("\n, tx AS", ", tx AS", 1) + f"""
, draws AS (SELECT tx."Index", c.copy_no, {_floyd_sql(['"Index"', 'c.copy_no'], '0', 1, 4, 40, 6)} FROM tx, range(0, 3) c(copy_no))
SELECT "Index", copy_no, CAST(n AS INTEGER) AS context_length, CAST(pid[x0 + 1] + CASE WHEN n > 1 THEN pid[x1 + 1] ELSE 0 END
  + CASE WHEN n > 2 THEN pid[x2 + 1] ELSE 0 END + CASE WHEN n > 3 THEN pid[x3 + 1] ELSE 0 END AS BIGINT) AS context_id_sum FROM draws, pool""")
def u06(spark, sf):
    t, survey = _survey(spark, sf)
    r = L.replicate_with_new_contexts(t.select("Index"), survey, k=3, max_len=4, seed=6, mode="84", hash_kind="md5")
    return r.select("Index", F.col("copy_no").cast("long").alias("copy_no"), "context_length", _id_sum("contexts"))


@query("u03_positions_minus", with_ctes(FX.SQL_F2) + """
SELECT instruction_id, count(*) FILTER (WHERE completion_no NOT IN (1, 2)) AS n_left FROM ratings GROUP BY 1""")
def u03(spark, sf):
    r = FX.f2_ratings(spark, sf)
    g = r.groupBy("instruction_id").agg(F.collect_list("completion_no").alias("all"))
    left = U.positions_minus(F.col("all"), F.array(F.lit(1), F.lit(2)))
    return g.select("instruction_id", F.size(left).cast("long").alias("n_left"))


# ---------------------------------------------------------------- P33 / P34 / P38 / P39 / L02 / L20 / L21
@query("p33_flatten_struct", with_ctes(FX.SQL_F1) + """
SELECT cmp_id, prompt AS info__post, 'pair ' || CAST(pair_no AS VARCHAR) AS info__title, 'tldr' AS info__subreddit FROM comparisons""")
def p33(spark, sf):
    s = FX.f1_summaries(spark, sf).select("cmp_id", "info")
    return P.flatten_struct(s, "__").select("cmp_id", "info__post", "info__title", "info__subreddit")


@query("p34_compose_steps", with_ctes(FX.SQL_F1, CP.NORM_SQL) + """
SELECT cmp_id FROM norm WHERE length(prompt) + length(chosen_only) <= 3000 AND length(prompt) + length(rejected_only) <= 3000
  AND split = 'train'""")
def p34(spark, sf):
    steps = [lambda d: P.pick_choice_flat(d),
             lambda d: P.drop_identical(d, "chosen_only", "rejected_only"),
             lambda d: P.max_text_length(d, 3000, chosen="chosen_only", rejected="rejected_only"),
             lambda d: d.filter(F.col("split") == "train")]
    return P.compose(FX.f1_comparisons(spark, sf), steps).select("cmp_id")


_SIDE_SQL = r"""regexp_replace(replace(split_part({c}, chr(10) || 'Assistant: ', -1), '"', ''), '^\s+|\s+$', '', 'g')"""
# prompts from whole texts: a document as prompt, the two texts of a comparison pair as answers
RAG_WHOLE_SQL = VQ.EMB_SQL + f"""
, t AS (SELECT qid, did, rank FROM (SELECT q.qid, d.did, d.label, row_number() OVER (PARTITION BY q.qid
       ORDER BY list_dot_product(q.v, d.v) DESC, d.did) AS rank FROM q CROSS JOIN d) WHERE rank <= 3),
n AS (SELECT CAST(floor(count(*) / 2) AS BIGINT) AS n_pairs FROM documents),
x AS (SELECT p.doc_id, p.text AS prompt, {_SIDE_SQL.format(c="chr(10) || 'Assistant: ' || a.text")} AS chosen,
      {_SIDE_SQL.format(c="'said \"x\"' || chr(10) || 'Assistant: ' || b.text")} AS rejected
      FROM documents p CROSS JOIN n JOIN documents a ON a.doc_id = 2 * (p.doc_id % n_pairs) JOIN documents b ON b.doc_id = 2 * (p.doc_id % n_pairs) + 1),
ex AS (SELECT t.qid, t.rank, x.*, {sql_seeded_hash(5, 't.qid', 't.rank')} % 2 = 0 AS a_first FROM t JOIN x ON x.doc_id = t.did),
eb AS (SELECT qid, string_agg(prompt || chr(10) || chr(10) || 'Response A: ' || CASE WHEN a_first THEN chosen ELSE rejected END || chr(10)
  || 'Response B: ' || CASE WHEN a_first THEN rejected ELSE chosen END || chr(10) || chr(10) || 'Which response do you prefer?' || chr(10) || chr(10)
  || 'Response ' || CASE WHEN a_first THEN 'A' ELSE 'B' END || chr(10) || '===' || chr(10), '' ORDER BY rank DESC) AS body FROM ex GROUP BY qid),
qb AS (SELECT doc_id AS qid, prompt, chosen, rejected, {sql_seeded_hash(6, 'doc_id')} % 2 = 0 AS a_first FROM x),
r AS (SELECT qid, 'The examples ' || body || 'Prompt: ' || prompt || chr(10) || chr(10) || 'Response A: ' || CASE WHEN a_first THEN chosen ELSE rejected END
  || chr(10) || chr(10) || 'Response B: ' || CASE WHEN a_first THEN rejected ELSE chosen END || chr(10) || chr(10)
  || 'Which response do you prefer?' || chr(10) || 'Response ' AS rag_prompt, CASE WHEN a_first THEN 'A' ELSE 'B' END AS answer
FROM eb JOIN qb USING (qid))
"""


@query("p38_rag_prompt", with_ctes(RAG_WHOLE_SQL) + "SELECT qid, md5(rag_prompt) AS prompt_md5, answer FROM r")
def p38(spark, sf):
    return p38_whole(spark, sf).select("qid", "prompt_md5", "answer")


@query("p38_rag_prompt_whole", with_ctes(RAG_WHOLE_SQL) + """
SELECT qid, md5(rag_prompt) AS prompt_md5, CAST(length(rag_prompt) AS BIGINT) AS n_chars, answer FROM r""")
def p38_whole(spark, sf):
    q, d = VQ.split_qd(spark, sf)
    top = L.top_k_similar(q, d, k=3)
    docs = FX.table(spark, sf, "documents")
    n_pairs = docs.select(F.floor(F.count(F.lit(1)) / 2).cast("long")).scalar()
    # ids first: a text is read once, goes to each place that holds it, and the places of a query meet once (rank 0: the query itself)
    own = q.select("qid", F.lit(0).alias("rank"), F.col("qid").alias("did"))
    ids = top.select("qid", F.col("rank").cast("int").alias("rank"), "did").union(own)
    a_id = 2 * (F.col("did") % n_pairs)
    places = ids.select("qid", "rank", F.posexplode(F.array("did", a_id, a_id + 1)).alias("place", "doc_id"))
    texts = places.join(docs.select("doc_id", "text"), "doc_id").select("qid", "rank", "place", "text").repartition("qid")
    text = lambda place: F.max(F.when(F.col("place") == place, F.col("text")))
    x = (texts.groupBy("qid", "rank").agg(F.count(F.lit(1)).alias("_n"), text(0).alias("prompt"), text(1).alias("a"), text(2).alias("b")).where("_n = 3")
         .select("qid", "rank", "prompt", F.concat(F.lit("\nAssistant: "), "a").alias("chosen"), F.concat(F.lit('said "x"\nAssistant: '), "b").alias("rejected")))
    r = P.rag_prompt(x.where("rank = 0").drop("rank"), x.where("rank > 0"), "qid", seed=5)
    return r.select("qid", F.md5("rag_prompt").alias("prompt_md5"), F.length("rag_prompt").cast("long").alias("n_chars"), "answer")


@query("p39_rebase_uid", with_ctes(FX.SQL_F3) + "SELECT traj_id, pos, uid - 1 AS uid FROM scored")
def p39(spark, sf):
    return P.rebase_uid(FX.f3_scored(spark, sf), n_users=8).select("traj_id", "pos", "uid")


@query("l02_sort_by_prompt", with_ctes(FX.SQL_F1) + """
SELECT cmp_id, row_number() OVER (ORDER BY prompt, cmp_id) AS pos FROM comparisons""")
def l02(spark, sf):
    c = L.sort_by(FX.f1_comparisons(spark, sf).select("cmp_id", "prompt"), "prompt", "cmp_id")
    return W.dense_position(c, ["prompt", "cmp_id"], "pos", base=1).select("cmp_id", "pos")


def _h(seed, key="row_id"):
    return sql_seeded_hash(seed, key)


@query("l20_synthetic_pairs", f"""
WITH pools AS (SELECT doc_id % 4 AS pool_no, doc_id // 4 AS sent_no, text FROM documents),
sizes AS (SELECT pool_no, count(*) AS pool_n FROM pools GROUP BY pool_no),
b AS (SELECT event_id AS row_id, CAST({_h(0)} % 10 AS INTEGER) AS pair_type, CAST({_h(1)} % 2 AS INTEGER) AS user_type FROM events),
d AS (SELECT b.*, CASE WHEN pair_type < 5 THEN 0 ELSE 2 END AS pool_a FROM b),
d2 AS (SELECT d.*, d.pool_a + 1 AS pool_b, sa.pool_n AS na, sb.pool_n AS nb FROM d JOIN sizes sa ON sa.pool_no = d.pool_a
       JOIN sizes sb ON sb.pool_no = d.pool_a + 1),
d3 AS (SELECT *, CAST({_h(2)} % greatest(CAST(floor(na * 0.8) AS BIGINT), 1) AS INTEGER) AS sent_a,
                 CAST({_h(3)} % greatest(CAST(floor(nb * 0.8) AS BIGINT), 1) AS INTEGER) AS sent_b FROM d2)
SELECT row_id, pair_type, user_type,
  md5(CASE WHEN pair_type >= 5 AND user_type = 1 THEN pb.text ELSE pa.text END) AS chosen_md5,
  md5(CASE WHEN pair_type >= 5 AND user_type = 1 THEN pa.text ELSE pb.text END) AS rejected_md5, pair_type >= 5 AS controversial
FROM d3 JOIN pools pa ON pa.pool_no = d3.pool_a AND pa.sent_no = d3.sent_a
        JOIN pools pb ON pb.pool_no = d3.pool_b AND pb.sent_no = d3.sent_b""")
def l20(spark, sf):
    docs = FX.table(spark, sf, "documents")
    pools = docs.select((F.col("doc_id") % 4).cast("int").alias("pool_no"), F.floor(F.col("doc_id") / 4).cast("int")
                        .alias("sent_no"), "text")
    base = FX.table(spark, sf, "events").select(F.col("event_id").alias("row_id"))
    s = L.synthetic_pairs(base, pools, seed=0)
    return s.select("row_id", "pair_type", "user_type", F.md5("chosen").alias("chosen_md5"),
                    F.md5("rejected").alias("rejected_md5"), "controversial")


@query("l21_sanity_subset", "SELECT event_id FROM events ORDER BY event_id LIMIT 100")
def l21(spark, sf):
    return L.sanity_subset(FX.table(spark, sf, "events").select("event_id"), 100, "event_id")


# ---------------------------------------------------------------- J08 / J11 / J13
@query("j08_zip_positional", with_ctes(FX.SQL_F1) + """
SELECT a.pos - 1 AS position, a.cmp_id, b.doc_id FROM
  (SELECT cmp_id, row_number() OVER (ORDER BY cmp_id) AS pos FROM comparisons) a JOIN
  (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS pos FROM documents) b ON a.pos = b.pos""")
def j08(spark, sf):
    a = FX.f1_comparisons(spark, sf).select("cmp_id")
    b = FX.table(spark, sf, "documents").select("doc_id")
    return J.zip_positional(a, b, "cmp_id", "doc_id").select("position", "cmp_id", "doc_id")


@query("j11_prompts_for_users", """
SELECT u.user_id, count(*) AS n FROM conversations c, (SELECT unnest(range(0, 4)) AS user_id) u
WHERE c.role = 'user' GROUP BY u.user_id""")
def j11(spark, sf):
    p = FX.f7_dialogs(spark, sf).filter(F.col("role") == "user").select(
        F.concat_ws("_", "conv_id", "turn").alias("prompt_id"))
    r = J.prompts_for_users(p, 3)
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("j13_filter_by_aligned", """
SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)""")
def j13(spark, sf):
    d = FX.table(spark, sf, "documents").select("doc_id")
    lab = FX.table(spark, sf, "labels")
    return J.filter_by_aligned(d, lab, "doc_id", F.col("quality") == 1)


# ---------------------------------------------------------------- G13 / F03 / F04 / F11
@query("g13_length_stats", """
SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean_len, max(length(text)) AS max_len,
       min(length(text)) AS min_len, count(*) FILTER (WHERE length(text) > 5000) AS n_truncated FROM documents GROUP BY lang""")
def g13(spark, sf):
    s = G.length_stats(FX.table(spark, sf, "documents"), "text", 5000, by=["lang"])
    return s.select("lang", "n", rd(F.col("mean_len"), "mean_len"), "max_len", "min_len", "n_truncated")


@query("g13_merge_length_stats", """
SELECT count(*) AS n, round(avg(length(text)), 6) AS mean_len, max(length(text)) AS max_len, min(length(text)) AS min_len,
       count(*) FILTER (WHERE length(text) > 5000) AS n_truncated FROM documents""")
def g13_merge(spark, sf):
    d = FX.table(spark, sf, "documents")
    even, odd = (G.length_stats(d.filter(F.col("doc_id") % 2 == k), "text", 5000) for k in (0, 1))
    m = G.merge_length_stats(even, odd)
    return m.select("n", rd(F.col("mean_len"), "mean_len"), "max_len", "min_len", "n_truncated")


@query("u03_rows_minus", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def u03_rows(spark, sf):
    return U.rows_minus(FX.table(spark, sf, "documents").select("doc_id"), FX.table(spark, sf, "labels"), ["doc_id"])


@query("u05_rows_except_all", """
SELECT user_id, event_type FROM events EXCEPT ALL SELECT user_id, event_type FROM events WHERE event_id % 3 = 0""")
def u05_rows(spark, sf):
    e = FX.table(spark, sf, "events")
    return U.rows_except_all(e.select("user_id", "event_type"), e.filter("event_id % 3 = 0").select("user_id", "event_type"))


@query("p38_judge_reply_side", """
SELECT conv_id, turn, CASE WHEN upper(substr(trim(text), 1, 1)) IN ('A', 'B') THEN upper(substr(trim(text), 1, 1)) END AS picked FROM conversations""")
def p38_reply(spark, sf):
    c = FX.f7_dialogs(spark, sf).select("conv_id", "turn", F.col("text").alias("reply"))
    return P.judge_reply_side(c).select("conv_id", "turn", "picked")


@query("p30_apply_replacements", """
SELECT doc_id, md5(replace(replace(text, ', ', '; '), 'the', 'THE')) AS text_md5 FROM documents""")
def p30_replacements(spark, sf):
    from ..functions.text import apply_replacements
    d = FX.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(apply_replacements(F.col("text"), {", ": "; ", "the": "THE"})).alias("text_md5"))


F3_LOGITS_SQL = """
lg AS (SELECT traj_id, pos, reward_chosen / 10 AS c0, uid / 10.0 AS c1, subset_no / 10.0 AS c2,
              reward_rejected / 10 AS r0, pos / 10.0 AS r1, 0.0 AS r2 FROM scored),
sm AS (SELECT traj_id, pos,
  exp(c0 - greatest(c0, c1, c2)) AS ec0, exp(c1 - greatest(c0, c1, c2)) AS ec1, exp(c2 - greatest(c0, c1, c2)) AS ec2,
  exp(r0 - greatest(r0, r1, r2)) AS er0, exp(r1 - greatest(r0, r1, r2)) AS er1, exp(r2 - greatest(r0, r1, r2)) AS er2 FROM lg),
pr AS (SELECT traj_id, pos, ec0 / (ec0 + ec1 + ec2) AS pc0, ec1 / (ec0 + ec1 + ec2) AS pc1, ec2 / (ec0 + ec1 + ec2) AS pc2,
              er0 / (er0 + er1 + er2) AS pr0, er1 / (er0 + er1 + er2) AS pr1, er2 / (er0 + er1 + er2) AS pr2 FROM sm)
"""


@query("f03_categorical_loss", with_ctes(FX.SQL_F3, F3_LOGITS_SQL) + """
SELECT traj_id, pos, round(-ln(pc0 * 0.5 * pr0 + pc1 * (pr0 + 0.5 * pr1) + pc2 * (pr0 + pr1 + 0.5 * pr2)), 6) AS loss FROM pr""")
def f03(spark, sf):
    s = FX.f3_scored(spark, sf)
    lc = F.array(F.col("reward_chosen") / 10, F.col("uid") / 10.0, F.col("subset_no") / 10.0)
    lr = F.array(F.col("reward_rejected") / 10, F.col("pos") / 10.0, F.lit(0.0))
    return s.select("traj_id", "pos", rd(V.categorical_loss(lc, lr), "loss"))


@query("f04_kl_normal", with_ctes(FX.SQL_F3) + """
SELECT traj_id, pos, round(-0.5 * ((1 + uid / 10.0 - (reward_chosen / 10) * (reward_chosen / 10) - exp(uid / 10.0))
                                   + (1 + subset_no / 10.0 - (reward_rejected / 10) * (reward_rejected / 10) - exp(subset_no / 10.0))), 6) AS kl
FROM scored""")
def f04(spark, sf):
    s = FX.f3_scored(spark, sf)
    m = F.array(F.col("reward_chosen") / 10, F.col("reward_rejected") / 10)
    lv = F.array(F.col("uid") / 10.0, F.col("subset_no") / 10.0)
    return s.select("traj_id", "pos", rd(V.kl_normal(m, lv, 0.5), "kl"))


@query("f11_gaussian_log_prob", with_ctes(FX.SQL_F3) + f"""
SELECT traj_id, pos, round(-0.5 * pow((reward_chosen / 10 - reward_rejected / 10) / greatest(exp(uid / 10.0 - 0.4), 1e-6), 2)
  - ln(greatest(exp(uid / 10.0 - 0.4), 1e-6)) - {0.5 * math.log(2 * math.pi)!r}, 6) AS log_prob FROM scored""")
def f11(spark, sf):
    s = FX.f3_scored(spark, sf)
    lp = V.gaussian_log_prob(F.col("reward_chosen") / 10, F.col("reward_rejected") / 10, F.col("uid") / 10.0 - 0.4)
    return s.select("traj_id", "pos", rd(lp, "log_prob"))


# ---------------------------------------------------------------- X01 / X02 / X03 / X09
@query("x01_map_batches", with_ctes(FX.SQL_F5) + "SELECT event_id, preference * 2 AS doubled FROM h2h")
def x01(spark, sf):
    d = FX.f5_h2h(spark, sf).select("event_id", "preference")

    def double(pdf):
        return pdf.assign(doubled=pdf["preference"].astype("int64") * 2)[["event_id", "doubled"]]
    return X.map_batches(d, double, "event_id long, doubled long")


@query("x02_filter_with_index", with_ctes(FX.SQL_F1) + """
SELECT cmp_id FROM (SELECT cmp_id, row_number() OVER (ORDER BY cmp_id) - 1 AS idx FROM comparisons) WHERE idx >= 100""")
def x02(spark, sf):
    c = FX.f1_comparisons(spark, sf).select("cmp_id")
    return X.filter_with_index(c, lambda i: i >= 100).select("cmp_id")


@query("x03_post_process", with_ctes(FX.SQL_F1) + """
SELECT cmp_id, length(prompt) AS prompt_len FROM comparisons WHERE text_0 <> text_1""")
def x03(spark, sf):
    c = FX.f1_comparisons(spark, sf)
    post = lambda d: P.drop_identical(d, "text_0", "text_1").withColumn("prompt_len", F.length("prompt"))
    return X.post_process(c, post).select("cmp_id", "prompt_len")


@query("x09_metric_registry", with_ctes(FX.SQL_F3) + """
SELECT uid, round(avg(CASE WHEN reward_chosen > reward_rejected THEN 1 ELSE 0 END), 6) AS accuracy,
       round(avg(greatest(-(reward_chosen - reward_rejected), 0) + ln(1 + exp(-abs(reward_chosen - reward_rejected)))), 6) AS loss,
       round(avg(reward_chosen - reward_rejected), 6) AS margin FROM scored GROUP BY uid""")
def x09(spark, sf):
    m = X.compute_metrics(FX.f3_scored(spark, sf), ["accuracy", "loss", "margin"], by=["uid"])
    return m.select("uid", *[rd(F.col(c), c) for c in ("accuracy", "loss", "margin")])


@query("s15_as_frame", "SELECT quality, count(*) AS n FROM labels GROUP BY quality")
def s15(spark, sf):
    from ..sources.readers import as_frame
    return as_frame(spark, FX.table(spark, sf, "labels")).groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@query("f03_categorical_batch_loss", with_ctes(FX.SQL_F3, F3_LOGITS_SQL) + """
, pl AS (SELECT uid % 2 AS half, -ln(pc0 * 0.5 * pr0 + pc1 * (pr0 + 0.5 * pr1) + pc2 * (pr0 + pr1 + 0.5 * pr2)) AS l,
               pc0, pc1, pc2, pr0, pr1, pr2 FROM pr JOIN scored USING (traj_id, pos)),
m AS (SELECT half, avg(l) AS log_loss, (sum(pc0) + sum(pr0)) / (2 * count(*)) AS m0,
             (sum(pc1) + sum(pr1)) / (2 * count(*)) AS m1, (sum(pc2) + sum(pr2)) / (2 * count(*)) AS m2 FROM pl GROUP BY half)
SELECT half, round(log_loss, 6) AS log_loss, round(m0 * ln(m0) + m1 * ln(m1) + m2 * ln(m2), 6) AS neg_entropy,
       round(log_loss + 0.1 * (m0 * ln(m0) + m1 * ln(m1) + m2 * ln(m2)), 6) AS loss FROM m""".replace("\n, pl AS", ", pl AS", 1))
def f03b(spark, sf):
    s = FX.f3_scored(spark, sf).withColumn("half", (F.col("uid") % 2).cast("int"))
    s = s.withColumn("lc", F.array(F.col("reward_chosen") / 10, F.col("uid") / 10.0, F.col("subset_no") / 10.0)) \
         .withColumn("lr", F.array(F.col("reward_rejected") / 10, F.col("pos") / 10.0, F.lit(0.0)))
    r = G.categorical_batch_loss(s, "lc", "lr", entropy_coeff=0.1, by=["half"])
    return r.select(F.col("half").cast("int").alias("half"), rd(F.col("log_loss"), "log_loss"),
                    rd(F.col("neg_entropy"), "neg_entropy"), rd(F.col("loss"), "loss"))
