"""Queries over F4 embeddings: similarity top-k, vector functions, pooling, scorers, user vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.util import at
from ..operators import aggregate as G
from ..operators import hooks as X
from ..operators import joins as J
from ..operators import select as L
from . import fixtures as FX
from .registry import query, with_ctes

EMB_SQL = """
q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id % 5 = 0),
d AS (SELECT vec_id AS did, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id % 5 <> 0)
"""


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return FX.f4_embeddings(spark, sf)


def split_qd(spark, sf):
    e = emb(spark, sf)
    q = e.filter(F.col("vec_id") % 5 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"),
                                                  F.col("label").alias("qlabel"))
    d = e.filter(F.col("vec_id") % 5 != 0).select(F.col("vec_id").alias("did"), F.col("embedding").alias("dvec"),
                                                  F.col("label").alias("dlabel"))
    return q, d


def rd(c, out, n=6):
    return F.round(c, n).alias(out)


# ---------------------------------------------------------------- L04 / J12
@query("l04_top_k_similar", with_ctes(EMB_SQL) + """
SELECT qid, did, rank FROM (SELECT q.qid, d.did, row_number() OVER (PARTITION BY q.qid
       ORDER BY list_dot_product(q.v, d.v) DESC, d.did) AS rank FROM q CROSS JOIN d) WHERE rank <= 3""")
def l04(spark, sf):
    q, d = split_qd(spark, sf)
    t = L.top_k_similar(q, d, k=3)
    return t.select("qid", "did", F.col("rank").cast("long").alias("rank"))


@query("j12_similarity_join", with_ctes(EMB_SQL) + """
SELECT qid, did, rank FROM (SELECT q.qid, d.did, row_number() OVER (PARTITION BY q.qid
       ORDER BY list_dot_product(q.v, d.v) DESC, d.did) AS rank FROM q JOIN d ON q.label = d.label) WHERE rank <= 3""")
def j12(spark, sf):
    q, d = split_qd(spark, sf)
    t = J.similarity_top_k(q.withColumnRenamed("qlabel", "g"), d.withColumnRenamed("dlabel", "g"), 3,
                           qid="qid", did="did", qvec="qvec", dvec="dvec", group="g")
    return t.select("qid", "did", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- F05 / F09 / F10 / F28
PAIR_SQL = """
pr AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
"""


def pairs(spark, sf):
    e = emb(spark, sf)
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.select("vec_id", F.col("embedding").alias("a")).join(b, "vec_id")


@query("f05_dot_cosine", with_ctes(PAIR_SQL) + """
SELECT vec_id, round(list_dot_product(a, b), 6) AS dot,
       round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS cosine FROM pr""")
def f05(spark, sf):
    p = pairs(spark, sf)
    return p.select("vec_id", rd(V.dot("a", "b"), "dot"), rd(V.cosine("a", "b"), "cosine"))


@query("f09_pair_diff", with_ctes(PAIR_SQL) + """
SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda x: x[1] - x[2])), 6) AS diff_sum,
       round(list_transform(list_zip(a, b), lambda x: x[1] - x[2])[1], 6) AS diff_first FROM pr""")
def f09(spark, sf):
    p = pairs(spark, sf).withColumn("d", V.pair_diff("a", "b"))
    return p.select("vec_id", rd(F.aggregate("d", F.lit(0.0), lambda s, x: s + x), "diff_sum"),
                    rd(at("d", 1), "diff_first"))


@query("f10_argmax_match", with_ctes(PAIR_SQL) + """
SELECT vec_id, list_position(a, list_max(a)) AS argmax_a, list_position(a, list_max(a)) = list_position(b, list_max(b)) AS same FROM pr""")
def f10(spark, sf):
    p = pairs(spark, sf)
    return p.select("vec_id", V.argmax("a").alias("argmax_a"), V.argmax_match("a", "b").alias("same"))


@query("f28_prior_scale", """
SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * sqrt(64) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first
FROM embeddings""")
def f28(spark, sf):
    e = emb(spark, sf)
    return e.select("vec_id", rd(at(V.prior_scale("embedding"), 1), "first"))


# ---------------------------------------------------------------- F06 / F07 / F08 (token pooling)
SEQ_SQL = """
tokv AS (SELECT vec_id // 4 AS seq_id, vec_id % 4 AS tok, CAST(embedding AS DOUBLE[]) AS v,
                CASE WHEN vec_id % 4 = 3 THEN 0 ELSE 1 END AS m FROM embeddings)
"""


def sequences(spark, sf):
    e = emb(spark, sf)
    t = e.select((F.col("vec_id") / 4).cast("long").alias("seq_id"), (F.col("vec_id") % 4).alias("tok"),
                 F.col("embedding").cast("array<double>").alias("v"),
                 F.when(F.col("vec_id") % 4 == 3, 0).otherwise(1).alias("m"))
    g = t.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("tok", "v", "m"))).alias("_t"))
    return g.select("seq_id", F.transform("_t", lambda x: x["v"]).alias("vectors"),
                    F.transform("_t", lambda x: x["m"]).alias("mask"),
                    F.aggregate(F.transform("_t", lambda x: x["m"]), F.lit(0), lambda a, b: a + b).alias("length"))


@query("f06_pool_mean", with_ctes(SEQ_SQL) + """
SELECT seq_id, round(avg(v[1]), 6) AS mean_first, round(avg(v[64]), 6) AS mean_last FROM tokv WHERE m = 1 GROUP BY seq_id""")
def f06(spark, sf):
    s = sequences(spark, sf).filter(F.col("length") > 0)
    p = V.pool_mean("vectors", "mask")
    return s.select("seq_id", rd(at(p, 1), "mean_first"), rd(at(p, 64), "mean_last"))


@query("f07_pool_last", with_ctes(SEQ_SQL) + """
SELECT t.seq_id, round(t.v[1], 6) AS last_first FROM tokv t
JOIN (SELECT seq_id, sum(m) AS len FROM tokv GROUP BY seq_id) l ON t.seq_id = l.seq_id AND t.tok = l.len - 1 WHERE l.len > 0""")
def f07(spark, sf):
    s = sequences(spark, sf).filter(F.col("length") > 0)
    return s.select("seq_id", rd(at(V.pool_last("vectors", "length"), 1), "last_first"))


@query("f08_pool_position_weighted", with_ctes(SEQ_SQL) + """
, l AS (SELECT seq_id, sum(m) AS len FROM tokv GROUP BY seq_id)
SELECT t.seq_id, round(sum((t.tok + 1) * t.v[1]) / (l.len * (l.len + 1) / 2.0), 6) AS wmean_first
FROM tokv t JOIN l ON t.seq_id = l.seq_id WHERE t.tok < l.len AND l.len > 0 GROUP BY t.seq_id, l.len
""".replace("\n, l AS", ", l AS", 1))
def f08(spark, sf):
    s = sequences(spark, sf).filter(F.col("length") > 0)
    return s.select("seq_id", rd(at(V.pool_position_weighted("vectors", "length"), 1), "wmean_first"))


# ---------------------------------------------------------------- X04 / X05 / X08 / G11 / L15
WEIGHTS = [((i * 37) % 11 - 5) / 10.0 for i in range(64)]  # a fixed linear scorer, built from a rule


@query("x04_score_with", "SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), ["
       + ", ".join(repr(w) for w in WEIGHTS) + "]::DOUBLE[]), 6) AS score FROM embeddings")
def x04(spark, sf):
    s = X.score_with(emb(spark, sf), X.LinearScorer(WEIGHTS), "embedding", "score")
    return s.select("vec_id", rd(F.col("score"), "score"))


@query("x05_embed_with")
def x05(spark, sf):
    docs = FX.table(spark, sf, "documents").select("doc_id", "text")
    e = X.embed_with(docs, "text", "embedding", dim=64)
    return e.select("doc_id", F.size("embedding").alias("dim"), rd(V.norm("embedding"), "norm", 3))


@query("x08_fit_linear_preference", """
SELECT a.label, count(*) AS n, true AS at_optimum FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY a.label""")
def x08(spark, sf):
    p = pairs(spark, sf).join(emb(spark, sf).select("vec_id", "label"), "vec_id").withColumn("diff", V.pair_diff("a", "b"))
    fit = X.fit_linear_preference(p, "diff", group="label")
    # the optimum is where each component of the mean gradient, computed here from the rows, vanishes
    rows = p.select("label", F.col("diff").cast("array<double>").alias("x")).join(fit.select("label", "weights"), "label")
    off = 1 - 1 / (1 + F.exp(-V.dot("x", "weights")))
    parts = rows.withColumn("off", off).select("label", "off", "weights", F.posexplode("x").alias("i", "v"))
    g = parts.groupBy("label", "i").agg((F.avg(-F.col("off") * F.col("v")) + 1e-3 * F.first(F.get("weights", F.col("i")))).alias("g"))
    g = g.groupBy("label").agg((F.max(F.abs("g")) < 1e-7).alias("at_optimum"))
    return fit.select("label", "n").join(g, "label")


@query("g11_question_groups", """
SELECT uid, chunk_no, count(*) AS n_questions, min(qkey) AS first_qkey FROM (
  SELECT label AS uid, vec_id AS qkey, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 25 AS chunk_no
  FROM embeddings) GROUP BY uid, chunk_no""")
def g11(spark, sf):
    e = emb(spark, sf).select(F.col("label").alias("uid"), F.col("vec_id").alias("qkey"))
    g = G.question_groups(e, fields=(), max_group=25)  # every question kept, arrays of <= 25
    return g.select("uid", "chunk_no", F.size("questions").cast("long").alias("n_questions"),
                    at("questions", 1)["qkey"].alias("first_qkey"))


@query("l15_context_target_split", """
SELECT uid, qkey, CASE WHEN rk <= 5 THEN 'context' WHEN rk <= 15 THEN 'target' END AS role FROM (
    SELECT label AS uid, vec_id AS qkey, row_number() OVER (PARTITION BY label ORDER BY
      CAST(('0x' || substr(md5(concat_ws(':', '6', CAST(label AS VARCHAR), CAST(vec_id AS VARCHAR))), 1, 15)) AS BIGINT), vec_id) AS rk
    FROM embeddings)""")
def l15(spark, sf):
    e = emb(spark, sf).select(F.col("label").alias("uid"), F.col("vec_id").alias("qkey"))
    return L.context_target_split(e, 5, 10, seed=6).select("uid", "qkey", "role")


@query("l15_evaluation_split", """
SELECT uid, qkey, 'context' AS role FROM (SELECT label AS uid, vec_id AS qkey, row_number() OVER (PARTITION BY label ORDER BY
      CAST(('0x' || substr(md5(concat_ws(':', '7', CAST(label AS VARCHAR), CAST(vec_id AS VARCHAR))), 1, 15)) AS BIGINT), vec_id) AS rk
    FROM embeddings WHERE vec_id % 3 <> 0) WHERE rk <= 4 AND uid IN (SELECT label FROM embeddings WHERE vec_id % 3 = 0)
UNION ALL SELECT label, vec_id, 'target' FROM embeddings WHERE vec_id % 3 = 0""")
def l15_evaluation(spark, sf):
    e = emb(spark, sf).select(F.col("label").alias("uid"), F.col("vec_id").alias("qkey"))
    return L.evaluation_split(e.filter("qkey % 3 <> 0"), e.filter("qkey % 3 = 0"), 4, seed=7).select("uid", "qkey", "role")


# ---------------------------------------------------------------- J14 / J16 / J17
@query("j14_attach_embeddings", """
SELECT d.doc_id, e.label, round(CAST(e.embedding[1] AS DOUBLE), 6) AS first_dim, round(CAST(e.embedding[64] AS DOUBLE), 6) AS last_dim
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT max(vec_id) + 2 FROM embeddings)""")
def j14(spark, sf):
    e = emb(spark, sf)
    # one id beyond the table's last stays without a vector
    docs = FX.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % e.select(F.max("vec_id") + 2).scalar()).alias("vec_id"))
    a = J.attach_embeddings(docs, e, "vec_id", ("embedding", "label"))
    return a.select("doc_id", "label", rd(F.col("embedding")[0].cast("double"), "first_dim"), rd(F.col("embedding")[63].cast("double"), "last_dim"))


UV_SQL = """
dims AS (SELECT e.label, i.pos, CAST(e.embedding[i.pos] AS DOUBLE) AS x FROM embeddings e, range(1, 65) i(pos)),
gen AS (SELECT pos, avg(x) AS g FROM dims GROUP BY pos),
off AS (SELECT label, pos, avg(x) AS o FROM dims GROUP BY label, pos)
"""


@query("j16_user_vector", with_ctes(UV_SQL) + """
SELECT o.label AS uid, round(sum(CASE WHEN o.label = 0 THEN g.g ELSE g.g + o.o END), 6) AS vec_sum
FROM off o JOIN gen g ON o.pos = g.pos GROUP BY o.label""")
def j16(spark, sf):
    e = emb(spark, sf)
    d = e.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    gen = d.groupBy("pos").agg(F.avg("x").alias("g"))
    # the generic vector has one entry per dimension: a bounded scalar sub-query
    generic = gen.select(F.transform(F.sort_array(F.collect_list(F.struct("pos", "g"))), lambda s: s["g"])).scalar()
    off = (d.groupBy("label", "pos").agg(F.avg("x").alias("o"))
            .groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "o"))).alias("_o"))
            .select(F.col("label").alias("uid"), F.transform("_o", lambda s: s["o"]).alias("offset")))
    users = off.select("uid")
    uv = J.user_vector(users, off, generic)
    return uv.select("uid", rd(F.aggregate("user_vector", F.lit(0.0), lambda a, b: a + b), "vec_sum"))


@query("j17_cluster_user_vector", with_ctes(UV_SQL) + """
, w AS (SELECT label, exp(0.0) / (exp(0.0) + exp(label / 10.0)) AS p0, exp(label / 10.0) / (exp(0.0) + exp(label / 10.0)) AS p1
        FROM (SELECT DISTINCT label FROM embeddings)),
c AS (SELECT pos, avg(CASE WHEN label % 2 = 0 THEN x END) AS c0, avg(CASE WHEN label % 2 = 1 THEN x END) AS c1 FROM dims GROUP BY pos)
SELECT w.label AS uid, round(sum(w.p0 * c.c0 + w.p1 * c.c1), 6) AS vec_sum FROM w, c GROUP BY w.label""".replace("\n, w AS", ", w AS", 1))
def j17(spark, sf):
    e = emb(spark, sf)
    d = e.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    cl = d.groupBy("pos").agg(F.avg(F.when(F.col("label") % 2 == 0, F.col("x"))).alias("c0"),
                              F.avg(F.when(F.col("label") % 2 == 1, F.col("x"))).alias("c1"))
    # two cluster vectors of one entry per dimension: a bounded scalar sub-query
    clusters = cl.select(F.array(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "c0"))), lambda s: s["c0"]),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "c1"))), lambda s: s["c1"]))).scalar()
    users = e.select(F.col("label").alias("uid")).distinct().withColumn(
        "weights", F.array(F.lit(0.0), F.col("uid") / 10.0))
    uv = J.cluster_user_vector(users, clusters, "weights")
    return uv.select("uid", rd(F.aggregate("user_vector", F.lit(0.0), lambda a, b: a + b), "vec_sum"))
