"""Joins.

Spark picks the physical join.  Explicit ``broadcast`` hints are only put
on sides whose size is bounded by construction (a k-row top list, a fixed
lookup, a per-partition count table).  Joins whose key is a pair of long
texts use a 128-bit hash key so only ids and hashes are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa  # the Arrow function's type hints are resolved in this module
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.util import at

from ..functions import vectors as V
from .aggregate import pair_hash
from .window import dense_position


# Broadcasts of data-dependent sides happen only below this row count (checked, see below).
BROADCAST_MAX_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Size-checked broadcast for a side whose size depends on the data.

    The side is written once to the shared checkpoint folder (it usually is a
    small aggregate), its exact row count is read, and it is hinted for
    broadcast only when the count is within ``max_rows``; beyond that the
    plain (shuffle) join is kept.
    """
    from ..session import materialize
    m = materialize(df)
    return F.broadcast(m) if m.count() <= max_rows else m


# J01 ------------------------------------------------------------------------
def align_by_prompt(original: DataFrame, binarized: DataFrame, prompt: str = "prompt",
                    instruction: str = "instruction", orig_idx: str = "orig_idx",
                    unique_prompts: bool = False) -> DataFrame:
    """Each binarised row goes to the original row with an equal prompt.

    The reference walks a forward-only cursor; with unique prompts that is
    an equi-join.  Original prompts are de-duplicated first (smallest
    ``orig_idx`` kept) so repeated prompts cannot multiply rows; a caller whose
    original table is unique on the prompt by construction (e.g. grouped by
    it) passes ``unique_prompts=True`` and skips that aggregate.
    """
    if unique_prompts:
        o = original
    else:
        from .window import first_by
        o = first_by(original, [instruction], orig_idx)
    return binarized.join(o, binarized[prompt] == o[instruction], "inner")


# J02 ------------------------------------------------------------------------
def match_completion(df: DataFrame, completions: str = "completions", chosen: str = "chosen",
                     rejected: str = "rejected", response: str = "response",
                     ratings: str = "ratings") -> DataFrame:
    """Ratings of the completions whose text equals chosen / rejected.

    If a completion equals both, the chosen branch wins; later duplicates
    overwrite earlier ones (so the *last* match is taken).
    """
    comps = F.col(completions)
    ch = F.filter(comps, lambda c: c.getField(response) == F.col(chosen))
    rj = F.filter(comps, lambda c: (c.getField(response) != F.col(chosen)) & (c.getField(response) == F.col(rejected)))
    return (df.withColumn("chosen_ratings", at(ch, -1).getField(ratings))
              .withColumn("rejected_ratings", at(rj, -1).getField(ratings)))


# J03 ------------------------------------------------------------------------
#: keys of more than one in HOT_KEYS rows of a side are at most HOT_KEYS in number: their table is broadcast
HOT_KEYS = 200


def _hot_splits(side: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``_splits``): the hot keys of a side and into how many shares their rows are cut."""
    from ..session import materialize
    n = materialize(side.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    total = n.select(F.sum("_n")).scalar()
    return n.withColumn("_splits", F.ceil(F.col("_n") * HOT_KEYS / total).cast("int")).filter("_splits > 1").drop("_n")


def head2head(a: DataFrame, b: DataFrame, keys: Iterable[str], value: str = "output",
              ordered: bool = False, order: str | None = None, suffixes=("_1", "_2")) -> DataFrame:
    """Inner join of two output tables on ``keys``; value columns suffixed.

    Unordered: the distinct pairs of a key's outputs.  Each side is reduced to its distinct (key, output) rows
    before the join, so repeats never multiply and nothing is de-duplicated behind it; a key with more than one in
    ``HOT_KEYS`` rows of A is cut into shares, each joined with its own copy of B's rows of that key.
    Ordered: a positional key (rank within the key, by ``order``) is added to
    the join so the i-th output of A meets the i-th of B; ranks come from global positions, so a hot key's
    rows are spread over many tasks.
    """
    keys = list(keys)
    if ordered:
        from .window import group_position
        a2, b2 = (group_position(x.select(*keys, value, *([] if order in (*keys, value) else [order])), keys, order, "_k")
                  .select(*keys, "_k", F.col(value).alias(value + s)) for x, s in zip((a, b), suffixes))
        return a2.join(b2, [*keys, "_k"], "inner").drop("_k")
    a2 = a.select(*keys, F.col(value).alias(value + suffixes[0])).distinct()
    b2 = b.select(*keys, F.col(value).alias(value + suffixes[1])).distinct()
    hot = F.broadcast(_hot_splits(a2, keys))
    splits = F.coalesce("_splits", F.lit(1))
    a2 = a2.join(hot, keys, "left").withColumn("_share", F.pmod(F.xxhash64(value + suffixes[0]), splits).cast("int")).drop("_splits")
    b2 = b2.join(hot, keys, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), splits - 1))).drop("_splits")
    return a2.join(b2, [*keys, "_share"], "inner").drop("_share")


# J04 ------------------------------------------------------------------------
ANNOTATION_KEYS = ["instruction", "input", "output_1", "output_2", "annotator"]


def row_key(cols) -> tuple[Column, Column]:
    """128-bit key of several (possibly NULL, possibly long) columns: two salted ``xxhash64``
    over the values, their NULL flags and lengths, so NULL-safe equality of the columns maps
    to equality of the key (collision chance ~1e-15 at 10^12 rows)."""
    parts = []
    for c in cols:
        parts += [F.col(c).isNull(), F.length(F.col(c).cast("string")), F.col(c)]
    return F.xxhash64(F.lit("row-k1"), *parts), F.xxhash64(F.lit("row-k2"), *reversed(parts))


def reuse_annotations(todo: DataFrame, done: DataFrame, keys: Iterable[str] = ANNOTATION_KEYS,
                      preference: str = "preference", extra: Iterable[str] = ("chain_of_thoughts",)) -> DataFrame:
    """Left join on the key columns: ``preference = coalesce(stored, new)`` (same for extras).
    The store is reduced to one row per key first."""
    keys = list(keys)
    extra = [e for e in extra if e in done.columns]
    k1, k2 = row_key(keys)
    # the store is reduced to (128-bit key, label): the texts of the five keys are not shuffled.
    # A store written by merge_store is unique on the keys; if it is not, the row of the
    # smallest (label, extras) is taken per key (an aggregate, reduced map-side)
    store = (done.select(k1.alias("_k1"), k2.alias("_k2"), F.struct(
                F.col(preference).alias("p"), *[F.col(e).alias(e) for e in extra]).alias("_v"))
             .groupBy("_k1", "_k2").agg(F.min("_v").alias("_v")))
    j = todo.withColumn("_k1", k1).withColumn("_k2", k2).join(store, ["_k1", "_k2"], "left")
    j = j.select(*[F.col(c) for c in todo.columns], F.col("_v.p").alias("_old_pref"),
                 *[F.col(f"_v.{e}").alias(f"_old_{e}") for e in extra])
    new_pref = F.col(preference) if preference in todo.columns else F.lit(None)
    j = j.withColumn(preference, F.coalesce(F.col("_old_pref"), new_pref))
    for e in extra:
        new_e = F.col(e) if e in todo.columns else F.lit(None).cast("string")
        j = j.withColumn(e, F.coalesce(F.col(f"_old_{e}"), new_e))
    return j.drop("_old_pref", *[f"_old_{e}" for e in extra])


# J05 / J07 ------------------------------------------------------------------
def _user_rows(df: DataFrame, uid_value, uid: str, n: int | None, order: str) -> DataFrame:
    rows = df.filter(F.col(uid) == F.lit(uid_value))
    if n is not None:
        from .select import head
        rows = head(rows, int(n), order)
    return rows


def _user_digest(df: DataFrame, uid_value, uid: str, chosen: str, rejected: str, n: int | None,
                 order: str) -> DataFrame:
    """The user's rows reduced to hashes (pair key, chosen text) and ids, written once: both the
    pair-key table and the chosen-text counts derive from it without rescanning the input."""
    from ..session import materialize
    mine = _user_rows(df, uid_value, uid, n, order)
    k1, k2 = pair_hash(chosen, rejected)
    return materialize(mine.select(k1.alias("_k1"), k2.alias("_k2"),
                                   *[h.alias(c) for h, c in zip(row_key([chosen]), ("_t1", "_t2"))], F.col(order)))


def others_on_same_pairs(df: DataFrame, uid_value, uid: str = "uid", chosen: str = "chosen_only",
                         rejected: str = "rejected_only", n: int | None = None,
                         order: str = "cmp_id", digest: DataFrame | None = None) -> DataFrame:
    """Rows of *other* users whose unordered pair occurs among the user's (first ``n``) rows.
    A left-semi join on the 128-bit pair key."""
    if digest is None:
        digest = _user_digest(df, uid_value, uid, chosen, rejected, n, order)
    keys = broadcast_if_small(digest.select("_k1", "_k2").distinct())
    k1, k2 = pair_hash(chosen, rejected)
    others = df.filter(F.col(uid) != F.lit(uid_value)).withColumn("_k1", k1).withColumn("_k2", k2)
    return others.join(keys, ["_k1", "_k2"], "left_semi").drop("_k1", "_k2")


def agreement_join(df: DataFrame, uid_value, uid: str = "uid", chosen: str = "chosen_only",
                   rejected: str = "rejected_only", n: int | None = None,
                   order: str = "cmp_id") -> DataFrame:
    """For each other-user row on the user's pairs: how many of the user's rows chose the text
    this row chose (``agree``) and how many chose the text this row rejected (``disagree``).

    The user's rows are reduced to one row per chosen text (count and first
    id) and joined twice on the text's 128-bit hash: each other row meets at most one
    row per join, so no pair of rows within a group is ever emitted.
    """
    digest = _user_digest(df, uid_value, uid, chosen, rejected, n, order)
    counts = broadcast_if_small(digest.groupBy("_t1", "_t2").agg(
        F.count(F.lit(1)).alias("_m"), F.min(order).alias("_first_new")))
    others = others_on_same_pairs(df, uid_value, uid, chosen, rejected, n, order, digest=digest)
    o = others
    for side, names in ((chosen, ("_c1", "_c2")), (rejected, ("_r1", "_r2"))):
        o = o.withColumns(dict(zip(names, row_key([side]))))
    a = counts.select(F.col("_t1").alias("_c1"), F.col("_t2").alias("_c2"), F.col("_m").alias("agree"),
                      F.col("_first_new").alias("first_new"))
    d = counts.select(F.col("_t1").alias("_r1"), F.col("_t2").alias("_r2"), F.col("_m").alias("disagree"))
    j = o.join(a, ["_c1", "_c2"], "left").join(d, ["_r1", "_r2"], "left")
    return (j.withColumn("agree", F.coalesce("agree", F.lit(0)))
             .withColumn("disagree", F.coalesce("disagree", F.lit(0)))
             .withColumn("kind", F.when(F.col("agree") > 0, "agree").when(F.col("disagree") > 0, "disagree"))
             .drop("_c1", "_c2", "_r1", "_r2"))


# J06 ------------------------------------------------------------------------
def lookup_user_id(df: DataFrame, ids: DataFrame, key: str = "worker", out: str = "uid",
                   default: int = 0) -> DataFrame:
    """Worker -> id, unknown -> ``default``.  ``ids`` is a user list (size = number of users;
    Spark broadcasts it when under the threshold)."""
    return (df.join(ids.select(key, F.col(out).alias("_id")), key, "left")
              .withColumn(out, F.coalesce(F.col("_id"), F.lit(default)).cast("long")).drop("_id"))


# J08 / J13 / J14 ------------------------------------------------------------
def zip_positional(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Row i of A with row i of B (positions by distributed numbering, then an equi-join)."""
    pa = dense_position(a, order_a, "_pos")
    pb = dense_position(b, order_b, "_pos")
    dup = set(a.columns) & set(b.columns)
    pb = pb.select("_pos", *[F.col(c).alias(c + "_b" if c in dup else c) for c in b.columns])
    return pa.join(pb, "_pos", "inner").withColumnRenamed("_pos", "position")


def filter_by_aligned(a: DataFrame, b: DataFrame, key: str, predicate: Column) -> DataFrame:
    """Keep rows of A whose aligned row of B (same key) passes ``predicate`` (over B's columns)."""
    return a.join(b.filter(predicate).select(key), key, "left_semi")


def attach_embeddings(df: DataFrame, emb: DataFrame, key: str, cols: Iterable[str] = ("embedding",)) -> DataFrame:
    return df.join(emb.select(key, *cols), key, "left")


# J10 / J15 ------------------------------------------------------------------
def dialog_profile(dialogs: DataFrame, profiles: DataFrame, key: str = "user_id") -> DataFrame:
    """Dialog -> its user's profile (profiles: one row per user)."""
    return dialogs.join(profiles, key, "left")


def reference_response(outputs: DataFrame, dataset: DataFrame, keys=("dialog_id", "turn"),
                       response: str = "chosen", out: str = "reference") -> DataFrame:
    return outputs.join(dataset.select(*keys, F.col(response).alias(out)), list(keys), "left")


# J11 ------------------------------------------------------------------------
def prompts_for_users(prompts: DataFrame, n_users: int, prompt_id: str = "prompt_id",
                      baseline: bool = False) -> DataFrame:
    """Every prompt for users 0..n_users (baseline: user 0 only); id ``user_prompt``.

    The user list is generated per row (``explode(sequence)``), not joined.
    """
    users = F.sequence(F.lit(0), F.lit(0 if baseline else n_users))
    d = prompts.withColumn("user_id", F.explode(users)).withColumn("user_id", F.col("user_id").cast("long"))
    return d.withColumn("user_prompt_id", F.concat_ws("_", F.col("user_id").cast("string"),
                                                      F.col(prompt_id).cast("string")))


# J12 / L04 ------------------------------------------------------------------
def best_of_cell(vq: np.ndarray, vectors: np.ndarray, k: int, chunk_rows: int, scored: list | None = None,
                 scores_at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(scores, places): the k best of ``vectors`` for each row of ``vq``, ties by place; unused entries have place -1.

    ``scores_at_once`` bounds the scores held (one query's chunk at least): a chunk meets the queries in tiles.
    ``scored`` receives the numbers of (query, vector) pairs that were computed."""
    vectors = np.vstack(vectors) if len(vectors) else np.zeros((0, vq.shape[1]))
    with np.errstate(all="ignore"):
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    # what is not a finite number bounds nothing
    norms = np.where(np.isfinite(norms), norms, np.inf)
    order = np.argsort(-norms, kind="stable")
    with np.errstate(all="ignore"):
        q_norm = np.sqrt((vq * vq).sum(axis=1))
    q_norm = np.where(np.isfinite(q_norm), q_norm, np.inf)
    best_s, best_i = np.full((len(vq), k), -np.inf), np.full((len(vq), k), -1)
    active = np.arange(len(vq))
    for lo in range(0, len(order), chunk_rows):
        with np.errstate(invalid="ignore"):
            # rounding in the products is far below this slack
            limit = q_norm[active] * norms[order[lo]] * (1 + 1e-9)
        full = best_i[active, -1] >= 0
        active = active[~(full & (best_s[active, -1] > limit))]
        if not len(active):
            break
        places = np.sort(order[lo: lo + chunk_rows])
        if scored is not None:
            scored.append(len(active) * len(places))
        chunk = vectors[places].T
        tile = max(1, scores_at_once // len(places))
        for a in range(0, len(active), tile):
            part = active[a: a + tile]
            s = np.concatenate([best_s[part], vq[part] @ chunk], axis=1)
            i = np.concatenate([best_i[part], np.broadcast_to(places, (len(part), len(places)))], axis=1)
            # empty entries last, then score falling, then place
            pick = np.lexsort((i, -s, i < 0), axis=1)[:, :k]
            best_s[part], best_i[part] = np.take_along_axis(s, pick, axis=1), np.take_along_axis(i, pick, axis=1)
    return best_s, best_i


def similarity_top_k(queries: DataFrame, docs: DataFrame, k: int, qid: str = "qid", did: str = "did",
                     qvec: str = "qvec", dvec: str = "dvec", block_rows: int | None = None,
                     group: str | None = None, q_block_rows: int = 8192, d_block_bytes: int = 64 << 20,
                     chunk_rows: int = 4096) -> DataFrame:
    """Exact top-k documents per query by dot product (``rank`` 1 = best; ties by doc id).

    Blocked scoring of the query set against all documents: within each ``group`` (e.g. user; one group without it)
    queries are cut into blocks of ``q_block_rows`` and documents into blocks of about ``d_block_bytes`` of
    vectors (``block_rows`` sets both in rows); a (group, query block, document block) cell is one task's work in
    ``applyInArrow``, which walks the documents in chunks of ``chunk_rows`` with NumPy mat-muls and
    keeps a running top-k per query, so it needs memory for its blocks (one matrix each) and a bounded tile of
    scores, and emits only its local top-k.  Chunks go by falling norm: no document behind scores above |query| x its chunk's largest
    norm (Cauchy-Schwarz), so a query whose k-th score is above that is done with the cell.  A final
    ``row_number`` per query keeps the global top-k.  No pair becomes
    a row, nothing is broadcast, and groups meet only themselves.  Ids keep their types; NULL groups match
    nothing; infinite scores count like others.
    """
    dim = docs.select(F.greatest(F.max(F.size(dvec)), F.lit(1))).scalar()
    d_rows = F.lit(block_rows) if block_rows else F.greatest((F.lit(d_block_bytes) / (dim * 8)).cast("long"), F.lit(1024))
    q_rows = F.lit(block_rows or q_block_rows)
    g = F.col(group) if group else F.lit(0)
    q = queries.select(g.alias("_g"), F.col(qid).alias("_q"), F.col(qvec).alias("_v"))
    d = docs.select(g.alias("_g"), F.col(did).alias("_d"), F.col(dvec).alias("_v"))
    # block counts of each group; rows go to blocks by a hash of their id, which is deterministic and
    # balanced without numbering them
    if group:
        nq = q.groupBy("_g").agg(F.ceil(F.count("*") / q_rows).alias("_nq"))
        nd = d.groupBy("_g").agg(F.count("*").alias("_c")).select("_g", F.ceil(F.col("_c") / d_rows).alias("_nd"))
        blocks = nq.join(nd, "_g")
        q, d = q.join(blocks, "_g"), d.join(blocks, "_g")
    else:
        n_q = q.select(F.greatest(F.ceil(F.count("*") / q_rows), F.lit(1))).scalar()
        n_d = docs.select(F.greatest(F.count("*"), F.lit(1))).scalar()
        q, d = (x.withColumn("_nq", n_q).withColumn("_nd", F.ceil(n_d / d_rows)) for x in (q, d))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = lambda salt, c, n: F.pmod(F.xxhash64(F.lit(salt), F.col(c)), F.col(n))
    # a query row is copied once per document block of its group, a document row once per query block
    side_q = q.select("_g", block("qblock", "_q", "_nq").alias("_qb"), every("_nd").alias("_db"), "_q", "_v")
    side_d = d.select("_g", every("_nq").alias("_qb"), block("dblock", "_d", "_nd").alias("_db"), "_d", "_v")
    cells = side_q.unionByName(side_d.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    kk = int(k)
    q_type, d_type = (df.schema[c].dataType.simpleString() for df, c in ((queries, qid), (docs, did)))

    def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
        if len(pc.unique(pc.list_value_length(vectors))) > 1 or vectors.null_count:
            raise ValueError("vectors are null or of different lengths")
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in vectors.chunks]).astype(np.float64, copy=False)
        return flat.reshape(len(vectors), -1)

    def score(cell: pa.Table) -> pa.Table:
        query = pc.is_null(cell["_side"])
        qs, ds = (cell.select([c, "_v"]).filter(m) for c, m in (("_q", query), ("_d", pc.invert(query))))
        if not len(qs) or not len(ds):
            places, nth, best_s, some = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, kk)), np.zeros((0, kk), bool)
        else:
            order = pc.sort_indices(ds["_d"]).to_numpy()
            best_s, best_i = best_of_cell(matrix(qs["_v"]), matrix(ds["_v"])[order], kk, chunk_rows)
            some = best_i >= 0
            places, nth = order[best_i[some]].astype(np.int64), np.repeat(np.arange(len(qs)), some.sum(axis=1))
        return pa.table({"qid": qs["_q"].take(pa.array(nth)), "did": ds["_d"].take(pa.array(places)), "score": best_s[some]})

    cand = cells.groupBy("_g", "_qb", "_db").applyInArrow(score, f"qid {q_type}, did {d_type}, score double")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("did"))
    top = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= kk)
    return top.withColumnsRenamed({"qid": qid, "did": did})


# J16 / J17 ------------------------------------------------------------------
def user_vector(df: DataFrame, offsets: DataFrame, generic: Column, uid: str = "uid",
                offset: str = "offset", out: str = "user_vector") -> DataFrame:
    """Generic vector + the user's offset; uid 0 and unknown users get the generic vector.
    ``offsets`` is (uid, offset) with one row per user."""
    j = df.join(offsets.select(uid, F.col(offset).alias("_off")), uid, "left")
    # the generic vector becomes a column first: sub-queries may not sit inside lambdas
    j = j.withColumn("_gen", generic.cast("array<double>"))
    return j.withColumn(out, F.when((F.col(uid) == 0) | F.col("_off").isNull(), F.col("_gen"))
                        .otherwise(V.vec_add("_gen", "_off"))).drop("_off", "_gen")


def cluster_user_vector(df: DataFrame, clusters: Column, weights: str = "weights",
                        out: str = "user_vector") -> DataFrame:
    """softmax(user weights) . cluster vectors (clusters: array<array<double>> literal column)."""
    df = df.withColumn("_clusters", clusters)  # a column first: sub-queries may not sit inside lambdas
    clusters = F.col("_clusters")
    p = V.softmax_array(weights)
    dim = F.size(at(clusters, 1))
    zero = F.array_repeat(F.lit(0.0), dim)
    pairs = F.arrays_zip(p.alias("p"), clusters.alias("c"))
    s = F.aggregate(pairs, zero, lambda acc, x: F.zip_with(acc, x.getField("c").cast("array<double>"),
                                                            lambda a, b: a + x.getField("p") * b))
    return df.withColumn(out, s).drop("_clusters")
