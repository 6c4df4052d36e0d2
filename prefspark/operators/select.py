"""Sorts, limits, top-k and sampling.

Random choices are hash-seeded (``functions.random``): a pure function of
``(seed, key)``, so a re-run after a lost executor reproduces them.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa  # the Arrow UDF's type hints are resolved in this module
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.util import at, computed_once

from ..functions.random import fast_hash, seeded_hash, seeded_uniform, weighted_choice
from ..session import drop_finished, materialize, scratch_table_path, when_scratch_drops
from .window import dense_position, group_position, numbered

# ``orderBy().limit(n)`` plans a TakeOrderedAndProject: every task keeps its n
# best rows and one task merges (#tasks x n) rows.  Above this n that merge
# would be too large for one task at cluster scale, so rows are numbered in a
# distributed way instead.
TAKE_ORDERED_MAX = 10_000


# L01 / L21 ------------------------------------------------------------------
def head(df: DataFrame, n: int, order: str | list = "cmp_id") -> DataFrame:
    """First ``min(n, rows)`` rows, sorted by ``order`` (which must be unique)."""
    order = [order] if isinstance(order, str) else list(order)
    if n <= TAKE_ORDERED_MAX:
        return df.orderBy(*order).limit(int(n))
    return dense_position(df, order, "_pos").filter(F.col("_pos") < n).drop("_pos").orderBy(*order)


sanity_subset = head


# L02 / L19 ------------------------------------------------------------------
def sort_by(df: DataFrame, *cols) -> DataFrame:
    return df.orderBy(*cols)


def leaderboard_order(df: DataFrame, col: str = "win_rate") -> DataFrame:
    return df.orderBy(F.desc(col))


# L03 ------------------------------------------------------------------------
def top_workers(train: DataFrame, k: int = 5, worker: str = "worker", order: str = "cmp_id",
                out: str = "uid") -> DataFrame:
    """The ``k`` most frequent workers of ``train`` with ids 1..k by rank; ties by first seen.

    Returns a k-row table (worker, uid, n, first_id): partial counts per
    partition, one shuffle on ``worker``, then a global top-k (each task keeps
    k rows).  Its size is bounded by ``k``, so it may be broadcast.
    """
    counts = train.groupBy(worker).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_id"))
    top = counts.orderBy(F.desc("n"), F.asc("first_id")).limit(int(k))
    w = Window.orderBy(F.desc("n"), F.asc("first_id"))  # over k rows only
    return top.withColumn(out, F.row_number().over(w).cast("long"))


def keep_top_workers(df: DataFrame, top: DataFrame, worker: str = "worker", out: str = "uid") -> DataFrame:
    """Keep rows of the top workers and attach their 1..k id (k-row broadcast)."""
    return df.join(F.broadcast(top.select(worker, out)), worker, "inner")


# L04 / J12 ------------------------------------------------------------------
def top_k_similar(queries: DataFrame, docs: DataFrame, k: int = 3, qid: str = "qid", did: str = "did",
                  qvec: str = "qvec", dvec: str = "dvec", **kw) -> DataFrame:
    """Top-k docs per query by dot product (see ``joins.similarity_top_k``)."""
    from .joins import similarity_top_k
    return similarity_top_k(queries, docs, k, qid=qid, did=did, qvec=qvec, dvec=dvec, **kw)


# L05 ------------------------------------------------------------------------
def best_of_n(df: DataFrame, group: str = "prompt_id", score: str = "score",
              sample: str = "sample_no", payload: Iterable[str] = ("output",)) -> DataFrame:
    """Per group: the sample with the highest score (first sample on ties), plus all scores."""
    payload = list(payload)
    st = F.struct(F.col(score).alias("s"), (-F.col(sample)).alias("neg_no"), F.col(sample).alias("no"),
                  *[F.col(p) for p in payload])
    g = df.groupBy(group).agg(F.max(st).alias("_best"),
                              F.sort_array(F.collect_list(F.struct(F.col(sample).alias("no"),
                                                                   F.col(score).alias("s")))).alias("_all"),
                              F.count(F.lit(1)).alias("n_samples"))
    return g.select(group, F.col("_best.no").alias("best_sample"), F.col("_best.s").alias("best_score"),
                    *[F.col(f"_best.{p}").alias(f"best_{p}") for p in payload],
                    F.transform("_all", lambda x: x.getField("s")).alias("scores"), "n_samples")


# L06 ------------------------------------------------------------------------
def rerank_top_k(df: DataFrame, k: int, group: str = "group_id", score: str = "score",
                 index: str = "sample_no") -> DataFrame:
    """Per group, the k best samples (score desc, index asc) with their indices and scores."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(index))
    top = df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k)  # window group limit
    g = top.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_rk", index, score))).alias("_t"))
    return g.select(group, F.transform("_t", lambda x: x.getField(index)).alias("top_indices"),
                    F.transform("_t", lambda x: x.getField(score)).alias("top_scores"))


# L07 / L08 / J09 ------------------------------------------------------------
def _hash_rank(df: DataFrame, seed: int, key: str) -> tuple[DataFrame, int]:
    """Rows numbered from 1 in hash order, and how many there are."""
    rows, n = numbered(df.withColumn("_h", seeded_hash(seed, key)), ["_h", key], "_hr", base=1)
    return rows.drop("_h"), n


def holdout_split(df: DataFrame, frac: float = 0.1, seed: int = 0, key: str = "cmp_id",
                  out: str = "is_test") -> DataFrame:
    """Flag ``floor(frac * n)`` rows picked by a hash-seeded permutation; the rest are train."""
    rows, n = _hash_rank(df, seed, key)
    return rows.withColumn(out, F.col("_hr") <= F.floor(F.lit(n) * F.lit(float(frac)))).drop("_hr")


def split_fixed(df: DataFrame, eval_size: int, seed: int = 0, key: str = "cmp_id",
                out: str = "is_eval") -> DataFrame:
    """Exact-size split; ``eval_size`` must be below the row count."""
    rows, n = _hash_rank(df, seed, key)
    if eval_size >= n > 0:
        raise ValueError("eval_size must be below the row count")
    return rows.withColumn(out, F.col("_hr") <= eval_size).drop("_hr")


def complement(df: DataFrame, picked: DataFrame, key: str = "cmp_id") -> DataFrame:
    """Rows whose key is not in ``picked`` (J09, left anti join)."""
    return df.join(picked.select(key), key, "left_anti")


# L09 / L14 ------------------------------------------------------------------
def shuffle(df: DataFrame, seed: int = 0, key: str = "cmp_id") -> DataFrame:
    """Reproducible random order."""
    return df.orderBy(seeded_hash(seed, key), F.col(key))


def survey_pool(df: DataFrame, size: int, seed: int = 0, key: str = "cmp_id") -> DataFrame:
    """``size`` rows without replacement (the first ``size`` rows in hash order)."""
    return head(df.withColumn("_h", seeded_hash(seed, key)), size, ["_h", key]).drop("_h")


# L12 ------------------------------------------------------------------------
def upsample_controversial(df: DataFrame, times: int = 4, flag: str = "controversial",
                           out: str = "copy_no", seed: int | None = None, key: Iterable[str] = ("cmp_id",),
                           place: str = "place") -> DataFrame:
    """The table plus ``times`` extra copies of flagged rows (copy 0 is the original).  With a ``seed`` rows also get their
    ``place`` in a shuffle of all copies (hash order of ``key`` and copy; numbered without a global sort)."""
    n = F.when(F.col(flag), F.lit(times + 1)).otherwise(F.lit(1))
    rows = df.withColumn(out, F.explode(F.sequence(F.lit(0), n - 1)))
    if seed is None:
        return rows
    keys = [key] if isinstance(key, str) else list(key)
    return dense_position(rows.withColumn("_h", seeded_hash(seed, *keys, out)), ["_h", *keys, out], place).drop("_h")


# L13 ------------------------------------------------------------------------
def cap_per_subset(df: DataFrame, total: int, subset: str = "data_subset", order: str = "cmp_id") -> DataFrame:
    """If the row count exceeds ``total`` each subset keeps its first floor(total / #subsets) rows."""
    df = materialize(df)  # feeds both counts and the numbering: computed once
    stats = df.select(F.count(F.lit(1)).alias("n"), F.countDistinct(subset).alias("k"))
    n = stats.select("n").scalar()
    cap = stats.select(F.floor(F.lit(total) / F.col("k")).cast("long")).scalar()
    # subsets are few and large: rank with the skew-safe numbering, not a per-subset window
    ranked = group_position(df, subset, order, "_rn")
    return ranked.filter((n <= total) | (F.col("_rn") <= cap)).drop("_rn")


# L15 ------------------------------------------------------------------------
def context_target_split(df: DataFrame, n_ctx: int, n_tar: int | None, seed: int = 0,
                         user: str = "uid", key: str = "qkey", out: str = "role") -> DataFrame:
    """Per user, a hash-seeded permutation: first ``n_ctx`` are context, next ``n_tar`` targets
    (``n_tar=None``: all the rest); other rows get NULL."""
    r = group_position(df.withColumn("_h", seeded_hash(seed, user, key)), user, ["_h", key], "_rn").drop("_h")
    tar = F.col("_rn") > n_ctx if n_tar is None else (F.col("_rn") > n_ctx) & (F.col("_rn") <= n_ctx + n_tar)
    return r.withColumn(out, F.when(F.col("_rn") <= n_ctx, "context").when(tar, "target")).drop("_rn")


def evaluation_split(train: DataFrame, test: DataFrame, n_ctx: int, seed: int = 0, user: str = "uid",
                     key: str = "qkey", out: str = "role") -> DataFrame:
    """The evaluation form: per user of ``test``, ``n_ctx`` rows of ``train`` drawn without replacement as context, and every
    row of ``test`` as target.

    The draw is the first ``n_ctx`` rows of a user in hash order; each task keeps no more than that per user before the exchange
    (a rank limit), so a user with a third of all rows is no hot task, and test rows are not moved at all.  A
    user with fewer train rows is an error, as is one without any.
    """
    w = Window.partitionBy(user).orderBy("_h", key)
    users = test.select(user).distinct()
    context = (train.withColumn("_h", seeded_hash(seed, user, key)).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n_ctx))
    context = context.join(users, user, "left_semi")
    enough = users.join(context.groupBy(user).agg(F.count(F.lit(1)).alias("_n")), user, "left").select(
        F.when(F.coalesce(F.min(F.coalesce("_n", F.lit(0))), F.lit(n_ctx)) < n_ctx,
               F.raise_error(F.lit(f"a user has fewer than {n_ctx} train rows")).cast("int")).otherwise(F.lit(0))).scalar()
    targets = test.withColumn(out, F.lit("target")).withColumn("_ok", enough)
    context = context.drop("_h", "_rn").withColumn(out, F.lit("context")).withColumn("_ok", enough)
    return context.unionByName(targets).filter("_ok = 0").drop("_ok")


# L16 ------------------------------------------------------------------------
def derangement(df: DataFrame, keys: Iterable[str], value: str, seed: int = 0, id_col: str = "row_id",
                out: str = "paired_value") -> DataFrame:
    """Within each key group pair each row with a *different* row's value (a cyclic shift of a
    hash-seeded order); one-element groups keep their own value."""
    keys = list(keys)
    # global positions in (keys, hash, id): a hot key is spread over many range partitions
    d = dense_position(df.withColumn("_h", seeded_hash(seed, id_col)), keys + ["_h", id_col], "_p").drop("_h")
    span = d.groupBy(*keys).agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi"))
    d = d.join(span, keys, "inner")
    d = d.withColumn("_pp", F.when(F.col("_p") < F.col("_hi"), F.col("_p") + 1).otherwise(F.col("_lo")))
    partner = d.select(F.col("_p").alias("_pp"), F.col(value).alias(out))
    return d.join(partner, "_pp", "inner").drop("_p", "_pp", "_lo", "_hi")


# L17 / L18 ------------------------------------------------------------------
def seeded_choice(df: DataFrame, choices: list, probs: list | None = None, seed: int = 0,
                  key: str = "cmp_id", out: str = "choice") -> DataFrame:
    return df.withColumn(out, weighted_choice(seeded_uniform(seed, key), choices, probs))


def random_tie_label(value: Column, seed: int, key: Column) -> Column:
    """1 if value > 0, 0 if < 0, a hash coin flip at 0."""
    coin = (seeded_hash(seed, key) % 2).cast("int")
    return F.when(value > 0, 1).when(value < 0, 0).otherwise(coin)


def random_argmax(arr: Column, seed: int, key: Column) -> Column:
    """1-based arg-max of an array with hash-seeded ties."""
    m = F.array_max(arr)
    idx = F.filter(F.transform(arr, lambda x, i: F.when(x == m, i + 1)), lambda i: i.isNotNull())
    pick = (seeded_hash(seed, key) % F.size(idx)).cast("int") + 1
    return at(idx, pick)


# L20 ------------------------------------------------------------------------
def synthetic_pairs(base: DataFrame, pools: DataFrame, seed: int = 0, n_types: int = 10,
                    train_share: float = 0.8, split: str = "train", key: str = "row_id") -> DataFrame:
    """Synthetic pairs over sentence pools.

    ``base`` supplies one row per pair to make (its ``key`` seeds the draws),
    ``pools`` is (pool_no 0..3, sent_no, text).  Pair types 0..4 are agreed
    (pool 0 beats pool 1 for everybody), types 5..9 controversial (pool 2 vs
    pool 3, reversed for user type 1).  Train draws from the first ``train_share`` of
    a pool's sentences, test from the rest.  Pools are joined by (pool, sentence), an
    equi-join on a table whose size is the pool size.
    """
    b = base.select(key)
    pair_type = (seeded_hash(seed, key) % n_types).cast("int")
    user_type = (seeded_hash(seed + 1, key) % 2).cast("int")
    pool_a = F.when(pair_type < 5, 0).otherwise(2)
    sizes = pools.groupBy("pool_no").agg(F.count(F.lit(1)).alias("pool_n"))
    d = b.select(key, pair_type.alias("pair_type"), user_type.alias("user_type"),
                 pool_a.alias("pool_a"), (pool_a + 1).alias("pool_b"))
    d = (d.join(sizes.withColumnsRenamed({"pool_no": "pool_a", "pool_n": "na"}), "pool_a")
          .join(sizes.withColumnsRenamed({"pool_no": "pool_b", "pool_n": "nb"}), "pool_b"))

    def draw(s, n_col):
        cut = F.floor(F.col(n_col) * train_share)
        lo, span = (F.lit(0), cut) if split == "train" else (cut, F.col(n_col) - cut)
        return (lo + seeded_hash(s, key) % F.greatest(span, F.lit(1))).cast("int")
    d = d.withColumn("sent_a", draw(seed + 2, "na")).withColumn("sent_b", draw(seed + 3, "nb"))
    pa = pools.select(F.col("pool_no").alias("pool_a"), F.col("sent_no").alias("sent_a"), F.col("text").alias("text_a"))
    pb = pools.select(F.col("pool_no").alias("pool_b"), F.col("sent_no").alias("sent_b"), F.col("text").alias("text_b"))
    d = d.join(pa, ["pool_a", "sent_a"]).join(pb, ["pool_b", "sent_b"])
    flip = (F.col("pair_type") >= 5) & (F.col("user_type") == 1)
    return d.select(key, "pair_type", "user_type",
                    F.when(flip, F.col("text_b")).otherwise(F.col("text_a")).alias("chosen"),
                    F.when(flip, F.col("text_a")).otherwise(F.col("text_b")).alias("rejected"),
                    (F.col("pair_type") >= 5).alias("controversial"))


# L10 / L11 / U06 ------------------------------------------------------------
def draw_plan(ranges: list[int]) -> list[tuple[int, int]]:
    """(word, divisor) of successive draws below the given ranges: draw = word // divisor % range.  One 60-bit
    hash word serves several draws while their ranges' product stays under 2**40."""
    plan, word, div = [], 0, 1
    for r in ranges:
        if div * r > 1 << 40 and div > 1:
            word, div = word + 1, 1
        plan.append((word, div))
        div *= r
    return plan


UNROLLED = 16   # steps of Floyd's method that are columns of their own


def _floyd(df: DataFrame, words: Column, plan: list[tuple[int, int]], lo: int, hi: int, m: int, out: str = "_idx") -> DataFrame:
    """``df`` with lo..hi distinct positions in [0, m) by Floyd's method: step k draws from the first m - n + k + 1 positions
    and takes the last of them where the draw is already taken.  The first draw of the plan is n.

    Up to ``UNROLLED`` steps are plain columns (compiled, each computed once a row); more are folded over an array."""
    # the hash words are made first, so that no step computes them again
    df = df.withColumn("_words", words)
    drawn = lambda j, below: (F.call_function("div", at("_words", plan[j][0] + 1), F.lit(plan[j][1]).cast("long")) % below).cast("int")
    df = df.withColumn("_n", (F.lit(lo) + drawn(0, F.lit(hi - lo + 1))).cast("int"))
    top = lambda k: F.lit(m) - F.col("_n") + k
    if hi <= UNROLLED:
        # all steps are computed, the first n used
        df = df.withColumns({f"_d{k}": drawn(k + 1, top(F.lit(k)) + 1) for k in range(hi)})
        for k in range(hi):
            d = F.col(f"_d{k}")
            df = df.withColumn(f"_x{k}", F.when(d.isin(*[F.col(f"_x{i}") for i in range(k)]), top(F.lit(k))).otherwise(d) if k else d)
        taken = F.slice(F.array(*[F.col(f"_x{k}") for k in range(hi)]), 1, F.col("_n")) if hi else F.array().cast("array<int>")
        return df.withColumn(out, taken).drop("_words", "_n", *[f"_{c}{k}" for k in range(hi) for c in "dx"])

    def step(acc, k):
        j = k + 2
        word = at("_words", at(F.array(*[F.lit(w + 1) for w, _ in plan]), j))
        x = (F.call_function("div", word, at(F.array(*[F.lit(d).cast("long") for _, d in plan]), j)) % (top(k) + 1)).cast("int")
        more = F.concat(acc, F.array(F.when(F.array_contains(acc, x), top(k).cast("int")).otherwise(x)))
        return F.when(k < F.col("_n"), more).otherwise(acc)
    folded = F.aggregate(F.array(*[F.lit(k) for k in range(hi)]), F.array().cast("array<int>"), step)
    return df.withColumn(out, folded).drop("_words", "_n")


class AcceptedChoices:
    """All choices of ``lo``..``hi`` pool rows that have exactly one type in common, by counting.

    ``ways[r][a][p]`` is how many sets of ``r`` rows at positions >= ``p`` turn the common types ``a`` into a single one (``a``
    = -1: none chosen yet).  So the k-th accepted set (in order of its positions) is found by ``hi`` binary
    searches.  A number of rows n is chosen as repeated uniform draws would come to it: by the share of accepted
    sets among all sets of n.  The table has pool x ``hi`` x (at most 2^types) counts.
    """

    def __init__(self, masks: list[int], lo: int, hi: int):
        self.masks, self.lo, self.hi, m = masks, lo, hi, len(masks)
        states = {-1}
        for mask in masks:
            states |= {a & mask for a in states}
        ways = [{a: [int(a > 0 and a & (a - 1) == 0)] * (m + 1) for a in states}]
        for _ in range(hi):
            more = {}
            for a in states:
                w = [0] * (m + 1)
                for p in range(m - 1, -1, -1):
                    w[p] = w[p + 1] + ways[-1][a & masks[p]][p + 1]
                more[a] = w
            ways.append(more)
        self.totals = [ways[n][-1][0] for n in range(lo, hi + 1)]
        shares = [t / math.comb(m, n) for t, n in zip(self.totals, range(lo, hi + 1))]
        self.bounds = list(itertools.accumulate(shares))
        # counts beyond 64 bits stay Python numbers
        kind = np.int64 if max(self.totals, default=0) < 1 << 62 else object
        self.kind = kind
        # sets whose first position lies below p
        self.before = {(r, a): np.array([w[0] - x for x in w], kind) for r in range(1, hi + 1) for a, w in ways[r].items()}

    def __bool__(self) -> bool:
        return any(self.totals)

    def choose(self, size_word: np.ndarray, rank_words: np.ndarray, order_word: np.ndarray) -> list[np.ndarray]:
        """Positions chosen by 60-bit hash words: one for the number of rows, two for the set's rank, one for its order."""
        n, out = self.chosen(size_word, rank_words, order_word)
        return [x[:c] for x, c in zip(out, n)]

    def chosen(self, size_word: np.ndarray, rank_words: np.ndarray, order_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of rows, their positions in a table of ``hi`` columns) of ``choose``."""
        u = size_word / float(1 << 60) * self.bounds[-1]
        n = self.lo + np.minimum(np.searchsorted(self.bounds, u, side="right"), self.hi - self.lo)
        total = np.array([*[1] * self.lo, *[max(t, 1) for t in self.totals]], self.kind)[n]
        if self.kind is object:
            rank = (rank_words[:, 0].astype(object) << 60 | rank_words[:, 1].astype(object)) % total
        else:
            rank = rank_words[:, 0] % total
        rows = len(n)
        at, state, out = np.zeros(rows, np.int64), np.full(rows, -1), np.zeros((rows, self.hi), np.int64)
        masks = np.array(self.masks)
        for k in range(self.hi):
            left = np.where(n > k, n - k, 0)
            for r, a in set(zip(left.tolist(), state.tolist())) if rows else ():
                if not r:
                    continue
                i = np.flatnonzero((left == r) & (state == a))
                before = self.before[r, a]
                want = before[at[i]] + rank[i]
                p = np.searchsorted(before, want, side="right") - 1
                rank[i] = want - before[p]
                out[i, k], at[i] = p, p + 1
            chosen = left > 0
            state[chosen] = np.where(state[chosen] < 0, masks[out[chosen, k]], state[chosen] & masks[out[chosen, k]])
        # a random order of each set: the last of the rows not yet placed changes with a drawn one
        for k in range(self.hi - 1, 0, -1):
            i = np.flatnonzero(n > k)
            j = order_word[i] % (k + 1)
            order_word[i] //= k + 1
            out[i, k], out[i, j] = out[i, j], out[i, k]
        return n, out


def survey_contexts(df: DataFrame, survey: DataFrame, max_len: int, seed: int = 0, mode: str = "84",
                    key: str = "Index", survey_key: str = "Index", subsets: str = "satisfied_subset",
                    copy: str | None = None, hash_kind: str = "xxhash") -> DataFrame:
    """Draw survey rows as contexts for every row (hash-seeded, without replacement).

    The survey is a pool of known size (``survey_pool`` output, bounded by its
    ``size`` argument); its type sets become bit masks.  Mode ``84``: 1..max_len contexts.  Other modes:
    2..max_len.  Mode ``single``: the chosen rows have exactly one type in common; the choice has the
    distribution of draws repeated until that holds, but is drawn at once (``AcceptedChoices``).  A
    pool that cannot give such a choice is refused.
    """
    rows = survey.select(F.col(survey_key).alias("original_id"), *[F.col(c) for c in survey.columns if c != survey_key])
    # the pool is small and read several times: computed once
    rows = materialize(rows)
    # a scalar sub-query: every task gets the pool without a join
    pool = rows.select(F.sort_array(F.collect_list(F.struct("*")))).scalar()
    lo = 1 if mode == "84" else 2
    seed_key = [key] + ([copy] if copy else [])
    # md5 draws can be replayed by any SQL engine; xxhash64 is cheaper
    h = seeded_hash if hash_kind == "md5" else fast_hash

    def finished(d: DataFrame) -> DataFrame:
        return (d.withColumn("_pool", pool).withColumn("contexts", F.transform("_idx", lambda i: at("_pool", i + 1)))
                 .withColumn("context_length", F.size("contexts")).drop("_pool", "_idx"))

    if mode != "single":
        m = rows.count()
        hi = min(max_len, m)
        lo = min(lo, hi)
        plan = draw_plan([hi - lo + 1] + [m] * hi)
        words = F.array(*[h(seed, *seed_key, F.lit(0), F.lit(w)) for w in range(plan[-1][0] + 1)])
        return finished(_floyd(df, words, plan, lo, hi, m))

    pool_rows = rows.select("original_id", subsets).orderBy("original_id").collect()
    names = sorted({x for r in pool_rows for x in r[subsets]})
    masks = [sum(1 << names.index(x) for x in set(r[subsets])) for r in pool_rows]
    hi = min(max_len, len(masks))
    choices = AcceptedChoices(masks, min(lo, hi), hi)
    if not choices:
        raise ValueError("no choice of survey rows has exactly one type in common")
    low = F.lit((1 << 60) - 1)

    @F.arrow_udf("array<int>")
    def chosen(size: pa.Array, rank: pa.Array, more: pa.Array, order: pa.Array) -> pa.Array:
        size, rank, more, order = (np.array(x, np.int64) for x in (size, rank, more, order))
        n, out = choices.chosen(size, np.stack([rank, more], axis=1), order)
        # one flat buffer for all rows
        flat = out[np.arange(out.shape[1]) < n[:, None]].astype(np.int32)
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), flat)

    words = [h(seed, *seed_key, F.lit(w)).bitwiseAND(low) for w in ("size", "rank", "more", "order")]
    return finished(df.withColumn("_idx", chosen(*words))).withColumn("identified", F.lit(True))


# bounds of what one call of ``_asked``, ``_answered`` or ``_placed`` holds: draws of a block of rows (fewer if a field's
# size has no bound), pool rows of a range and draws from it
DRAWS_PER_BLOCK, TEXT_DRAWS_PER_BLOCK = 1 << 20, 1 << 14
ROWS_PER_RANGE, DRAWS_PER_RANGE = 1 << 18, 1 << 21
_FIXED_SIZE = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _gaps(x: np.ndarray) -> np.ndarray:
    """Ascending distinct numbers as their gaps, in units of one or two bytes; a full unit goes on in the next one."""
    gap = np.diff(x, prepend=0)
    most = min((255, 65535), key=lambda most: (gap // most + 1).sum() * (1 if most == 255 else 2))
    n = gap // most + 1
    out = np.full(n.sum(), most, np.uint8 if most == 255 else np.uint16)
    out[np.cumsum(n) - 1] = gap % most
    return out


def _of_gaps(units: np.ndarray) -> np.ndarray:
    return np.cumsum(units, dtype=np.int64)[units != np.iinfo(units.dtype).max]


def _asked(size: int):
    """A block's drawn positions, each once: one row for every range of ``size`` positions."""
    def run(block: pa.Table) -> pa.Table:
        at = np.unique(block["_p"].combine_chunks().flatten().to_numpy(zero_copy_only=False))
        ranges, first = np.unique(at // size, return_index=True)
        gaps = [_gaps(x - r * size) for r, x in zip(ranges, np.split(at, first[1:]))]
        return pa.table({"_range": pa.array(ranges, pa.int32()), "_block": pa.array([block["_block"][0].as_py()] * len(ranges), pa.int32()),
                         "gaps": pa.array([x.tobytes() for x in gaps], pa.binary()), "wide": pa.array([x.itemsize == 2 for x in gaps], pa.bool_())})
    return run, "_range int, _block int, gaps binary, wide boolean"


def _answered(names: list[str], planes: bool):
    """The pool rows asked for, packed by block.  A range's pool rows come before what is asked of it, in order of
    their positions; only they are held."""
    def packed(rows: pa.RecordBatch) -> tuple[bytes, int]:
        raw = np.frombuffer(rows.serialize(), np.uint8)
        if planes:  # the n-th bytes of all numbers stand together
            raw = np.append(raw, np.zeros(-len(raw) % 8, np.uint8)).reshape(-1, 8).T
        return pa.compress(raw.tobytes(), "zstd", asbytes=True), raw.size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        now, held, whole, out, space = None, [], None, [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(dict(zip(("_block", "_range", "packed", "size"), zip(*out))), schema=pa.schema(
                [("_block", pa.int32()), ("_range", pa.int32()), ("packed", pa.binary()), ("size", pa.int32())]))

        for batch in batches:
            ranges, blocks = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("_range", "_block"))
            cuts = np.flatnonzero((np.diff(ranges) != 0) | ((blocks[1:] < 0) != (blocks[:-1] < 0))) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ranges)] if len(ranges) else []):
                if ranges[a] != now:
                    now, held, whole = ranges[a], [], None
                if blocks[a] < 0:
                    held.append(batch.slice(a, b - a).select(names))
                    continue
                if whole is None:
                    whole, held = pa.Table.from_batches(held).combine_chunks().to_batches()[0], []
                for i in range(a, b):
                    units = np.frombuffer(batch["gaps"][i].as_buffer(), np.uint16 if batch["wide"][i].as_py() else np.uint8)
                    out.append((blocks[i], now, *packed(whole.take(pa.array(_of_gaps(units))))))
                    space += len(out[-1][2])
                    if space > 1 << 22:
                        yield done()
                        out, space = [], 0
        if out:
            yield done()
    return run, "_block int, _range int, packed binary, size int"


def _placed(columns: list[str], key: str, n: int, lists_of: pa.DataType, planes: bool):
    """The rows of a block with the pool rows at their drawn positions.  Equal keys have the draws of all their rows,
    ordered by the number of the draw; a NULL key has none."""
    kind = pa.schema(lists_of.value_type)

    def unpacked(blob: pa.Scalar, size: int) -> pa.RecordBatch:
        raw = pa.decompress(blob.as_buffer(), size, "zstd")
        if planes:
            raw = pa.py_buffer(np.frombuffer(raw, np.uint8).reshape(8, -1).T.tobytes())
        return pa.ipc.read_record_batch(raw, kind)

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        lists = block["_p"].combine_chunks()
        at, back = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        order = np.argsort(answers["_range"].to_numpy()) if answers.num_rows else []
        found = pa.Table.from_batches([unpacked(answers["packed"][i], answers["size"][i].as_py()) for i in order], kind)
        if len(found) != len(at):
            raise ValueError(f"{len(found)} pool rows for {len(at)} positions")
        codes = block[key].combine_chunks().dictionary_encode().indices
        known = codes.is_valid().to_numpy(zero_copy_only=False)
        codes = codes.drop_null().to_numpy()
        rows = np.bincount(codes) if len(codes) else np.zeros(0, np.int64)
        sizes = np.zeros(len(known), np.int64)
        sizes[known] = rows[codes] * n
        ends = np.cumsum(sizes)
        if len(rows) < len(codes):
            k, size = rows[codes], sizes[known]
            member, first = np.argsort(codes, kind="stable"), (np.cumsum(rows) - rows)[codes]
            t = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            k = np.repeat(k, size)
            back = back[member[np.repeat(first, size) + t % k] * n + t // k]
        found = found.take(pa.array(back)).combine_chunks()
        fields = [c.combine_chunks() for c in found.columns]
        contexts = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind)),
                                            lists_of, mask=pa.array(~known))
        return block.select(columns).append_column("contexts", contexts)
    return run


def random_contexts(df: DataFrame, pool: DataFrame, n: int = 8, seed: int = 0, key: str = "Index",
                    prompt: str = "prompt", fields: Iterable[str] = ("chosen", "rejected"),
                    columns: Iterable[str] | None = None) -> DataFrame:
    """For each row draw exactly ``n`` pool rows *with* replacement among those of another prompt.

    The pool is numbered by (prompt hash, key), so a prompt's rows are one range [lo, hi).  A draw p from the
    m - (hi - lo) other positions skips the range (p >= lo moves up by its length): every draw counts.
    A context has its ``original_id`` and ``fields`` of the pool row (none: ids only, and no text moves).  ``columns`` of
    ``df`` (default: all) stay.  A row whose prompt is the pool's only one fails.

    Rows meet the pool in blocks: a block (rows by the hash of their key) asks each range of positions once for all it drew there,
    as gaps of about a byte, and gets the pool rows in the same order, packed.  So a draw moves as a few bytes, not as a row on
    its way to the pool and another one back; draws are computed again where their contexts are put together.
    """
    spark, fields = df.sparkSession, [c for c in fields if c in pool.columns]
    columns = [key, *(c for c in (df.columns if columns is None else columns) if c != key)]
    # a table has no column of nulls only
    void = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    stored = [c for c in columns if c not in void or c == key]
    ph = F.unhex(F.md5(prompt)).alias("_ph")
    idx, m = numbered(pool.select(key, ph, *fields), ["_ph", key], "_pidx")
    drop_finished(spark)
    span = idx.groupBy("_ph").agg(F.min("_pidx").alias("_lo"), F.count("*").alias("_len"))
    held = idx.select("_pidx", F.col(key).alias("original_id"), *fields)
    of_pool = T.StructType(held.schema.fields[1:])
    planes = all(isinstance(f.dataType, _FIXED_SIZE) for f in of_pool)
    draws = df.count() * n
    blocks = max(1, -(-draws // (DRAWS_PER_BLOCK if planes else TEXT_DRAWS_PER_BLOCK)))
    size = max(1, -(-m // max(1, -(-m // ROWS_PER_RANGE), -(-draws // DRAWS_PER_RANGE))))
    length = F.coalesce("_len", F.lit(0))
    others = F.when(length < m, F.lit(m) - length).otherwise(F.raise_error(F.lit("no pool row of another prompt")).cast("long"))
    block = F.pmod(F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64("_ph")), F.lit(blocks)).cast("int")
    rows = df.select(*columns, ph).join(span, "_ph", "left").select(
        *stored, F.coalesce("_lo", F.lit(0)).alias("_lo"), others.alias("_others"), block.alias("_block"))
    # bucketed by block: read twice where they lie, for the questions and for the answers
    name, parts = f"context_rows_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    when_scratch_drops(lambda: spark.sql(f"DROP TABLE IF EXISTS {name}"))
    rows.repartition(parts, "_block").write.bucketBy(parts, "_block").option("path", scratch_table_path(spark, name)).saveAsTable(name)
    rows = spark.table(name)
    drop_finished(spark)
    p = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda d: seeded_hash(seed, key, d) % F.col("_others"))
    p = F.transform(p, lambda x: F.when(x >= F.col("_lo"), x + (F.lit(m) - F.col("_others"))).otherwise(x))
    drawn = F.when(F.col(key).isNotNull(), p).alias("_p")
    run, out = _asked(size)
    asked = materialize(rows.select("_block", drawn).groupBy("_block").applyInArrow(run, out))
    drop_finished(spark)
    both = held.withColumns({"_range": F.expr(f"_pidx div {size}").cast("int"), "_block": F.lit(-1)}).unionByName(asked, allowMissingColumns=True)
    run, out = _answered(of_pool.names, planes)
    answers = both.repartition("_range").sortWithinPartitions("_range", "_block", "_pidx").mapInArrow(run, out)
    out = T.StructType([*rows.select(*stored).schema.fields, T.StructField("contexts", T.ArrayType(of_pool, False))])
    run = _placed(stored, key, n, to_arrow_schema(out).field("contexts").type, planes)
    c = rows.select(*stored, "_block", drawn).groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(run, out)
    # rows of equal keys: a draw's contexts in their own order
    k = (F.size("contexts") / n).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda d: F.sort_array(F.slice("contexts", d * k + 1, k)))
    contexts = F.when(F.size("contexts") > n, F.flatten(each)).otherwise(F.col("contexts")).alias("contexts")
    return c.select(*[c if c in stored else F.lit(None).alias(c) for c in columns], contexts)


def replicate_with_new_contexts(df: DataFrame, survey: DataFrame, k: int, max_len: int, out: str = "copy_no", **kw) -> DataFrame:
    """K copies of every row, each with contexts of its own (the copy number enters the seeds)."""
    copies = df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return survey_contexts(copies, survey, max_len, copy=out, **kw)
