"""Aggregations.

Every aggregate is a hash aggregate with map-side partial aggregation, so
a hot key (a user or pair holding a third of all rows) is reduced inside
each task before the shuffle; nothing collects an unbounded group into one
task.  Ties that the reference breaks by "first seen" are broken by the
smallest row id.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.util import computed_once


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def correct(a, b) -> Column:
    """1 when chosen scores strictly above rejected (a tie is wrong)."""
    return F.when(_c(a) > _c(b), 1).otherwise(0)


# G01 / G02 ------------------------------------------------------------------
def accuracy_by_user(df: DataFrame, uid: str = "uid", chosen: str = "reward_chosen",
                     rejected: str = "reward_rejected") -> DataFrame:
    """Share of rows with chosen > rejected, per user (plus the row count)."""
    return df.groupBy(uid).agg(F.avg(correct(chosen, rejected)).alias("accuracy"),
                               F.count(F.lit(1)).alias("n"))


# Benchmark subset -> category (4 categories, 23 subsets), in natural order.
CATEGORY_SUBSETS = {
    "chat": ["alpacaeval-easy", "alpacaeval-length", "alpacaeval-hard", "mt-bench-easy", "mt-bench-medium"],
    "chat hard": ["mt-bench-hard", "llmbar-natural", "llmbar-adver-neighbor", "llmbar-adver-GPTInst",
                  "llmbar-adver-GPTOut", "llmbar-adver-manual"],
    "safety": ["refusals-dangerous", "refusals-offensive", "xstest-should-refuse", "xstest-should-respond",
               "do not answer"],
    "reasoning": ["math-prm", "hep-cpp", "hep-go", "hep-java", "hep-js", "hep-python", "hep-rust"],
}


def category_table(spark) -> DataFrame:
    """(subset_no, subset, key): 23 rows, numbered in the order above."""
    rows = []
    for cat, subs in CATEGORY_SUBSETS.items():
        for s in subs:
            rows.append((len(rows), s, cat))
    return spark.createDataFrame(rows, "subset_no int, subset string, key string")


def accuracy_by_category(df: DataFrame, categories: DataFrame, on: str = "subset_no",
                         chosen: str = "reward_chosen", rejected: str = "reward_rejected") -> DataFrame:
    """Accuracy per benchmark category; the 23-row map is broadcast (fixed size)."""
    j = df.join(F.broadcast(categories.select(on, "key")), on, "inner")
    return j.groupBy("key").agg(F.avg(correct(chosen, rejected)).alias("accuracy"),
                                F.count(F.lit(1)).alias("n"))


# G05 ------------------------------------------------------------------------
def unordered_pair_key(a, b) -> tuple[Column, Column]:
    """(low, high) text of the unordered pair; a struct key has no join-string collisions."""
    return F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b))


def pair_hash(a, b) -> tuple[Column, Column]:
    """128-bit key of the unordered pair (two independently salted 64-bit hashes).

    Grouping on it shuffles 16 bytes per row instead of both texts; with
    10^12 rows the chance of any collision is about 10^-15.
    """
    lo, hi = unordered_pair_key(a, b)
    return (F.xxhash64(F.lit("pair-k1"), lo, hi), F.xxhash64(F.lit("pair-k2"), F.length(lo), lo, hi))


# G03 ------------------------------------------------------------------------
def majority_vote(df: DataFrame, chosen: str = "chosen_only", rejected: str = "rejected_only",
                  order: str = "cmp_id") -> DataFrame:
    """Group by the unordered pair (prompt not in the key); the majority chosen side wins,
    ties go to the side seen first; keep the first row that has the winning side.

    Plan: a narrow hash-key projection -> partial+final count per (pair, side)
    -> per-pair pick (again partially aggregated) -> join of the input on the
    winning row id (a broadcast when the winner table passes the size check,
    so the input is not shuffled).  Only ids and hashes are shuffled for the
    vote; hot pairs are reduced map-side.
    """
    h1, h2 = pair_hash(chosen, rejected)
    side = F.col(chosen) <= F.col(rejected)
    votes = (df.select(h1.alias("_h1"), h2.alias("_h2"), side.alias("_side"), F.col(order))
               .groupBy("_h1", "_h2", "_side")
               .agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")))
    best = votes.groupBy("_h1", "_h2").agg(
        F.max(F.struct(F.col("_n"), (-F.col("_first")).alias("_neg"), F.col("_first"))).alias("_b"),
        F.sum("_n").alias("_pair_n"))
    winners = best.select(F.col("_b._first").alias(order), F.col("_b._n").alias("votes"),
                          F.col("_pair_n").alias("pair_votes"))
    # one row per pair: broadcast only after its size is checked, else a shuffle join
    from .joins import broadcast_if_small
    return df.join(broadcast_if_small(winners), order, "inner")


# G04 ------------------------------------------------------------------------
def similar_user(agreement: DataFrame, other: str = "worker", agree: str = "agree",
                 disagree: str = "disagree", first_new: str = "first_new", order: str = "cmp_id") -> DataFrame:
    """The other user with the largest positive (sum agree - sum disagree).

    Input is ``joins.agreement_join`` output for one user.  Only positive
    totals survive; ties go to the user whose first agreeing row comes first
    (by the user's row, then the other row).  No positive total -> no row.
    """
    first = F.min(F.when(F.col(agree) > 0, F.struct(F.col(first_new).alias("f1"), F.col(order).alias("f2"))))
    s = agreement.groupBy(other).agg((F.sum(agree) - F.sum(disagree)).alias("score"), first.alias("_first"))
    best = s.filter(F.col("score") > 0).orderBy(F.desc("score"), F.asc("_first")).limit(1)
    return best.select(F.col(other).alias("similar_uid"), "score")


# G06 ------------------------------------------------------------------------
def head2head_metrics(df: DataFrame, preference: str = "preference", by: Iterable[str] = ()) -> DataFrame:
    """0 draw / 1 base wins / 2 method wins (other codes dropped):
    win_rate = mean(0.5, 0, 1) * 100, standard_error = sample sd / sqrt(n) * 100."""
    by = list(by)
    p = F.col(preference)
    kept = df.filter(p.isin(0, 1, 2))
    score = F.when(p == 0, 0.5).otherwise(p.cast("double") - 1.0)
    return kept.groupBy(*by).agg(
        (F.avg(score) * 100).alias("win_rate"),
        (F.stddev_samp(score) / F.sqrt(F.count(F.lit(1))) * 100).alias("standard_error"),
        F.count(F.when(p == 2, 1)).alias("n_wins"),
        F.count(F.when(p == 1, 1)).alias("n_wins_base"),
        F.count(F.when(p == 0, 1)).alias("n_draws"),
        F.count(F.lit(1)).alias("n_total"))


def metrics_from_counts(df: DataFrame, wins: str = "n_wins", base: str = "n_wins_base",
                        draws: str = "n_draws") -> DataFrame:
    """G06 from the three counts alone (the stored leaderboard has only counts)."""
    w, b, d = (F.col(wins).cast("double"), F.col(base).cast("double"), F.col(draws).cast("double"))
    n = w + b + d
    mean = (w + 0.5 * d) / n
    ss = w * (1 - mean) ** 2 + b * mean ** 2 + d * (0.5 - mean) ** 2
    sd = F.sqrt(ss / (n - 1))
    return df.withColumn("win_rate", mean * 100).withColumn("standard_error", sd / F.sqrt(n) * 100)


# G07 / G08 ------------------------------------------------------------------
def win_lose_tie_by_user(df: DataFrame, user: str = "user_id", preference: str = "preference",
                         label: str = "label") -> DataFrame:
    """3 = tie, equal to the label = win, anything else = loss; a missing annotation is skipped
    but its user still gets a row (with zeros)."""
    p, lab = F.col(preference), F.col(label)
    return df.groupBy(user).agg(
        F.count(F.when(p.isNotNull() & (p != 3) & (p == lab), 1)).alias("wins"),
        F.count(F.when(p.isNotNull() & (p != 3) & (p != lab), 1)).alias("losses"),
        F.count(F.when(p == 3, 1)).alias("ties"))


#: numerator and denominator of a win rate
WIN_RATES = {"prism": lambda w, l, t: (w + t, w + t + l + t), "psoups": lambda w, l, t: (w, w + l + t)}


def win_rates(counts: DataFrame, modes: Iterable[str] = ("prism", "psoups")) -> DataFrame:
    """One row per mode: pooled and per-user-mean win rate and the number of users, all from one pass over the counts.
    prism: (w+t)/(w+t+l+t); psoups: w/(w+l+t).  A zero denominator gives NULL."""
    def rate(mode, w, l, t):
        num, den = WIN_RATES[mode](w, l, t)
        return F.when(den > 0, num / den)
    modes = list(modes)
    own = [F.col(c) for c in ("wins", "losses", "ties")]
    total = [F.sum(c) for c in ("wins", "losses", "ties")]
    both = counts.agg(F.count(F.lit(1)).alias("n_users"),
                      *[x.alias(f"_{k}{i}") for i, m in enumerate(modes) for k, x in (("pooled", rate(m, *total)), ("mean", F.avg(rate(m, *own))))])
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"_pooled{i}").alias("pooled_win_rate"),
                              F.col(f"_mean{i}").alias("mean_user_win_rate"), F.col("n_users").alias("n_users")) for i, m in enumerate(modes)])
    return both.select(F.inline(rows))


def win_rate(counts: DataFrame, mode: str = "prism", user: str = "user_id") -> DataFrame:
    """Pooled and per-user-mean win rate of one mode (``win_rates``).  One output row."""
    return win_rates(counts, [mode]).drop("mode")


# G09 / G10 ------------------------------------------------------------------
def macro_average(metrics: DataFrame, by: Iterable[str] = ("run", "metric"), uid: str = "uid",
                  value: str = "value") -> DataFrame:
    """Mean over users per metric, skipping user 0 and NULL/NaN values."""
    v = F.col(value)
    ok = (F.col(uid) != 0) & v.isNotNull() & ~F.isnan(v)
    return metrics.groupBy(*by).agg(F.avg(F.when(ok, v)).alias("macro_avg"))


def global_stats(metrics: DataFrame, uid: str = "uid", metric: str = "metric", value: str = "value") -> DataFrame:
    """Mean per (user, metric) over runs (NaN skipped)."""
    v = F.col(value)
    return metrics.groupBy(uid, metric).agg(F.avg(F.when(~F.isnan(v), v)).alias("mean_value"),
                                            F.count(F.when(~F.isnan(v), 1)).alias("n_runs"))


# G11 / G12 ------------------------------------------------------------------
def question_groups(df: DataFrame, uid: str = "uid", key: str = "qkey",
                    fields: Iterable[str] = ("prompt",), max_group: int | None = 10_000) -> DataFrame:
    """A user's questions as sorted arrays of at most ``max_group`` entries (None: one array a user, for users
    whose questions fit a row).

    One row per (user, chunk_no): a user with more questions than
    ``max_group`` gets several consecutive chunks, so no single array (and no
    single task) has to hold a hot user's whole history.  Chunks are cut with
    the skew-safe per-group numbering.
    """
    from .window import group_position
    st = F.struct(F.col(key), *[F.col(f) for f in fields])
    if max_group is None:
        return df.groupBy(uid).agg(F.lit(0).cast("long").alias("chunk_no"), F.sort_array(F.collect_list(st)).alias("questions"))
    ranked = group_position(df, uid, key, "_rk", base=0)
    chunked = ranked.withColumn("chunk_no", F.floor(F.col("_rk") / max_group).cast("long"))
    return chunked.groupBy(uid, "chunk_no").agg(F.sort_array(F.collect_list(st)).alias("questions"))


def macro_micro_accuracy(df: DataFrame, uid: str = "uid", correct_col: str = "correct") -> DataFrame:
    """micro = all questions pooled, macro = mean of per-user means (one row)."""
    per_user = df.groupBy(uid).agg(F.avg(correct_col).alias("_acc"), F.sum(correct_col).alias("_s"),
                                   F.count(F.lit(1)).alias("_n"))
    return per_user.agg((F.sum("_s") / F.sum("_n")).alias("micro_accuracy"),
                        F.avg("_acc").alias("macro_accuracy"), F.count(F.lit(1)).alias("n_users"))


# G13 ------------------------------------------------------------------------
def length_stats(df: DataFrame, col: str, max_len: int | None = None, by: Iterable[str] = ()) -> DataFrame:
    """n, mean, max, min length and (with ``max_len``) the count above it."""
    ln = F.length(col)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(ln).alias("mean_len"), F.max(ln).alias("max_len"),
            F.min(ln).alias("min_len")]
    if max_len is not None:
        aggs.append(F.count(F.when(ln > max_len, 1)).alias("n_truncated"))
    return df.groupBy(*list(by)).agg(*aggs)


def merge_length_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """Merge two stats rows: means weighted by n, extremes combined, counts added."""
    u = a.unionByName(b, allowMissingColumns=True)
    aggs = [F.sum("n").alias("n"), (F.sum(F.col("mean_len") * F.col("n")) / F.sum("n")).alias("mean_len"),
            F.max("max_len").alias("max_len"), F.min("min_len").alias("min_len")]
    if "n_truncated" in u.columns:
        aggs.append(F.sum("n_truncated").alias("n_truncated"))
    return u.agg(*aggs)


# G14 ------------------------------------------------------------------------
def distinct_users(df: DataFrame, uid: str = "uid") -> DataFrame:
    return df.select(uid).distinct()


def distinct_keys(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.countDistinct(col).alias(f"n_distinct_{col}"))


# F03 (batch form) -------------------------------------------------------------
def categorical_batch_loss(df: DataFrame, logits_c: str, logits_r: str, entropy_coeff: float = 0.0,
                           by: Iterable[str] = ()) -> DataFrame:
    """Mean of -log P(chosen > rejected) plus ``entropy_coeff`` * sum_k m_k log m_k, where m is
    the mean of all chosen and rejected atom distributions (the training-time penalty).

    The mean distribution is an aggregate per atom (rows exploded to one row per atom and
    side, then averaged): partial aggregation, no array is collected.  A row's loss is averaged beside its atoms
    (as atom -1), so the rows are read once and a row's distributions are computed once."""
    by = list(by)
    d = computed_once(df.select(*by, logits_c, logits_r), _pc=V.softmax_array(logits_c), _pr=V.softmax_array(logits_r))
    loss = F.struct(F.lit(-1).alias("k"), (-F.log(V.preference_prob_of("_pc", "_pr"))).alias("p"))
    numbered = [F.transform(c, lambda p, i: F.struct(i.alias("k"), p.alias("p"))) for c in ("_pc", "_pr")]
    atoms = d.select(*by, F.explode(F.coalesce(F.concat(F.array(loss), *numbered), F.array(loss))).alias("_a"))
    mean = atoms.groupBy(*by, F.col("_a.k").alias("k")).agg(F.avg("_a.p").alias("m"))
    term = F.when(F.col("m") > 0, F.col("m") * F.log("m")).otherwise(0.0)
    res = mean.groupBy(*by).agg(F.max(F.when(F.col("k") < 0, F.col("m"))).alias("log_loss"),
                                F.sum(F.when(F.col("k") >= 0, term)).alias("neg_entropy"))
    if by:
        # a group without any atom has no distribution; a NULL is no group
        for c in [*by, "neg_entropy"]:
            res = res.filter(F.col(c).isNotNull())
    return res.withColumn("loss", F.col("log_loss") + F.lit(float(entropy_coeff)) * F.col("neg_entropy"))


# G16 / G17 / G19 / G20 ------------------------------------------------------
def pairwise_loss(df: DataFrame, chosen: str = "reward_chosen", rejected: str = "reward_rejected",
                  by: Iterable[str] = ()) -> DataFrame:
    """mean of -log sigma(chosen - rejected)."""
    return df.groupBy(*list(by)).agg(F.avg(V.log_sigmoid_loss(chosen, rejected)).alias("loss"))


def user_weighted_loss(df: DataFrame, alpha: float, uid: str = "uid", loss: str = "loss") -> DataFrame:
    """alpha * mean(individual) + (1-alpha) * mean(generic); an absent side contributes 0."""
    ind = F.avg(F.when(F.col(uid) != 0, F.col(loss)))
    gen = F.avg(F.when(F.col(uid) == 0, F.col(loss)))
    return df.agg((F.lit(alpha) * F.coalesce(ind, F.lit(0.0))
                   + F.lit(1 - alpha) * F.coalesce(gen, F.lit(0.0))).alias("weighted_loss"))


def accuracy_and_loss(df: DataFrame, chosen: str = "reward_chosen", rejected: str = "reward_rejected",
                      by: Iterable[str] = ()) -> DataFrame:
    """accuracy = share with loss < ln 2 (same as chosen > rejected), and mean loss."""
    loss = V.log_sigmoid_loss(chosen, rejected)
    return df.groupBy(*list(by)).agg(F.avg(correct(chosen, rejected)).alias("accuracy"),
                                     F.avg(loss).alias("loss"))


def reward_margin(df: DataFrame, chosen: str = "reward_chosen", rejected: str = "reward_rejected",
                  by: Iterable[str] = ()) -> DataFrame:
    return df.groupBy(*list(by)).agg(F.avg(correct(chosen, rejected)).alias("accuracy"),
                                     F.avg(F.col(chosen) - F.col(rejected)).alias("margin"))


# G18 ------------------------------------------------------------------------
def user_metric_table(df: DataFrame, uid: str = "uid", chosen: str = "reward_chosen",
                      rejected: str = "reward_rejected") -> DataFrame:
    """Per user and ``each`` (all uid != 0): accuracy, mean chosen, mean rejected.

    One pass: a row counts for its user and, unless that is 0, for ``each``; both are partial sums before the exchange.
    """
    u = F.col(uid).cast("string")
    d = df.withColumn("user", F.explode(F.when(F.col(uid) != 0, F.array(u, F.lit("each"))).otherwise(F.array(u))))
    return d.groupBy("user").agg(F.avg(correct(chosen, rejected)).alias("accuracy"),
                                 F.avg(chosen).alias("mean_chosen"), F.avg(rejected).alias("mean_rejected"))


# G21 ------------------------------------------------------------------------
def whiten(df: DataFrame, col: str, shift_mean: bool = True, out: str | None = None,
           min_rows: int = 8) -> DataFrame:
    """(x - mean)/(pop sd + 1e-8), optionally adding the mean back; needs >= ``min_rows`` rows.
    The global statistics are a one-row scalar sub-query."""
    stats = df.agg(F.avg(col).alias("m"), F.stddev_pop(col).alias("s"), F.count(F.lit(1)).alias("n"))
    m = stats.select("m").scalar()
    s = stats.select("s").scalar()
    n = stats.select("n").scalar()
    z = (F.col(col) - m) / (s + F.lit(1e-8))
    if shift_mean:
        z = z + m
    z = F.when(n >= min_rows, z).otherwise(F.raise_error(F.lit(f"whiten needs at least {min_rows} rows")))
    return df.withColumn(out or col, z)


# G22 ------------------------------------------------------------------------
def rollout_stats(df: DataFrame, kl: str = "kl", rewards: str = "shaped_rewards",
                  entropy: str = "entropies") -> DataFrame:
    """Means over sequences of summed KL, summed shaped reward and mean entropy."""
    def s(c):
        return F.aggregate(F.col(c).cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return df.agg(F.avg(s(kl)).alias("kl_sum_mean"), F.avg(s(rewards)).alias("shaped_reward_sum_mean"),
                  F.avg(s(entropy) / F.size(entropy)).alias("entropy_mean"),
                  F.count(F.lit(1)).alias("n_sequences"))


# G26 / G27 ------------------------------------------------------------------
def mean_choice(df: DataFrame, col: str = "choice") -> DataFrame:
    return df.agg(F.avg(col).alias("mean_choice"))


def dedupe_pairs(df: DataFrame, keys: Iterable[str], order: str | None = None) -> DataFrame:
    """One row per key: the first by ``order`` (stable) or any (``dropDuplicates``)."""
    keys = list(keys)
    if order is None:
        return df.dropDuplicates(keys)
    from .window import first_by
    return first_by(df, keys, order)
