"""Vector and loss functions over array columns.

Vectors are ``array<float|double>``; maths is done in double with the
higher-order functions ``zip_with`` / ``aggregate`` / ``transform`` so it
stays inside the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .util import at


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _d(x) -> Column:
    return _c(x).cast("array<double>")


# F01 / F32 / F16-loss ------------------------------------------------------
def softplus(x: Column) -> Column:
    """log(1 + e^x), stable for large |x|."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    """Logistic function, stable on both tails."""
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def preference_probability(a, b) -> Column:
    """F32: sigma(a - b)."""
    return sigmoid(_c(a) - _c(b))


def log_sigmoid_loss(a, b) -> Column:
    """-log sigma(a - b) = softplus(-(a - b))."""
    return softplus(-(_c(a) - _c(b)))


# F02 ----------------------------------------------------------------------
def mean_variance_loss(mean_c, raw_c, mean_r, raw_r) -> Column:
    """softplus(-z * sqrt(2*pi)) with z = (mu_c - mu_r)/sqrt(s_c^2 + s_r^2), s = softplus(raw)."""
    sc, sr = softplus(_c(raw_c)), softplus(_c(raw_r))
    z = (_c(mean_c) - _c(mean_r)) / F.sqrt(sc * sc + sr * sr)
    return softplus(-z * F.lit(math.sqrt(2 * math.pi)))


# F03 ----------------------------------------------------------------------
def _bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once a row: a lambda computes what it holds anew for every element."""
    return at(F.transform(F.array(value), f), 1)


def softmax_array(logits) -> Column:
    x = _d(logits)
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    shifted = _bound(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp(v - m)))
    return _bound(shifted, lambda e: _bound(total(e), lambda s: F.transform(e, lambda v: v / s)))


def categorical_preference_prob(logits_c, logits_r) -> Column:
    """P(chosen > rejected) over ordered atoms with 1/2 on ties:
    sum_i p_c[i] * (CDF_r[i-1] + 0.5 * p_r[i])."""
    return preference_prob_of(softmax_array(logits_c), softmax_array(logits_r))


def preference_prob_of(pc, pr) -> Column:
    """``categorical_preference_prob`` of distributions, in one walk over both."""
    both = F.zip_with(_c(pc), _c(pr), lambda c, r: F.struct(c.alias("c"), r.alias("r")))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("cdf"))
    step = lambda a, x: F.struct((a["sum"] + x["c"] * (a["cdf"] + 0.5 * x["r"])).alias("sum"), (a["cdf"] + x["r"]).alias("cdf"))
    return F.aggregate(both, start, step, lambda a: a["sum"])


def categorical_loss(logits_c, logits_r) -> Column:
    """-log P(chosen > rejected)."""
    return -F.log(categorical_preference_prob(logits_c, logits_r))


def entropy(p) -> Column:
    return -F.aggregate(_d(p), F.lit(0.0), lambda a, v: a + F.when(v > 0, v * F.log(v)).otherwise(0.0))


# F04 ----------------------------------------------------------------------
def kl_normal(mean, logvar, factor: float = 0.5) -> Column:
    """-factor * sum(1 + lv - m^2 - e^lv); factor 0.5 in training, 1 in evaluation."""
    t = F.zip_with(_d(mean), _d(logvar), lambda m, lv: 1 + lv - m * m - F.exp(lv))
    return F.lit(-float(factor)) * F.aggregate(t, F.lit(0.0), lambda a, v: a + v)


# F05 / F09 / F10 / F28 -----------------------------------------------------
def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def pair_diff(a, b) -> Column:
    return F.zip_with(_d(a), _d(b), lambda x, y: x - y)


def vec_add(a, b) -> Column:
    return F.zip_with(_d(a), _d(b), lambda x, y: x + y)


def scale(a, s) -> Column:
    s = _c(s) if not isinstance(s, (int, float)) else F.lit(float(s))
    return F.transform(_d(a), lambda x: x * s)


def argmax(a) -> Column:
    """1-based position of the first maximum."""
    return F.array_position(_c(a), F.array_max(_c(a)))


def argmax_match(pred, label) -> Column:
    return argmax(pred) == argmax(label)


def prior_scale(a) -> Column:
    """L2-normalise then multiply by sqrt(dim)."""
    v = _d(a)
    k = F.sqrt(F.size(v).cast("double")) / norm(v)
    return F.transform(v, lambda x: x * k)


# F06 / F07 / F08 ----------------------------------------------------------
def pool_mean(vectors, mask) -> Column:
    """Masked mean of token vectors (array<array<double>>, mask array<int>)."""
    vs = F.col(vectors) if isinstance(vectors, str) else vectors
    m = _c(mask)
    kept = F.filter(F.zip_with(vs, m, lambda v, k: F.when(k != 0, v)), lambda v: v.isNotNull())
    dim = F.size(at(vs, 1))
    n = F.size(kept).cast("double")
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(kept, zero, lambda acc, v: F.zip_with(acc, v.cast("array<double>"), lambda a, b: a + b))
    return F.transform(total, lambda x: x / n)


def pool_last(vectors, length) -> Column:
    """Vector of the last real token (1-based ``length``)."""
    return at(_c(vectors), _c(length).cast("int"))


def pool_position_weighted(vectors, length) -> Column:
    """sum_i i*v_i / sum_i i over the first ``length`` tokens (i 1-based)."""
    vs = _c(vectors)
    n = _c(length).cast("int")
    dim = F.size(at(vs, 1))
    zero = F.array_repeat(F.lit(0.0), dim)
    real = F.slice(vs, 1, n)
    weighted = F.transform(real, lambda v, i: F.transform(v.cast("array<double>"), lambda x: x * (i + 1)))
    total = F.aggregate(weighted, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    denom = (n * (n + 1) / 2).cast("double")
    return F.transform(total, lambda x: x / denom)


# F11 ----------------------------------------------------------------------
def gaussian_log_prob(x, mean, raw_std, mode: str = "exp", min_std: float = 1e-6) -> Column:
    """Normal log density; std = exp(s) or 0.05 + 0.95 * softplus(s), clamped >= min_std; NaN -> defaults."""
    s = _c(raw_std)
    s = F.when(F.isnan(s), F.lit(0.0)).otherwise(s)
    std = F.exp(s) if mode == "exp" else 0.05 + 0.95 * softplus(s)
    std = F.greatest(std, F.lit(min_std))
    mu = F.when(F.isnan(_c(mean)), F.lit(0.0)).otherwise(_c(mean))
    z = (_c(x) - mu) / std
    return -0.5 * z * z - F.log(std) - F.lit(0.5 * math.log(2 * math.pi))


# F23 / F24 / F33 / F34 ----------------------------------------------------
def pad(arr, size: int, value=0, side: str = "right") -> Column:
    a = _c(arr)
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(size) - F.size(a), F.lit(0)))
    return F.concat(a, fill) if side == "right" else F.concat(fill, a)


def pad_multiple(arr, multiple: int = 64, value=0, side: str = "right") -> Column:
    a = _c(arr)
    target = (F.ceil(F.size(a) / multiple) * multiple).cast("int")
    fill = F.array_repeat(F.lit(value), target - F.size(a))
    return F.concat(a, fill) if side == "right" else F.concat(fill, a)


def pad_mask(arr, pad_value=0) -> Column:
    return F.transform(_c(arr), lambda x: F.when(x != pad_value, 1).otherwise(0))


def batch_select(arr, idx) -> Column:
    """Gather ``arr[idx[j]]`` (0-based indices)."""
    a = _c(arr)
    return F.transform(_c(idx), lambda i: at(a, i.cast("int") + 1))


def segment_valid_length(arr) -> Column:
    return F.size(F.filter(_c(arr), lambda x: x != 0))


def mask_prompt_labels(ids, n_prompt, ignore: int = -100) -> Column:
    n = _c(n_prompt)
    return F.transform(_c(ids), lambda x, i: F.when(i < n, F.lit(ignore)).otherwise(x))


# F25 / F26 / F27 ----------------------------------------------------------
def kl_shaped_reward(logprobs, ref_logprobs, reward, length, coef) -> Column:
    """Per token -coef * max(lp - ref, 0); the scalar reward is added at the last real token."""
    n = _c(length).cast("int")
    kl = F.zip_with(_d(logprobs), _d(ref_logprobs), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    return F.transform(kl, lambda k, i: -F.lit(float(coef)) * k
                       + F.when(i + 1 == n, _c(reward).cast("double")).otherwise(0.0))


def ending_penalty(tokens, reward, end_tokens: list[int], penalty: float, min_pos: int = 0) -> Column:
    """Reward becomes ``penalty`` if no allowed end token occurs at a position >= ``min_pos``."""
    t = _c(tokens)
    hit = F.exists(F.transform(t, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                   lambda s: s.getField("x").isin(*end_tokens) & (s.getField("i") >= min_pos))
    return F.when(hit, _c(reward)).otherwise(F.lit(float(penalty)))


def mean_log_likelihood(logprobs, mask=None) -> Column:
    lp = _d(logprobs)
    if mask is None:
        return F.aggregate(lp, F.lit(0.0), lambda a, v: a + v) / F.size(lp)
    m = _c(mask)
    kept = F.filter(F.zip_with(lp, m, lambda v, k: F.when(k != 0, v)), lambda v: v.isNotNull())
    return F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / F.size(kept)
