"""Rated completions -> user-typed preference pairs.

One row per instruction holds its completions (bounded by the number of
completions a prompt has); labelling is a set of column expressions on
that row, then one ``explode`` to one row per user type.  The only wide
steps are the per-instruction collect and the prompt join (J01).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.util import at, computed_once

from ..functions import labels as LB

RATING_FIELDS = LB.ATTRIBUTES


def completions_table(ratings: DataFrame, instruction_id: str = "instruction_id",
                      prompt_prefix: str = "instruction ") -> DataFrame:
    """Flat (instruction_id, completion_no, response, <4 ratings>) -> one row per instruction:
    (instruction_id, instruction, completions array<struct<completion_no, response, ratings...>>)."""
    st = F.struct("completion_no", "response", *RATING_FIELDS)
    return ratings.groupBy(instruction_id).agg(F.sort_array(F.collect_list(st)).alias("completions")) \
        .withColumn("instruction", F.concat(F.lit(prompt_prefix), F.col(instruction_id).cast("string")))


def binarize(ratings: DataFrame, chosen_no: int = 1, rejected_no: int = 2,
             instruction_id: str = "instruction_id", prompt_prefix: str = "instruction ") -> DataFrame:
    """A binarised pair table: completion ``chosen_no`` vs ``rejected_no`` of every instruction."""
    c = ratings.filter(F.col("completion_no") == chosen_no).select(instruction_id, F.col("response").alias("chosen"))
    r = ratings.filter(F.col("completion_no") == rejected_no).select(instruction_id, F.col("response").alias("rejected"))
    return c.join(r, instruction_id).select(
        F.concat(F.lit(prompt_prefix), F.col(instruction_id).cast("string")).alias("prompt"), "chosen", "rejected",
        F.col(instruction_id).alias("pair_id"))


def binarize_completions(comps: DataFrame, chosen_no: int = 1, rejected_no: int = 2,
                         instruction_id: str = "instruction_id", keep: Iterable[str] = ()) -> DataFrame:
    """``binarize`` from the per-instruction completions table: no second pass over the
    ratings (the completions are already grouped by instruction).  Columns of ``keep`` stay on the row, so that
    pairs need no join back to the table they were derived from."""
    def response_of(no):
        m = F.filter("completions", lambda c: c.getField("completion_no") == no)
        return at(m, 1).getField("response")
    return comps.select(F.col("instruction").alias("prompt"), response_of(chosen_no).alias("chosen"),
                        response_of(rejected_no).alias("rejected"), F.col(instruction_id).alias("pair_id"), *keep) \
        .filter(F.col("chosen").isNotNull() & F.col("rejected").isNotNull())


def match_ratings(pairs: DataFrame, completions: str = "completions", chosen: str = "chosen",
                  rejected: str = "rejected") -> DataFrame:
    """J02 + the usability rule: ratings of the last completion equal to chosen (resp. rejected,
    checked only when not equal to chosen); the pair is dropped when a side has no match or any
    matched completion has a non-integer rating."""
    comps = F.col(completions)
    ratings = lambda c: F.struct(*[LB.rating_int(c.getField(k)).alias(k) for k in RATING_FIELDS])
    bad = lambda m: F.exists(m, lambda c: F.greatest(*[c.getField(k).isNull().cast("int") for k in RATING_FIELDS]) == 1)
    is_c = lambda c: c.getField("response") == F.col(chosen)
    is_r = lambda c: (c.getField("response") != F.col(chosen)) & (c.getField("response") == F.col(rejected))
    d = computed_once(pairs, _mc=F.transform(F.filter(comps, is_c), ratings), _mr=F.transform(F.filter(comps, is_r), ratings))
    d = d.filter((F.size("_mc") > 0) & (F.size("_mr") > 0) & ~bad("_mc") & ~bad("_mr"))
    d = computed_once(d, _c=at("_mc", -1), _r=at("_mr", -1))
    cols = {f"{x}_{k}": F.col(f"_{x}").getField(k) for k in RATING_FIELDS for x in ("c", "r")}
    return d.withColumns(cols).drop("_mc", "_mr", "_c", "_r")  # one projection, one analysis pass


def label_user_types(pairs: DataFrame, seed: int = 0, key: str = "pair_id", filter_equal: bool = False,
                     mode: str = "single", all_types: Iterable[str] = LB.USER_TYPES) -> DataFrame:
    """Per pair, labels per user type, then one row per (present) user type.

    Output: pair_id, prompt, data_subset, reversed, controversial, satisfied_subset, survey_options,
    chosen/rejected as ``Human: p\\n\\nAssistant: r`` with sides swapped when reversed,
    and ``n_present`` / ``n_same`` (types present / sharing this row's label) for G15.
    """
    all_types = list(all_types)
    labels = LB.user_type_labels({k: F.col(f"c_{k}") for k in RATING_FIELDS},
                                 {k: F.col(f"r_{k}") for k in RATING_FIELDS}, seed, F.col(key))
    # many columns and the callers' filters read the labels and their types
    d = computed_once(pairs, _labels=LB.drop_equal_types(labels) if filter_equal else labels)
    if filter_equal:
        if mode == "84":
            d = d.filter(F.size("_labels") == 2)
    d = d.withColumn("controversial", LB.controversial(F.col("_labels")))
    e = d.select("*", F.explode("_labels").alias("_l"))
    rev = F.col("_l.reversed")
    human = F.concat(F.lit("Human: "), F.col("prompt"), F.lit("\n\nAssistant: "))
    return e.select(
        key, "prompt",
        F.col("_l.type").alias("data_subset"),
        rev.alias("reversed"),
        "controversial",
        LB.satisfied_subset(F.col("_labels"), rev, all_types).alias("satisfied_subset"),
        (F.col("controversial") & (F.size("_labels") == len(all_types))).alias("survey_options"),
        F.concat(human, F.when(rev, F.col("rejected")).otherwise(F.col("chosen"))).alias("chosen"),
        F.concat(human, F.when(rev, F.col("chosen")).otherwise(F.col("rejected"))).alias("rejected"),
        F.size("_labels").alias("n_present"),
        F.size(F.filter("_labels", lambda x: x.getField("reversed") == rev)).alias("n_same"),
        F.transform("_labels", lambda x: x.getField("type")).alias("present_types"))


def augment_counters(rows: DataFrame, all_types: Iterable[str] = LB.USER_TYPES) -> DataFrame:
    """G15 per user type: rows, reversed rows, agreed / controversial rows and the two
    "guess" baselines (types sharing the row's label; half the present types when the type
    is absent from the row)."""
    # a type absent from a pair contributes 0.5 * n_present; absent types only exist with filter_equal
    types = F.array(*[F.lit(t) for t in all_types])
    if "present_types" in rows.columns:
        # every row carries its pair's present types: the pair's first present type speaks for
        # the pair, so no regrouping (shuffle) by pair is needed
        per_pair = rows.filter(F.col("data_subset") == F.element_at("present_types", 1)).select(
            "n_present", "controversial", F.col("present_types").alias("_present"))
    else:
        per_pair = rows.groupBy("pair_id").agg(F.first("n_present").alias("n_present"),
                                              F.first("controversial").alias("controversial"),
                                              F.collect_set("data_subset").alias("_present"))
    absent = per_pair.select(F.explode(F.array_except(types, F.col("_present"))).alias("data_subset"),
                             (F.col("n_present") * 0.5).alias("g"),
                             F.when(F.col("controversial"), F.col("n_present") * 0.5).otherwise(0.0).alias("gc"),
                             F.lit(0).alias("r"), F.lit(0).alias("rv"), F.lit(0).alias("c"))
    present = rows.select("data_subset", F.col("n_same").cast("double").alias("g"),
                          F.when(F.col("controversial"), F.col("n_same").cast("double")).otherwise(0.0).alias("gc"),
                          F.lit(1).alias("r"), F.col("reversed").cast("int").alias("rv"),
                          F.col("controversial").cast("int").alias("c"))
    u = present.unionByName(absent)
    return u.groupBy("data_subset").agg(
        F.sum("r").alias("n_rows"), F.sum("rv").alias("n_reversed"),
        F.sum("c").alias("n_controversial"), (F.sum("r") - F.sum("c")).alias("n_agreed"),
        F.sum("g").alias("guess"), F.sum("gc").alias("guess_controversial"))


def ratings_long(ratings: DataFrame, instruction_id: str = "instruction_id") -> DataFrame:
    """One row per (instruction, completion, attribute) with the raw rating string."""
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("attribute"), F.col(k).alias("rating"))
                                for k in RATING_FIELDS]))
    return ratings.select(instruction_id, "completion_no", "response", stack.alias("_a")) \
        .select(instruction_id, "completion_no", "response", "_a.attribute", "_a.rating")


def best_worst_by_attribute(ratings: DataFrame, instruction_id: str = "instruction_id") -> DataFrame:
    """Per instruction and attribute, the first highest-rated completion is chosen and the
    first lowest-rated rejected, kept only if max > min; any non-integer rating skips the pair."""
    lg = ratings_long(ratings, instruction_id).withColumn("score", LB.rating_int(F.col("rating")))
    g = lg.groupBy(instruction_id, "attribute").agg(
        F.count(F.when(F.col("score").isNull(), 1)).alias("_bad"),
        F.max(F.struct(F.col("score"), (-F.col("completion_no")).alias("_neg"), F.col("completion_no"))).alias("_hi"),
        F.min(F.struct(F.col("score"), F.col("completion_no"))).alias("_lo"))
    ok = (F.col("_bad") == 0) & (F.col("_hi.score") > F.col("_lo.score")) & (F.col("_hi.score") > 0)
    return g.filter(ok).select(instruction_id, "attribute",
                               F.col("_hi.completion_no").alias("chosen_no"), F.col("_hi.score").alias("chosen_score"),
                               F.col("_lo.completion_no").alias("rejected_no"), F.col("_lo.score").alias("rejected_score"))


def guided_disagreement(ratings: DataFrame, instruction_id: str = "instruction_id", scale: tuple[int, int] = (1, 5)) -> DataFrame:
    """Does some pair of completions rank one way by one attribute and the other way by
    another?

    Per attribute pair the rating pairs that occur are the bits of one number (a grid of at most 64 cells), merged by
    ``bit_or``: partial sums before the one exchange, no sort and no pair of completions.  Two
    occurring cells disagree when one lies above and before the other.  Ratings outside ``scale`` fail.
    """
    lo, hi = scale
    size = hi - lo + 1
    if size > 8:
        raise ValueError("a scale of at most 8 values")
    rated = {k: LB.rating_int(F.col(k)) for k in RATING_FIELDS}
    place = {k: F.when(v.between(lo, hi), v - lo).when(v.isNotNull(), F.raise_error(F.lit(f"{k} outside {lo}..{hi}")).cast("int"))
             for k, v in rated.items()}
    d = ratings.select(instruction_id, *[v.alias(k) for k, v in place.items()])
    pairs = [(a, b) for i, a in enumerate(RATING_FIELDS) for b in RATING_FIELDS[i + 1:]]
    one = F.lit(1).cast("long")
    cells = [F.bit_or(F.call_function("shiftleft", one, F.col(a) * size + F.col(b))).alias(f"_{a}_{b}") for a, b in pairs]
    g = d.groupBy(instruction_id).agg(*cells)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    any_pair = F.lit(False)
    for a, b in pairs:
        seen = F.coalesce(F.col(f"_{a}_{b}"), F.lit(0))
        for x in range(size - 1):
            for y in range(1, size):
                # cells above x and before y
                against = sum(1 << (u * size + v) for u in range(x + 1, size) for v in range(y))
                any_pair = any_pair | ((seen.bitwiseAND(F.lit(signed(1 << (x * size + y)))) != 0)
                                       & (seen.bitwiseAND(F.lit(signed(against))) != 0))
    return g.select(instruction_id, any_pair.alias("guided_disagreement"))
