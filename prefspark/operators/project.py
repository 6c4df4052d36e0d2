"""Projections, filters and predicates.

All of these are narrow: one stage, no shuffle, whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

import numpy as np
import pyarrow as pa  # the Arrow UDF's type hints are resolved in this module
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.util import at

from ..functions import text as T
from ..functions.random import seeded_bit


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# P01 ----------------------------------------------------------------------
def pick_choice(df: DataFrame, summaries: str = "summaries", choice: str = "choice",
                field: str = "text") -> DataFrame:
    """``chosen_only = summaries[choice].text``, ``rejected_only = summaries[1-choice].text``."""
    s = F.col(summaries)
    ch = F.col(choice).cast("int")
    return (df.withColumn("chosen_only", at(s, ch + 1).getField(field))
              .withColumn("rejected_only", at(s, 2 - ch).getField(field)))


def pick_choice_flat(df: DataFrame, text0: str = "text_0", text1: str = "text_1",
                     choice: str = "choice", chosen: str = "chosen_only", rejected: str = "rejected_only") -> DataFrame:
    """P01 on the flat two-column shape (same semantics, no array built)."""
    ch = F.col(choice)
    return (df.withColumn(chosen, F.when(ch == 0, F.col(text0)).otherwise(F.col(text1)))
              .withColumn(rejected, F.when(ch == 0, F.col(text1)).otherwise(F.col(text0))))


# P02 ----------------------------------------------------------------------
def map_attribute_to_uid(df: DataFrame, mapping: Mapping[str, int], col: str = "attributes",
                         out: str = "uid", drop_source: bool = True) -> DataFrame:
    """Literal dictionary lookup (the map is an argument, never a global)."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(int(v)))])
    res = df.withColumn(out, m[F.col(col)].cast("long"))
    return res.drop(col) if drop_source and col != out else res


# P03 / P04 ----------------------------------------------------------------
def drop_identical(df: DataFrame, a: str = "chosen", b: str = "rejected") -> DataFrame:
    """Drop rows whose two sides are equal (NULL-safe: a NULL side is kept as in the reference)."""
    return df.filter(~F.col(a).eqNullSafe(F.col(b)))


def drop_missing(df: DataFrame, cols: Iterable[str] = ("prompt", "chosen", "rejected")) -> DataFrame:
    """Require non-null values in ``cols`` (nested fields allowed, e.g. ``info.post``)."""
    cond = None
    for c in cols:
        x = F.col(c).isNotNull()
        cond = x if cond is None else cond & x
    return df.filter(cond)


# P05 ----------------------------------------------------------------------
def for_user(df: DataFrame, uid, col: str = "uid") -> DataFrame:
    """Keep one user.  Apply it *after* ``head`` when both are used (see ``load_for_user``)."""
    return df.filter(F.col(col) == F.lit(int(uid)))


def load_for_user(df: DataFrame, n: int | None, uid, order: str = "cmp_id", col: str = "uid") -> DataFrame:
    """The reference order: first ``n`` rows, *then* the user filter (no push-down across the limit)."""
    from .select import head
    base = head(df, n, order) if n is not None else df
    return for_user(base, uid, col)


# P06 / P07 / P08 ----------------------------------------------------------
def keep_attributes(df: DataFrame, values: Iterable, col: str = "attributes") -> DataFrame:
    return df.filter(F.col(col).isin(list(values)))


def all_summaries_match(df: DataFrame, summaries: str = "summaries", must: str = "sup",
                        must_not: Iterable[str] = ("ppo", "cnn")) -> DataFrame:
    """Every element: policy contains ``must`` and none of ``must_not``."""
    def ok(s):
        p = s.getField("policy")
        cond = p.contains(must)
        for bad in must_not:
            cond = cond & ~p.contains(bad)
        return cond
    return df.filter(F.forall(F.col(summaries), ok))


def max_text_length(df: DataFrame, n: int, prompt: str = "prompt", chosen: str = "chosen",
                    rejected: str = "rejected") -> DataFrame:
    """``len(prompt)+len(side) <= n`` for both sides, in code points."""
    lp = F.length(prompt)
    return df.filter((lp + F.length(chosen) <= n) & (lp + F.length(rejected) <= n))


# P09 ----------------------------------------------------------------------
def batch_counter(count: Callable[[list[str]], list[int]]) -> Callable[[Column], Column]:
    """A token counter that works on lists of texts (a tokenizer's batch call), as a function of an array column: the
    largest count of each array.  Runs on Arrow batches, all texts of a batch at once; a NULL text counts 0."""
    def largest(texts: Column) -> Column:
        @F.arrow_udf("int")
        def longest(a: pa.Array) -> pa.Array:
            flat = a.flatten().to_pylist()
            sizes = iter(count([t for t in flat if t is not None]))
            n = np.array([0 if t is None else next(sizes) for t in flat], np.int64)
            lens = np.array(pc.fill_null(pc.list_value_length(a), 0), np.int64)
            out = np.zeros(len(a), np.int64)
            np.maximum.at(out, np.repeat(np.arange(len(a)), lens), n)
            return pa.array(out, pa.int32())
        return longest(texts)
    return largest


def counted(c: Column) -> Column:
    """The ``count`` of columns that hold token counts already: a text that many rows share is counted once."""
    return c


def largest_token_count(cols: Iterable[str] = ("chosen", "rejected"), count: Callable[[Column], Column] | None = None,
                        contexts: str | None = None, context_cols: Iterable[str] = ("chosen", "rejected"),
                        counter: Callable[[list[str]], list[int]] | None = None) -> Column:
    """The most tokens that any of the texts has: the listed columns and, with ``contexts`` (an array of structs), those
    fields of every context.  ``counter`` counts a list of texts; else ``count`` is a column
    expression (default: regex word count).  A NULL text counts 0."""
    texts = F.array(*[F.col(c) for c in cols])
    if contexts is not None:
        nested = F.transform(F.col(contexts), lambda x: F.array(*[x.getField(c) for c in context_cols]))
        texts = F.concat(texts, F.coalesce(F.flatten(nested), F.array().cast("array<string>")))
    if counter is not None:
        return batch_counter(counter)(texts)
    count = count or T.word_count
    own = [F.coalesce(count(F.col(c)), F.lit(0)) for c in cols]
    if contexts is not None:
        own.append(F.coalesce(F.array_max(F.transform(F.flatten(nested), count)), F.lit(0)))
    return F.greatest(*own, F.lit(0))


def max_token_length(df: DataFrame, n: int, cols: Iterable[str] = ("chosen", "rejected"),
                     count: Callable[[Column], Column] | None = None, contexts: str | None = None,
                     context_cols: Iterable[str] = ("chosen", "rejected"),
                     counter: Callable[[list[str]], list[int]] | None = None) -> DataFrame:
    """Every listed column, and every text of the contexts, has at most ``n`` tokens (``largest_token_count``)."""
    return df.filter(largest_token_count(cols, count, contexts, context_cols, counter) <= n)


# P10 ----------------------------------------------------------------------
def rename_roles(df: DataFrame, mapping: Mapping[str, str], drop: Iterable[str] = ()) -> DataFrame:
    """Swap/rename the columns playing chosen/rejected, drop others."""
    return df.drop(*drop).withColumnsRenamed(dict(mapping))


# P11 ----------------------------------------------------------------------
def response_after_marker(df: DataFrame, col: str = "chosen", marker: str = "Assistant: ",
                          out: str | None = None, last: bool = False) -> DataFrame:
    """Second segment after ``marker`` (or the last segment), stripped; NULL when absent."""
    return df.withColumn(out or col, T.after_marker(F.col(col), marker, last))


# P12 / P13 ----------------------------------------------------------------
def tag_constant(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def add_index(df: DataFrame, order: str = "cmp_id", out: str = "Index") -> DataFrame:
    """Dense 0-based index in ``order`` if ``out`` is absent.

    Computed without a single-partition window: each partition's rows are
    counted (one small aggregate over range buckets), the prefix sums of
    those counts give every bucket's offset, and rows are numbered inside
    their bucket only.
    """
    if out in df.columns:
        return df
    from .window import dense_position
    return dense_position(df, order, out, base=0)


# P14 / P15 / P16 / P17 / P18 ---------------------------------------------
def prepend_user_id(df: DataFrame, uid: str = "uid", prompt: str = "prompt") -> DataFrame:
    return df.withColumn(prompt, F.concat(F.lit("User ID: "), F.col(uid).cast("string"),
                                          F.lit("\n"), F.col(prompt)))


def plain_text_pair(df: DataFrame, prompt: str = "prompt", sides=("chosen", "rejected"),
                    style: str = "dialog") -> DataFrame:
    """``Human: p\\nAssistant: r`` (style dialog) or ``p\\nr`` (style summary)."""
    for s in sides:
        if style == "dialog":
            e = F.concat(F.lit("Human: "), F.col(prompt), F.lit("\nAssistant: "), F.col(s))
        else:
            e = F.concat(F.col(prompt), F.lit("\n"), F.col(s))
        df = df.withColumn(s, e)
    return df


def message_pair(df: DataFrame, prompt: str = "prompt", sides=("chosen", "rejected")) -> DataFrame:
    """``[{content: prompt, role: user}, {content: response, role: assistant}]`` per side."""
    for s in sides:
        df = df.withColumn(s, F.array(
            F.struct(F.col(prompt).alias("content"), F.lit("user").alias("role")),
            F.struct(F.col(s).alias("content"), F.lit("assistant").alias("role"))))
    return df


def user_prompt(df: DataFrame, uid: str = "uid", question: str = "prompt", sep: str = "ASSISTANT:",
                n_tokens: int = 0, eos: str = "<|endoftext|>", blanks: bool = False,
                out: str = "prompt") -> DataFrame:
    return df.withColumn(out, T.user_prompt_text(F.col(uid), F.col(question), sep, n_tokens, eos, blanks))


def parse_user_identifier(df: DataFrame, col: str = "prompt", out: str = "uid") -> DataFrame:
    return df.withColumn(out, T.parse_user_id(F.col(col)))


# P19 ----------------------------------------------------------------------
def duplicate_generic(df: DataFrame, train: bool = True, uid: str = "uid") -> DataFrame:
    """Train: each row with uid != 0 yields itself and a uid 0 copy; uid 0 rows yield none.
    Eval: unchanged.  A ``user_kind`` column records which copy a row is."""
    if not train:
        return df.withColumn("user_kind", F.when(F.col(uid) == 0, "generic").otherwise("individual"))
    cols = [c for c in df.columns if c != uid]
    return (df.filter(F.col(uid) != 0)
              .select(*cols, F.explode(F.array(F.col(uid).cast("long"), F.lit(0).cast("long"))).alias(uid))
              .withColumn("user_kind", F.when(F.col(uid) == 0, "generic").otherwise("individual")))


# P20 ----------------------------------------------------------------------
def length_preference(df: DataFrame, user_types: DataFrame, key: str = "worker",
                      text0: str = "text_0", text1: str = "text_1",
                      length: Callable[[Column], Column] = F.length) -> DataFrame:
    """Synthetic label: type 0 prefers the longer side, type 1 the shorter; equal -> side 0.

    ``user_types`` is (key, preference) with one row per user: a lookup table
    whose size is the number of users, joined by key (Spark broadcasts it when
    its size is under the threshold, else shuffles).  The sides are compared before the join, which moves the
    outcome and no text that the caller does not read.  ``length`` is ``counted`` for columns that hold lengths already.
    """
    l0, l1 = length(F.col(text0)), length(F.col(text1))
    longer = F.when(l1 > l0, 1).when(l1 < l0, -1).otherwise(0).cast("tinyint")
    j = df.withColumn("_longer", longer).join(user_types.select(key, F.col("preference").alias("_ptype")), key, "inner")
    choice = F.when(F.col("_longer") == F.when(F.col("_ptype") == 0, 1).otherwise(-1), 1).otherwise(0)
    return j.withColumn("choice", choice).drop("_ptype", "_longer")


# P21 / P22 / P23 ---------------------------------------------------------
def tldr_query(df: DataFrame, info: str = "info", out: str = "query") -> DataFrame:
    i = F.col(info)
    return df.withColumn(out, F.concat(
        F.lit("SUBREDDIT: r/"), i.getField("subreddit"), F.lit("\nTITLE: "), i.getField("title"),
        F.lit("\nPOST: "), F.coalesce(i.getField("post"), i.getField("article")), F.lit("\nTL;DR:")))


def paired_text(df: DataFrame, prompt: str = "prompt", chosen: str = "chosen",
                rejected: str = "rejected", out: str = "paired_text", mode: str = "both") -> DataFrame:
    parts = [F.lit("Prompt: "), F.col(prompt)]
    if mode in ("both", "chosen"):
        parts += [F.lit("\nChosen response: "), F.col(chosen)]
    if mode in ("both", "rejected"):
        parts += [F.lit("\nRejected response: "), F.col(rejected)]
    return df.withColumn(out, F.concat(*parts))


def profile_text(df: DataFrame, profile: str = "demographics", out: str = "profile_text") -> DataFrame:
    return df.withColumn(out, T.profile_text(F.col(profile)))


# P24 ----------------------------------------------------------------------
def ab_position(df: DataFrame, seed: int, key: str = "cmp_id", chosen: str = "chosen",
                rejected: str = "rejected") -> DataFrame:
    """Deterministically place chosen as A or B; keeps ``answer`` letter and ``dist``."""
    a_is_chosen = seeded_bit(seed, key) == 0
    return (df.withColumn("option_a", F.when(a_is_chosen, F.col(chosen)).otherwise(F.col(rejected)))
              .withColumn("option_b", F.when(a_is_chosen, F.col(rejected)).otherwise(F.col(chosen)))
              .withColumn("answer", F.when(a_is_chosen, "A").otherwise("B"))
              .withColumn("dist", F.when(a_is_chosen, F.array(F.lit(1.0), F.lit(0.0)))
                                   .otherwise(F.array(F.lit(0.0), F.lit(1.0)))))


# P25 ----------------------------------------------------------------------
def explode_options(df: DataFrame, options: str = "options", out: str = "option",
                    pos: str = "option_no") -> DataFrame:
    """One row per option text, numbered from 0."""
    rest = [c for c in df.columns if c != options]
    return df.select(*rest, F.posexplode(options).alias(pos, out))


# P26 / P27 ----------------------------------------------------------------
def controversial_only(df: DataFrame, col: str = "controversial") -> DataFrame:
    return df.filter(F.col(col))


def one_user(df: DataFrame, subset: str, col: str = "data_subset") -> DataFrame:
    return df.filter(F.col(col) == subset)


# P28 / P29 ----------------------------------------------------------------
def completion_of(df: DataFrame, output: str = "output", inp: str = "input",
                  marker: str = "ASSISTANT:", out: str = "completion") -> DataFrame:
    return df.withColumn(out, T.completion_of(F.col(output), F.col(inp), marker))


def split_prompt_id(df: DataFrame, col: str = "prompt_id", names=("user_id", "dialog_id", "turn"),
                    drop_generic: bool = True) -> DataFrame:
    """``user_dialog_turn`` / ``user_sample`` ids into integer columns; user 0 dropped."""
    parts = F.split(F.col(col), "_")
    for i, n in enumerate(names):
        df = df.withColumn(n, at(parts, i + 1).cast("long"))
    return df.filter(F.col(names[0]) != 0) if drop_generic else df


# P30 / P31 ----------------------------------------------------------------
def format_prompt(df: DataFrame, with_input: str, no_input: str, output: str | None = None,
                  eos: str = "", out: str = "prompt", fields=("instruction", "input")) -> DataFrame:
    return df.withColumn(out, T.format_prompt(with_input, no_input, fields, output, eos))


def choice_index(df: DataFrame, col: str = "preference", out: str = "choice") -> DataFrame:
    """preference 1 -> 0, 2 -> 1; anything else -> NULL (and counted by the caller)."""
    p = F.col(col)
    return df.withColumn(out, F.when(p.isin(1, 2), (p - 1).cast("int")))


# P33 ----------------------------------------------------------------------
def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested struct columns -> flat columns named with ``sep``; ``sep`` in a name is an error."""
    from pyspark.sql.types import StructType

    def walk(schema, prefix, path):
        out = []
        for f in schema.fields:
            if sep in f.name:
                raise ValueError(f"separator {sep!r} inside field name {f.name!r}")
            name = f"{prefix}{sep}{f.name}" if prefix else f.name
            col = path.getField(f.name) if path is not None else F.col(f"`{f.name}`")
            if isinstance(f.dataType, StructType):
                out += walk(f.dataType, name, col)
            else:
                out.append(col.alias(name))
        return out
    return df.select(*walk(df.schema, "", None))


# P34 ----------------------------------------------------------------------
def compose(df: DataFrame, steps: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply DataFrame functions in order (``DataFrame.transform`` chain)."""
    for s in steps:
        df = df.transform(s)
    return df


# P35 ----------------------------------------------------------------------
def run_config_from_name(df: DataFrame, col: str = "file_name") -> DataFrame:
    """A column per run field: the first of the field's fixed names contained in the file name, else ``NA``."""
    from ..functions.report import run_config
    return df.select("*", *[v.alias(k) for k, v in run_config(F.col(col)).items()])


# P36 ----------------------------------------------------------------------
def drop_empty_side(df: DataFrame, sides=("chosen", "rejected"), ratings: Iterable[str] = ()) -> DataFrame:
    """Skip pairs with an empty side or a rating that is not an integer."""
    cond = None
    for s in sides:
        x = F.col(s).isNotNull() & (F.length(s) > 0)
        cond = x if cond is None else cond & x
    for r in ratings:
        cond = cond & F.col(r).cast("string").rlike(r"^\s*-?\d+\s*$")
    return df.filter(cond)


# P37 / P38 ----------------------------------------------------------------
def judge_prompt(df: DataFrame, profile: str = "profile", question: str = "prompt",
                 a: str = "option_a", b: str = "option_b", out: str = "judge_prompt") -> DataFrame:
    return df.withColumn(out, T.judge_prompt(F.col(profile), F.col(question), F.col(a), F.col(b)))


def judge_reply_side(df: DataFrame, reply: str = "reply", out: str = "picked") -> DataFrame:
    """The first letter of the judge's reply picks the side (A/B), else NULL."""
    first = F.upper(F.substring(F.trim(F.col(reply)), 1, 1))
    return df.withColumn(out, F.when(first.isin("A", "B"), first))


def rag_prompt(queries: DataFrame, shots: DataFrame, qid: str = "qid", seed: int = 0, prompt: str = "prompt",
               chosen: str = "chosen", rejected: str = "rejected", rank: str = "rank", out: str = "rag_prompt") -> DataFrame:
    """The few-shot preference prompt of each query.

    ``shots`` holds each query's retrieved examples with their rank (1 is the best); they stand in ascending
    similarity, the best last.  Sides are the answers alone; which one is A is a seeded coin of (query, rank),
    and of the query for its own pair, whose letter is ``answer``.
    """
    def sides(coin):
        c, r = T.answer_text(F.col(chosen)), T.answer_text(F.col(rejected))
        return {"prompt": F.col(prompt), "a": F.when(coin, c).otherwise(r), "b": F.when(coin, r).otherwise(c)}

    letter = lambda coin: F.when(coin, "A").otherwise("B")
    coin = seeded_bit(seed, qid, rank) == 0
    one = shots.select(qid, (-F.col(rank)).alias("_o"), T.fill(T.FEWSHOT_EXAMPLE, answer=letter(coin), **sides(coin)).alias("_t"))
    body = one.groupBy(qid).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_t"))), lambda x: x["_t"]), "").alias("_body"))
    coin = seeded_bit(seed + 1, qid) == 0
    return (queries.join(body, qid)
            .withColumn(out, F.concat(F.lit(T.FEWSHOT_HEAD), "_body", T.fill(T.FEWSHOT_QUERY, **sides(coin))))
            .withColumn("answer", letter(coin)).drop("_body"))


# P39 ----------------------------------------------------------------------
def rebase_uid(df: DataFrame, col: str = "uid", n_users: int | None = None) -> DataFrame:
    """1-based ids -> 0-based; ids out of range become NULL (``range_ok`` false)."""
    u = F.col(col) - 1
    ok = u >= 0
    if n_users is not None:
        ok = ok & (u < n_users)
    return df.withColumn(col, F.when(ok, u))
