"""Text column builders (templates, markers, parsers).

All builders return Columns made of JVM string functions, so they stay in
whole-stage codegen.  Python's ``str.strip()`` removes every Unicode blank;
``pystrip`` does the same on the JVM side.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .util import at

_BLANK = r"[\s\p{Z}\x{FEFF}\x{1C}-\x{1F}\x{85}]"


def pystrip(c: Column) -> Column:
    """Python ``str.strip()`` on a string column."""
    return F.regexp_replace(c, f"^{_BLANK}+|{_BLANK}+$", "")


def word_count(c: Column) -> Column:
    """Default tokenizer for length filters: count of ``\\S+`` runs (0 for empty/blank)."""
    return F.size(F.filter(F.split(pystrip(c), f"{_BLANK}+"), lambda t: F.length(t) > 0))


def after_marker(c: Column, marker: str, last: bool = False) -> Column:
    """``c.split(marker)[1].strip()``; NULL when the marker is absent.

    ``last=True`` takes the last segment instead (the retrieval variant).
    """
    parts = F.split(c, re.escape(marker), -1)
    seg = at(parts, -1) if last else at(parts, 2)
    return F.when(F.size(parts) >= 2, pystrip(seg))


def user_prompt_text(uid: Column, question: Column, sep: str, n_tokens: int = 0,
                     eos: str = "<|endoftext|>", blanks: bool = False) -> Column:
    """``"USER: {uid}" + eos*n + sep + question`` (compact) or
    ``"USER: {uid} " + (eos+" ")*n + sep + " " + question`` (blank-separated)."""
    if blanks:
        return F.concat(F.lit("USER: "), uid.cast("string"), F.lit(" "),
                        F.lit((eos + " ") * n_tokens), F.lit(sep), F.lit(" "), question)
    return F.concat(F.lit("USER: "), uid.cast("string"), F.lit(eos * n_tokens), F.lit(sep), question)


EOS_MARKERS = ["<|endoftext|>", "<|end_of_text|>", "</s>"]


def parse_user_id(prompt: Column, sep: str | None = None) -> Column:
    """Inverse of ``user_prompt_text``: the integer after ``USER:`` (NULL if absent)."""
    head = prompt if sep is None else F.substring_index(prompt, sep, 1)
    return F.regexp_extract(head, r"USER:\s*(\d+)", 1).cast("long").alias("uid")


def profile_text(profile: Column) -> Column:
    """``"preference: a, b; k: v; "``: ``preference`` first, other keys sorted.

    ``profile`` is ``struct<preference: array<string>, attributes: map<string,string>>``
    or a ``map<string,string>`` whose ``preference`` value is a comma list.
    """
    pref = profile.getField("preference")
    attrs = profile.getField("attributes")
    entries = F.array_sort(F.map_entries(attrs))
    rest = F.array_join(F.transform(entries, lambda e: F.concat(e.getField("key"), F.lit(": "),
                                                                 e.getField("value"), F.lit("; "))), "")
    return F.concat(F.lit("preference: "), F.array_join(pref, ", "), F.lit("; "), F.coalesce(rest, F.lit("")))


def completion_of(output: Column, inp: Column, marker: str) -> Column:
    """Fewer markers in the output than the input -> ``"Wrong completion."``, else text after the last marker."""
    po = F.split(output, re.escape(marker), -1)
    pi = F.split(inp, re.escape(marker), -1)
    return F.when(F.size(po) < F.size(pi), F.lit("Wrong completion.")).otherwise(at(po, -1))


def format_prompt(with_input: str, no_input: str, fields: Iterable[str] = ("instruction", "input"),
                  output: str | None = None, eos: str = "") -> Column:
    """Pick the template by whether ``input`` is NULL/empty, then fill ``{field}`` placeholders."""
    fields = list(fields)

    def fill(tpl: str) -> Column:
        pieces = re.split(r"(\{[A-Za-z_][A-Za-z0-9_]*\})", tpl)
        cols = []
        for p in pieces:
            if not p:
                continue
            m = re.fullmatch(r"\{([A-Za-z_][A-Za-z0-9_]*)\}", p)
            cols.append(F.col(m.group(1)).cast("string") if m else F.lit(p))
        return F.concat(*cols) if cols else F.lit("")

    inp = F.col("input")
    prompt = F.when(inp.isNull() | (F.length(inp) == 0), fill(no_input)).otherwise(fill(with_input))
    if output is not None:
        prompt = F.concat(prompt, F.col(output), F.lit(eos))
    return prompt


def judge_prompt(profile: Column, question: Column, a: Column, b: Column) -> Column:
    """Profile + question + two answers; the judge answers with a letter."""
    return F.concat(
        F.lit("Here is a user profile:\n"), profile,
        F.lit("\n\nQuestion:\n"), question,
        F.lit("\n\nAnswer A:\n"), a,
        F.lit("\n\nAnswer B:\n"), b,
        F.lit("\n\nWhich answer does this user prefer? Reply with A or B."))


# The few-shot preference prompt.
FEWSHOT_HEAD = "The examples "
FEWSHOT_EXAMPLE = ("{prompt}\n\nResponse A: {a}\nResponse B: {b}\n\nWhich response do you prefer?\n\nResponse {answer}\n===\n")
FEWSHOT_QUERY = "Prompt: {prompt}\n\nResponse A: {a}\n\nResponse B: {b}\n\nWhich response do you prefer?\nResponse "
ANSWER_MARK = "\nAssistant: "


def answer_text(c: Column) -> Column:
    """What follows the last answer mark, without double quotes, trimmed."""
    return pystrip(F.replace(F.element_at(F.split(c, ANSWER_MARK), -1), F.lit('"'), F.lit("")))


def fill(template: str, **values: Column) -> Column:
    """``template`` with ``{name}`` places filled by columns."""
    import re
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if i % 2 or x])


def strip_quotes(c: Column) -> Column:
    return F.regexp_replace(c, "[\"']", "")


def chatml_messages(c: Column) -> Column:
    """Parse ``<|im_start|>role k=v\\ncontent<|im_end|>`` blocks into
    ``array<struct<role, content, attrs map<string,string>>>``."""
    blocks = F.filter(F.split(c, r"<\|im_start\|>"), lambda s: F.length(pystrip(s)) > 0)

    def one(b):
        body = F.regexp_replace(b, r"(?s)<\|im_end\|>.*$", "")
        header = F.substring_index(body, "\n", 1)
        content = F.regexp_extract(body, r"(?s)^[^\n]*\n(.*)$", 1)
        role = F.regexp_extract(header, r"^\s*(\S+)", 1)
        kv = F.regexp_extract(header, r"^\s*\S+\s+(.*)$", 1)
        attrs = F.when(F.length(kv) > 0, F.str_to_map(kv, F.lit(r"\s+"), F.lit("=")))
        return F.struct(role.alias("role"), pystrip(content).alias("content"), attrs.alias("attrs"))
    return F.transform(blocks, one)


def apply_replacements(c: Column, mapping: Mapping[str, str]) -> Column:
    for k, v in mapping.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c
