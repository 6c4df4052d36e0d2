"""Language ID by word-first backoff.

A word that the model knows is scored by its log frequency in each language; an unseen word
falls back to its longest character n-grams that the model knows (4 down to 1).  A text's
scores are sums over its words, its probabilities their softmax.

Model: per language the ``words`` most frequent words and ``grams`` most frequent n-grams of
each order, counted by Spark over at most ``max_docs_per_lang`` training rows a language
(chosen by a hash of the id), so its size is bounded by the languages alone.

Defined results: null text or no letter -> ``und``, score 0; no training rows -> every text is
``und``; ties go to the first language in alphabetical order; null languages are not learned;
a null id counts as empty in the sampling hash; repeated rows are scored alike; extra columns pass by.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import releasing

ORDERS = (4, 3, 2, 1)
_KEEP = 200_000


def _words():
    return re.compile(r"[^\W\d_]+")


def _grams(word: str, n: int) -> list[str]:
    w = f"^{word}$" if n > 1 else word
    return [w[i: i + n] for i in range(len(w) - n + 1)]


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_docs_per_lang: int = 8000, words: int = 20000, grams: int = 4000) -> dict:
    """Count the training rows and return the (bounded) model."""
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"),
                       F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {"langs": [], "tables": {}}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, max_docs_per_lang / n))])
    chosen = rows.where(F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches):
        from collections import Counter
        find = _words().findall
        for pdf in batches:
            seen: dict = {}
            for text, lang in zip(pdf["text"], pdf["lang"]):
                seen.setdefault(lang, Counter()).update(find(text.lower()))
            out = []
            for lang, c in seen.items():
                by = {n: Counter() for n in ORDERS}
                for w, k in c.items():
                    for n in ORDERS:
                        for g in _grams(w, n):
                            by[n][g] += k
                out += [(lang, 0, w, k) for w, k in c.items()]
                out += [(lang, n, g, k) for n in ORDERS for g, k in by[n].items()]
            yield pd.DataFrame(out, columns=["lang", "kind", "gram", "n"])

    counts = (chosen.select("text", "lang").mapInPandas(releasing(count), "lang string, kind int, gram string, n long")
              .groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n")))
    w = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("r", F.row_number().over(w)).where(
        F.col("r") <= F.when(F.col("kind") == 0, words).otherwise(grams)).drop("r")
    langs = sorted(sizes)
    at = {x: i for i, x in enumerate(langs)}
    raw: dict = {}
    for r in top.collect():
        raw.setdefault(r["kind"], {}).setdefault(r["gram"], [0] * len(langs))[at[r["lang"]]] += r["n"]
    tables = {}
    for kind, t in raw.items():
        keys = sorted(t)
        m = np.array([t[k] for k in keys], dtype=np.float64)
        total = m.sum(axis=0)
        tables[kind] = (keys, (np.log(m + 0.5) - np.log(total + 0.5 * (len(keys) + 1))).astype(np.float32))
    return {"langs": langs, "tables": tables}


class Scorer:
    """Word -> row of log scores; unseen words are remembered up to a bound."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.find = _words().findall
        tables = model["tables"]
        keys, m = tables.get(0, ([], np.zeros((0, len(self.langs)), np.float32)))
        self.known = len(keys)
        self.words = {k: i for i, k in enumerate(keys)}
        self.rows = np.zeros((self.known + _KEEP, len(self.langs)), np.float32)
        self.rows[: self.known] = m
        self.fresh: dict = {}
        self.grams = {n: ({k: i for i, k in enumerate(tables[n][0])}, tables[n][1]) for n in ORDERS if n in tables}

    def backoff(self, word: str) -> np.ndarray:
        for n in ORDERS:
            if n in self.grams:
                at, m = self.grams[n]
                hit = [at[g] for g in _grams(word, n) if g in at]
                if hit:
                    return m[hit].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def row(self, word: str) -> int:
        i = self.fresh.get(word)
        if i is None:
            i = self.known + len(self.fresh)
            self.rows[i] = self.backoff(word)
            self.fresh[word] = i
        return i

    def score(self, text) -> tuple[str, float]:
        from collections import Counter
        if text is None or not self.langs:
            return "und", 0.0
        c = Counter(self.find(text.lower()))
        if not c:
            return "und", 0.0
        total = np.zeros(len(self.langs))
        items = list(c.items())
        for a in range(0, len(items), 50_000):
            part = items[a: a + 50_000]
            if len(self.fresh) + len(part) > _KEEP:
                self.fresh = {}
            get = self.words.get
            ids = [i if (i := get(w)) is not None else self.row(w) for w, _ in part]
            total += np.fromiter((k for _, k in part), np.float64, len(part)) @ self.rows[ids]
        p = np.exp(total - total.max())
        best = int(total.argmax())
        return self.langs[best], float(p[best] / p.sum())


def predict(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``; the text and all other columns stay."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    out = StructType([f for f in df.schema.fields if f.name not in ("lang_pred", "score")]
                     + [StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    df = df.drop("lang_pred", "score")
    at = df.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        s = Scorer(shared.value)
        for b in batches:
            got = [s.score(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())],
                names=[*b.schema.names, "lang_pred", "score"])

    return df.mapInArrow(releasing(run), out)


def in_training(id_col: str = "doc_id"):
    """Rows a model may learn from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 != 0


def identify(docs: DataFrame, **params) -> DataFrame:
    """Train on the training part of ``docs`` and predict all of it (doc_id, held_out, lang_pred, score)."""
    model = train(docs.where(in_training()), **params)
    res = predict(docs.select("doc_id", "text", (~in_training()).alias("held_out")), model)
    return res.select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5, **params) -> DataFrame:
    """Pipeline stage: drop rows whose language is ``und`` or uncertain (score below ``min_score``)."""
    model = train(docs.where(in_training()), **params)
    cols = docs.columns
    res = predict(docs, model)
    return res.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select(*cols)
