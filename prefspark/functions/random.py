"""Hash-seeded randomness.

Every random choice of the library is a pure function of ``(seed, key...)``
so that results repeat across runs, executors lost and re-run, and any
partitioning.  The hash is the first 60 bits of ``md5("seed:key:...")``:
native in the JVM, and reproducible in any SQL engine that has ``md5``
(the oracle queries use exactly this form).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_60 = float(1 << 60)


def _key(seed, keys) -> Column:
    parts = [F.lit(str(seed))] + [F.col(k).cast("string") if isinstance(k, str) else k.cast("string")
                                  for k in keys]
    return F.concat_ws(":", *parts)


def seeded_hash(seed, *keys) -> Column:
    """Non-negative 60-bit BIGINT hash of ``seed`` and the key columns."""
    return F.conv(F.substring(F.md5(_key(seed, keys)), 1, 15), 16, 10).cast("long")


def fast_hash(seed, *keys) -> Column:
    """Non-negative 62-bit hash from ``xxhash64`` (cheaper than md5; used where no SQL
    engine has to reproduce the draw)."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.xxhash64(F.lit(str(seed)), *cols).bitwiseAND(F.lit((1 << 62) - 1))


def seeded_uniform(seed, *keys) -> Column:
    """Deterministic uniform draw in [0, 1)."""
    return seeded_hash(seed, *keys) / F.lit(TWO_60)


def seeded_bit(seed, *keys) -> Column:
    """Deterministic fair coin (0/1 INT)."""
    return (seeded_hash(seed, *keys) % 2).cast("int")


def sql_seeded_hash(seed, *key_sql: str) -> str:
    """The same hash as SQL text (DuckDB / ANSI) for oracle queries."""
    keys = ", ".join(f"CAST({k} AS VARCHAR)" for k in key_sql)
    return f"CAST(('0x' || substr(md5(concat_ws(':', '{seed}', {keys})), 1, 15)) AS BIGINT)"


def sql_seeded_uniform(seed, *key_sql: str) -> str:
    return f"({sql_seeded_hash(seed, *key_sql)} / {TWO_60!r})"


def weighted_choice(u: Column, choices: list, probs: list | None = None) -> Column:
    """Map a uniform draw ``u`` to one of ``choices`` by cumulative ``probs``."""
    n = len(choices)
    if probs is None:
        probs = [1.0 / n] * n
    total = float(sum(probs))
    expr = None
    acc = 0.0
    for c, p in zip(choices[:-1], probs[:-1]):
        acc += p / total
        cond = u < F.lit(acc)
        expr = F.when(cond, F.lit(c)) if expr is None else expr.when(cond, F.lit(c))
    last = F.lit(choices[-1])
    return last if expr is None else expr.otherwise(last)
