"""Set operations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.util import at


# U01 ------------------------------------------------------------------------
def concat(frames: Iterable[DataFrame]) -> DataFrame:
    """Stack tables keeping duplicates; missing columns become NULL."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# U02 ------------------------------------------------------------------------
def merge_store(old: DataFrame, new: DataFrame, keys: Iterable[str],
                noisy: str = "is_noisy_label") -> tuple[DataFrame, DataFrame]:
    """Old + new, unique on ``keys``, old rows win.

    Returns ``(store, result)``: ``store`` excludes new rows whose label was
    made by noise (they are returned to the caller but never persisted);
    ``result`` is the merged table including them.
    """
    keys = list(keys)
    o = old.withColumn("_prio", F.lit(0))
    n = new.withColumn("_prio", F.lit(1))
    u = o.unionByName(n, allowMissingColumns=True)
    from .window import first_by
    # an aggregate: hot keys are reduced map-side; among equals the row of the smallest hash, whatever the plan
    rest = [F.col(c) for c in u.columns if c not in keys]
    merged = first_by(u, keys, ["_prio", F.xxhash64(*rest)])
    result = merged.drop("_prio")
    if noisy in merged.columns:
        store = merged.filter((F.col("_prio") == 0) | ~F.coalesce(F.col(noisy), F.lit(False))).drop("_prio")
    else:
        store = result
    return store, result


# U03 ------------------------------------------------------------------------
def positions_minus(all_pos: Column, used: Column) -> Column:
    """Indices not used as context (array difference, order kept)."""
    return F.array_except(all_pos, used)


def rows_minus(df: DataFrame, used: DataFrame, keys: Iterable[str]) -> DataFrame:
    return df.join(used.select(*keys), list(keys), "left_anti")


# U04 ------------------------------------------------------------------------
def common_subsets(contexts: Column, field: str = "satisfied_subset") -> Column:
    """Intersection of the user-type sets over a context array."""
    first = at(contexts, 1).getField(field)
    rest = F.slice(contexts, 2, F.greatest(F.size(contexts), F.lit(1)))
    return F.array_sort(F.aggregate(rest, first, lambda acc, x: F.array_intersect(acc, x.getField(field))))


def identifies_user(contexts: Column, field: str = "satisfied_subset") -> Column:
    return F.size(common_subsets(contexts, field)) == 1


# U05 ------------------------------------------------------------------------
def positive_counter_diff(a: DataFrame, b: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Multiset difference of two count tables, positive counts only (Counter subtraction)."""
    j = a.join(b.select(key, F.col(count).alias("_b")), key, "left")
    d = F.col(count) - F.coalesce(F.col("_b"), F.lit(0))
    return j.select(key, d.alias(count)).filter(F.col(count) > 0)


def rows_except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of U05 (multiset difference of rows)."""
    return a.exceptAll(b)


# U06 ------------------------------------------------------------------------
def replicate(df: DataFrame, k: int, out: str = "copy_no") -> DataFrame:
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
