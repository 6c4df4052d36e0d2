"""Small column helpers shared by the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at(arr, idx) -> Column:
    """1-based array access (negative from the end); NULL when out of range (never raises)."""
    a = F.col(arr) if isinstance(arr, str) else arr
    i = F.lit(idx) if isinstance(idx, int) else idx
    return F.try_element_at(a, i)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns, each computed once a row (one generated row per row).

    Columns of ``withColumn`` are copied into every filter and column that names them, and costly ones are
    then computed as often as they are named; the optimizer does not move a filter or column below a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
