"""A lookup join that hot keys cannot slow down."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_table_path

#: keys that hold more than one in HOT_SHARE of the counted rows are at most HOT_SHARE in number
HOT_SHARE = 10_000
#: rows of a table that may be broadcast besides
SMALL_ROWS = 200_000


def lookup(big: DataFrame, table: DataFrame, keys: list[str], weight: str, spread: Column, written: bool = False) -> DataFrame:
    """``big`` left-joined with ``table``, which has one row per key and, in ``weight``, that key's rows in ``big``;
    ``written``: the table already stands in the shared folder.

    The keys of more than one in ``HOT_SHARE`` rows are broadcast: there can be no more than ``HOT_SHARE`` of them.
    The others are broadcast too while they are few; else ``big`` is shuffled by key, where rows that
    have found their hot key go by ``spread`` instead.
    """
    spark, values = big.sparkSession, [c for c in table.columns if c not in keys and c != weight]
    if not written:
        path = scratch_table_path(spark, f"lookup-{uuid.uuid4().hex}")
        table.write.mode("overwrite").parquet(path)
        table = spark.read.parquet(path)
    n, rows = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    if n <= SMALL_ROWS:
        return big.join(F.broadcast(table.drop(weight)), keys, "left")
    hot = F.col(weight) * HOT_SHARE > rows
    found = table.filter(hot).select(*[F.col(k).alias(f"_hot_{k}") for k in keys],
                                     *[F.col(c).alias(f"_hot_{c}") for c in values], F.lit(True).alias("_hot"))
    cold = table.filter(~hot).select(*[F.col(k).alias(f"_cold_{k}") for k in keys],
                                     *[F.col(c).alias(f"_cold_{c}") for c in values], F.lit(0).cast("long").alias("_spread"))
    on = [F.col(k) == F.col(f"_hot_{k}") for k in keys]
    met = (big.join(F.broadcast(found), on, "left")
           .withColumn("_way", F.when(F.col("_hot"), F.xxhash64(spread).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long"))))
    on = [F.col(k) == F.col(f"_cold_{k}") for k in keys] + [F.col("_way") == F.col("_spread")]
    out = met.join(cold, on, "left")
    return out.select(*[big.columns[i] for i in range(len(big.columns))],
                      *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in values])
