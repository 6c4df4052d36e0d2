"""Sources: declared schemas, partition pruning, keyed JSON."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as SC


# S01 ------------------------------------------------------------------------
def read_comparisons(spark: SparkSession, path: str, split: str | None = None,
                     schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """A comparison table with a declared schema; ``split`` is a partition column, so the
    split filter prunes directories instead of reading them."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    df = r.load(path)
    SC.check_columns(df, [f.name for f in (schema or df.schema).fields])
    return df if split is None else df.filter(F.col("split") == split)


# S02 ------------------------------------------------------------------------
def read_jsonl_by_subset(spark: SparkSession, root: str, subsets: Iterable[str] | None = None,
                         split: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """JSONL partitioned as ``data_subset=<s>/split=<t>``; the union of the wanted subsets is a
    partition filter (pruned at planning time)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.json(root)
    if subsets is not None:
        df = df.filter(F.col("data_subset").isin([str(s) for s in subsets]))
    if split is not None:
        df = df.filter(F.col("split") == split)
    return df


# S03 ------------------------------------------------------------------------
def read_keyed_json(spark: SparkSession, path: str, value_schema: T.DataType, key: str = "id") -> DataFrame:
    """JSON objects keyed by id (``{"id1": {...}, "id2": {...}}``) -> rows.

    A file is read by byte blocks and its members are parsed one by one (``json_members``), so one
    object of any size is many tasks."""
    from .json_members import json_members
    m = json_members(spark, path)
    return m.select(F.col("key").alias(key), F.from_json("value", value_schema).alias("_v")).select(key, "_v.*")


# S04 ------------------------------------------------------------------------
def read_lookup(spark: SparkSession, path: str, name: str = "worker", value: str | None = None) -> DataFrame:
    """Whitespace text list: ``name`` per line, optionally ``name value``.  Ids are numbered from
    1 in file order (0 stays reserved for unknown).  A lookup file is small by nature (a user
    list); it is read whole and its rows are numbered by line, over several files by path and line."""
    raw = spark.read.text(path, wholetext=True)
    lines = raw.select(F.col("_metadata.file_path").alias("_f"), F.posexplode(F.split(F.col("value"), "\n")).alias("_ln", "_l")).filter(F.length(F.trim("_l")) > 0)
    parts = F.split(F.trim(F.col("_l")), r"\s+")
    cols = [parts[0].alias(name)]
    if value is not None:
        cols.append(parts[1].alias(value))
    d = lines.select("_f", "_ln", *cols)
    from ..operators.window import dense_position
    return dense_position(d, ["_f", "_ln"], "uid", base=1).drop("_f", "_ln")


# S05 / S06 ------------------------------------------------------------------
def read_saved(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def read_prompts(spark: SparkSession, path: str, fmt: str = "json", text: str = "prompt") -> DataFrame:
    """Prompt list with an explicit ``prompt_id``.  ``fmt="json_list"`` reads files holding one
    JSON list each and numbers the entries by file path and position."""
    if fmt == "json_list":
        from ..operators.window import dense_position
        from .json_members import json_members
        m = json_members(spark, path, keyed=False)
        entries = m.select("file", "place", F.get_json_object(F.concat(F.lit("["), "value", F.lit("]")), "$[0]").alias(text))
        return dense_position(entries, ["file", "place"], "prompt_id").select("prompt_id", text)
    return spark.read.format(fmt).load(path)


# S15 ------------------------------------------------------------------------
def as_frame(spark: SparkSession, data, schema=None) -> DataFrame:
    """Accept a DataFrame (passed through), a pandas frame, a list of records or an iterable of
    records; records get the declared ``schema``."""
    if isinstance(data, DataFrame):
        return data
    try:
        import pandas as pd
        if isinstance(data, pd.DataFrame):
            return spark.createDataFrame(data, schema=schema)
    except ImportError:  # pragma: no cover
        pass
    rows = list(data)
    return spark.createDataFrame(rows, schema=schema)
