"""Declared schemas and checks at the source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

COMPARISON = T.StructType([
    T.StructField("cmp_id", T.LongType(), False),
    T.StructField("uid", T.LongType(), True),
    T.StructField("prompt", T.StringType(), True),
    T.StructField("chosen", T.StringType(), True),
    T.StructField("rejected", T.StringType(), True),
    T.StructField("chosen_only", T.StringType(), True),
    T.StructField("rejected_only", T.StringType(), True),
    T.StructField("split", T.StringType(), True),
])

RATING = T.StructType([
    T.StructField("instruction_id", T.LongType(), False),
    T.StructField("completion_no", T.IntegerType(), False),
    T.StructField("response", T.StringType(), True),
    T.StructField("ratings", T.MapType(T.StringType(), T.StringType()), True),
])

PAIR_LABEL = T.StructType(RATING.fields + [
    T.StructField("data_subset", T.StringType(), True),
    T.StructField("controversial", T.BooleanType(), True),
    T.StructField("reversed", T.BooleanType(), True),
    T.StructField("satisfied_subset", T.ArrayType(T.StringType()), True),
])

ANNOTATION = T.StructType([
    T.StructField("instruction", T.StringType(), True),
    T.StructField("input", T.StringType(), True),
    T.StructField("output_1", T.StringType(), True),
    T.StructField("output_2", T.StringType(), True),
    T.StructField("annotator", T.StringType(), True),
    T.StructField("preference", T.IntegerType(), True),
    T.StructField("chain_of_thoughts", T.StringType(), True),
])

SCORED = T.StructType([
    T.StructField("row_id", T.LongType(), False),
    T.StructField("uid", T.LongType(), True),
    T.StructField("key", T.StringType(), True),
    T.StructField("reward_chosen", T.DoubleType(), True),
    T.StructField("reward_rejected", T.DoubleType(), True),
])

METRIC = T.StructType([
    T.StructField("run", T.StringType(), True),
    T.StructField("uid", T.LongType(), True),
    T.StructField("metric", T.StringType(), True),
    T.StructField("value", T.DoubleType(), True),
])

DIALOG_TURN = T.StructType([
    T.StructField("turn_nb", T.IntegerType(), True),
    T.StructField("user_utterance", T.ArrayType(T.StringType()), True),
    T.StructField("chosen_utterance", T.ArrayType(T.StringType()), True),
    T.StructField("rejected_utterance", T.ArrayType(T.StringType()), True),
])

DIALOG = T.StructType([
    T.StructField("user_id", T.StringType(), True),
    T.StructField("turns", T.ArrayType(DIALOG_TURN), True),
])


def check_columns(df: DataFrame, required) -> DataFrame:
    """Fail early (at planning, no job) when a required column is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
