"""Members of JSON files that hold one object or one list, read by byte blocks.

Spark's text reader cuts a file at every comma and, by its byte blocks, into many tasks, whether or not the file has lines.
A piece is known by its block and its rank there.  Sums over the pieces before it (within the block by a window,
over the blocks before from one narrow row a block) tell whether it starts inside a string and how deep; a piece that
starts outside strings at depth 1 starts a member.  Pieces of a member are joined again, and a member is one value.  So a file
of any size is many tasks, and only its pieces' order within a block is ever sorted in one.

Files are plain text in UTF-8 (a compressed file cannot be cut and is one block).  Malformed JSON gives members that do not parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from ..operators.window import written


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _before(pieces: DataFrame, value: Column, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the file's pieces before each one."""
    blocks = pieces.groupBy("file", "block").agg(F.sum(value).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("file").orderBy("block")) - F.col("_n")
    starts = broadcast_if_small(blocks.select("file", "block", earlier.alias("_earlier")))
    inside = Window.partitionBy("file", "block").orderBy("id")
    return (pieces.withColumn("_inside", F.sum(value).over(inside) - value).join(starts, ["file", "block"])
            .withColumn(out, F.col("_earlier") + F.col("_inside")).drop("_earlier", "_inside"))


def json_members(spark: SparkSession, path: str, keyed: bool = True) -> DataFrame:
    """(file, place, key, value): the members of the object (``keyed``; keys decoded) or list (key NULL) in each file under
    ``path``, as JSON text; ``place`` orders the members of a file."""
    m = F.col("_metadata")
    pieces = (spark.read.option("lineSep", ",").text(path)
              .select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"), "value"))
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    pieces = written(_before(pieces.withColumn("_plain", plain), _count(F.col("_plain"), '"').cast("long"), "_quotes"), "json-pieces")[0]
    inside = F.col("_quotes") % 2 == 1
    outside = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), F.col("_plain")), '(?s)"[^"]*("|$)', "")
    pieces = pieces.withColumn("_in", inside).withColumn("_out", outside)
    deeper = (_count(F.col("_out"), "{[") - _count(F.col("_out"), "}]")).cast("long")
    pieces = _before(pieces.withColumn("_deeper", deeper), F.col("_deeper"), "_depth")
    first = (F.col("block") == 0) & (F.col("_depth") == 0)
    pieces = pieces.select("file", "block", "id", "value", (F.col("_depth") + F.col("_deeper") == 0).alias("_last"), first.alias("_first"),
                           (first | (~F.col("_in") & (F.col("_depth") == 1))).cast("long").alias("_starts"))
    pieces = written(pieces, "json-members")[0]
    # members up to and with this piece
    pieces = _before(pieces, F.col("_starts"), "_n").withColumn("place", F.col("_n") + F.col("_starts") - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "id", "value"))), lambda p: p["value"]), ",")
    members = pieces.groupBy("file", "place").agg(text.alias("text"), F.max("_first").alias("_first"), F.max("_last").alias("_last"))
    body = F.when(F.col("_first"), F.regexp_replace("text", r"^\s*[\{\[]", "")).otherwise(F.col("text"))
    members = members.withColumn("text", body)
    body = F.when(F.col("_last"), F.regexp_replace("text", r"[\}\]]\s*$", "")).otherwise(F.col("text"))
    members = members.withColumn("text", body).filter(F.length(F.trim("text")) > 0)
    if not keyed:
        return members.select("file", "place", F.lit(None).cast("string").alias("key"), F.trim("text").alias("value"))
    name = r'(?s)^\s*("(?:[^"\\]|\\.)*")\s*:'
    quoted = F.regexp_extract("text", name, 1)
    return members.select("file", "place", F.get_json_object(F.concat(F.lit("["), quoted, F.lit("]")), "$[0]").alias("key"),
                          F.regexp_replace("text", name, "").alias("value"))
