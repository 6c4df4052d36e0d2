"""Corpus pipeline: documents -> identified, de-duplicated, cut, decontaminated and packed.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return the columns of ``documents``.

1. language_id: documents without a sure language go.
2. near_duplicates: of documents linked by word-shingle similarity (5 words, 0.75) the one of the smallest id stays.
3. repeated_substrings: bytes covered by strings of ``PASSAGE_BYTES`` that occur elsewhere go; a text may become empty.
4. decontamination: documents that hold a benchmark item go.
5. packing: the rest is tokenised and packed into sequences of 4096 ids.

Each stage reads only what its predecessor kept and every row and text of it.  The stages' own docstrings
define the results for nulls, empty texts, repeated rows and empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from prefspark.llm.decontaminate import drop_contaminated
from prefspark.llm.jaccard_join import keep_one
from prefspark.llm.langid import keep_identified
from prefspark.llm.packing import pack_documents
from prefspark.llm.queries import bounded_batches, read, tokenizer_path
from prefspark.llm.substring_dedup import remove_repeats
from prefspark.session import scratch_dropped, scratch_table_path


#: a passage of over 50 words has more bytes than this, unless its words have under three letters
PASSAGE_BYTES = 200


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return keep_one(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return remove_repeats(docs, PASSAGE_BYTES)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return (pack_documents(docs, tokenizer_path())
            .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    tag = uuid.uuid4().hex
    for i, (name, stage) in enumerate(STAGES):
        path = scratch_table_path(spark, f"pipeline-{tag}-{i}-{name}")
        # a stage's own intermediate tables go once its result is written
        with scratch_dropped():
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
