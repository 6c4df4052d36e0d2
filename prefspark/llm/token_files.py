"""Token ids as wavelet-matrix shards, written by Spark and read back.

Documents are range-partitioned by id and each partition, in ascending order, is cut into shards of
about ``shard_tokens`` ids.  A shard is one row (so one file: ``maxRecordsPerFile`` is 1) of a Parquet
table in a folder that all executors share: the wavelet matrix of its ids, its documents' ids and
lengths.  Shards carry their place, so global offsets need only the token counts per
partition on the driver and a window within each partition.

Defined results: null or empty text holds only the end id; a null id sorts first; repeated ids keep all
their rows, ordered by text hash; an empty table has no shards; extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_table_path
from .arrays import table, text_chunks
from .tokenise import encoder
from .wavelet import WaveletMatrix

SHARD = "part int, shard int, n_docs long, n_tokens long, doc_ids array<long>, lengths array<long>, wavelet binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                     ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("wavelet", pa.binary())])


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, shard_tokens: int = 2_000_000) -> None:
    """Tokenise ``docs`` (doc_id, text) and write their shards to ``path``."""

    def run(batches):
        from pyspark import TaskContext

        part, made, size = TaskContext.get().partitionId(), 0, 0
        enc = encoder(tokenizer)
        held: list = []

        def flush():
            lens = np.concatenate([n for _, n, _ in held])
            wm = WaveletMatrix.build(np.concatenate([x for *_, x in held]))
            return table(_SCHEMA, part=[part], shard=[made], n_docs=[len(lens)], n_tokens=[int(lens.sum())],
                         doc_ids=[[i for d, _, _ in held for i in d]], lengths=[lens.tolist()], wavelet=[wm.to_bytes()])

        for rows, data, off in text_chunks(batches, "text", 2 << 20):
            ids, at = enc.encode(data, off)
            held.append((rows.column(0).to_pylist(), np.diff(at) + 1, np.insert(ids, at[1:], np.uint16(end_id))))
            size += len(held[-1][2])
            if size >= shard_tokens:
                yield flush()
                held, size, made = [], 0, made + 1
        if held:
            yield flush()

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
     .repartitionByRange(F.col("doc_id").asc_nulls_first())
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
     .mapInArrow(run, SHARD).write.mode("overwrite").option("maxRecordsPerFile", 1).parquet(path))


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, shard, start): ids before each shard."""
    per = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    total, base = 0, []
    for p in sorted(per):
        base.append((p, total))
        total += per[p]
    w = Window.partitionBy("part").orderBy("shard")
    base = shards.sparkSession.createDataFrame(base, "part int, _base long")
    return (shards.select("part", "shard", "n_tokens").join(base, "part")
            .select("part", "shard", (F.sum("n_tokens").over(w) - F.col("n_tokens") + F.col("_base")).alias("start")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' decoded ids."""
    shards = spark.read.parquet(path)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        import zlib

        for b in batches:
            for i in range(b.num_rows):
                start, doc_ids, lens, blob = (b.column(k)[i].as_py() for k in range(4))
                ids = WaveletMatrix.from_bytes(blob).decode().astype("<u4")
                at = np.concatenate([[0], np.cumsum(lens)])
                mv = memoryview(ids).cast("B")
                yield table(schema, doc_id=doc_ids, start=(at[:-1] + start).tolist(), n_tokens=lens,
                            ids_crc32=[zlib.crc32(mv[4 * a: 4 * e]) for a, e in zip(at[:-1].tolist(), at[1:].tolist())])

    joined = shards.join(shard_starts(shards), ["part", "shard"])
    return (joined.select("start", "doc_ids", "lengths", "wavelet")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write, then read back."""
    path = path or scratch_table_path(docs.sparkSession, f"tokens-{uuid.uuid4().hex}")
    write_shards(docs, tokenizer, path)
    return read_documents(docs.sparkSession, path)
