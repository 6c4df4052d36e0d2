"""Best-fit packing planned over the histogram of lengths.

Documents are tokenised and cut into pieces of at most ``capacity`` ids.  Only the histogram
(length, pieces), at most ``capacity`` rows, reaches the driver; best-fit decreasing runs over
its counts and yields slots: ranges of ranks within a length that go to consecutive sequences.
Pieces then take their slots by joining on their rank within their length.  The rank is a
window over (length, hash bucket) plus the bucket's offset, so a length that a third of the pieces
share is not ranked in one task.

Defined results: null or empty text is one piece holding only the end id; no rows give no rows;
repeated rows are packed separately; a null id is packed like any other.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .arrays import table, text_chunks
from .tokenise import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece of each document's ids (with the end id)."""

    def run(batches):
        import zlib

        enc = encoder(tokenizer)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                            ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for part, data, off in text_chunks(batches, "text", 2 << 20):
            ids, at = enc.encode(data, off)
            doc_ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
            rows: list[list] = [[], [], [], [], []]
            for i, d in enumerate(doc_ids):
                own = np.append(ids[at[i]: at[i + 1]].astype("<u4"), np.uint32(end_id)).astype("<u4")
                for k, s in enumerate(range(0, len(own), capacity)):
                    cut = own[s: s + capacity]
                    for c, v in zip(rows, (d, k, s, len(cut), zlib.crc32(cut.tobytes()))):
                        c.append(v)
            yield table(schema, **dict(zip(schema.names, rows)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, sequences, pieces in each, first
    sequence, offset there).  Sequences of equal room are kept as ranges, so the work follows
    the number of lengths and not of documents."""
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges (first sequence, how many)
    free: list[int] = []
    slots, opened = [], 0

    def add(room, first, n):
        if n and room:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(free, room)
            rooms[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect.bisect_left(free, length)
            if i == len(free):
                per = capacity // length
                n = -(-left // per)
                room, first = capacity, opened
                opened += n
            else:
                room = free[i]
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    free.pop(i)
            per = room // length
            full = min(n, left // per)
            if full:
                slots.append((length, rank, full, per, first, capacity - room))
                rank += full * per
                left -= full * per
                add(room - per * length, first, full)
            rest = left if full < n and left < per else 0
            if rest:
                slots.append((length, rank, 1, rest, first + full, capacity - room))
                rank += rest
                left -= rest
                add(room - rest * length, first + full, 1)
            add(room, first + full + bool(rest), n - full - bool(rest))
    return slots


#: pieces of one length ranked by one task, about
RANKED = 200_000


def pack(pieces: DataFrame, capacity: int = 4096, buckets: int | None = None) -> DataFrame:
    """``pieces`` (with a ``length`` of 1..capacity and a ``doc_id``) plus ``sequence_id`` and ``offset``.

    A length's pieces are ranked in ``buckets`` shares; by default as many as keep the most frequent length's shares at about
    ``RANKED``."""
    spark = pieces.sparkSession
    if buckets is None:
        most = pieces.groupBy("length").count().agg(F.max("count")).collect()[0][0] or 0
        buckets = max(1, -(-most // RANKED))
    pieces = pieces.withColumn("_b", F.pmod(F.xxhash64(*[F.col(c) for c in pieces.columns]), F.lit(buckets)))
    per = pieces.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    per = materialize(per)
    hist = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = plan(hist, capacity)
    base = per.withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n")).drop("_n")
    keys = [c for c in pieces.columns if c not in ("length", "_b")]
    ranked = (pieces.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_b").orderBy(*keys)))
              .join(base, ["length", "_b"])
              .withColumn("_rank", F.col("_base") + F.col("_r") - 1))
    plan_df = spark.createDataFrame(slots, "_l long, _from long, _seqs long, _per long, _first long, _off long")
    at = F.col("_rank") - F.col("_from")
    # the plan has a few rows per length (at most capacity lengths): bounded, so it is broadcast
    return (ranked.join(F.broadcast(plan_df), (F.col("length") == F.col("_l")) & (F.col("_rank") >= F.col("_from"))
                        & (F.col("_rank") < F.col("_from") + F.col("_seqs") * F.col("_per")))
            .withColumn("sequence_id", F.col("_first") + F.floor(at / F.col("_per")))
            .withColumn("offset", F.col("_off") + F.pmod(at, F.col("_per")) * F.col("length"))
            .drop("_b", "_base", "_r", "_rank", "_l", "_from", "_seqs", "_per", "_first", "_off"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenise once (the narrow pieces are written to the shared folder), plan, place."""
    return pack(materialize(pieces_of(docs, tokenizer, capacity, end_id)), capacity)
