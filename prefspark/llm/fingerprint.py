"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its pieces between line feeds and sentence marks (``. , ; : ! ?``), without surrounding
blanks; a piece of over ``LONG`` bytes also ends behind every word whose hash is a multiple of 4, so that texts
without marks are resolved too.  A digest is 40 bits of hash (of the piece and of how often it stood before in the same text, so
a repeated piece counts each time) and 24 bits of byte length.  A sketch has three rows of ``cells``
cells; each digest is added to one cell per row as (count, xor of digests, xor of checks).

Two versions' sketches subtract cell by cell; peeling cells that hold one digest recovers exactly the
digests that differ.  When peeling gets stuck the sketches are made four times larger, with other cells, until
it succeeds.  From the recovered digests' lengths follows the likeness: bytes in common over
bytes in either.

All pairs of a batch are peeled together in numpy.  A fingerprint is the smallest sketch with the number of digests
and bytes, in base64; equal texts have equal fingerprints.

Defined results: null and empty texts have no digests; two texts without digests are alike (1.0); equal
ids are ordered by text hash, null ids come last; a single row is its own next; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mix, prefix_sums, span_hash, text_buffer, word_spans, worker_cache

ROWS = 3
CELLS = 8
LONG = 40
LENGTH = np.uint64((1 << 24) - 1)


def _marks() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[list(b".,;:!?")] = 1
    t[10] = 2
    t[[9, 11, 12, 13, 32]] = 3
    return t


def digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digest, document) of every paragraph of a buffer of documents, by document."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = worker_cache("paragraph_marks", _marks)[data]
    # a piece ends after a mark and at a line feed
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(kind == 1) + 1, np.flatnonzero(kind == 2), np.flatnonzero(kind == 2) + 1]))
    sums = prefix_sums(data)
    long_ = np.diff(cuts) > LONG
    if long_.any():
        s, e, _ = word_spans(data, offsets)
        e = e[span_hash(sums, s, e) & np.uint64(3) == 0]
        cuts = np.unique(np.concatenate([cuts, e[long_[np.searchsorted(cuts, e, side="left") - 1]]]))
    starts, ends = cuts[:-1], cuts[1:]
    # blanks around a piece do not count
    solid = np.concatenate([[0], np.cumsum((kind != 2) & (kind != 3))])
    some = solid[ends] > solid[starts]
    starts, ends = starts[some], ends[some]
    at = np.flatnonzero((kind != 2) & (kind != 3))
    first, last = at[solid[starts]], at[solid[ends] - 1] + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    h = span_hash(sums, first, last)
    # how often the piece stood before in its document
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    run = np.flatnonzero(new)
    nth = np.empty(len(h), np.int64)
    nth[order] = np.arange(len(h)) - np.repeat(run, np.diff(np.append(run, len(h))))
    h = mix(h + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 4)
    return (h & ~LENGTH) | np.minimum((last - first).astype(np.uint64), LENGTH), doc


def cells_of(key: np.ndarray, cells: int, level: int) -> np.ndarray:
    """(ROWS, n) cell numbers."""
    return np.stack([(mix(key, 16 * level + r + 1) % np.uint64(cells)).astype(np.int64) + r * cells for r in range(ROWS)])


def check(key: np.ndarray) -> np.ndarray:
    return (mix(key, 99) >> np.uint64(32)).astype(np.uint32)


def sketches(key: np.ndarray, owner: np.ndarray, sign: np.ndarray, n: int, cells: int, level: int):
    """Signed sums of digests as (count, digest xor, check xor) arrays of n sketches."""
    width = ROWS * cells
    at = (cells_of(key, cells, level) + owner * width).ravel()
    count = np.bincount(at, weights=np.tile(sign, ROWS), minlength=n * width).astype(np.int32)
    keys, checks = np.zeros(n * width, np.uint64), np.zeros(n * width, np.uint32)
    np.bitwise_xor.at(keys, at, np.tile(key, ROWS))
    np.bitwise_xor.at(checks, at, np.tile(check(key), ROWS))
    return count, keys, checks


def peel(count, keys, checks, n: int, cells: int, level: int):
    """Recovered (pair, digest, sign) of n subtracted sketches, and which were emptied."""
    width = ROWS * cells
    found = []
    watch = np.flatnonzero(count)
    while len(watch):
        pure = watch[np.abs(count[watch]) == 1]
        pure = pure[check(keys[pure]) == checks[pure]]
        if len(pure) == 0:
            break
        pair, key, sign = pure // width, keys[pure], count[pure]
        order = np.lexsort((key, pair))
        pair, key, sign = pair[order], key[order], sign[order]
        one = np.ones(len(pair), bool)
        one[1:] = (pair[1:] != pair[:-1]) | (key[1:] != key[:-1])
        pair, key, sign = pair[one], key[one], sign[one]
        found.append((pair, key, sign))
        at = (cells_of(key, cells, level) + pair * width).ravel()
        np.subtract.at(count, at, np.tile(sign, ROWS).astype(np.int32))
        np.bitwise_xor.at(keys, at, np.tile(key, ROWS))
        np.bitwise_xor.at(checks, at, np.tile(check(key), ROWS))
        watch = np.unique(at)
    empty = ~((count != 0) | (keys != 0)).reshape(n, width).any(axis=1) if n else np.zeros(0, bool)
    if not found:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), z, empty
    return *(np.concatenate(x) for x in zip(*found)), empty


def differences(key_a, doc_a, key_b, doc_b, n: int):
    """Digests that differ in n pairs of texts: (pair, digest, +1 only in a / -1 only in b).

    Pair i holds the digests whose document is i; stuck pairs are retried with four times the cells."""
    out = []
    left = np.arange(n)
    key, pair = np.concatenate([key_a, key_b]), np.concatenate([doc_a, doc_b])
    sign = np.concatenate([np.ones(len(key_a)), -np.ones(len(key_b))])
    cells, level = CELLS, 0
    while len(left):
        local = np.full(n, -1, np.int64)
        local[left] = np.arange(len(left))
        own = local[pair] >= 0
        key, pair, sign = key[own], pair[own], sign[own]
        p, k, s, empty = peel(*sketches(key, local[pair], sign, len(left), cells, level), len(left), cells, level)
        ok = empty[p] if len(p) else np.zeros(0, bool)
        out.append((left[p[ok]], k[ok], s[ok]))
        left = left[~empty]
        cells, level = cells * 4, level + 1
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def likeness(key_a, doc_a, key_b, doc_b, n: int) -> np.ndarray:
    """Bytes in common over bytes in either, from the recovered digests."""
    size = lambda k, d: np.bincount(d, weights=(k & LENGTH).astype(np.float64), minlength=n)
    pair, key, sign = differences(key_a, doc_a, key_b, doc_b, n)
    only = size(key[sign > 0], pair[sign > 0])
    other = size(key[sign < 0], pair[sign < 0])
    common = size(key_a, doc_a) - only
    union = common + only + other
    return np.where(union > 0, common / np.maximum(union, 1), 1.0)


def fingerprints(key: np.ndarray, doc: np.ndarray, n: int) -> list[str]:
    """The smallest sketch of each text, as base64 of (digests, bytes, cells)."""
    count, keys, checks = sketches(key, doc, np.ones(len(key)), n, CELLS, 0)
    head = np.stack([np.bincount(doc, minlength=n), np.bincount(doc, weights=(key & LENGTH).astype(np.float64), minlength=n)], axis=1).astype("<u8")
    w = ROWS * CELLS
    parts = (head.view(np.uint8).reshape(n, -1), count.astype("<i4").view(np.uint8).reshape(n, 4 * w),
             keys.astype("<u8").view(np.uint8).reshape(n, 8 * w), checks.astype("<u4").view(np.uint8).reshape(n, 4 * w))
    return [base64.b64encode(row.tobytes()).decode() for row in np.hstack(parts)] if n else []


def _bucket(bounds: list[int], x):
    """How many sorted bounds are below x, by binary search."""
    if not bounds:
        return F.lit(0)
    arr = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << j) for j in range(len(bounds).bit_length() - 1, -1, -1)])
    n = F.lit(len(bounds))
    return F.aggregate(steps, F.lit(0), lambda pos, s: F.when((pos + s <= n) & (F.element_at(arr, F.least(pos + s, n)) < x), pos + s).otherwise(pos))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows (bucket, look, doc_id, text) dealt by ranges of ``doc_id`` and sorted in descending order within each bucket;
    after a bucket's rows comes a copy (look = 1) of the row that follows its last one, the first row after the very last."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    probs = [i / buckets for i in range(1, buckets)]
    bounds = sorted({int(b) for b in docs.where("doc_id is not null").stat.approxQuantile("doc_id", probs, 0.2 / buckets)}) if probs else []
    # null ids come last, by ranges of the text hash that orders them: 16 buckets below the others
    tie = F.coalesce(F.xxhash64("text"), F.lit(0))
    docs = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), -9 - F.shiftright(tie, 60)).otherwise(_bucket(bounds, F.col("doc_id"))).cast("int"))
    heads = (docs.groupBy("bucket").agg(F.max(F.struct("doc_id", F.bitwise_not(tie).alias("t"))).alias("h"))
             .orderBy(F.desc("bucket")).collect())
    order = [(r["bucket"], r["h"]["doc_id"], ~r["h"]["t"]) for r in heads]
    # one row per bucket
    ahead = spark.createDataFrame([(*order[(i + 1) % len(order)][1:], b) for i, (b, _, _) in enumerate(order)], "_id long, _tie long, _to int")
    marked = docs.join(F.broadcast(ahead), docs["doc_id"].eqNullSafe(ahead["_id"]) & (tie == ahead["_tie"]), "left")
    own = F.array(F.struct(F.col("bucket"), F.lit(0).alias("look")))
    both = F.array(F.struct(F.col("bucket"), F.lit(0).alias("look")), F.struct(F.col("_to").alias("bucket"), F.lit(1).alias("look")))
    dealt = marked.select("doc_id", "text", F.explode(F.when(F.col("_to").isNull(), own).otherwise(both)).alias("x"))
    # a bucket is a task: hashed bucket numbers would put several ranges into one
    return (dealt.select("x.bucket", "x.look", "doc_id", "text").repartitionById(len(bounds) + 17, F.col("bucket") + 16)
            .sortWithinPartitions("bucket", "look", F.col("doc_id").desc_nulls_last(), tie))


def _compare():
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def piece(rows):
        """Rows (bucket, look, doc_id, text); every row but the last one is compared to its follower in the same bucket."""
        texts = [r[3] for r in rows]
        key, doc = digests(*text_buffer(pa.array(texts, pa.large_string())))
        use = [i for i in range(len(rows) - 1) if rows[i][1] == 0 and rows[i + 1][0] == rows[i][0]]
        n = len(use)
        if not n:
            return pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names=names)
        edited = []
        for i in use:
            t = texts[i]
            cut = len(t) // 3
            edited.append(t[: len(t) - cut] + texts[i + 1][:cut])
        ekey, edoc = digests(*text_buffer(pa.array(edited, pa.large_string())))
        place = np.full(len(rows) + 1, -1, np.int64)
        place[use] = np.arange(n)
        own, nxt = place[doc], place[doc - 1]
        mine, follow = own >= 0, nxt >= 0
        a_key, a_doc = key[mine], own[mine]
        prints = fingerprints(a_key, a_doc, n)
        return pa.RecordBatch.from_arrays([
            pa.array([rows[i][2] for i in use], pa.int64()), pa.array([len(texts[i]) for i in use], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited]), pa.array(prints), pa.array(fingerprints(ekey, edoc, n)),
            pa.array(likeness(a_key, a_doc, ekey, edoc, n)), pa.array(likeness(a_key, a_doc, key[follow], nxt[follow], n))], names=names)

    def run(batches):
        held: list = []
        size = 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                r = (*r[:3], r[3] or "")
                held.append(r)
                size += len(r[3])
                if size > 1 << 20 and len(held) > 1:
                    yield piece(held)
                    held, size = held[-1:], len(held[-1][3])
        if len(held) > 1:
            yield piece(held)

    return run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit (the last third replaced by as many characters of the next document)."""
    run, out = _compare()
    return with_next(docs).mapInArrow(run, out)
