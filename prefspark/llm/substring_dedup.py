"""Removal of repeated byte strings (``min_len`` bytes that also start anywhere else).

1. Every window of ``min_len`` bytes is owned by its minimizer (the smallest hash of its
   ``k``-byte strings, leftmost on ties), so equal windows have equal minimizers at equal places.
   Consecutive windows of one minimizer occurrence form a stretch; a stretch is one narrow row.
2. Spark counts stretches by minimizer and content.  A minimizer seen once owns no repeat.
   Stretches of equal content repeat as a whole (counted with partial aggregation, so a text that
   a third of all rows hold is one sum).
3. Differing stretches of one minimizer are fetched once each, trimmed to the longest context that
   another one shares on either side, and searched by threshold-bounded interval expansion on
   their Burrows-Wheeler transform (``bwt.py``), a bounded collection at a time.  A minimizer
   with more than ``HOT`` differing stretches is not gathered: its windows are hashed (128 bits)
   and counted by Spark.
4. Repeated ranges meet their documents by id and text hash.

Defined results: null and empty texts have no bytes and nothing removed; texts shorter than
``min_len`` keep everything; repeated rows remove each other like any other copies; null ids are
matched by their texts; extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_table_path
from .bwt import repeated_starts
from .hot_join import lookup
from .arrays import powers, prefix_sums, releasing, table, text_chunks

K = 64
HOT = 3000
BATCH = 1 << 19
_POS = np.uint64((1 << 24) - 1)


def gram_hashes(sums: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-byte string of a buffer."""
    m = len(sums) - k
    _, q = powers(m)
    h = (sums[k:] - sums[:m]) * q
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def stretches(data: np.ndarray, offsets: np.ndarray, min_len: int, k: int = K):
    """(document, first window, end of windows, minimizer) of each stretch, in buffer positions.

    At most 16 MB at once (position bits); a longer document is cut by the caller."""
    n = len(data)
    w = min_len - k + 1
    none = np.zeros(0, np.int64)
    if n < min_len:
        return none, none, none, np.zeros(0, np.uint64)
    h = gram_hashes(prefix_sums(data), k)
    m = len(h)
    blocks = np.full(m + -m % w, ~np.uint64(0))
    np.bitwise_or(h & ~_POS, np.arange(m, dtype=np.uint64), out=blocks[:m])
    blocks = blocks.reshape(-1, w)
    windows = n - min_len + 1
    least = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:windows]
    np.minimum.accumulate(blocks, axis=1, out=blocks)
    pos = (np.minimum(least, blocks.ravel()[w - 1: w - 1 + windows]) & _POS).astype(np.int64)
    del blocks, least
    first = np.empty(windows, bool)
    first[0] = True
    first[1:] = pos[1:] != pos[:-1]
    a, b = offsets[:-1], offsets[1:] - min_len + 1
    long_enough = b > a
    a, b = a[long_enough], b[long_enough]
    first[a] = True
    edge = np.zeros(windows + 1, np.int32)
    edge[a] += 1
    np.subtract.at(edge, b, 1)
    first &= np.cumsum(edge[:-1]) > 0
    s0 = np.flatnonzero(first)
    doc = np.searchsorted(offsets, s0, side="right") - 1
    s1 = np.minimum(np.append(s0[1:], windows), offsets[doc + 1] - min_len + 1)
    return doc, s0, s1, h[pos[s0]]


def cut_long(data: np.ndarray, offsets: np.ndarray, min_len: int, limit: int = 1 << 23):
    """Buffers of at most ``limit`` bytes with (document, shift): documents beyond it are cut into
    parts that overlap by ``min_len - 1`` bytes, so every window is in exactly one part."""
    if len(data) <= limit:
        yield data, offsets, np.arange(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
        return
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        step = limit - min_len + 1
        for s in range(a, max(a + 1, b - min_len + 1), step):
            part = data[s: min(b, s + limit)]
            yield part, np.array([0, len(part)]), np.array([i]), np.array([s - a])


def _find(min_len: int, k: int):
    schema = pa.schema([("mh", pa.int64()), ("sh", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()),
                        ("start", pa.int64()), ("n", pa.int32())])

    def run(batches):
        import xxhash

        for rows, data, off in text_chunks(batches, "text"):
            ids, th = rows.column(0), rows.column(1)
            for part, po, docs, shift in cut_long(data, off, min_len):
                doc, s0, s1, mh = stretches(part, po, min_len, k)
                if len(doc) == 0:
                    continue
                mv, add = memoryview(np.ascontiguousarray(part)), min_len - 1
                digest = xxhash.xxh3_64_intdigest
                sh = np.fromiter((digest(mv[a: b + add]) for a, b in zip(s0.tolist(), s1.tolist())), np.uint64, len(s0))
                at = pa.array(docs[doc])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mh.view(np.int64)), pa.array(sh.view(np.int64)), ids.take(at), th.take(at),
                     pa.array(s0 - po[doc] + shift[doc]), pa.array((s1 - s0).astype(np.int32))], schema=schema)

    return run, "mh long, sh long, doc_id long, th long, start long, n int"


def _slices():
    """Bytes of the wanted stretches of each text."""
    schema = pa.schema([("mh", pa.int64()), ("sh", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()),
                        ("th", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        for b in batches:
            rows: list[list] = [[] for _ in schema]
            for doc_id, th, text, want in zip(*(c.to_pylist() for c in b.columns)):
                raw = text.encode("utf-8")
                for x in want:
                    for col, v in zip(rows, (x["mh"], x["sh"], x["c"], doc_id, th, x["start"], raw[x["start"]: x["end"]])):
                        col.append(v)
            yield table(schema, **dict(zip(schema.names, rows)))

    return run, "mh long, sh long, c long, doc_id long, th long, start long, bytes binary"


def trimmed(strings: list[bytes], mh: int, min_len: int, k: int) -> list[tuple[int, bytes] | None]:
    """Each string cut to the longest context around its minimizer that another one shares on
    either side, as (offset, bytes); None where both together stay below ``min_len``."""
    from os.path import commonprefix

    pos = []
    for x in strings:
        h = gram_hashes(prefix_sums(np.frombuffer(x, np.uint8)), k)
        pos.append(int(np.flatnonzero(h.view(np.int64) == mh)[0]))
    shared = []
    for context in ([x[p + k:] for x, p in zip(strings, pos)], [x[:p][::-1] for x, p in zip(strings, pos)]):
        most = [0] * len(strings)
        order = sorted(range(len(strings)), key=context.__getitem__)
        for i, j in zip(order, order[1:]):
            c = len(commonprefix([context[i], context[j]]))
            most[i], most[j] = max(most[i], c), max(most[j], c)
        shared.append(most)
    return [(p - left, x[p - left: p + k + right]) if left + k + right >= min_len else None
            for x, p, right, left in zip(strings, pos, *shared)]


def _expand(min_len: int, k: int):
    """Rows sorted by minimizer: repeated ranges of stretches that occur once."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])

    def run(batches):
        from collections import Counter
        from itertools import groupby

        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        pool: list[bytes] = []
        holders: list[list] = []
        size = 0

        def ranges_of(holder, starts):
            out = []
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > 1)
                for a, b in zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist()):
                    out += [(d, t, o + a, o + b + min_len) for d, t, o in holder]
            return out

        def flush():
            out = []
            for holder, starts in zip(holders, repeated_starts(pool, min_len)):
                out += ranges_of(holder, starts)
            return table(schema, **dict(zip(schema.names, zip(*out) if out else [[]] * 4)))

        for mh, group in groupby(rows(), key=lambda r: r[0]):
            # a repeated row of a repeated id brings the same stretch twice
            group = list({r[1]: r for r in group}.values())
            if len(group) < 2:
                continue
            cut = [(r, t) for r, t in zip(group, trimmed([r[6] for r in group], mh, min_len, k)) if t]
            same = Counter(t[1] for _, t in cut)
            by: dict = {}
            for r, (o, x) in cut:
                held = by.setdefault(x, [])
                if r[2] == 1:
                    held.append((r[3], r[4], r[5] + o))
            out = []
            for x, held in by.items():
                if same[x] > 1 and held:
                    out += [(d, t, o, o + len(x)) for d, t, o in held]
            if out:
                yield table(schema, **dict(zip(schema.names, zip(*out))))
            if len(by) > 1 and any(same[x] == 1 and held for x, held in by.items()):
                for x, held in by.items():
                    pool.append(x)
                    holders.append(held if same[x] == 1 else [])
                    size += len(x) + 1
                if size >= BATCH:
                    yield flush()
                    pool, holders, size = [], [], 0
        if pool:
            yield flush()

    return run, "doc_id long, th long, s long, e long"


def _window_hashes(min_len: int):
    """Every window of a stretch: (digest, place); for minimizers with very many differing stretches."""
    schema = pa.schema([("w", pa.binary()), ("c", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("s", pa.int64())])

    def run(batches):
        import xxhash

        for b in batches:
            for i in range(0, b.num_rows, 2000):
                rows: list[list] = [[] for _ in schema]
                for _, _, c, d, t, start, x in zip(*(q.to_pylist() for q in b.slice(i, 2000).columns)):
                    mv = memoryview(x)
                    for j in range(len(x) - min_len + 1):
                        for col, v in zip(rows, (xxhash.xxh3_128_digest(mv[j: j + min_len]), c, d, t, start + j)):
                            col.append(v)
                yield table(schema, **dict(zip(schema.names, rows)))

    return run, "w binary, c long, doc_id long, th long, s long"


def repeated_ranges(docs: DataFrame, min_len: int = 400, k: int = K) -> DataFrame:
    """(doc_id, th, s, e): byte ranges of ``docs`` (doc_id, th, text) covered by repeats, may overlap."""
    spark = docs.sparkSession
    tag = uuid.uuid4().hex
    docs = docs.where(F.octet_length("text") >= min_len)

    def written(df, name):
        path = scratch_table_path(spark, f"substrings-{tag}-{name}")
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    run, out = _find(min_len, k)
    found = written(docs.select("doc_id", "th", "text").mapInArrow(run, out), "stretches")
    # counts with partial aggregation; only minimizers seen twice go on.  A minimizer, content or window that very many
    # rows hold finds its count by broadcast, the others by shuffle
    often = written(found.groupBy("mh").agg(F.count("*").alias("_n"), F.min("sh").alias("_lo"), F.max("sh").alias("_hi"))
                    .where("_n > 1").select("mh", "_n", (F.col("_lo") != F.col("_hi")).alias("many")), "often")
    again = written(lookup(found, often, ["mh"], "_n", F.col("start"), written=True).where("many is not null"), "repeats")
    kinds = again.groupBy("mh", "sh").agg(F.count("*").alias("c"), F.first("many").alias("many"),
                                          F.min(F.struct("doc_id", "th", "start", "n")).alias("r"))
    kinds = written(kinds.where("c > 1 or many"), "kinds")
    copies = kinds.where("c > 1").select("mh", "sh", "c", F.lit(True).alias("copied"))
    whole = (lookup(again, copies, ["mh", "sh"], "c", F.col("start"), written=True).where("copied")
             .select("doc_id", "th", F.col("start").alias("s"), (F.col("start") + F.col("n") + (min_len - 1)).alias("e")))
    want = written(kinds.where("many").select("mh", "sh", "c", "r.*"), "wanted")
    wanted = want.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.collect_list(
        F.struct("mh", "sh", "c", "start", (F.col("start") + F.col("n") + (min_len - 1)).alias("end"))).alias("want"))
    run, out = _slices()
    parts = written(docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_d"]) & (docs["th"] == wanted["_t"]))
                    .select("doc_id", "th", "text", "want").mapInArrow(releasing(run), out), "slices")
    hot = want.groupBy("mh").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select("mh")
    run, out = _expand(min_len, k)
    some = (parts.join(hot, "mh", "left_anti").repartition("mh").sortWithinPartitions("mh")
            .select("mh", "sh", "c", "doc_id", "th", "start", "bytes").mapInArrow(releasing(run), out))
    run, out = _window_hashes(min_len)
    windows = written(parts.join(hot, "mh", "left_semi").select("mh", "sh", "c", "doc_id", "th", "start", "bytes").mapInArrow(run, out),
                      "windows")
    twice = windows.groupBy("w").agg(F.count("*").alias("_n")).where("_n > 1").select("w", "_n", F.lit(True).alias("twice"))
    many = (lookup(windows.where("c = 1"), twice, ["w"], "_n", F.col("s")).where("twice")
            .select("doc_id", "th", "s", (F.col("s") + min_len).alias("e")))
    return whole.union(some).union(many)


def cut_repeats(docs: DataFrame, min_len: int = 400, keep: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """One row per document: ``row`` (a struct of the columns ``keep``, all by default), ``kept`` (the remaining
    bytes, or as text), n_bytes, n_removed, n_spans."""
    th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), th.alias("th"), F.col("text"))
    spans = repeated_ranges(base, min_len)
    spans = spans.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(
        F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"))
    left = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.col("text"), F.col("doc_id").cast("long").alias("_id"), th.alias("_th"))
    joined = left.join(spans, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left").select("row", "text", "spans")
    kind = "string" if as_text else "binary"
    out_schema = joined.select("row", F.lit(None).cast(kind).alias("kept"),
                               *(F.lit(None).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans"))).schema

    def run(batches):
        for b in batches:
            kept, total, gone, count = [], [], [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = (text or "").encode("utf-8")
                merged: list[list[int]] = []
                for x in found or ():
                    if merged and x["s"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["e"])
                    else:
                        merged.append([x["s"], x["e"]])
                at, out = 0, []
                for s, e in merged:
                    out.append(raw[at:s])
                    at = e
                out.append(raw[at:])
                rest = b"".join(out)
                # a character that a cut splits is dropped whole
                kept.append((rest.decode("utf-8", "ignore") if text is not None else None) if as_text else rest)
                total.append(len(raw))
                gone.append(sum(e - s for s, e in merged))
                count.append(len(merged))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kept, pa.string() if as_text else pa.binary()),
                 *(pa.array(x, pa.int64()) for x in (total, gone, count))],
                names=["row", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(releasing(run), out_schema)


def report(docs: DataFrame, min_len: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    return (cut_repeats(docs, min_len, ["doc_id"])
            .select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))


def remove_repeats(docs: DataFrame, min_len: int = 400) -> DataFrame:
    """Pipeline stage: texts without their repeated bytes; ``n_chars``, where present, follows a changed
    text; a null text stays null."""
    out = cut_repeats(docs, min_len, as_text=True)
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(
            F.char_length("kept").cast(docs.schema["n_chars"].dataType))
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
