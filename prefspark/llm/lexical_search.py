"""Ranked lexical search with bag deduplication.

1. The items' terms are the vocabulary (exact strings; 64-bit hashes of two kinds in the tasks).  Items are dealt into
   blocks of about ``block_terms`` terms, so the vocabulary in a task is bounded whatever the number of items.
2. Each document's text is cut into terms once per block: its length in terms and its bag, the counts of vocabulary
   terms.  N, L and the document frequencies are summed over all documents.
3. Documents with equal bag and equal length class m are one class.  A window over (hash, m, bag) keeps a class's least
   ten ids; Spark compares the bags themselves behind the hash, and limits ranks before the shuffle, so a class of
   a third of all documents sends ten rows a task.  More than ``k`` members of one class cannot be listed for
   one item, for equal scores go by id.
4. The classes of a partition are scored once each against all items with integer arithmetic; a partition keeps
   the best ``k`` per item, expanding members by ascending id, and a last window ranks them.

Defined results: null and empty texts have no terms; documents with a null id count in N, L and df but are never
listed; repeated ids are listed as often as they stand; items that have no terms, or none with a document,
get no rows; each row of ``items`` is an item of its own, nulls in item_id included; extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_table_path
from .arrays import lower_ascii, mix, prefix_sums, ranges, releasing, span_hash, text_chunks, word_spans

#: sums below this are exact in doubles
EXACT = 1 << 53
#: score additions held at once in a task
CHUNK_CELLS = 1 << 21

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: Column) -> Column:
    """The terms of a text, A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), F.lit(f"({TERM})"))


class Vocabulary:
    """Terms in order of their hash; a lookup is exact up to a clash of two 64-bit hashes and the length."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        self.hash, self.check, self.size = self.hashes(data, ends - [len(r) for r in raw], ends)
        order = np.argsort(self.hash)
        self.hash, self.check, self.size = self.hash[order], self.check[order], self.size[order]
        self.terms = [terms[i] for i in order]

    @staticmethod
    def hashes(data, starts, ends):
        h = span_hash(prefix_sums(data), starts, ends)
        # the second one is of the bytes in another code
        g = span_hash(prefix_sums(data ^ np.uint8(0x55)), starts, ends)
        return h, mix(g, 1), (ends - starts).astype(np.int64)

    def find(self, data, starts, ends) -> np.ndarray:
        """Place of each span's term, -1 for others."""
        h = span_hash(prefix_sums(data), starts, ends)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        hit = np.flatnonzero(self.hash[at] == h)
        g = span_hash(prefix_sums(data ^ np.uint8(0x55)), starts[hit], ends[hit])
        good = (mix(g, 1) == self.check[at[hit]]) & ((ends - starts)[hit] == self.size[at[hit]])
        out = np.full(len(h), -1, np.int64)
        out[hit[good]] = at[hit[good]]
        return out


_BAGS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("bag", pa.binary())])


def _pack(ids: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Bags as 32-bit pairs (term, count), in order of term."""
    flat = np.empty((len(ids), 2), "<u4")
    flat[:, 0], flat[:, 1] = ids, counts
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds * 8), pa.py_buffer(flat)]).cast(pa.binary())


def _pairs(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, counts, offsets by row) of packed bags."""
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset: col.offset + len(col) + 1]
    flat = np.frombuffer(data, "<u4")[off[0] // 4: off[-1] // 4].reshape(-1, 2)
    return flat[:, 0].astype(np.int64), flat[:, 1].astype(np.int64), (off - off[0]) // 8


def bags(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(doc_id, n, bag) of every document: its terms with repeats, its vocabulary terms' counts."""
    def run(batches):
        for rows, data, off in text_chunks(batches):
            low = lower_ascii(data)
            starts, ends, doc = word_spans(low, off, plain=True)
            n = np.bincount(doc, minlength=rows.num_rows)
            at = vocab.find(low, starts, ends) if len(starts) else np.zeros(0, np.int64)
            keys, counts = np.unique(doc[at >= 0] * len(vocab.terms) + at[at >= 0], return_counts=True)
            bounds = np.searchsorted(keys, np.arange(rows.num_rows + 1) * len(vocab.terms))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), _pack(keys % len(vocab.terms), counts, bounds)], schema=_BAGS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, bag binary")


def document_frequencies(bagged: DataFrame, terms: int) -> np.ndarray:
    """df per vocabulary term: summed in each task, then by term; at most a vocabulary reaches the driver."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(terms, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(_pairs(b.column(0))[0], minlength=terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=schema)

    out = np.zeros(terms, np.int64)
    for r in bagged.select("bag").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    return out


class ItemMatrix:
    """Items' weights by term: rows of (item, repeats x w) for terms with a weight."""

    def __init__(self, term: np.ndarray, item: np.ndarray, repeats: np.ndarray, weight: np.ndarray, terms: int):
        self.items, item = np.unique(item, return_inverse=True)
        w = weight[term] * repeats
        order = np.argsort(term, kind="stable")
        order = order[w[order] > 0]
        self.item, self.weight = item[order], w[order]
        self.bounds = np.searchsorted(term[order], np.arange(terms + 1))
        most = np.bincount(item, weights=w, minlength=len(self.items)).max() if len(item) else 0
        self.exact = most * 1e6 < EXACT

    def scores(self, row: np.ndarray, term: np.ndarray, gain: np.ndarray, rows: int) -> np.ndarray:
        """(rows, items) integer scores of (row, term, gain) triples."""
        k = len(self.items)
        count = self.bounds[term + 1] - self.bounds[term]
        out = np.zeros(rows * k, np.float64 if self.exact else np.int64)
        ends = np.cumsum(count)
        a = 0
        while a < len(term):
            base = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, base + CHUNK_CELLS, side="right")))
            at = ranges(self.bounds[term[a:b]], count[a:b])
            cell = np.repeat(row[a:b] * k, count[a:b]) + self.item[at]
            add = np.repeat(gain[a:b], count[a:b]) * self.weight[at]
            if self.exact:
                lo, hi = (int(row[a]) * k, (int(row[b - 1]) + 1) * k)
                out[lo:hi] += np.bincount(cell - lo, weights=add, minlength=hi - lo)
            else:
                np.add.at(out, cell, add)
            a = b
        return out.astype(np.int64).reshape(rows, k)


class Best:
    """The best ``k`` (score, least ids first) of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.item = self.score = self.doc = np.zeros(0, np.int64)

    def add(self, item, score, doc):
        item, score, doc = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        start = np.searchsorted(item, item)
        rank = np.arange(len(item)) - start
        keep = rank < self.k
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]
        full = np.flatnonzero(rank[keep] == self.k - 1)
        self.floor[self.item[full]] = self.score[full]


def _scorer(matrix: ItemMatrix, k: int, batch_classes: int):
    """Members of classes (m, bag, doc_id; a class in adjacent rows, ids ascending) -> a partition's best (q, doc_id, score)."""
    schema = pa.schema([("q", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        best = Best(len(matrix.items), k)
        for b in batches:
            for a in range(0, b.num_rows, batch_classes):
                part = b.slice(a, batch_classes)
                m, doc = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
                first = np.flatnonzero(part.column(3).to_numpy(zero_copy_only=False) == 1)
                # a class that goes on from the batch before is scored again from its own rows
                first = np.union1d([0], first)
                members = np.diff(np.append(first, part.num_rows))
                term, tf, off = _pairs(part.column(1).take(pa.array(first)))
                row = np.repeat(np.arange(len(first)), np.diff(off))
                gain = 1_000_000_000 * tf // (1000 * tf + 8 * m[first][row])
                got = matrix.scores(row, term, gain, len(first))
                cls, item = np.nonzero(got >= best.floor)
                if len(cls):
                    times = members[cls]
                    best.add(np.repeat(item, times), np.repeat(got[cls, item], times), doc[ranges(first[cls], times)])
        if len(best.item):
            yield pa.RecordBatch.from_arrays([pa.array(matrix.items[best.item]), pa.array(best.doc), pa.array(best.score)], schema=schema)

    return run


def _rank(docs: DataFrame, postings: list, k: int, batch_classes: int) -> DataFrame:
    """(q, doc_id, score, rank) for one block of items; ``postings``: its (q, term, repeats)."""
    spark = docs.sparkSession
    vocab = Vocabulary(sorted({p["term"] for p in postings}))
    place = {t: i for i, t in enumerate(vocab.terms)}
    path = scratch_table_path(spark, f"bags-{uuid.uuid4().hex}")
    bags(docs, vocab).write.mode("overwrite").parquet(path)
    bagged = spark.read.parquet(path)
    total = bagged.agg(F.sum(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"] or 0, total["terms"] or 0
    df = document_frequencies(bagged, len(vocab.terms))
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    matrix = ItemMatrix(np.array([place[p["term"]] for p in postings]), np.array([p["q"] for p in postings]),
                        np.array([p["repeats"] for p in postings]), weight, len(vocab.terms))
    rows = (bagged.filter(F.col("doc_id").isNotNull() & (F.octet_length("bag") > 0))
            .withColumn("m", F.lit(25).cast("long") + F.expr(f"(75 * n * {n_docs}L) div {max(n_terms, 1)}L"))
            .withColumn("h", F.xxhash64("bag", "m")))
    same = Window.partitionBy("h", "m", "bag").orderBy("doc_id")
    members = rows.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= k)
    best = members.select("m", "bag", "doc_id", "place").mapInArrow(releasing(_scorer(matrix, k, batch_classes)), "q long, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = 500_000, batch_classes: int = 500) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    path = scratch_table_path(spark, f"queries-{uuid.uuid4().hex}")
    (items.select(F.monotonically_increasing_id().alias("q"), F.col("item_id"), terms_of(F.col("text")).alias("terms"))
     .write.mode("overwrite").parquet(path))
    queries = spark.read.parquet(path)
    postings = (queries.select("q", F.explode("terms").alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("repeats")))
    blocks = max(1, -(-postings.count() // block_terms))
    out = None
    for b in range(blocks):
        own = postings.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()
        if own:
            got = _rank(docs, own, k, batch_classes)
            out = got if out is None else out.unionByName(got)
    if out is None:
        return queries.select("item_id", F.lit(0).alias("rank"), *[F.lit(0).cast("long").alias(c) for c in ("doc_id", "score")]).limit(0)
    return out.join(queries.select("q", "item_id"), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
     lens AS (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n FROM t WHERE len(ts) > 0),
     st AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM lens),
     items AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS qtf FROM
                 (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
     tfs AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM t)
             WHERE term IN (SELECT term FROM items) GROUP BY ALL),
     ws AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(nd) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM tfs, st GROUP BY term),
     sc AS (SELECT item_id, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l)))) AS BIGINT) AS score
            FROM tfs JOIN items USING (term) JOIN ws USING (term) JOIN lens USING (doc_id), st GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM sc WHERE score > 0 QUALIFY rank <= 10
"""
