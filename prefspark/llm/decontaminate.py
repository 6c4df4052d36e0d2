"""Benchmark passages in documents, by latent semantic retrieval.

1. Terms are the words of the benchmark items, single characters in scripts without spaces.  Spark counts in how many documents each occurs (over all
   documents) for the TF-IDF weights; the same pass lists the passages (windows of ``WINDOW`` words, every
   ``STRIDE``) of all documents as packed term ids.
2. A randomised SVD of the TF-IDF matrix of those passages and all items (subspace iterations) gives the latent space.  Spark
   tasks sum the lower triangle of A'A of the passages once, in stripes of terms, and multiply by the stripes; above ``GRAM_TERMS``
   terms, where a task could not hold it, they multiply by A and A' in each iteration.  A row holds 512 KB at most: JVM and Python
   workers buffer many rows at once.  Spark adds up the tasks' products, so the driver gets one matrix of terms x rank an iteration.
3. Every passage of every document whose weight lies mostly enough in benchmark terms is projected; items
   with a cosine of at least ``min_cosine`` are candidates.
4. A candidate's neighbourhood and the item are compared by longest common subsequence of words, over the
   whole item and over its answer (its last quarter).  Copies and paraphrases pass either with ``min_lcs`` of
   the item and half of the answer, or with 85 % of the item.  An item of more than ``WINDOW`` words also passes by one
   of its passages, held to the same rule on its own; its result then tells the passage's figures.
5. Items under ``SHORT`` words drown in a passage.  They are also looked up by their rarest words, so many that a
   match holds one of them; the words around an occurrence are compared as in 4, and those of the item among them must
   reach ``min_cosine`` with the item.

Items are the stated query set; they are taken in blocks of ``BLOCK`` items, whose vectors and terms are
broadcast (bounded by the block).

Defined results: null or empty texts and items match nothing, nor do items below ``MIN_WORDS`` words;
items and documents repeated as rows give a result each for their id once; a null doc id is reported
as null; no items or no documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .arrays import doc_bounds, lower_ascii, prefix_sums, ranges, release, span_hash, table, text_buffer, text_chunks, word_spans

WINDOW, STRIDE = 32, 16
BLOCK = 20_000
MIN_WORDS = 5
SHORT = 15
GRAM_TERMS, GRAM_STRIPE = 5500, 1 << 16   # terms of a sum of A'A of which a task holds a triangle (121 MB), and entries of a stripe of it
# first and last characters: scripts without spaces between words (Thai, Lao, Burmese, Khmer, kana, Han), and their punctuation
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3041, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
            (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F))
MARKS = ((0x3000, 0x3004), (0x3008, 0x303F), (0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


def _within(code: np.ndarray, spans) -> np.ndarray:
    return np.any([(code >= a) & (code <= b) for a, b in spans], axis=0)


def unspaced_cuts(low: np.ndarray) -> np.ndarray:
    """Where characters of scripts without spaces begin and end; their punctuation is blanked in ``low``."""
    at = np.flatnonzero(low >= 0xE0)
    if not len(at):
        return at
    a, b, c = (low[np.minimum(at + i, len(low) - 1)].astype(np.int64) for i in range(3))
    code = (a & 15) << 12 | (b & 63) << 6 | c & 63
    three = a < 0xF0
    marks = at[three & _within(code, MARKS)]
    for i in range(3):
        low[marks + i] = 0x20
    own, far = at[three & _within(code, UNSPACED)], at[(a == 0xF0) & (b >= 0xA0)]
    return np.unique(np.concatenate([own, own + 3, far, far + 4]))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased plain word or character of a script without spaces, bounds by document)."""
    low = lower_ascii(data)
    cuts = unspaced_cuts(low)
    s, e, doc = word_spans(low, offsets, plain=True)
    if len(cuts) and len(s):
        w = np.searchsorted(s, cuts, side="right") - 1
        cuts = cuts[(w >= 0) & (cuts > s[w]) & (cuts < e[w])]
        s, e = np.sort(np.concatenate([s, cuts])), np.sort(np.concatenate([e, cuts]))
        doc = np.searchsorted(offsets, s, side="right") - 1
    return span_hash(prefix_sums(low), s, e), doc_bounds(doc, len(offsets) - 1)


def term_ids(words: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Positions of words among sorted terms; -1 for other words."""
    if len(terms) == 0:
        return np.full(len(words), -1, np.int64)
    p = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
    return np.where(terms[p] == words, p, -1)


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, end) of every passage, given documents' word bounds."""
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
    doc = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = at[doc] + nth * STRIDE
    return doc, start, np.minimum(start + WINDOW, at[doc + 1])


def rows_of(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(passages, WINDOW) distinct term ids of passages, -1 elsewhere."""
    at = start[:, None] + np.arange(WINDOW)
    m = np.where(at < end[:, None], ids[np.minimum(at, max(len(ids) - 1, 0))], -1) if len(ids) else np.full(at.shape, -1)
    m = np.sort(m, axis=1)
    m[:, 1:][m[:, 1:] == m[:, :-1]] = -1
    return m


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    mask: dict[int, int] = {}
    for i, x in enumerate(a):
        mask[x] = mask.get(x, 0) | 1 << i
    v = full = (1 << len(a)) - 1
    for x in b:
        m = mask.get(x)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _terms_and_passages(terms, share: int, rows_at_once: int = 256):
    """Per task: document counts of terms (kind 0); passages of the picked documents as packed term ids (kind 1), their number as ``df``."""
    schema = pa.schema([("kind", pa.int32()), ("term", pa.int64()), ("df", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary())])

    def run(batches):
        own = terms.value
        df = np.zeros(len(own), np.int64)
        docs = 0
        for part, data, off in text_chunks(batches):
            words, at = word_hashes(data, off)
            ids = term_ids(words, own)
            doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
            hit = ids >= 0
            both = np.unique(doc[hit] * np.int64(len(own)) + ids[hit])
            df += np.bincount(both % max(len(own), 1), minlength=len(own))
            docs += len(off) - 1
            chosen = np.array(part.column(part.schema.get_field_index("pick")).to_pylist(), np.int64) < share
            d, s, e = windows(at)
            keep = np.flatnonzero(chosen[d])
            for a in range(0, len(keep), rows_at_once):
                pick = keep[a: a + rows_at_once]
                m = rows_of(ids, s[pick], e[pick])
                n = (m >= 0).sum(axis=1)
                m, n = m[n >= WINDOW // 4], n[n >= WINDOW // 4]
                if len(m):
                    yield table(schema, kind=[1], term=[None], df=[len(m)], ids=[m[m >= 0].astype(np.int32).tobytes()], sizes=[n.astype(np.uint8).tobytes()])
        some = np.flatnonzero(df)
        yield table(schema, kind=[0] * (len(some) + 1), term=[*some.tolist(), -1], df=[*df[some].tolist(), docs], ids=[None] * (len(some) + 1),
                    sizes=[None] * (len(some) + 1))

    return run, "kind int, term long, df long, ids binary, sizes binary"


def scaled(flat: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Entries of the TF-IDF rows that ``n`` cuts ``flat`` into, each row of length 1."""
    norm = np.sqrt(np.add.reduceat(w[flat] ** 2, np.cumsum(n) - n))
    return w[flat] / np.repeat(np.maximum(norm, 1e-9), n)


def gram_product(flat: np.ndarray, n: np.ndarray, w: np.ndarray, q: np.ndarray, out: np.ndarray, rows_at_once: int = 512) -> None:
    """Add A'(A q) of the rows to ``out``."""
    upto = np.concatenate([[0], np.cumsum(n)])
    for a in range(0, len(n), rows_at_once):
        size = n[a: a + rows_at_once]
        ids = flat[upto[a]: upto[a + len(size)]]
        val = scaled(ids, size, w)[:, None]
        y = np.add.reduceat(q[ids] * val, np.cumsum(size) - size, axis=0)
        add = np.repeat(y, size, axis=0) * val
        order = np.argsort(ids, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0]))
        out[ids[order][cut]] += np.add.reduceat(add[order], cut, axis=0)


def _packed(batches, rows_at_once: int = 16384):
    """(term ids, sizes) of some passages at a time: a batch's blobs lie one after the other in its buffers."""
    for b in batches:
        if not b.num_rows:
            continue
        ids, sizes = (np.frombuffer(data, kind)[off[0] // step: off[-1] // step] for (data, off), kind, step in
                      zip(map(_blobs, b.columns), (np.int32, np.uint8), (4, 1)))
        upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        for a in range(0, len(sizes), rows_at_once):
            n = sizes[a: a + rows_at_once].astype(np.int64)
            yield ids[upto[a]: upto[a + len(n)]].astype(np.int64), n


def _blobs(column: pa.Array):
    """(buffer, byte offsets) of a binary column."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    return column.buffers()[2], np.frombuffer(column.buffers()[1], kind)[column.offset: column.offset + len(column) + 1]


def _in_parts(z: np.ndarray, at_once: int = 1 << 16):
    """Rows of ``z`` as blobs of bounded size, with the first row's place."""
    step = max(1, at_once // max(1, z.shape[1]))
    for a in range(0, len(z), step):
        yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([z[a: a + step].tobytes()], pa.binary())], names=["first", "blob"])


def _added(parts: pa.Table) -> pa.Table:
    """The sum of the tasks' parts of the same rows, in an order of their own: the order of arrival would change the last digits."""
    blobs = sorted(parts.column("blob").to_pylist())
    total = np.sum([np.frombuffer(x, np.float64) for x in blobs], axis=0)
    return pa.table([parts.column("first")[:1], pa.array([total.tobytes()], pa.binary())], names=["first", "blob"])


def _products(weights, basis):
    """Per task: A'(A Q) over its passages."""

    def run(batches):
        w, q = weights.value, basis.value
        out = np.zeros_like(q)
        for flat, n in _packed(batches):
            gram_product(flat, n, w, q, out)
        yield from _in_parts(out)

    return run, "first long, blob binary"


def _stripes(weights, rows_at_once: int = 1024):
    """Per task: the lower triangle of A'A over its passages, as packed stripes of whole rows."""

    def run(batches):
        # a broadcast array has a dtype object of its own, with which ``np.add.at`` takes its slow way
        w = weights.value.astype(np.float64)
        d = len(w)
        base = np.arange(d + 1) * np.arange(1, d + 2) // 2   # where a row begins
        g = np.zeros(base[-1])
        for flat, n in _packed(batches):
            val, start = scaled(flat, n, w), np.cumsum(n) - n
            for k in np.unique(n):
                own = start[n == k]
                for a in range(0, len(own), rows_at_once):
                    at = own[a: a + rows_at_once] + np.arange(k)[:, None]
                    t, v = flat[at], val[at]
                    row = base[t]
                    # a passage's terms ascend: with the one ``s`` places before, the lower triangle
                    for s in range(k):
                        np.add.at(g, (row[s:] + t[: k - s]).ravel(), (v[s:] * v[: k - s]).ravel())
        a = 0
        while a < d:
            b = max(a + 1, int(np.searchsorted(base, base[a] + GRAM_STRIPE, side="right")) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([g[base[a]: base[b]].tobytes()], pa.binary())], names=["first", "blob"])
            a = b

    return run, "first long, blob binary"


def _times_stripes(basis):
    """Per task: the product of its stripes, each with its mirror above the diagonal, and the basis."""

    def run(batches):
        q = basis.value
        out = np.zeros_like(q)
        for batch in batches:
            for first, blob in zip(*batch.columns):
                a, packed = first.as_py(), np.frombuffer(blob.as_py(), np.float64)
                rows = []
                at = 0
                while at < len(packed):
                    size = a + len(rows) + 1
                    rows.append(packed[at: at + size])
                    at += size
                b = a + len(rows)
                low = np.zeros((len(rows), b))
                for i, row in enumerate(rows):
                    low[i, : a + i + 1] = row
                out[a:b] += low @ q[:b]
                low[np.arange(len(rows)), np.arange(a, b)] = 0
                out[:b] += low.T @ q[a:b]
        yield from _in_parts(out)

    return run, "first long, blob binary"


def latent_space(passages: DataFrame, items: list[np.ndarray], share: float, weights: np.ndarray, rank: int, iterations: int = 2,
                 tasks: int = 6) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of the TF-IDF matrix of all passages and of the items, ``share`` times as
    heavy, by randomised subspace iteration.

    ``passages`` is (ids, sizes), packed.  What reaches the driver is terms x rank."""
    spark = passages.sparkSession
    d = len(weights)
    rank = min(rank, d)
    rng = np.random.default_rng(7)
    q, _ = np.linalg.qr(rng.standard_normal((d, min(d, rank + 16))))
    shared = spark.sparkContext.broadcast(weights)
    rows = passages.select("ids", "sizes").coalesce(tasks)
    if dense := d <= GRAM_TERMS:
        run, out = _stripes(shared)
        rows = materialize(rows.mapInArrow(run, out))
    flat, n = np.concatenate(items), np.array([len(x) for x in items])
    for step in range(iterations + 1):
        basis = spark.sparkContext.broadcast(q)
        run, out = _times_stripes(basis) if dense else _products(shared, basis)
        z = np.zeros_like(q)
        gram_product(flat, n, weights, q, z)
        z *= share ** 2
        for r in rows.mapInArrow(run, out).groupBy("first").applyInArrow(_added, out).collect():
            part = np.frombuffer(r["blob"], np.float64).reshape(-1, q.shape[1])
            z[r["first"]: r["first"] + len(part)] += part
        basis.destroy()
        if step < iterations:
            q, _ = np.linalg.qr(z)
    # Rayleigh-Ritz: Q'A'AQ gives the directions and their order
    value, vector = np.linalg.eigh(q.T @ z)
    shared.destroy()
    return (q @ vector[:, np.argsort(-value)])[:, :rank].astype(np.float32)


def short_index(items, terms: np.ndarray, weights: np.ndarray, min_lcs: float) -> dict:
    """Short items by their rarest words: an item matched by ``need`` words lacks len - need of them at most, so it holds
    one of the len - need + 1 rarest."""
    own = [(i, x, term_ids(x, terms)) for i, x in items if len(x) < SHORT]
    need = np.array([int(np.ceil(min_lcs * len(x) - 1e-9)) for _, x, _ in own], np.int64)
    keys = [np.unique(t[np.argsort(-weights[t], kind="stable")[: len(t) - k + 1]]) for (_, _, t), k in zip(own, need)]
    flat = np.concatenate([np.zeros(0, np.int64), *keys]).astype(np.int64)
    of = np.repeat(np.arange(len(own)), [len(k) for k in keys]).astype(np.int64)
    order = np.argsort(flat, kind="stable")
    members = [np.unique(t) + j * len(terms) for j, (_, _, t) in enumerate(own)]
    return {"items": [(i, x.tolist(), x[-max(1, len(x) // 4):].tolist()) for i, x, _ in own], "need": need,
            "length": np.array([len(x) for _, x, _ in own], np.int64), "at": np.searchsorted(flat[order], np.arange(len(terms) + 1)), "of": of[order],
            "members": np.concatenate([np.zeros(0, np.int64), *members]).astype(np.int64),
            "norm": np.array([(weights[np.unique(t)] ** 2).sum() for _, _, t in own])}


def short_candidates(ids: np.ndarray, at: np.ndarray, index: dict, w2: np.ndarray, min_cosine: float, pairs_at_once: int = 16384):
    """(short item, document, begin, end, cosine) of the places that hold enough words of an item."""
    n_terms = len(w2) - 1
    where = np.flatnonzero(ids >= 0)
    count = (index["at"][1:] - index["at"][:-1])[ids[where]]
    where, count = where[count > 0], count[count > 0]
    upto = np.cumsum(count)
    members = index["members"]
    for a in range(0, int(upto[-1]) if len(upto) else 0, pairs_at_once):
        pair = np.arange(a, min(a + pairs_at_once, int(upto[-1])))
        i = np.searchsorted(upto, pair, side="right")
        spot = where[i]
        item = index["of"][index["at"][ids[spot]] + pair - (upto[i] - count[i])]
        reach = index["length"][item] * 3 // 2
        doc = np.searchsorted(at, spot, side="right") - 1
        lo, hi = np.maximum(at[doc], spot - reach), np.minimum(at[doc + 1], spot + reach + 1)
        row = np.repeat(np.arange(len(pair)), hi - lo)
        term = ids[ranges(lo, hi - lo)]
        row, term = row[term >= 0], term[term >= 0]
        key = item[row] * n_terms + term
        hit = members[np.minimum(np.searchsorted(members, key), len(members) - 1)] == key
        row, term = row[hit], term[hit]
        enough = np.bincount(row, minlength=len(pair)) >= index["need"][item]
        once = np.unique(row * np.int64(n_terms) + term)
        held = np.bincount(once // n_terms, weights=w2[once % n_terms], minlength=len(pair))
        cos = np.sqrt(held / np.maximum(index["norm"][item], 1e-9))
        for k in np.flatnonzero(enough & (cos >= min_cosine)):
            yield int(item[k]), int(doc[k]), int(lo[k]), int(hi[k]), float(min(cos[k], 1.0))


def matched(item: list[int], answer: list[int], region: list[int], min_lcs: float):
    """(share of the item, share of its answer) when they pass, else None."""
    share = lcs(item, region) / len(item)
    if share < min_lcs:
        return None
    ans = lcs(answer, region) / len(answer)
    return (share, ans) if share >= 0.85 or ans >= 0.5 else None


def similar(rows: np.ndarray, items: np.ndarray, least: float, tile: int = 4096):
    """(row, item, cosine) of pairs of unit vectors at or above ``least``, a tile of items at a time."""
    for a in range(0, len(items), tile):
        cos = rows @ items[a: a + tile].T
        for i, j in zip(*np.nonzero(cos >= least)):
            yield i, a + j, float(cos[i, j])


def _search(shared, min_weight: float, min_cosine: float, min_lcs: float):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()),
                        ("answer_lcs", pa.float64()), ("word", pa.int64())])

    def keep(best, key, new):
        # the whole item before a passage of it, then by share and cosine
        old = best.get(key)
        if old is None or (new[0], new[1], new[3]) > (old[0], old[1], old[3]):
            best[key] = new

    def run(batches):
        m = shared.value
        terms, w, other = m["terms"], m["weights"], m["other"]
        space = m["space"] * w[:, None].astype(np.float32)
        w2 = np.append(w ** 2, 0.0)
        items, vec, short = m["items"], m["vectors"], m["short"]
        for part, data, off in text_chunks(batches):
            words, at = word_hashes(data, off)
            ids = term_ids(words, terms)
            doc, s, e = windows(at)
            known = ids >= 0
            inside = np.concatenate([[0.0], np.cumsum(w2[ids])])
            outside = np.concatenate([[0], np.cumsum(~known)])
            x = inside[e] - inside[s]
            total = x + (outside[e] - outside[s]) * other ** 2
            near = np.flatnonzero((x > 0) & (x >= min_weight ** 2 * total))
            best: dict = {}
            for a in range(0, len(near), 2048):
                pick = near[a: a + 2048]
                rows = rows_of(ids, s[pick], e[pick])
                some = rows >= 0
                n = some.sum(axis=1)
                lat = np.add.reduceat(space[rows[some]], np.cumsum(n) - n, axis=0)
                lat /= np.maximum(np.linalg.norm(lat, axis=1, keepdims=True), 1e-9)
                for i, j, c in similar(lat, vec, min_cosine):
                    p = pick[i]
                    d = int(doc[p])
                    item_id, item, answer, passage, ending = items[j]
                    lo, hi = int(at[d]), int(at[d + 1])
                    reach = max(WINDOW, len(item))
                    got = matched(item, answer, words[max(lo, s[p] - reach): min(hi, e[p] + reach)].tolist(), min_lcs)
                    if got:
                        keep(best, (d, item_id), (1, *got, c, int(s[p]) - lo))
                    elif passage and best.get((d, item_id), (0,))[0] == 0:
                        got = matched(passage, ending, words[max(lo, s[p] - WINDOW): min(hi, e[p] + WINDOW)].tolist(), min_lcs)
                        if got:
                            keep(best, (d, item_id), (0, *got, c, int(s[p]) - lo))
            if short["items"]:
                for j, d, lo, hi, c in short_candidates(ids, at, short, w2, min_cosine):
                    item_id, item, answer = short["items"][j]
                    got = matched(item, answer, words[lo:hi].tolist(), min_lcs)
                    if got:
                        keep(best, (d, item_id), (1, *got, c, lo - int(at[d])))
            if best:
                doc_ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
                yield table(schema, doc_id=[doc_ids[d] for d, _ in best], item_id=[i for _, i in best], cosine=[v[3] for v in best.values()],
                            lcs=[v[1] for v in best.values()], answer_lcs=[v[2] for v in best.values()], word=[v[4] for v in best.values()])

    return run, "doc_id long, item_id long, cosine double, lcs double, answer_lcs double, word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = 128, min_weight: float = 0.28, min_cosine: float = 0.6,
               min_lcs: float = 0.6, max_sample_docs: int | None = None) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer_lcs, word) of every document that holds an item; ``word`` is where its passage begins.

    The latent space is fitted to the passages of all documents; ``max_sample_docs``, for quick trials, to those of a hash sample."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    found = None
    blocks = max(1, -(-benchmark.count() // BLOCK))
    for b in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
        part = _find_block(spark, docs, rows.collect(), rank, min_weight, min_cosine, min_lcs, max_sample_docs)
        if part is not None:
            found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], _search(None, 0, 0, 0)[1])
    best = F.max(F.struct("lcs", "cosine", "answer_lcs", "word")).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.cosine", "x.lcs", "x.answer_lcs", "x.word")


def _find_block(spark, docs, rows, rank, min_weight, min_cosine, min_lcs, max_sample_docs):
    words, at = word_hashes(*text_buffer(pa.array([r["text"] for r in rows], pa.string())))
    items = [(r["item_id"], words[at[i]: at[i + 1]]) for i, r in enumerate(rows)]
    items = [(i, x) for i, x in items if len(x) >= MIN_WORDS]
    if not items:
        return None
    terms = np.unique(np.concatenate([x for _, x in items]))
    share = 1 << 20
    if max_sample_docs is not None:
        share = int(min(1.0, max_sample_docs / max(docs.select("doc_id").count(), 1)) * share)
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("pick")
    own_terms = spark.sparkContext.broadcast(terms)
    run, out = _terms_and_passages(own_terms, share)
    seen = materialize(docs.select("text", pick).mapInArrow(run, out))
    own_terms.destroy()
    df = np.zeros(len(terms))
    count = passages = 0
    # one row per term of the block
    for r in seen.groupBy("kind", "term").agg(F.sum("df").alias("df")).collect():
        if r["kind"] == 1:
            passages = r["df"]
        elif r["term"] < 0:
            count = r["df"]
        else:
            df[r["term"]] = r["df"]
    weights = np.log((count + 1) / (df + 1)) + 1e-3
    own = [np.unique(term_ids(x, terms)) for _, x in items]
    # items weigh as much as all passages: a space fitted to passages alone would leave out the rare words that mark an item
    space = latent_space(seen.where("kind = 1"), own, max(1.0, passages / len(own)) ** 0.5, weights, rank)
    # each item as its passages, so long items are found by any part; the parts of long ones count on their own
    vectors, listed = [], []
    for item_id, x in items:
        t = term_ids(x, terms)
        cut = max(1, len(x) // 4)
        for a in range(0, max(1, len(x) - STRIDE), STRIDE):
            u, part = np.unique(t[a: a + WINDOW]), x[a: a + WINDOW].tolist() if len(x) > WINDOW else []
            v = (space[u] * weights[u][:, None]).sum(axis=0)
            vectors.append(v / max(np.linalg.norm(v), 1e-9))
            listed.append((item_id, x.tolist(), x[-cut:].tolist(), part, part[-max(1, len(part) // 4):]))
    model = {"terms": terms, "weights": weights, "other": float(weights.max()), "space": space, "items": listed,
             "vectors": np.array(vectors, np.float32), "short": short_index(items, terms, weights, min_lcs)}
    run, out = _search(spark.sparkContext.broadcast(model), min_weight, min_cosine, min_lcs)
    release()
    return docs.mapInArrow(run, out)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """Pipeline stage: documents without any benchmark item; rows without an id that hold one go with the other
    null-id rows of the same text."""
    th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.select(th.alias("doc_id"), "text")
    hits = materialize(find_leaks(keyed, benchmark, **params).select(F.col("doc_id").alias("_h")).distinct())
    return docs.join(hits, th == hits["_h"], "left_anti").select(*docs.columns)
