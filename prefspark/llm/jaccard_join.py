"""Near duplicates: exact Jaccard self-join of word-shingle sets with several global token orders.

1. One pass turns blocks of documents into their distinct shingles, dealt by hash range.  A range counts in
   how many documents each shingle occurs and answers each block with those that occur twice or more.
   Documents of equal sets (128-bit digests) form one class, and only classes are joined.
2. First order: rare shingles first.  Two sets that link share one of their first ``n - ceil(0.75 n) + 1``
   shingles under *every* global order, so shingles of one document alone fill most prefixes and only the shared
   ones left in a prefix are sent on.  Classes that share one form a group; a group gives pairs with its
   smallest member.
3. A pair whose bucket counts bound its overlap below the threshold is dropped; the texts of candidate
   classes are fetched once.  A pair must then share a prefix shingle under two further orders before its sets
   are intersected exactly.
4. Links give components.  In a group that still spans several components members of different components
   are compared in cells of at most ``CELL`` x ``CELL`` members: first by their bucket counts, then those that may
   link by the exact sizes of all their intersections at once (bit rows).  A cell makes no row for a pair: it sends
   on the members that may link, then a star for each set that it has linked.  The members of one group mostly share
   others too: so each class's largest group is done first, then every group that still spans components.  No
   link between different components is lost, and a large group of near copies makes a few rows a member and cell.

Hot shingles: one that more than ``HOT`` sets hold is dealt over tasks by the classes' digests.  Each share pairs with
its own smallest class and all shares form one group, so step 4 compares across them.

Defined results: a null or word-less text has an empty set and links with nothing; fewer than
``k`` words are one shingle; repeated rows share a class; a null id is never the smallest of a
component (a component of null ids only has a null id); extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_table_path
from .arrays import (byte_planes, doc_bounds, from_planes, lower_ascii, mix, packed, prefix_sums, range_cuts, ranges, span_hash, table,
                     text_buffer, text_chunks, unpacked, word_spans)
from .components import components, drop_finished, local_roots

BLOCK_BYTES = 4 << 20
TOKENS_PER_RANGE = 1_000_000
CELL = 1000
CELL_TOKENS = 1_000_000
#: shingles in more sets of a cell than this are compared as bits, so many at once
RARE, COLUMNS = 8, 4096
ORDERS = (1, 2)
#: classes that share a prefix shingle and meet in one task; those of a more frequent shingle are dealt over several
HOT = 50_000
#: members that one task verifies against a pivot
VERIFY = 256


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a buffer."""
    n_docs = len(offsets) - 1
    low = lower_ascii(data)
    starts, ends, doc = word_spans(low, offsets)
    h = span_hash(prefix_sums(low), starts, ends)
    at = doc_bounds(doc, n_docs)
    mult = [np.uint64(0x9E3779B97F4A7C15 * (2 * j + 1) & ((1 << 64) - 1)) for j in range(k)]
    m = max(0, len(h) - k + 1)
    s = np.zeros(m, np.uint64)
    for j in range(k):
        s = mix(s + h[j: j + m] * mult[j], j + 1)
    out = []
    for i in range(n_docs):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= k:
            out.append(np.unique(s[a: b - k + 1]))
        elif b > a:
            v = np.array([b - a], np.uint64)
            for j in range(a, b):
                v = mix(v * np.uint64(0x9E3779B97F4A7C15) + h[j: j + 1], 77)
            out.append(v)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(tokens: np.ndarray) -> bytes:
    import xxhash
    return xxhash.xxh3_128_digest(tokens.tobytes())


def order_keys(tokens: np.ndarray, order: int) -> np.ndarray:
    """Sort keys of shingles under one of the hashed global orders."""
    return mix(tokens, order)


def prefix_length(n: int, pct: int) -> int:
    return n - -(-pct * n // 100) + 1


def prefix(keys: np.ndarray, pct: int) -> np.ndarray:
    p = prefix_length(len(keys), pct)
    return keys if p >= len(keys) else np.partition(keys, p - 1)[:p]


def sketch(tokens: np.ndarray) -> bytes | None:
    """How many shingles fall in each of 64 or more hash buckets (a power of two, about one shingle each);
    None where a count exceeds a byte."""
    bits = max(6, (len(tokens) // 2).bit_length())
    c = np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return c.astype(np.uint8).tobytes() if c.max() < 256 else None


def folded(s: np.ndarray, size: int) -> np.ndarray:
    """Counts of a sketch (or of rows of sketches) in ``size`` buckets, at most its own."""
    return s if s.shape[-1] == size else s.reshape(*s.shape[:-1], size, -1).sum(axis=-1)


def overlap_bound(a: bytes | None, b: bytes | None, n: int) -> int:
    """No two sets with these sketches share more shingles than this (n: the smaller set's size)."""
    if a is None or b is None:
        return n
    x, y = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    size = min(len(x), len(y))
    return int(np.minimum(folded(x, size), folded(y, size)).sum())


def may_link(bound, m, n, pct: int):
    return 100 * bound >= pct * (m + n - bound)


_SHINGLES = pa.schema([("p", pa.int32()), ("block", pa.string()), ("tokens", pa.binary()), ("docs", pa.binary()), ("ids", pa.list_(pa.int64())),
                       ("ns", pa.list_(pa.int64())), ("keys", pa.list_(pa.binary())), ("sketches", pa.list_(pa.binary()))])
_SHINGLES_SQL = "p int, block string, tokens binary, docs binary, ids array<long>, ns array<long>, keys array<binary>, sketches array<binary>"


def _residual_shift(parts: int) -> int:
    """Bits to drop so that a token within its range takes 32 bits; the range says the others."""
    return max(0, 64 - (parts.bit_length() - 1) - 32)


def _shingles(k: int, parts: int):
    """Blocks of documents: a row with the documents' sizes, digests and sketches (p < 0) and, for each hash range, the
    sorted shingles with their documents.  A set that the task has seen before is not sent again."""

    def run(batches):
        task, made, seen = TaskContext.get().partitionId(), 0, set()
        shift = np.uint64(_residual_shift(parts))
        ids, sets, size = [], [], 0

        def flush():
            keys = [digest(x) if len(x) else None for x in sets]
            block = f"{task}-{made}"
            send = []
            for i, q in enumerate(keys):
                if q is not None and q not in seen:
                    seen.add(q)
                    send.append(i)
            cols: dict = {n: [] for n in _SHINGLES.names}

            def row(**kw):
                for n in cols:
                    cols[n].append(kw.get(n))

            row(p=-1 - zlib.crc32(block.encode()) % parts, block=block, ids=ids, ns=[len(x) for x in sets], keys=keys,
                sketches=[sketch(x) if len(x) else None for x in sets])
            if send:
                token = np.concatenate([sets[i] for i in send])
                doc = np.repeat(np.array(send, np.uint32), [len(sets[i]) for i in send])
                order = np.argsort(token)
                token, doc = token[order], doc[order]
                cut = range_cuts(token, parts)
                for p in range(parts):
                    a, b = int(cut[p]), int(cut[p + 1])
                    if b > a:
                        rel = ((token[a:b] - np.uint64((p << 64) // parts)) >> shift).astype(np.uint32)
                        row(p=p, block=block, tokens=packed(byte_planes(np.diff(rel, prepend=np.uint32(0)))), docs=packed(byte_planes(doc[a:b])))
            return table(_SHINGLES, **cols)

        for rows, data, off in text_chunks(batches):
            sets += shingle_sets(data, off, k)
            ids += rows.column(0).to_pylist()
            size += len(data)
            if size >= BLOCK_BYTES:
                yield flush()
                ids, sets, size, made = [], [], 0, made + 1
        if sets:
            yield flush()

    return run, _SHINGLES_SQL


_SHARED_SQL = _SHINGLES_SQL + ", df binary"


def _shared(t: pa.Table) -> pa.Table:
    """A hash range: each block's shingles that occur in two documents or more, with a frequency class.  Rows with
    the documents pass."""
    schema = _SHINGLES.append(pa.field("df", pa.binary()))
    if t["p"][0].as_py() < 0:
        return t.append_column("df", pa.nulls(t.num_rows, pa.binary()))
    p, blocks = t["p"][0].as_py(), t["block"].to_pylist()
    token = [np.cumsum(from_planes(unpacked(x, np.uint8), np.uint32), dtype=np.uint32) for x in t["tokens"].to_pylist()]
    sizes = [len(x) for x in token]
    uniq, inv, count = np.unique(np.concatenate(token), return_inverse=True, return_counts=True)
    level = np.minimum(255, 1 + 8 * np.log2(count)).astype(np.uint8)
    keep, at = count[inv] > 1, 0
    cols: dict = {n: [] for n in schema.names}
    for block, x, docs, n in zip(blocks, token, t["docs"].to_pylist(), sizes):
        own = keep[at: at + n]
        if own.any():
            doc = from_planes(unpacked(docs, np.uint8), np.uint32)[own]
            for c, v in (("p", p), ("block", block), ("tokens", packed(byte_planes(np.diff(x[own], prepend=np.uint32(0))))),
                         ("docs", packed(byte_planes(doc))), ("df", packed(level[inv[at: at + n][own]]))):
                cols[c].append(v)
            for c in ("ids", "ns", "keys", "sketches"):
                cols[c].append(None)
        at += n
    return pa.Table.from_batches([table(schema, **cols)])


def hot_splits(keys: np.ndarray) -> np.ndarray:
    """Tasks over which the classes of each shingle are dealt, by the frequency class in its key."""
    level = (keys >> np.uint64(56)).astype(np.float64)
    return np.maximum(1, np.ceil(2 ** ((level - 1) / 8) / HOT)).astype(np.uint64)


def salt_of(digests: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """The share of a shingle's classes to which a class (its digest: 16 bytes) belongs."""
    return np.frombuffer(digests.tobytes(), "<u8").reshape(-1, 2)[:, 0] % splits


def _prefixes(pct: int, parts: int):
    """A block's documents with their shared shingles: the shared ones within each prefix under the first order
    (by frequency, those of one document first), dealt by shingle."""
    schema = pa.schema([("p", pa.int32()), ("keys", pa.binary()), ("idx", pa.binary()), ("sets", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        cols: dict = {n: [] for n in schema.names}
        rows = t.to_pylist()
        ns = keys = None
        token, doc, df = [], [], []
        for r in rows:
            if r["p"] < 0:
                ns, keys = np.array(r["ns"], np.int64), r["keys"]
                continue
            x = np.cumsum(from_planes(unpacked(r["tokens"], np.uint8), np.uint32), dtype=np.uint32).astype(np.uint64)
            token.append(x | np.uint64(r["p"]) << np.uint64(32))
            doc.append(from_planes(unpacked(r["docs"], np.uint8), np.uint32).astype(np.int64))
            df.append(unpacked(r["df"], np.uint8))
        if token:
            doc, df = np.concatenate(doc), np.concatenate(df).astype(np.uint64)
            key = mix(np.concatenate(token), 31) >> np.uint64(8) | df << np.uint64(56)
            order = np.lexsort((key, doc))
            key, doc = key[order], doc[order]
            at = doc_bounds(doc, len(ns))
            have = np.diff(at)
            names = np.frombuffer(b"".join(x or bytes(16) for x in keys), "V16")
            # a prefix begins with the shingles of this document alone
            want = np.minimum(have, np.maximum(0, (ns + (-pct * ns // 100) + 1) - (ns - have)))
            pick = ranges(at[:-1], want)
            key, doc = key[pick], doc[pick]
            part = (mix(key + salt_of(names[doc], hot_splits(key)), 7) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            for i in range(parts):
                o = order[cut[i]: cut[i + 1]]
                if len(o):
                    used, local = np.unique(doc[o], return_inverse=True)
                    heads = b"".join(keys[d] + int(ns[d]).to_bytes(4, "little") for d in used)
                    for c, v in zip(cols.values(), (i, key[o].tobytes(), local.astype("<u4").tobytes(), heads)):
                        c.append(v)
        return pa.Table.from_batches([table(schema, **cols)])

    return run, "p int, keys binary, idx binary, sets binary"


def _group(pct: int):
    """Within a partition of shingles: pairs with each group's smallest class, and groups of three or more.  The
    classes of a hot shingle come in shares: each has a pivot of its own, and all shares are one group."""
    cols = ["gid", "a", "an", "b", "bn", "load"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heads = [np.frombuffer(x, dtype=[("q", "V16"), ("n", "<u4")]) for x in pdf["sets"]]
        base = np.cumsum([0] + [len(x) for x in heads])
        heads = np.concatenate(heads)
        key = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["keys"]])
        idx = np.concatenate([np.frombuffer(x, "<u4").astype(np.int64) + o for x, o in zip(pdf["idx"], base)])
        two = np.ascontiguousarray(heads["q"]).view(">u8").reshape(-1, 2)
        order = np.lexsort((two[:, 1], two[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (two[order][1:] != two[order][:-1]).any(axis=1)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        firsts = order[new]
        q, n = heads["q"][firsts], heads["n"][firsts].astype(np.int64)
        cls = rank[idx]
        splits = hot_splits(key)
        salt = salt_of(q[cls], splits)
        order = np.lexsort((cls, salt, key))
        key, cls, salt, splits = key[order], cls[order], salt[order], splits[order]
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls, salt, splits = key[keep], cls[keep], salt[keep], splits[keep]
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]))
        size = np.diff(np.append(cut, len(key)))
        many = (size >= 2) | (splits[cut] > 1)
        cut, size = cut[many], size[many]
        if len(size) == 0:
            return pd.DataFrame({c: [] for c in cols})
        # groups of the same members are one group; shares of a hot shingle are named by it
        members = cls[ranges(cut, size)]
        bounds = np.cumsum(size) - size
        salted = mix(two[firsts][members][:, 0].astype(np.uint64) ^ two[firsts][members][:, 1].astype(np.uint64), 5)
        hot = splits[cut] > 1
        gid = np.where(hot, mix(key[cut], 9), np.add.reduceat(salted, bounds) + size.astype(np.uint64))
        one = np.unique(np.stack([gid, np.where(hot, salt[cut], 0).astype(np.uint64)]), axis=1, return_index=True)[1]
        gid, hot, size, starts = gid[one], hot[one], size[one], bounds[one]
        mem = members[ranges(starts, size)]
        who = np.repeat(np.arange(len(size)), size)
        pivot = members[starts][who]
        other = mem != pivot
        small, large = np.minimum(n[mem], n[pivot]), np.maximum(n[mem], n[pivot])
        near = other & (100 * small >= pct * large)
        load = np.zeros(len(q), np.int64)
        np.maximum.at(load, pivot, size[who])
        pair = np.unique(np.stack([pivot[near], mem[near]], axis=1), axis=0)
        # a pivot has met the others of its group, but not those of other shares
        rest = (other & (size[who] >= 3)) | hot[who]
        blob = lambda i: [x.tobytes() for x in q[i]]
        none = np.zeros(int(rest.sum()), np.int64)
        return pd.DataFrame({
            "gid": np.concatenate([np.zeros(len(pair), np.int64), gid.view(np.int64)[who[rest]]]),
            "a": blob(pair[:, 0]) + blob(mem[rest]), "an": np.concatenate([n[pair[:, 0]], n[mem[rest]]]),
            "b": blob(pair[:, 1]) + [None] * len(none), "bn": np.concatenate([n[pair[:, 1]], none]),
            "load": np.concatenate([load[pair[:, 0]], none])})

    return run, "gid long, a binary, an long, b binary, bn long, load long"


def _verify(k: int, pct: int):
    """Rows sorted by pivot (its own text first): links of the pivot with its members."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        def prefixes(x):
            return [prefix(order_keys(x, o), pct) for o in ORDERS]

        pivot, own, own_p = None, None, None
        for part, data, off in text_chunks(batches):
            a_col, b_col = part.column(0).to_pylist(), part.column(1).to_pylist()
            links: list[list] = [[], []]
            for a, b, x in zip(a_col, b_col, shingle_sets(data, off, k)):
                if b is None:
                    # rows of a repeated id with another text are told apart by the digest
                    if digest(x) == a:
                        pivot, own, own_p = a, x, prefixes(x)
                    continue
                if pivot != a or digest(x) != b or b in links[1][-1:] and links[0][-1] == a:
                    continue
                if not all(len(np.intersect1d(m, n, assume_unique=True)) for m, n in zip(prefixes(x), own_p)):
                    continue
                both = len(np.intersect1d(x, own, assume_unique=True))
                if 100 * both >= pct * (len(x) + len(own) - both):
                    links[0].append(a)
                    links[1].append(b)
            yield table(schema, a=links[0], b=links[1])

    return run, "a binary, b binary"


def _near(pct: int):
    """Pairs whose sketches allow a link."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("load", pa.int64())])

    def run(batches):
        for t in batches:
            an, sa, bn, sb = (t.column(i).to_pylist() for i in (1, 2, 4, 5))
            mask = pa.array([bool(may_link(overlap_bound(x, y, min(m, n)), m, n, pct)) for x, y, m, n in zip(sa, sb, an, bn)], pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(i).filter(mask) for i in (0, 3, 6)], schema=schema)

    return run, "a binary, b binary, load long"


def _rows_by_cell(batches):
    """The rows of sorted batches, a list per cell (gid, i, j)."""
    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    for _, cell in groupby(rows(), key=lambda r: r[:3]):
        yield list(cell)


def _cells(pct: int):
    """Rows sorted by cell: the members whose sketch allows a link with a member of another component."""
    schema = pa.schema([("gid", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("own", pa.int32()), ("key", pa.binary()), ("root", pa.binary())])

    def within(rows):
        diagonal = rows[0][1] == rows[0][2]
        ns = np.array([r[6] for r in rows], np.int64)
        roots = np.unique(np.array([r[5] for r in rows], dtype=object), return_inverse=True)[1]
        side = np.array([r[3] for r in rows])
        size = np.array([len(r[7]) if r[7] is not None else 0 for r in rows])
        packs = {}
        for z in np.unique(size).tolist():
            at = np.flatnonzero((size == z) & (diagonal | (side == rows[0][2])))
            if len(at):
                packs[z] = at, np.frombuffer(b"".join(rows[i][7] for i in at), np.uint8).reshape(-1, z) if z else None
        flagged = np.zeros(len(rows), bool)
        for i in np.flatnonzero(diagonal | (side == rows[0][1])).tolist():
            own = np.frombuffer(rows[i][7], np.uint8).astype(np.int16) if size[i] else None
            for z, (at, sk) in packs.items():
                near = (100 * np.minimum(ns[at], ns[i]) >= pct * np.maximum(ns[at], ns[i])) & (roots[at] != roots[i])
                if diagonal:
                    near &= at > i
                other = at[near]
                if len(other) and own is not None and z:
                    low = min(z, len(own))
                    bound = np.minimum(folded(sk[near], low), folded(own, low)).sum(axis=1, dtype=np.int64)
                    other = other[may_link(bound, ns[other], ns[i], pct)]
                if len(other):
                    flagged[i] = True
                    flagged[other] = True
        return [r[:6] for r, f in zip(rows, flagged) if f]

    def run(batches):
        for cell in _rows_by_cell(batches):
            found = within(cell)
            if found:
                yield table(schema, **dict(zip(schema.names, zip(*found))))

    return run, "gid long, i int, j int, own int, key binary, root binary"


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles sets a < b share, at [a, b].  Shingles of few sets are counted pair by pair, those of many
    by bit rows."""
    m = len(sets)
    token, who = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(token, kind="stable")
    token, who = token[order], who[order]
    cut = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    count = np.diff(np.append(cut, len(token)))
    out = np.zeros((m, m), np.int32)
    for c in range(2, RARE + 1):
        at = cut[count == c]
        if len(at):
            members = who[at[:, None] + np.arange(c)]
            for x in range(c):
                for y in range(x + 1, c):
                    np.add.at(out, (members[:, x], members[:, y]), 1)
    often = np.flatnonzero(count > RARE)
    for a in range(0, len(often), COLUMNS):
        some = often[a: a + COLUMNS]
        holds = np.zeros((m, -(-len(some) // 64) * 64), bool)
        holds[who[ranges(cut[some], count[some])], np.repeat(np.arange(len(some)), count[some])] = True
        bits = np.packbits(holds, axis=1).view(np.uint64)
        for i in range(m - 1):
            out[i, i + 1:] += np.bitwise_count(bits[i + 1:] & bits[i]).sum(axis=1, dtype=np.int32)
    return out


def _verified_cells(k: int, pct: int):
    """Rows sorted by cell: exact links between members of different components, as a star around the smallest member
    of each linked set of a cell, so a cell makes fewer rows than it has members."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def within(rows):
        rows = sorted({r[4]: r for r in rows}.values(), key=lambda r: r[4])
        data, off = text_buffer(pa.array([r[6] for r in rows], pa.string()))
        sets = shingle_sets(data, off, k)
        # rows of a repeated id with another text are told apart by the digest
        good = [i for i, x in enumerate(sets) if digest(x) == rows[i][4]]
        rows, sets = [rows[i] for i in good], [sets[i] for i in good]
        if len(rows) < 2:
            return [], []
        m, both = len(rows), overlaps(sets)
        n = np.array([len(x) for x in sets], np.int64)
        roots = np.unique(np.array([r[5] for r in rows], dtype=object), return_inverse=True)[1]
        root = np.arange(m)
        for a in range(0, m, 256):
            shared = both[a: a + 256].astype(np.int64)
            linked = (100 * shared >= pct * (n[a: a + 256, None] + n - shared)) & (roots[a: a + 256, None] != roots) & (shared > 0)
            x, y = np.nonzero(linked)
            # a member with what it has joined so far
            root = local_roots(np.concatenate([x + a, np.arange(m)]), np.concatenate([y, root]), m)
        ends = np.flatnonzero(root != np.arange(m))
        return [rows[i][4] for i in root[ends]], [rows[i][4] for i in ends]

    def run(batches):
        for cell in _rows_by_cell(batches):
            a, b = within(cell)
            if a:
                yield table(schema, a=a, b=b)

    return run, "a binary, b binary"


def _links_between_components(groups: DataFrame, comp: DataFrame, classes: DataFrame, texts: DataFrame, k: int, pct: int) -> DataFrame:
    """Links (a, b) that join the components of the groups that span several.

    A group's members go to blocks of about ``CELL`` members or ``CELL_TOKENS`` shingles; a cell holds two of its blocks.
    Sketches tell which members of a cell may link; only their texts are fetched."""
    now = groups.join(comp, groups["key"] == comp["node"], "left").select("gid", "key", "n", F.coalesce("root", "key").alias("root"))
    blocks = F.ceil(F.greatest(F.count("*") / CELL, F.sum("n") / CELL_TOKENS)).cast("int")
    size = now.groupBy("gid").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), blocks.alias("_b"))
    now = now.join(size.where("_lo != _hi").select("gid", "_b"), "gid")
    now = now.withColumn("own", F.pmod(F.xxhash64("key"), F.col("_b")).cast("int"))
    every = F.sequence(F.lit(0), F.col("_b") - 1)
    cells = (now.join(classes.select("key", "sketch"), "key")
             .select("gid", "own", "key", "root", "n", "sketch", F.explode(every).alias("_o"))
             .select("gid", F.least("own", "_o").alias("i"), F.greatest("own", "_o").alias("j"), "own", "key", "root", "n", "sketch"))
    run, out = _cells(pct)
    flagged = cells.repartition("gid", "i", "j").sortWithinPartitions("gid", "i", "j").mapInArrow(run, out)
    run, out = _verified_cells(k, pct)
    return (flagged.join(texts, "key").select("gid", "i", "j", "own", "key", "root", "text")
            .repartition("gid", "i", "j").sortWithinPartitions("gid", "i", "j").mapInArrow(run, out))


def _links(near: DataFrame, texts: DataFrame, k: int, pct: int) -> DataFrame:
    """Exact links among candidate pairs (a, b, load); ``texts`` has the candidates' texts by key.  The members of a
    pivot are dealt by its load, about ``VERIFY`` to a task."""
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("load") / VERIFY).cast("long")).alias("_salt")
    members = near.select("a", salt, "b", F.col("b").alias("key"))
    pivots = members.select("a", "_salt").distinct().select("a", "_salt", F.lit(None).cast("binary").alias("b"), F.col("a").alias("key"))
    rows = pivots.union(members).join(texts, "key").repartition("a", "_salt").sortWithinPartitions("a", "_salt", F.col("b").asc_nulls_first())
    run, out = _verify(k, pct)
    return rows.select("a", "b", "text").mapInArrow(run, out)


def jaccard_components(docs: DataFrame, k: int = 5, pct: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    tag = uuid.uuid4().hex

    def written(df, name):
        path = scratch_table_path(spark, f"jaccard-{tag}-{name}")
        df.write.mode("overwrite").parquet(path)
        drop_finished(spark)
        return spark.read.parquet(path)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    parts = max(4, -(-size // 6 // TOKENS_PER_RANGE))
    run, out = _shingles(k, parts)
    shared = written(docs.mapInArrow(run, out).groupBy("p").applyInArrow(_shared, _SHARED_SQL), "shared")
    ids = (shared.where("p < 0").select(F.explode(F.arrays_zip("ids", "ns", "keys", "sketches")).alias("x"))
           .select(F.col("x.ids").alias("doc_id"), F.col("x.ns").alias("n"), F.col("x.keys").alias("key"), F.col("x.sketches").alias("sketch")))
    classes = written(ids.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"),
                                                                     F.max("sketch").alias("sketch")), "classes")
    parts = max(4, parts // 8)
    run, out = _prefixes(pct, parts)
    prefixes = shared.select("block", "p", "tokens", "docs", "df", "ns", "keys").groupBy("block").applyInArrow(run, out)
    run, out = _group(pct)
    found = written(prefixes.groupBy("p").applyInPandas(run, out), "groups")
    pairs = written(found.where("b is not null").groupBy("a", "b").agg(F.max("load").alias("load")), "pairs")
    groups = written(found.where("b is null").groupBy("gid", F.col("a").alias("key")).agg(F.max("an").alias("n")), "members")
    own = classes.select("key", "n", "sketch")
    run, out = _near(pct)
    near = written(pairs.join(own.toDF("a", "an", "sa"), "a").join(own.toDF("b", "bn", "sb"), "b")
                   .select("a", "an", "sa", "b", "bn", "sb", "load").mapInArrow(run, out), "near")
    need = near.select("a").union(near.select("b")).union(groups.select("key")).distinct()
    need = need.join(classes, need["a"] == classes["key"]).select("key", "rep")
    # rows of a repeated id with another text are told apart by their digests later
    texts = written(docs.join(need, docs["doc_id"].eqNullSafe(need["rep"])).select("key", "text"), "texts")
    comp = components(_links(near, texts, k, pct), "a", "b")
    # each class's largest group joins most near copies, so that few groups still span components afterwards
    size = groups.groupBy("gid").agg(F.count("*").alias("_n"))
    largest = groups.join(size, "gid").groupBy("key", "n").agg(F.max(F.struct("_n", "gid")).alias("_g")).select("_g.gid", "key", "n")
    for step, some in enumerate((largest, groups)):
        more = written(_links_between_components(some, comp, classes, texts, k, pct), f"links{step}")
        # the stars of the components so far and the new links
        comp = components(comp.toDF("a", "b").union(more), "a", "b")
    named = classes.join(comp, classes["key"] == comp["node"], "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    low = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(low, "root").select("key", "component_id")
    return (ids.join(named, "key", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def keep_one(docs: DataFrame, k: int = 5, pct: int = 75) -> DataFrame:
    """Pipeline stage: of each component the document of the smallest id stays, once when its
    row is repeated.  Rows without an id stay."""
    found = jaccard_components(docs, k, pct)
    stay = (found.where((F.col("doc_id") == F.col("component_id"))).groupBy(F.col("doc_id").alias("_id"))
            .agg((F.count("*") > 1).alias("_many")))
    kept = docs.join(stay, docs["doc_id"] == stay["_id"])
    cols = [docs[c] for c in docs.columns]
    return (kept.where("not _many").select(*cols)
            .union(kept.where("_many").select(*cols).dropDuplicates(["doc_id", "text"]))
            .union(docs.where("doc_id is null")))
