"""Operators 11 to 13 against brute force, on edge cases and on the small tables."""

import collections
import gzip
import hashlib
import math
import os
import random
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import repair_reference  # noqa: E402
from edge import documents, sentence  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- 11 archives

BIG = "é漢\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3000
PAGES = ([(i, f"http://a/ b\n{i}", t) for i, t in enumerate([
    None, "", "x", "é" * 499 + "x", "é" * 500, "é" * 500, BIG, BIG, "0\r\n\r\n" * 500, "y" * 8192, "z" * 4096, "w" * 40000])]
    + [(None, None, BIG), (None, None, "q" * 2000), (None, None, "q" * 2000), (7, "u", BIG), (7, "http://a/ b\n7", BIG), (11, "w2", "w" * 40000)])


def pages(spark, data=PAGES):
    """pages with columns that the operator names inside."""
    extra = ["digest", "size", "rows", "block", "response_id", "id", "_hot", "payload"]
    return spark.createDataFrame([(*r, *["c"] * len(extra)) for r in data],
                                 "page_id long, url string, html string, " + ", ".join(f"{c} string" for c in extra)).repartition(3)


def brute_pages(data):
    bodies = [(i, (h or "").encode()) for i, _, h in data]
    last = {}
    for i, b in bodies:
        if len(b) >= 1000 and i is not None:
            last[b] = max(last.get(b, i), i)
    out = []
    for i, b in bodies:
        revisit = b in last and i != last[b]
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", last[b] if revisit else None))
    return collections.Counter(out)


@pytest.mark.parametrize("small", [200_000, 0])
def test_archives(spark, monkeypatch, small):
    from prefspark.llm import hot_join, warc
    monkeypatch.setattr(hot_join, "SMALL_ROWS", small)
    monkeypatch.setattr(hot_join, "HOT_SHARE", 3)
    assert collections.Counter(rows(warc.round_trip(pages(spark)))) == brute_pages(PAGES)
    given = spark.read.parquet(f"{SF}/pages.parquet")
    assert collections.Counter(rows(warc.round_trip(given, segment_bytes=700, chunk_bytes=90, file_records=50))) == brute_pages(rows(given))
    assert rows(warc.round_trip(pages(spark, []))) == []


def test_archive_files(spark, tmp_path):
    """The files are WARC: records one behind the other, payloads, uris and identifiers as written."""
    from prefspark.llm import warc
    warc.write_archives(pages(spark), str(tmp_path / "w"), segment_bytes=10000, file_records=4)
    found, seen = collections.Counter(), collections.Counter()
    for f in (tmp_path / "w").glob("part-*"):
        data = gzip.decompress(f.read_bytes())
        records = list(warc.parse_records(data))
        assert 0 < len(records) <= 4 and data.endswith(b"\r\n\r\n")
        for fields, block, whole in records:
            assert whole and len(block) <= 10000
            assert ("warc-segment-origin-id" in fields) == (fields["warc-type"] == "continuation")
            found[fields["warc-type"]] += 1
            seen[fields["warc-record-id"]] += 1
    assert set(found) == {"response", "revisit", "continuation"}
    assert found["response"] + found["revisit"] == len(PAGES)
    got = warc.read_records(spark, str(tmp_path / "w")).collect()
    assert all(r["complete"] for r in got)
    texts = collections.Counter(bytes(r["payload"]) for r in got if r["record_type"] == "response")
    kinds = brute_pages(PAGES)
    assert collections.Counter(hashlib.sha1(p).hexdigest() for p in texts.elements()) == collections.Counter(
        k[2] for k in kinds.elements() if k[3] == "response")


def test_archives_with_faults(spark, tmp_path):
    """A lost segment, a wrong total, a broken chunk and a cut file leave null payloads, others stay right;
    segments are found in any order and file; plain HTTP bodies and chunk extensions are read."""
    from prefspark.llm import warc

    def record(kind, ident, block, **fields):
        names = {"page": "Page-ID", "seg": "WARC-Segment-Number", "origin": "WARC-Segment-Origin-ID", "total": "WARC-Segment-Total-Length"}
        head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <" + ident.encode() + b">"]
        head += [f"{names[k]}: {v}".encode() for k, v in fields.items()] + [b"content-length: %d" % len(block)]
        return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    whole = http + b"5;x=y\r\nhello\r\nA\r\n world 123\r\n0\r\n\r\n"
    cut = [whole[:40], whole[40:60], whole[60:]]

    def split(page, parts, total, numbers=(1, 2, 3)):
        return [record("response" if n == 1 else "continuation", f"{page}-{n}", p, page=page, seg=n,
                       **({} if n == 1 else {"origin": f"<{page}-1>"}), **({"total": total} if n == 3 else {})) for n, p in zip(numbers, parts)]

    files = [
        split(1, cut, len(whole))[::-1] + [record("warcinfo", "i", b"software: x")],
        split(2, cut[:1] + cut[2:], len(whole), (1, 3)) + split(3, cut, len(whole) + 1)[:2],
        split(3, cut, len(whole) + 1)[2:] + [record("response", "4", http + b"5\r\nhel", page=4)],
        [record("response", "5", b"HTTP/1.1 200 OK\r\n\r\nplain", page=5), record("response", "6", whole, page=6)],
        [record("response", "7", whole, page=7)[:-20]],
    ]
    for i, f in enumerate(files):
        data = b"".join(f)
        # one gzip member a record, one for all, or none
        (tmp_path / f"{i}.warc").write_bytes([b"".join(map(gzip.compress, f)), gzip.compress(data), data][i % 3])
    got = {r["page_id"]: (r["payload"] and bytes(r["payload"]), r["complete"]) for r in warc.read_records(spark, str(tmp_path)).collect()}
    assert got == {1: (b"hello world 123", True), 2: (None, False), 3: (None, False), 4: (None, False), 5: (b"plain", True),
                   6: (b"hello world 123", True), 7: (None, False)}


# --- 12 conversations

@pytest.mark.parametrize("block", [2, 3, 7, 32])
def test_cheapest_edits(block):
    from prefspark.llm.conversation_repair import cheapest
    rnd = random.Random(block)
    for _ in range(800):
        codes = bytes(4 * rnd.choice([0, 0, 0, 1, 2]) + rnd.randrange(4) for _ in range(rnd.randint(0, 14)))
        want = repair_reference.cheapest([(0, 0, "suax"[c % 4], "t") for c in codes], [["", "blank", "truncated"][c // 4] for c in codes])
        assert cheapest(codes, block) == want[:2]


def conversations(spark):
    rnd = random.Random(4)
    roles = ["user", "assistant", "user", "assistant", "system", "User", "", "tool", None]
    said = ["Hello.", "Why?", "No end", " ", "", None, "Tab.\t\n", "\x1c", "a.b", "é!", "Same.", "Same."]
    data = []
    for conv in [*range(40), None]:
        data += [(conv, t, rnd.choice(roles[: 4 + conv % 6] if conv is not None else roles), rnd.choice(said)) for t in range(rnd.randint(1, 12))]
    data += [(50, None, "user", "Hi."), (50, None, "assistant", "Yes."), (51, -(1 << 63), "user", "Low."), (51, (1 << 63) - 1, "assistant", "High."),
             (52, 3, "user", "Tie."), (52, 3, "user", "Tie."), (52, 3, "assistant", "x" * 200_000), (53, 10, "system", "Only system.")]
    data += [(60, t, "user" if t % 2 else "assistant", f"Turn {t}" + ".!? "[t % 4]) for t in range(700)]
    extra = ["h", "h2", "gone", "code", "seen", "kind", "is_row", "letter"]
    df = spark.createDataFrame([(*r, *["c"] * len(extra)) for r in data],
                               "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in extra)).repartition(5)
    return df, data


def test_conversation_repair(spark):
    from prefspark.llm.conversation_repair import MAX_LONG, repair
    df, data = conversations(spark)
    hashes = {r["text"]: (r["a"], r["b"]) for r in df.selectExpr("coalesce(text, ' ') AS text").selectExpr(
        "explode(array(text, '', translate(text, '.!?', ''))) AS text").selectExpr("text", "xxhash64(text) AS a", "xxhash64('second', text) AS b").collect()}
    want = repair_reference.repaired(data, lambda r: (r[2].encode(), hashes[r[3]]))
    want = [(r[0], min(r[1], MAX_LONG), *r[2:]) for r in want]
    got = rows(repair(df))
    assert collections.Counter(got) == collections.Counter(want)
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    assert collections.Counter(rows(repair(given))) == collections.Counter(repair_reference.repaired(rows(given), lambda r: 0))
    assert rows(repair(given.limit(0))) == []


# --- 13 search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, k):
    bags = [(d, collections.Counter(TERM.findall((t or "").translate(LOW)))) for d, t in docs]
    n_docs, total = sum(1 for _, c in bags if c), sum(sum(c.values()) for _, c in bags)
    df = collections.Counter(x for _, c in bags for x in c)
    out = []
    for i, t in items:
        found = []
        for d, c in bags:
            m = 25 + (75 * sum(c.values()) * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10 ** 9 * c[x]) // (1000 * c[x] + 8 * m))
                        for x in TERM.findall((t or "").translate(LOW)) if c[x])
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return collections.Counter(out)


@pytest.mark.parametrize("settings", [{}, {"block_terms": 20, "batch_classes": 3}, {"k": 3}])
def test_search(spark, settings):
    from prefspark.llm.lexical_search import search
    rnd = random.Random(5)
    docs = documents(spark)
    same = [(100 + i, "one two " * 40) for i in range(30)]
    docs = docs.unionByName(spark.createDataFrame(same, "doc_id long, text string").repartition(7), allowMissingColumns=True)
    items = [(0, sentence(rnd, 30)), (1, None), (2, ""), (None, sentence(rnd, 5)), (3, "漢字 one ONE é"), (3, "two"), (4, "zzzz nothing")]
    items += [(10 + i, sentence(rnd, 40)) for i in range(5)] + [(20, "alphaa " * 500_000)]
    table = spark.createDataFrame([(*r, "c", "c", "c") for r in items], "item_id long, text string, q string, term string, doc_id string")
    want = brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], items, settings.get("k", 10))
    assert collections.Counter(rows(search(docs, table, **settings))) == want
    assert rows(search(documents(spark, []), table)) == []
    assert rows(search(docs, table.limit(0))) == []


def test_search_beyond_doubles():
    """Sums that doubles cannot hold are added as integers."""
    import numpy as np
    from prefspark.llm.lexical_search import ItemMatrix
    matrix = ItemMatrix(np.array([0, 1]), np.array([0, 0]), np.array([1 << 30, 1]), np.array([10_001, 3]), 2)
    assert not matrix.exact
    got = matrix.scores(np.array([0, 0]), np.array([0, 1]), np.array([99_999, 7]), 1)
    assert got.tolist() == [[(1 << 30) * 10_001 * 99_999 + 21]]


def test_queries_equal_their_sql(spark):
    import duckdb
    from prefspark.llm.queries import ORACLES, QUERIES
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("op11_warc_segments", "op13_lexical_search"):
        df, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
        cols = sorted(df.columns)
        assert cols == sorted(want.columns)
        assert collections.Counter(rows(df.select(*cols))) == collections.Counter(want.select(*cols).fetchall())
