"""Every operator against a brute-force version, on edge cases and on the small documents."""

import collections
import hashlib
import html
import math
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from edge import WORDS, documents, pairs, sentence, texts  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(i):
    return zlib.crc32(str(i if i is not None else "").encode())


@pytest.fixture(scope="module", params=["edge", "sf", "empty"])
def docs(request, spark):
    if request.param == "edge":
        return documents(spark).persist()
    if request.param == "empty":
        return documents(spark, [])
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- 1 fingerprints

def word_hash(word, seen={}):  # noqa: B006
    from prefspark.llm.arrays import prefix_sums, span_hash
    if word not in seen:
        raw = np.frombuffer(word.encode(), np.uint8)
        seen[word] = int(span_hash(prefix_sums(raw), np.array([0]), np.array([len(raw)]))[0])
    return seen[word]


def pieces(t):
    c = collections.Counter()
    words = {m.end() for m in WORD.finditer(t) if word_hash(m[0]) % 4 == 0}
    at = 0
    for x in re.split(r"(?<=[.,;:!?])|(\n)", t):
        if not x:
            continue
        end = at + len(x)
        cuts = sorted({at, end} | ({w for w in words if at < w < end} if len(x.encode()) > 40 else set()))
        for a, b in zip(cuts, cuts[1:]):
            y = t[a:b].strip(" \t\x0b\x0c\r\n")
            if y:
                c[y] += 1
        at = end
    return c


def alike(a, b):
    x, y = pieces(a), pieces(b)
    size = lambda p: len(p.encode())
    union = sum(max(x[p], y[p]) * size(p) for p in x.keys() | y.keys())
    return sum(min(n, y[p]) * size(p) for p, n in x.items()) / union if union else 1.0


def test_fingerprints(docs):
    from prefspark.llm.fingerprint import fingerprint_documents
    got = rows(fingerprint_documents(docs).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"))
    src = [(i, t or "") for i, t in pairs(docs) if i is not None]
    assert len(got) == docs.count()
    by = {}
    for g in got:
        if g[0] is not None:
            by.setdefault(g[0], []).append(g)
    order = sorted(src, key=lambda r: -r[0])
    prints = collections.defaultdict(set)
    for k, (i, t) in enumerate(order[:-1]):
        n = order[k + 1][1]
        cut = len(t) // 3
        e = t[: len(t) - cut] + n[:cut]
        hit = [g for g in by[i] if g[2] == hashlib.sha256(e.encode()).hexdigest()]
        assert hit and hit[0][1] == len(t)
        assert hit[0][5] == pytest.approx(alike(t, e)) and hit[0][6] == pytest.approx(alike(t, n))
        prints[t].add(hit[0][3])
    assert all(len(v) == 1 for v in prints.values())


def test_peeling_recovers_the_difference():
    from prefspark.llm.fingerprint import differences
    rnd = np.random.default_rng(1)
    for n in (0, 1, 5, 300, 5000):
        a, b, c = (rnd.integers(0, 1 << 62, n).astype(np.uint64) for _ in range(3))
        x, y = np.concatenate([a, b]), np.concatenate([a, c])
        z = np.zeros(len(x), np.int64)
        _, k, s = differences(x, z, y, z, 1)
        assert sorted(k[s > 0].tolist()) == sorted(b.tolist()) and sorted(k[s < 0].tolist()) == sorted(c.tolist())


# --- 2 toxicity

def test_toxicity(spark):
    from prefspark.llm.toxicity import score_documents
    rnd = random.Random(5)
    bad = ["rotten", "vilething", "grubby"]
    data, labels = [], []
    for i in range(700):
        toxic = i % 7 == 0
        words = sentence(rnd, 60).split()
        if toxic:
            for w in rnd.sample(bad, 2):
                words.insert(rnd.randrange(len(words)), w + (rnd.choice(["us", "o", "et"]) if w == "vilething" else ""))
        data.append((i, " ".join(words), "extra"))
        if i % 10:
            labels.append((i, int(toxic)))
    data += [(900, None, "x"), (901, "", "x"), (None, "rotten grubby", "x"), (900, None, "x")]
    labels += [(None, 1), (5000, 1), (3, None), (6, 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, score string")
    got = rows(score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert len(got) == len(data)
    for i, held, s, p in got:
        assert 0 <= s <= 1 and p == int(s >= 0.3) and held == (key(i) % 4 == 2)
        if i is not None and i < 700:
            assert p == int(i % 7 == 0), i
        elif i in (900, 901):
            assert p == 0
    none = rows(score_documents(docs, spark.createDataFrame([], "doc_id long, toxic int")))
    assert len(none) == len(data) and {r[3] for r in none} == {0}
    assert rows(score_documents(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int"))) == []


def patterns_table(spark, votes, labels):
    rows = collections.Counter((int(y), tuple(np.flatnonzero(v).tolist())) for v, y in zip(votes, labels))
    return spark.createDataFrame([(y, list(f), n) for (y, f), n in rows.items()], "label int, fired array<int>, n long").repartition(3)


def test_label_model_discounts_correlated_voters(spark):
    """Copies of a voter count about as one, and a voter of the clean side lowers the posterior."""
    from prefspark.llm.toxicity import fit_labels
    rnd = np.random.default_rng(0)
    y = (rnd.random(2000) < 0.3).astype(int)
    vote = lambda hit, miss: (rnd.random(2000) < np.where(y > 0, hit, miss)).astype(int)
    one, two, clean = vote(0.6, 0.05), vote(0.6, 0.05), vote(0.05, 0.5)
    labels = np.where(rnd.random(2000) < 0.5, y, -1)
    p = lambda m, *fired: m.posterior(np.zeros(len(fired), np.int64), np.array(fired, np.int64), 1)[0]
    single = fit_labels(patterns_table(spark, np.stack([one, two, clean], 1), labels), 3)
    copied = fit_labels(patterns_table(spark, np.stack([one, one, one, one, two, clean], 1), labels), 6)
    assert abs(p(single, 0) - p(copied, 0, 1, 2, 3)) < 0.1 and copied.weight[0] < 0.3 < 0.6 < copied.weight[4]
    assert p(single, 2) < p(single) < p(single, 0) < p(single, 0, 1) and p(single, 0, 2) < p(single, 0)
    assert abs(single.balance - 0.3) < 0.05


def brute_label_model(votes, labels, rounds):
    """EM over the rows themselves: dense votes, no patterns."""
    n, size = votes.shape
    weight = np.ones(size)

    def rates(y, rows):
        t, c, nt, nc = votes[rows].T @ y[rows], votes[rows].T @ (1 - y[rows]), y[rows].sum(), (1 - y[rows]).sum()
        mean = (t + c + 0.5) / (nt + nc + 1)
        return (t + 2 * mean) / (nt + 2), (c + 2 * mean) / (nc + 2), min(max(nt / (nt + nc), 1e-4), 1 - 1e-4)

    def post():
        z = math.log(balance / (1 - balance)) + votes @ (weight * np.log(a / b))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    a, b, balance = rates(labels.astype(float), labels >= 0)
    everyone = np.ones(n, bool)
    for step in range(2 * rounds):
        y = np.where(labels >= 0, labels, post())
        if step == rounds:
            share = np.zeros((size, size))
            for w, rate in ((y, a), (1 - y, b)):
                sd = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
                share = np.maximum(share, np.clip(((votes * w[:, None]).T @ votes / w.sum() - np.outer(rate, rate)) / np.outer(sd, sd), 0, 1))
            np.fill_diagonal(share, 0)
            weight = 1 / (1 + np.where(share > 0.1, share, 0).sum(axis=1))
            y = np.where(labels >= 0, labels, post())
        a, b, _ = rates(y, everyone)
    return post()


def test_toxicity_against_brute_force(spark):
    """Mined voters, label model, classifier and scores recomputed over plain rows; ties and a very long text included."""
    from prefspark.llm import toxicity as T
    rnd = random.Random(21)
    bad = ["grubby", "rottenly", "vilethings", "idiot"]
    data, labels = [], []
    for i in range(500):
        words = sentence(rnd, rnd.randint(5, 90)).split()
        toxic = i % 5 == 0
        for w in rnd.sample(bad, 2) if toxic and i % 25 else [rnd.choice(["please", "nothing", "you are an idiot"])] if i % 9 == 0 else []:
            words.insert(rnd.randrange(len(words)), w)
        data.append((i, " ".join(words) + ("!!" if i % 13 == 0 else "")))
        if i % 3:
            labels.append((i, int(toxic)))
    data += [(600, sentence(rnd, 60_000) + " grubby"), (601, ""), (602, None), (603, data[5][1]), (603, data[5][1])]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {(r["doc_id"], r["score"]) for r in T.score_documents(docs, table).collect()}
    train = [(i, t) for i, t in data if key(i) % 4 != 2 and t is not None]
    gold = dict(labels)
    mined, _ = T.mine_voters(spark.createDataFrame([(t, gold[i]) for i, t in train if i in gold], "text string, toxic int"))
    assert {"grubby", "rottenly"} <= set(mined)
    v = T.Votes(mined)
    counts = [v.of(t) for _, t in train]
    dense = np.zeros((len(train), len(v.names)))
    for r, c in enumerate(counts):
        dense[r, list(c)] = 1
    y = np.array([gold.get(i, -1) for i, _ in train])
    p = brute_label_model(dense, y, T.ROUNDS)
    known = y >= 0
    given = np.where(y[known] > 0, 0.97, 0.03)
    soft = p[known] * given / (p[known] * given + (1 - p[known]) * (1 - given))
    clean = np.array([n in T.CLEAN for n in v.names])
    w = T.fit_linear(T.design([c for c, k in zip(counts, known) if k], len(v.names), clean), soft)
    for i, t in data:
        z = (T.design([v.of(t)], len(v.names), clean) @ w[:-1] + w[-1])[0]
        want = 1 / (1 + math.exp(-min(30, max(-30, z))))
        assert any(j == i and abs(s - want) < 1e-6 for j, s in got), (i, want)


def test_given_voters():
    from prefspark.llm.toxicity import Votes
    v = Votes(["rott*", "rotten"])
    name = lambda t: {v.names[i]: n for i, n in v.of(t).items()}
    assert name("You are an IDIOT, you are such an idiot!! Rotten.") == {"!idiot": 2, "#insulted": 1, "#bang": 1, "rott*": 1, "rotten": 1}
    assert name("STOP THIS THING NOWW please") == {"#shout": 1, "#polite": 1} and name("f**k") == {"#masked": 1}
    assert name("Licensed under x://y") == {"#license": 1, "#link": 1} and name("plain " * 40) == {"#quiet": 1}
    assert name("plain") == name("") == name(None) == {}


# --- 3 html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li>Menu</ul></nav>
<div class="ad">Buy</div><article><h1>Head &amp; tail</h1><p><b>One<br>two &nbsp; three<p>Same passage everywhere.</p>
<div class="box"><span>Follow us on our pages</span></div><ul><li>i1<li>i2</ul><table><tr><td>a<td>b</table><ul><li>i1<li>own {i}</ul>
<table><tr><td>a<td>{i}</table><section class="comments"><p>reader {i}</p></section><p>Own text {i} &lt;tag&gt; &amp;amp;</p><form><input value=x>f</form></article><footer>foot</footer></body></html>"""


def test_html(spark):
    from prefspark.llm import html_extract as H
    data = [(i, f"http://h.example/{i}", PAGE.format(i=i)) for i in range(30)]
    plain = "<body><div>Site line</div><p>text {i}</p><div>Site foot</div>"
    data += [(100 + i, f"https://plain.example:80/{i}", plain.format(i=i)) for i in range(30)]
    data += [(200, None, None), (201, "", ""), (202, "x", "just text &copy"), (203, "x", "<p"), (204, "x", "</div><b>un<i>closed"), (200, None, None)]
    pages = spark.createDataFrame([(*r, "z") for r in data], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in H.extract(pages).collect()}
    for i in range(30):
        assert got[i]["text"] == f"Head & tail\nOne two three\nSame passage everywhere.\ni1\nown {i}\na {i}\nOwn text {i} <tag> &amp;"
        assert got[100 + i]["text"] == f"text {i}"
    assert got[0]["n_chars"] == len(got[0]["text"])
    assert [got[i]["text"] for i in (200, 201, 202, 204)] == ["", "", "just text ©", "unclosed"]
    assert H.extract(pages).count() == len(data)
    joined = {r["page_id"]: r["text"] for r in H._extract_joined(pages, H.site_templates(pages)).collect()}
    assert joined == {k: r["text"] for k, r in got.items()}
    assert H.extract(pages.limit(0)).count() == 0


def test_html_copies_are_no_templates(spark):
    from prefspark.llm.html_extract import extract
    wrapped = "<body><article><div class=body><section><p>Long story of one page.</p></section><section><p>Its second part.</p></section></div></article></body>"
    plain = "<body><div><p>A page without an article.</p></div><div><p>More of the same page.</p></div></body>"
    own = "<body><article><div><p>Near copy.</p><p>One of many with {i} in it.</p></div><div>tail</div></article></body>"
    body = "<body><article><div><section><p>The very same long body on many pages.</p></section></div><p>no {i}</p></article></body>"
    data = [(i, f"http://copies.example/{i}", (wrapped, plain)[i % 2]) for i in range(24)]
    data += [(100 + i, f"http://near.example/{i}", own.format(i=i)) for i in range(12)]
    data += [(200 + i, f"http://body.example/{i}", body.format(i=i)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    for i in range(24):
        assert got[i] == ("Long story of one page.\nIts second part.", "A page without an article.\nMore of the same page.")[i % 2]
    for i in range(12):
        assert got[100 + i] == f"Near copy.\nOne of many with {i} in it."
        assert got[200 + i] == f"The very same long body on many pages.\nno {i}"


def test_html_templates_do_not_depend_on_the_size_of_the_host(spark):
    from prefspark.llm.html_extract import extract
    page = "<body><article><h1>Head {i}</h1><p>Text of page {i}.</p>{block}</article></body>"
    block = "<div>Read more here</div>"
    data = [(i, f"http://large.example/{i}", page.format(i=i, block=block if i < 6 else "")) for i in range(400)]
    data += [(1000 + i, f"http://small.example/{i}", page.format(i=i, block=block)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Head {k % 1000}\nText of page {k % 1000}." for k, _, _ in data)


@pytest.mark.parametrize("before, after", [
    ("<form id=aspnetForm>", "</form>"), ("<div class='with-sidebar'>", "</div>"), ("<div class='social-layout'>", "</div>"), ("<div hidden>", "</div>"),
    ("<nav><a href=x>menu</a>", ""), ("<aside class=related>", "</aside>")])
@pytest.mark.parametrize("page", [
    "{0}<article><p>Body of the page.</p><p>More of it.</p></article>{1}", "<article>{0}<p>Body of the page.</p><p>More of it.</p>{1}</article>",
    "{0}<main><p>Body of the page.</p><p>More of it.</p></main>{1}", "{0}<p>Body of the page.</p><p>More of it.</p>{1}"])
def test_html_names_take_no_article(before, after, page):
    from prefspark.llm.html_extract import Page
    body = "<html><head><title>T</title><body>" + page.format(before, after) + "<div class=cookie>We use it</div></body></html>"
    got = Page(body).text().split("\n")
    assert "Body of the page." in got and "More of it." in got and "We use it" not in got


def test_html_names_are_hints():
    from prefspark.llm.html_extract import Page
    results = "".join(f"<article class='search-result'><p>Result {i} of the list.</p></article>" for i in range(4))
    assert Page(f"<body>{results}</body>").text() == "\n".join(f"Result {i} of the list." for i in range(4))
    parts = "".join(f"<div class='social-layout'><p>Part {i} of the page.</p></div>" for i in range(4))
    for whole in (parts, f"<article>{parts}</article>", f"<main>{parts}</main>"):
        assert Page(f"<body><nav><a>m</a></nav>{whole}</body>").text() == "\n".join(f"Part {i} of the page." for i in range(4))
    page = "<body><div class='page-with-sidebar'><article><p>The one long article of this page.</p></article><aside><article>Teaser</article></aside></div></body>"
    assert Page(page).text() == "The one long article of this page."


REMARK = "".join(f"<div class=c><p>Reader {i} says a lot more than the article itself does, at length and often.</p></div>" for i in range(9))


@pytest.mark.parametrize("box", ["<section class=comments>{0}</section>", "<ol class='commentlist x'>{0}</ol>", "<div id=comments><article>{0}</article></div>",
                                 "<div class='post comments-area'>{0}</div>", "<div id=disqus_thread>{0}</div>",
                                 "<article class=comment>{0}</article><article class=comment>{0}</article>"])
@pytest.mark.parametrize("page", [
    "<article><h1>Title</h1><p>Short body.</p>{0}</article>", "<main><article><h1>Title</h1><p>Short body.</p></article>{0}</main>",
    "<main><h1>Title</h1><p>Short body.</p>{0}</main>", "<div><h1>Title</h1><p>Short body.</p></div>{0}", "<div><h1>Title</h1><p>Short body.</p>{0}</div>"])
def test_html_comments_go_whatever_their_size(box, page):
    from prefspark.llm.html_extract import Page
    assert Page("<body><nav><a>m</a></nav>" + page.format(box.format(REMARK)) + "<footer>f</footer></body>").text() == "Title\nShort body."


def test_html_wrappers_named_for_comments_stay():
    from prefspark.llm.html_extract import Page
    body = "<article><h1>Title</h1><p>Short body.</p><section class=comments><p>Reader</p></section></article>"
    assert Page(f"<body class=comments><div class=comments>{body}</div></body>").text() == "Title\nShort body."
    assert Page(f"<body><article class='post has-comments comments-open'><h1>Title</h1><p>Short body.</p></article></body>").text() == "Title\nShort body."
    assert Page("<body><div class=comments><p>Only this.</p></div></body>").text() == "Only this."


def test_html_counts_decide_on_lists_and_boxes(spark):
    """A share list, an author box or a table that stands on many pages goes; items, rows, cells and words of text that recur stay."""
    from prefspark.llm.html_extract import extract
    page = ("<body><article><h1>Same head</h1><p>Text of page {i} with <a href=x>the same link</a>.</p><ul class=x><li>Share it</li><li>Print</li></ul>"
            "<ul><li>Yes</li><li>Own {i}</li></ul><address>By the desk</address><figure><img src=l><figcaption>Our logo</figcaption></figure>"
            "<table><tr><th>Size</th><td>Total</td></tr><tr><td>{i}</td><td>Total</td></tr></table><p>Same closing words.</p></article></body>")
    data = [(i, f"http://lists.example/{i}", page.format(i=i)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Same head\nText of page {i} with the same link.\nYes\nOwn {i}\nSize Total\n{i} Total\nSame closing words." for i in range(8))


def test_html_long_and_deep_pages():
    from prefspark.llm.html_extract import Page
    long = "<article>" + "".join(f"<p>Paragraph {i} " + "word " * 50 + "</p>" for i in range(20_000)) + "</article>"
    assert len(Page(long).text().split("\n")) == 20_000
    assert Page("<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000).text() == "deep"


def test_html_pages(spark):
    from prefspark.llm.html_extract import extract
    got = {r["page_id"]: r["text"] for r in extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        a = r["html"][r["html"].find("<article>") + 9: r["html"].find("</article>")]
        parts = re.split(r"</?(?:p|h1)>", a)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
        assert got[r["page_id"]] == "\n".join(x for x in want if x)


# --- 4 decontamination

def test_leaks(spark):
    from prefspark.llm.decontaminate import drop_contaminated, find_leaks
    rnd = random.Random(9)
    items = [(i, sentence(rnd, rnd.randint(15, 60))) for i in range(40)] + [(50, None), (51, ""), (52, "tiny item"), (3, None)]
    data, want = [], set()
    for i in range(400):
        text = sentence(rnd, 200).split()
        if i % 20 == 0:
            item = items[i // 20][1].split()
            if i % 40 == 0:
                for _ in range(max(1, len(item) // 8)):
                    item[rnd.randrange(len(item))] = "reworded"
            text[60:60] = item if i % 60 else [w.upper() for w in item]
            want.add((i, i // 20))
        data.append((i, " ".join(text), "x", len(" ".join(text))))
    data += [(500, None, "x", 0), (501, "", "x", 0), (500, None, "x", 0), (None, data[0][1], "x", 1), (None, "clean words only", "x", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, item_id string, n_chars long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, bench).collect()}
    assert want <= got and got - want <= {(None, 0)}
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(data) - len(want) - 1 and not {i for i, _ in want} & set(ids)
    assert find_leaks(docs, bench.limit(0)).count() == 0 and find_leaks(docs.limit(0), bench).count() == 0


def test_leaks_of_long_short_and_unspaced_items(spark):
    from prefspark.llm.decontaminate import find_leaks
    rnd = random.Random(4)
    sentence = lambda _, n: " ".join(f"{rnd.choice(WORDS)}{rnd.randrange(100)}" for _ in range(n))
    han = lambda n: "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(n))
    items = [(i, sentence(rnd, 120)) for i in range(10)] + [(100 + i, sentence(rnd, 5 + i % 10)) for i in range(60)] + [(200 + i, han(8 + 3 * i)) for i in range(10)]
    data, want = [], set()

    def plant(item, some, space=" "):
        text = sentence(rnd, 300).split()
        if not space:
            text = list(han(300))
        at = rnd.randrange(len(text))
        text[at:at] = some
        want.add((len(data), item))
        data.append((len(data), space.join(text)))

    for i, text in items[:10]:
        a = rnd.randrange(0, 60)
        plant(i, text.split()[a: a + 50])
    for i, text in items[10:70]:
        plant(i, text.split())
        reworded = text.split()
        if len(reworded) > 8:
            reworded[len(reworded) // 3] = "reworded"
            plant(i, reworded)
    for i, text in items[70:]:
        plant(i, list(text), "")
    clean = {len(data) + i for i in range(100)}
    data += [(i, sentence(rnd, 300)) for i in sorted(clean)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert want <= got, sorted(want - got)
    assert not {d for d, _ in got} & clean, [x for x in got if x[0] in clean]


def test_unspaced_scripts_are_words_by_character():
    import pyarrow as pa
    from prefspark.llm.arrays import text_buffer
    from prefspark.llm.decontaminate import word_hashes
    forms = ["ab \u4ec0\u4e48,x\U00020000\u3002\u0e01y", "AB \u4ec0 \u4e48 x \U00020000 \u0e01 y", "caf\u00e9 \ud55c\uad6d\uc5b4 \u20ac"]
    words, at = word_hashes(*text_buffer(pa.array(forms)))
    assert at.tolist() == [0, 7, 14, 17] and words[:7].tolist() == words[7:14].tolist()


def test_lcs():
    from prefspark.llm.decontaminate import lcs
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randint(1, 40))] for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert lcs(a, b) == row[-1]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def lcs_of(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("sampled", [3000, 60])
def test_leak_recall_against_brute_force(spark, sampled):
    """Paraphrases: of all (document, item) pairs that the subsequence rule accepts anywhere, at least 0.9 are found, also with a
    space fitted to a small sample; nothing else is found; very long texts and a null item id included."""
    from prefspark.llm.decontaminate import find_leaks
    rnd = random.Random(31)
    # a vocabulary with frequent and rare words, as texts have
    words = sorted({"".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 8))) for _ in range(4000)})
    odds = [1 / (k + 3) for k in range(len(words))]
    rnd.shuffle(words)
    sentence = lambda _, n: " ".join(rnd.choices(words, odds, k=n))
    items = [(i, sentence(rnd, rnd.randint(8, 70))) for i in range(30)] + [(None, sentence(rnd, 20)), (40, None)]
    data = []
    for i in range(240):
        text = sentence(rnd, rnd.randint(40, 160)).split()
        if i % 2:
            item = items[rnd.randrange(31)][1].split()
            share = rnd.choice([1, 0.9, 0.8, 0.7, 0.6, 0.5])
            kept = [w if rnd.random() < share else rnd.choice([w + "x", "", "filler here"]) for w in item]
            at = rnd.randrange(len(text))
            text[at:at] = [w for w in kept if w]
        data.append((i, " ".join(text)))
    data.append((500, sentence(rnd, 30_000) + " " + items[0][1] + " " + sentence(rnd, 100)))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, bench, max_sample_docs=sampled).collect()}
    want, maybe = set(), set()
    for d, text in data[:240] + [(500, " ".join(data[-1][1].split()[-250:]))]:
        w = words_of(text)
        for i, t in items:
            x = words_of(t)
            if not x:
                continue
            answer = x[-max(1, len(x) // 4):]
            reach = len(x) * 3 // 2
            for a in range(0, len(w), max(1, len(x) // 4)):
                region = w[a: a + reach + len(x)]
                share = lcs_of(x, region) / len(x)
                if share >= 0.6 and (share >= 0.85 or lcs_of(answer, region) / len(answer) >= 0.5):
                    want.add((d, i))
                    break
    assert (500, 0) in got and len(want) > 60 and any(i is None for _, i in want)
    assert len(want & got) >= 0.9 * len(want)
    # what is found beyond stands in a wider region than the brute force looked at
    assert len(got - want) <= 0.1 * len(got)


# --- 5 language ID

def test_language(spark, docs):
    from prefspark.llm.langid import identify, keep_identified
    got = rows(identify(docs))
    src = pairs(docs)
    assert len(got) == len(src)
    text = dict(src)
    for i, held, lang, s in got:
        assert 0 <= s <= 1 and held == (key(i) % 5 == 0)
        if i is not None:
            letters = any(c.isalpha() for c in text[i] or "")
            assert (lang == "und") == (not letters)
    kept = keep_identified(docs)
    assert kept.columns == docs.columns


def test_language_held_out(spark):
    from prefspark.llm.langid import identify
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [(i, p) for i, h, p, _ in rows(identify(docs)) if h]
    assert sum(lang[i] == p for i, p in held) >= 0.97 * len(held)


def test_unseen_words_fall_back(spark):
    from prefspark.llm.langid import Scorer, train
    docs = spark.createDataFrame([(i, "kaloka malika sonaka", "aa") for i in range(20)] + [(50 + i, "bredt grund strjom", "bb") for i in range(20)],
                                 "doc_id long, text string, lang string")
    s = Scorer(train(docs))
    assert s.score("lokali kasona")[0] == "aa" and s.score("strund bredjom")[0] == "bb"
    assert s.score("123 !")[0] == "und" and s.score(None) == ("und", 0.0)


# --- 6 packing, 7 token files

def tokens(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs):
    from prefspark.llm.packing import pack_documents
    from prefspark.llm.queries import tokenizer_path
    got = pack_documents(docs, tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
    want = collections.Counter()
    for i, t in pairs(docs):
        ids = tokens(t) + [1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            want[i, k, s, len(ids[s: s + 4096]), crc(ids[s: s + 4096])] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 4096
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // 4096) * 1.25 + 1


def test_plan_matches_best_fit_one_by_one():
    from prefspark.llm.packing import plan
    rnd = random.Random(1)
    for _ in range(100):
        cap = rnd.choice([7, 32, 100])
        hist = {n: rnd.randint(1, 30) for n in rnd.sample(range(1, cap + 1), rnd.randint(1, min(cap, 12)))}
        used = collections.Counter()
        ranks = collections.defaultdict(set)
        for length, rank, seqs, per, first, off in plan(hist, cap):
            for s in range(seqs):
                assert used[first + s] == off
                used[first + s] += per * length
                ranks[length] |= set(range(rank + s * per, rank + (s + 1) * per))
        assert {n: len(r) for n, r in ranks.items()} == hist and max(used.values()) <= cap
        rooms = []
        for n in sorted(hist, reverse=True):
            for _ in range(hist[n]):
                fits = [i for i, r in enumerate(rooms) if r >= n]
                i = min(fits, key=lambda j: rooms[j]) if fits else len(rooms)
                if not fits:
                    rooms.append(cap)
                rooms[i] -= n
        assert len(used) == len(rooms)


def test_pieces_are_encoded_as_the_tokenizer_does():
    import public_tokenizers
    from tokenizers import Tokenizer
    from prefspark.llm.tokenise import PieceEncoder
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    pieces = ["hello", "don't", "é", "éo", "éa", "İstanbul", "ß", "ΣΑΣ", "a1", "漢字", "x" * 3000, "…", "<|endoftext|>", "ǆabc", "ſt", "ﬁ", "a‍b", "ᾳ", "ŉ",
              "K", "Ⅷ", "ª", "e\u0301", "\u0301e", "ｆｕｌｌ"] * 3
    lens, ids = PieceEncoder(path).encode_new(pieces)
    at = np.cumsum(lens) - lens
    for p, a, n in zip(pieces, at, lens):
        assert ids[a: a + n].tolist() == tok.encode(p, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_files(docs):
    from prefspark.llm.queries import tokenizer_path
    from prefspark.llm.token_files import round_trip
    got = sorted(((-1 if r[0] is None else r[0], *r[1:]) for r in rows(round_trip(docs, tokenizer_path()))), key=lambda r: r[1])
    src = pairs(docs)
    assert [r[0] for r in got] == sorted(-1 if i is None else i for i, _ in src)
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    want = collections.Counter((-1 if i is None else i, len(x), crc(x)) for i, x in ((i, tokens(t) + [2]) for i, t in src))
    assert collections.Counter((r[0], r[2], r[3]) for r in got) == want


def test_wavelet_matrix():
    from prefspark.llm.wavelet import WaveletMatrix
    rnd = random.Random(4)
    for _ in range(40):
        n = rnd.choice([0, 1, 63, 64, 65, 500])
        a = np.array([rnd.choice([0, 2, 5, 49407, 300, 65535]) for _ in range(n)], np.uint16)
        w = WaveletMatrix.from_bytes(WaveletMatrix.build(a).to_bytes())
        assert (w.decode() == a).all() and [w.access(i) for i in range(n)] == a.tolist()
        for s in (0, 2, 49407, 7, 1 << 20):
            assert w.count(s) == (a == s).sum() and w.occurrences(s) == np.flatnonzero(a == s).tolist()
            if n > 3:
                assert w.count(s, 2, n - 1) == (a[2: n - 1] == s).sum()


# --- 8 repeated substrings

def brute_cut(texts_, size=400):
    raw = [(t or "").encode() for t in texts_]
    seen = collections.Counter(b[k: k + size] for b in raw for k in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k: k + size]] > 1:
                gone[k: k + size] = b"\1" * size
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [3000, 2])
def test_substrings(docs, hot, monkeypatch):
    from prefspark.llm import substring_dedup as S
    monkeypatch.setattr(S, "HOT", hot)
    src = pairs(docs)
    got = collections.Counter(rows(S.report(docs)))
    assert got == collections.Counter((i, *x) for (i, _), x in zip(src, brute_cut([t for _, t in src])))


def test_remove_repeats_stage(docs):
    from prefspark.llm.substring_dedup import remove_repeats
    out = remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.select("text", "n_chars").collect():
        assert r["text"] is None or r["n_chars"] == len(r["text"])


def test_repeated_starts():
    from prefspark.llm.bwt import repeated_starts
    for t in range(150):
        rnd = random.Random(t)
        al = rnd.choice([b"ab", b"abcdefg", bytes(range(256))])
        base = bytes(rnd.choice(al) for _ in range(60))
        ss = []
        for _ in range(rnd.randint(1, 8)):
            x = bytearray(base[rnd.randint(0, 20): rnd.randint(30, 60)])
            for _ in range(rnd.randint(0, 3)):
                x[rnd.randrange(len(x))] = rnd.choice(al)
            ss.append(bytes(x))
        size = rnd.choice([1, 2, 5, 9, 16])
        c = collections.Counter(s[i: i + size] for s in ss for i in range(len(s) - size + 1))
        assert [x.tolist() for x in repeated_starts(ss, size)] == [[i for i in range(len(s) - size + 1) if c[s[i: i + size]] > 1] for s in ss]


def test_long_documents_are_cut_without_losing_windows():
    from prefspark.llm.substring_dedup import cut_long, stretches
    rnd = np.random.default_rng(0)
    data = rnd.integers(97, 100, 9000).astype(np.uint8)
    off = np.array([0, 100, 8000, 9000])
    starts = []
    for part, po, docs_, shift in cut_long(data, off, 400, 2000):
        d, a, b, _ = stretches(part, po, 400)
        for x, s, e in zip(d, a, b):
            starts += [(int(docs_[x]), int(k - po[x] + shift[x])) for k in range(s, e)]
    assert sorted(starts) == [(i, k) for i in range(3) for k in range(off[i + 1] - off[i] - 399)]


# --- 9 near duplicates

def brute_components(src):
    sets = []
    for i, t in src:
        w = WORD.findall((t or "").translate(LOW))
        sets.append((i, frozenset(tuple(w[k: k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            both = len(a & b)
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                up[find(x)] = find(y)
    low = {}
    for x, (i, _) in enumerate(sets):
        r = find(x)
        low[r] = min((v for v in (low.get(r), i) if v is not None), default=None)
    return collections.Counter((i, len(s), low[find(x)]) for x, (i, s) in enumerate(sets))


def test_jaccard(docs):
    from prefspark.llm.jaccard_join import jaccard_components
    assert collections.Counter(rows(jaccard_components(docs))) == brute_components(pairs(docs))


@pytest.mark.parametrize("cell,tokens,hot", [(1000, 10**6, 50_000), (3, 10**6, 50_000), (5, 200, 4)])
def test_jaccard_groups_without_links(spark, monkeypatch, cell, tokens, hot):
    """Many texts share prefix shingles but link in several clusters or not at all; hot shingles are dealt out."""
    from prefspark.llm import jaccard_join as J
    jaccard_components = J.jaccard_components
    monkeypatch.setattr(J, "HOT", hot)
    monkeypatch.setattr(J, "VERIFY", hot)
    monkeypatch.setattr(J, "CELL", cell)
    monkeypatch.setattr(J, "CELL_TOKENS", tokens)
    rnd = random.Random(8)
    core = sentence(rnd, 40)
    data = []
    for c in range(25):
        own = sentence(rnd, rnd.choice([8, 14, 20]))
        for k in range(3):
            data.append((len(data), core + " " + own + (f" tail{k}" if k else "")))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert collections.Counter(rows(jaccard_components(docs))) == brute_components(data)


@pytest.mark.parametrize("hot", [50_000, 7])
def test_near_copies_at_the_threshold(spark, monkeypatch, hot):
    """Copies with random edits, so that many pairs of one large group fall on either side of the threshold."""
    from prefspark.llm import jaccard_join
    from prefspark.llm.jaccard_join import jaccard_components
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    rnd = random.Random(12)
    base = sentence(rnd, 120).split()
    data = []
    for i in range(60):
        words = list(base)
        for _ in range(rnd.randint(0, 5)):
            words[rnd.randrange(len(words))] = f"edit{rnd.randrange(40)}"
        data.append((i, " ".join(words)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert collections.Counter(rows(jaccard_components(docs))) == brute_components(data)


def test_components(spark):
    """Paths, stars around the least and the greatest node, random graphs, loops and no edge at all."""
    from prefspark.llm.components import components
    rnd = random.Random(1)
    names = [rnd.randbytes(16) for _ in range(3000)]
    names = [min(names)] + [x for x in names if x not in (min(names), max(names))] + [max(names)]
    graphs = [[], [(1, 1)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)], [(i, 2999) for i in range(300)],
              [(rnd.randrange(3000), rnd.randrange(3000)) for _ in range(2500)] + [(5, 6), (6, 5), (5, 6)]]
    for edges in graphs:
        edges = [(names[a], names[b]) for a, b in edges]
        df = spark.createDataFrame(edges, "a binary, b binary").repartition(6)
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        got = [(bytes(r[0]), bytes(r[1])) for r in rows(components(df, "a", "b"))]
        assert sorted(got) == sorted((x, find(x)) for x in root if find(x) != x)


def test_overlaps(monkeypatch):
    from prefspark.llm import jaccard_join as J
    rnd = np.random.default_rng(6)
    monkeypatch.setattr(J, "COLUMNS", 100)
    for m, rare in ((2, 8), (12, 3), (40, 8)):
        monkeypatch.setattr(J, "RARE", rare)
        sets = [np.unique(rnd.integers(0, 400, rnd.integers(1, 120)).astype(np.uint64)) for _ in range(m)]
        got = J.overlaps(sets)
        assert all(got[a, b] == len(np.intersect1d(sets[a], sets[b])) for a in range(m) for b in range(a + 1, m))


def test_sketches_never_bound_too_low():
    from prefspark.llm.jaccard_join import overlap_bound, sketch
    rnd = np.random.default_rng(3)
    for n in (1, 5, 70, 400, 3000):
        for _ in range(20):
            both = rnd.integers(0, 1 << 63, rnd.integers(0, n + 1)).astype(np.uint64)
            x = np.unique(np.concatenate([both, rnd.integers(0, 1 << 63, n).astype(np.uint64)]))
            y = np.unique(np.concatenate([both, rnd.integers(0, 1 << 63, 2 * n).astype(np.uint64)]))
            assert overlap_bound(sketch(x), sketch(y), min(len(x), len(y))) >= len(np.intersect1d(x, y))


def test_keep_one(docs):
    from prefspark.llm.jaccard_join import keep_one
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute_components([(i, t) for i, t in pairs(docs)]) if c is not None}
    got = [i for i, _ in pairs(kept) if i is not None]
    assert sorted(got) == sorted(want)


# --- 10 scores

@pytest.mark.parametrize("order, block", [(2, 6 << 20), (3, 6 << 20), (3, 2000)])
def test_scores(docs, order, block, monkeypatch):
    from prefspark.llm import lm_score
    from prefspark.llm.lm_score import score_documents
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", block)
    src = pairs(docs)
    t = [(i, WORD.findall((x or "").translate(LOW)) + [None]) for i, x in src]
    train = [x for i, x in t if key(i) % 10]
    c = collections.Counter(w for x in train for w in x)
    two = collections.Counter(p for x in train for p in zip(["<b>", *x], x))
    three = collections.Counter(p for x in train for p in zip(["<b>", *x], x, x[1:]))
    n, v = sum(c.values()), len(c)
    ctx = lambda u: len(train) if u == "<b>" else c[u]

    def failure(grams, context):
        n1, tot = collections.Counter(), collections.Counter()
        for g, k in grams.items():
            b = math.frexp(context(g))[1]
            tot[b] += k
            n1[b] += k == 1
        return lambda count: min(0.999, max(0.001, (n1[math.frexp(count)[1]] + 0.5) / (tot[math.frexp(count)[1]] + 1)))
    fail2, fail3 = failure(two, lambda g: ctx(g[0])), failure(three, lambda g: two[g[:2]])
    got = sorted(rows(score_documents(docs, order)), key=lambda r: (str(r[0]), r[2], r[5]))
    want = []
    for i, x in t:
        base = s = 0.0
        past = ["<b>"]
        for w in x:
            p = (c[w] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            # from the root up: each longer state that was seen puts its arc before what its failure arc leads to
            if ctx(past[-1]):
                share = fail2(ctx(past[-1]))
                p = (1 - share) * two[past[-1], w] / ctx(past[-1]) + share * p
            if order == 3 and len(past) > 1 and two[past[-2], past[-1]]:
                seen = two[past[-2], past[-1]]
                share = fail3(seen)
                p = (1 - share) * three[past[-2], past[-1], w] / seen + share * p
            s += math.log10(p)
            past.append(w)
        want.append((i, key(i) % 10 == 0, len(x), sum(c[w] > 0 for w in x), n, base, s))
    want.sort(key=lambda r: (str(r[0]), r[2], r[5]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)
