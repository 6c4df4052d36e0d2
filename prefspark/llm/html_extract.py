"""Main text of web pages by removing what a site repeats.

Each page is read into elements once.  Its content is the articles within ``main``, else ``main``, else its articles, else the body.
Scripts and controls go by tag, menus and footers by tag and role, asides, forms, adverts, notices and the like by tag, role
and class or id, which are hints: they never take main, an article or most of the text (``Page._dropped``).  Containers of reader
comments go by their whole class or id whatever their size, while a paragraph, heading or article stands beside them.
Then site templates go: every element subtree that may be furniture is hashed, Spark
counts the distinct pages of each host that hold it (pages of the same content count once), and subtrees on at least
``min_pages`` of them are deleted, however large the host.  A subtree that holds half of a page's
content text or more is never deleted from that page.  Inside an article or main, paragraphs, headings, quotes and the items,
rows and cells of lists and tables are never taken for templates by themselves, however often a site repeats a passage, but a list,
table, figure, address or box may be one as a whole; without article and main every subtree may be one.

A page's hashes are one narrow row, rows of copies are merged before they are counted.  Repeated subtrees are broadcast
only when at most ``MAX_SHARED`` (checked); beyond that each page meets its own by a join.

Defined results: null, empty or textless html gives the empty text; a null url is a host of its own; repeated rows
are extracted each (and count as one page); unclosed and stray tags are repaired as browsers do; extra
columns are ignored.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .arrays import table

MAX_SHARED = 500_000

# fixed values: element names of HTML and common names of page furniture
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul "
                   "caption").split())
PROSE = frozenset(("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre thead tbody tfoot tr td th caption figcaption "
                   "a abbr b bdi bdo br cite code data dfn em i kbd mark q s samp small span strong sub sup time u var wbr "
                   "font hr img summary").split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6".split())
COMMENTS = frozenset(("comment comments commentlist comment-list comments-list comment-section comments-section comments-area comment-area "
                      "comment-thread comment-wrapper comments-wrapper user-comments post-comments reader-comments disqus disqus_thread disqus-thread "
                      "replies reply-list").split())
CLOSES_P = BLOCK - frozenset(("body", "html", "caption", "tbody", "tfoot", "thead", "tr"))
NO_TEXT = frozenset(("script style noscript template iframe object embed svg canvas button select option textarea input head title audio "
                     "video map").split())
HEAD = frozenset("head base basefont bgsound link meta noscript script style template title".split())
NAV_TAGS, NAV_ROLES = frozenset("nav footer menu".split()), frozenset("navigation contentinfo menubar menu".split())
ROLES = frozenset("banner complementary search alert alertdialog dialog form".split())
FURNITURE = frozenset(("ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner cookie cookies consent "
                       "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar side menu nav navbar "
                       "navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comments comment commentlist disqus "
                       "replies reply respond share sharing social related recommended recommendations widget widgets search skip skiplink "
                       "hidden").split())
_SCOPE = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def tokens():
    return re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S).finditer


def attributes(raw: str) -> dict[str, str]:
    out = {}
    for m in re.finditer(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", raw):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


# what an element says about itself: no text of the page, site navigation, a furniture tag or name, a part of a name only, reader comments
TEXTLESS, NAV, NAMED, HINT, REMARKS = 1, 2, 3, 4, 5


def furniture(tag: str, raw: str, in_content: bool) -> int:
    if tag in NO_TEXT:
        return TEXTLESS
    if tag in NAV_TAGS:
        return NAV
    kind = NAMED if tag in ("aside", "dialog") or tag == "header" and not in_content else HINT if tag in ("form", "fieldset", "label") else 0
    if not raw or tag in ("body", "html", "main"):
        return kind
    a = attributes(raw)
    role = a.get("role", "").lower()
    if role in NAV_ROLES:
        return NAV
    if role in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return NAMED
    names = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
    if any(name in COMMENTS for name in names):
        return REMARKS
    if any(name in FURNITURE for name in names):
        return kind or NAMED
    return kind or (HINT if any(part in FURNITURE for name in names for part in re.split(r"[-_]+", name)) else 0)


def _hash(parts) -> int:
    h = xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


class Page:
    """A page's elements in document order: tag, parent, furniture kind, whether dropped, content root, text pieces."""

    __slots__ = ("tag", "parent", "kind", "drop", "root", "pieces")

    def __init__(self, source: str):
        self.tag, self.parent, self.kind, self.root = ["#page"], [-1], [0], [False]
        # (element, text) and (element, None) where a block begins or ends
        self.pieces: list = []
        stack, at, n = [0], 0, len(source)
        low = None
        find = tokens()
        skip_to = 0
        for m in find(source):
            s = m.start()
            if s < skip_to:
                continue
            if s > at:
                self.pieces.append((stack[-1], source[at:s]))
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                k = len(stack) - 1
                while k and self.tag[stack[k]] != tag:
                    k -= 1
                if k:
                    if tag in BLOCK or any(self.tag[e] in BLOCK for e in stack[k + 1:]):
                        self.pieces.append((stack[k], None))
                    elif tag in ("td", "th"):
                        self.pieces.append((stack[k], " "))
                    del stack[k:]
                continue
            if self.tag[stack[-1]] == "head" and tag not in HEAD:
                stack.pop()
            if tag in CLOSES_P:
                self._close(stack, ("p",), ("article", "section", "div", "body", "td", "th", "li", "table", "button", "main", "aside", "blockquote"))
            if tag in _SAME:
                self._close(stack, _SAME[tag], _SCOPE[tag])
            up = stack[-1]
            if tag == "br":
                self.pieces.append((up, " "))
                continue
            e = len(self.tag)
            raw = m[3]
            self.tag.append(tag)
            self.parent.append(up)
            in_content = self.root[up] or tag in ("article", "main")
            self.kind.append(furniture(tag, raw, in_content))
            self.root.append(in_content)
            if tag in BLOCK:
                self.pieces.append((e, None))
            elif tag in ("td", "th"):
                self.pieces.append((e, " "))
            if tag in VOID:
                continue
            if raw.endswith("/") and tag not in BLOCK and tag not in RAW:
                continue
            if tag in RAW:
                if low is None:
                    low = source.lower()
                end = low.find(f"</{tag}", at)
                end = n if end < 0 else end
                close = low.find(">", end)
                if end > at:
                    self.pieces.append((e, source[at:end]))
                at = skip_to = n if close < 0 else close + 1
                continue
            stack.append(e)
        if at < n:
            self.pieces.append((stack[-1], source[at:]))
        self.drop = self._dropped()

    def _below(self, flags) -> list[bool]:
        out = list(flags)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out

    def _without_comments(self, gone: list[bool]) -> list[bool]:
        """``gone`` and the containers of reader comments, whatever their size: all of them where a paragraph, a heading or an article
        outside of navigation stands beside; else (a wrapper of the page that is named so) none."""
        n, tag = len(self.tag), self.tag
        remarks = self._below([k == REMARKS for k in self.kind])
        beside = self._below([k in (TEXTLESS, NAV) or k == NAMED and t not in ("article", "main") for k, t in zip(self.kind, tag)])
        prose = self._below([t in PARAGRAPHS or t == "article" for t in tag])
        if any(t and prose[e] and not remarks[e] and not beside[e] and t.strip() for e, t in self.pieces):
            return [g or r for g, r in zip(gone, remarks)]
        # an article in a wrapper that is named for comments as a whole: comments within it still go
        inner = [k == REMARKS and e > 0 and self._has(e, remarks) for e, k in enumerate(self.kind)]
        inner = self._below(inner)
        if any(t and prose[e] and not inner[e] and not beside[e] and t.strip() for e, t in self.pieces):
            return [g or r for g, r in zip(gone, inner)]
        return gone

    def _has(self, e: int, flags: list[bool]) -> bool:
        """Whether the element around ``e`` is flagged."""
        return self.parent[e] >= 0 and flags[self.parent[e]]

    def _dropped(self) -> list[bool]:
        """Which elements go by tag, role or name.

        Names are hints: what holds main goes never, nor what holds most of the text outside links of its article (of
        the page outside articles); what holds an article goes only for its tag or whole name, and when the
        page has an article elsewhere.  If the hints of one article or page together would take
        half of its text, parts of names do not count, and if all of it, no name does."""
        tag, parent, kind = self.tag, self.parent, self.kind
        n = len(tag)
        gone = self._below([k == TEXTLESS for k in kind])
        if not any(k > TEXTLESS for k in kind):
            return gone
        if any(k == REMARKS for k in kind):
            gone = self._without_comments(gone)
        main, article = [t == "main" for t in tag], [t == "article" for t in tag]
        for e in range(n - 1, 0, -1):
            if not gone[e]:
                main[parent[e]] |= main[e]
                article[parent[e]] |= article[e]
        marked = self._below([k in (NAV, NAMED) for k in kind])
        free = any(t == "article" and not m and not g for t, m, g in zip(tag, marked, gone))
        nav = [k == NAV and not main[e] and (free or not article[e]) for e, k in enumerate(kind)]
        region = [0] * n
        for e in range(1, n):
            region[e] = parent[e] if tag[parent[e]] in ("article", "main") else region[parent[e]]
        if any(nav):
            # an unclosed menu may have taken its article or page in: it holds paragraphs, and nothing else is left
            prose, holds, rest = [False] * n, list(nav), [0] * n
            inside_p, link = self._below([t == "p" for t in tag]), self._below([t == "a" for t in tag])
            for e in range(n - 1, 0, -1):
                holds[parent[e]] |= holds[e]
            below = self._below([k >= NAV and (nav[e] or not holds[e]) for e, k in enumerate(kind)])
            for e, t in self.pieces:
                if t and not gone[e] and t.strip():
                    prose[e] |= inside_p[e] and not link[e]
                    rest[e] += not below[e]
            for e in range(n - 1, 0, -1):
                prose[parent[e]] |= prose[e]
                rest[parent[e]] += rest[e]
            nav = [x and not (prose[e] and not rest[region[e]]) for e, x in enumerate(nav)]
        gone = [g or b for g, b in zip(gone, self._below(nav))]
        link = self._below([t == "a" for t in tag])
        words, linked = [0] * n, [0] * n
        for e, t in self.pieces:
            if t and not gone[e]:
                (linked if link[e] else words)[e] += len(t.strip())
        for e in range(n - 1, 0, -1):
            words[parent[e]] += words[e]
            linked[parent[e]] += linked[e]
        # a part of the page made of links alone is measured by them
        size = [words[e] if words[region[e]] else linked[e] for e in range(n)]
        whole = [words[e] or linked[e] for e in range(n)]
        names = []
        for e in range(1, n):
            if kind[e] < NAMED or gone[e] or main[e] or article[e] and not (kind[e] == NAMED and free):
                continue
            if 2 * size[e] < max(whole[region[e]], 1):
                names.append(e)
        for kinds, share in (((NAMED, HINT), 2), ((NAMED,), 1)):
            taken: dict = {}
            flags = [False] * n
            for e in names:
                flags[e] = kind[e] in kinds
            below = self._below(flags)
            for e in names:
                if flags[e] and not below[parent[e]]:
                    taken[region[e]] = taken.get(region[e], 0) + size[e]
            full = {r for r, x in taken.items() if x and share * x >= whole[r]}
            names = [e for e in names if region[e] not in full or share == 2 and kind[e] == NAMED]
        flags = [False] * n
        for e in names:
            flags[e] = True
        return [g or b for g, b in zip(gone, self._below(flags))]

    def _close(self, stack, tags, stop) -> None:
        for k in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[k]]
            if t in tags:
                self.pieces.append((stack[k], " " if t in ("td", "th") else None))
                del stack[k:]
                return
            if t in stop:
                return

    def content(self) -> list[bool]:
        """Which elements belong to the content: within an article of main, else main, else articles, else anywhere."""
        n = len(self.tag)
        within = self._below([t == "main" and not d for t, d in zip(self.tag, self.drop)])
        if any(t == "article" and w and not d for t, w, d in zip(self.tag, within, self.drop)):
            return self._below([t == "article" and w and not d for t, w, d in zip(self.tag, within, self.drop)])
        for want in ("main", "article"):
            if any(t == want and not d for t, d in zip(self.tag, self.drop)):
                inside = [False] * n
                for e in range(1, n):
                    inside[e] = inside[self.parent[e]] or (self.tag[e] == want and not self.drop[e])
                return inside
        return [True] * n

    def template_hashes(self) -> tuple[dict[int, int], int]:
        """(element -> 64-bit hash of its subtree, for kept elements that may be furniture; hash of the whole content)."""
        inside = self.content()
        n = len(self.tag)
        parts: list = [[] for _ in range(n)]
        for e, text in self.pieces:
            if text and not self.drop[e]:
                t = " ".join(text.split())
                if t:
                    parts[e].append(t)
        size = [sum(map(len, own)) for own in parts]
        out, tops, total = {}, [], 0
        in_prose = self._below([t in PARAGRAPHS for t in self.tag])
        for e in range(n - 1, 0, -1):
            if self.drop[e] or not inside[e]:
                continue
            h = _hash([self.tag[e], *parts[e]])
            up = self.parent[e]
            parts[up].append(f"\x01{h:x}")
            size[up] += size[e]
            if not inside[up]:
                tops.append(f"{h:x}")
                total += size[e]
            prose = self.root[e] and (in_prose[e] or self.tag[e] in PROSE or self.tag[e] in ("main", "article"))
            if size[e] and not prose and self.tag[e] not in ("html", "body", "#page"):
                out[e] = h
        if inside[0]:
            tops, total = parts[0], size[0]
        return {e: h for e, h in out.items() if 2 * size[e] < total}, _hash(tops)

    def text(self, templates=frozenset()) -> str:
        """Blocks joined by a line feed; elements whose subtree hash is in ``templates`` are left out."""
        inside = self.content()
        drop = self.drop
        if templates:
            gone = {e for e, h in self.template_hashes()[0].items() if h in templates}
            if gone:
                drop = list(drop)
                for e in range(1, len(drop)):
                    drop[e] = drop[e] or e in gone or drop[self.parent[e]]
        blocks: list[str] = []
        open_: list[str] = []

        def close():
            if open_:
                t = " ".join(_html.unescape("".join(open_)).split()) if any("&" in x for x in open_) else " ".join("".join(open_).split())
                if t:
                    blocks.append(t)
                open_.clear()

        for e, piece in self.pieces:
            if piece is None:
                close()
            elif inside[e] and not drop[e]:
                open_.append(piece)
        close()
        return "\n".join(blocks)


def host_of(url) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _subtrees():
    """Each host's distinct pages of a batch: hash of the content, hashes of the subtrees."""
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            seen: dict = {}
            for url, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if source:
                    hashes, page = Page(source).template_hashes()
                    if hashes:
                        seen[host_of(url), page] = list(set(hashes.values()))
            yield table(schema, host=[h for h, _ in seen], page=[x for _, x in seen], hashes=list(seen.values()))

    return run, "host string, page long, hashes array<long>"


def site_templates(pages: DataFrame, min_pages: int = 5) -> DataFrame:
    """(host, hash) of subtrees that recur across a host's distinct pages."""
    run, out = _subtrees()
    distinct = pages.select("url", "html").mapInArrow(run, out).dropDuplicates(["host", "page"])
    counts = distinct.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_pages).select("host", "hash")


def _extracted(templates_of):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in batches:
            texts = []
            for url, source, own in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                texts.append(Page(source).text(templates_of(url, own)) if source else "")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             schema=schema)

    return run, "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, min_pages: int = 5) -> DataFrame:
    """(page_id, url, text, n_chars) of every page (page_id, url, html)."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    found = materialize(site_templates(pages, min_pages))
    if found.count() <= MAX_SHARED:
        by: dict = {}
        for r in found.collect():
            by.setdefault(r["host"], set()).add(r["hash"])
        shared = spark.sparkContext.broadcast(by)
        run, out = _extracted(lambda url, own: shared.value.get(host_of(url), frozenset()))
        return pages.withColumn("own", F.lit(None).cast("array<long>")).mapInArrow(run, out)
    return _extract_joined(pages, found)


def _extract_joined(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Each page meets its own templates by a join; for very many sites."""
    schema = pa.schema([("k", pa.int64()), ("host", pa.string()), ("hash", pa.int64())])

    def run(batches):
        for b in batches:
            rows = [(k, host_of(u), h) for k, u, s in zip(*(c.to_pylist() for c in b.columns)) if s
                    for h in set(Page(s).template_hashes()[0].values())]
            yield table(schema, **dict(zip(schema.names, zip(*rows) if rows else [[], [], []])))

    pages = pages.withColumn("_k", F.xxhash64("page_id", "url", "html"))
    own = (pages.select("_k", "url", "html").mapInArrow(run, "k long, host string, hash long").join(found, ["host", "hash"])
           .groupBy("k").agg(F.collect_set("hash").alias("own")))
    run2, out = _extracted(lambda url, own: frozenset(own or ()))
    return (pages.join(own, pages["_k"] == own["k"], "left").select("page_id", "url", "html", "own").mapInArrow(run2, out))
