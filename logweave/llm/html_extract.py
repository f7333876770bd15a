"""Main text of web pages by consensus paths per host.

A page is read once into containers (body, main, article, section, div, td) and blocks of text.
Each container gets a score: the unlinked text of its own blocks, half of its children's,
weighted by what its tag and classes say. A container's generalised path is the tags from the
root with their classes, digits written as #. Every page votes for the path of its best
container; votes are counted per host (partial counts, so a host with any share of the pages is
combined before the shuffle), and each page is read again with its host's winning path, or its
own best container where the page has no such path.

Boilerplate elements are left out within the winner too. They are told by tag (navigation,
headers, footers, asides, forms, media), by the `hidden` attribute or a style that hides, by
role, and by the tokens of class and id. A token that is a mark as a whole ("sidebar", "comments")
always counts; a compound whose first or last word is one ("site-footer", "comment-list") counts
unless another token names content ("entry-content"); compounds that only describe a state
("no-sidebar", "ad-free", "overflow-hidden", "category-social") never do. An `article` or `main`
inside a form or a marked layout wrapper is read all the same, but never inside comments, adverts,
side columns or the boilerplate tags.

Defined results: null html counts as empty and gives an empty text; pages without a host vote
among themselves; repeated rows vote each and are each returned; among equal votes the larger
score, then the smaller path wins; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

CONTAINERS = {"body", "main", "article", "section", "div", "td"}
BLOCK = CONTAINERS | {
    "address", "blockquote", "center", "dd", "details", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "nav", "ol", "p", "pre", "summary", "table", "tbody", "tfoot", "th", "thead", "tr", "ul", "aside", "menu", "dialog",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements without main text; what may wrap a whole page is LAYOUT (1), the others are OUT (2).
LAYOUT, OUT = 1, 2
LEFT_OUT = dict.fromkeys(
    "nav header footer aside button menu dialog object canvas audio video map label select noscript template svg math".split(), OUT
) | {"form": LAYOUT, "fieldset": LAYOUT}
#: Elements whose content is no markup.
RAW = "script|style|title|textarea|iframe|noembed|noframes"
#: Words that mark boilerplate: reader comments and adverts, side columns, layout.
FOREIGN = set("comment comments reply replies disqus respond ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsors sponsored promo promos promotion".split())
SIDE = set("sidebar sidebars related recommended recommendations complementary".split())
FRAME = set(
    "banner cookie cookies consent notice notices gdpr menu nav navbar navigation breadcrumb breadcrumbs share sharing social newsletter subscribe "
    "signup login popup modal overlay footer header masthead toolbar pager pagination copyright skip search contentinfo tags".split()
)
MARKS = FOREIGN | SIDE | FRAME
#: Marks as a whole token only.
ALONE = {"widget", "widgets", "side", "alert", "dialog", "form"}
#: First and last words of compounds that describe a state or a subject, not the element.
STATES = set("no non not without has have with is are hide show js overflow category tag topic type status format term tax".split())
QUALITIES = set("free less open closed enabled disabled active fixed sticky visible".split())
GOOD = set("article content post entry story text main body maincontent".split())
#: Elements that the start of a tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|(?=<body[\s>])|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_DIGITS = re.compile(r"\d+")
_WORTH_READING = re.compile(r"class|id\b|role|hidden|style", re.IGNORECASE)


@lru_cache(1 << 14)
def token_kind(token: str) -> tuple[str, str]:
    """What a class, id or role says: ("whole" or "part", its family of marks), ("good", ""), or ("", "")."""
    words = [w.lower() for w in _WORDS.findall(token)]
    if not words or words[0] in STATES and len(words) > 1 or words[-1] in QUALITIES:
        return "", ""
    for w in (words[0], words[-1]):
        if w in MARKS or len(words) == 1 and w in ALONE:
            return "whole" if len(words) == 1 else "part", "foreign" if w in FOREIGN else "side" if w in SIDE else "frame"
    return ("good", "") if words[-1] in GOOD else ("", "")


def read_attributes(tag: str, attrs: str) -> tuple[str, int, bool, bool]:
    """(generalised classes, 0 or how far it is left out, names content, is the main element)."""
    main = tag in ("article", "main")
    if not _WORTH_READING.search(attrs):
        return "", 0, False, main
    classes, kinds, hidden = "", set(), False
    for name, a, b, c in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "class":
            classes = "".join("." + _DIGITS.sub("#", x) for x in sorted(value.lower().split()))
        if name in ("class", "id", "role"):
            kinds.update(map(token_kind, value.split()))
            main = main or (name == "role" and value.strip().lower() in ("main", "article"))
        elif name == "hidden":
            hidden = value.lower() not in ("false", "until-found")
        elif name == "style":
            hidden = hidden or bool(_HIDING.search(value))
    good = ("good", "") in kinds
    whole, part = ({f for k, f in kinds if k == x} for x in ("whole", "part"))
    if hidden:
        return classes, OUT, good, main
    if main or tag in ("html", "body"):
        # the main element is left out only as a comment or an advert
        return classes, OUT * (tag not in ("html", "body") and "foreign" in (whole if good else whole | part)), good, main
    if whole & {"foreign", "side"} or "foreign" in part and not good:
        return classes, OUT, good, main
    return classes, LAYOUT if whole or part and not good else 0, good, main


class Page:
    """Containers and blocks of a page."""

    def __init__(self, source: str | None):
        self.blocks: list[str] = []
        self.paths: list[str] = []
        self.scores: list[float] = []
        self.weights: list[float] = []
        self.spans: list[list[int]] = []
        self._read(source or "")

    def _open(self, path: str, weight: float) -> int:
        self.paths.append(path)
        self.scores.append(0.0)
        self.weights.append(weight)
        self.spans.append([len(self.blocks), -1])
        return len(self.paths) - 1

    def _read(self, source: str) -> None:
        # an element: tag, its path, its container (or that around it), left out, is it a container itself
        root = self._open("", 0.5)
        stack: list[tuple[str, str, int, int, bool]] = [("", "", root, 0, True)]
        parents = {root: -1}
        buf: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal linked
            if buf:
                text = " ".join("".join(buf).split())
                if text:
                    self.blocks.append(text)
                    own = stack[-1][2]
                    worth = max(0, len(text) - 2 * linked)
                    self.scores[own] += worth
                    if parents[own] >= 0:
                        self.scores[parents[own]] += worth / 2
                buf.clear()
            linked = 0

        def pop() -> None:
            _, _, node, _, is_container = stack.pop()
            if is_container:
                self.spans[node][1] = len(self.blocks)

        links = 0
        for m in _TOKEN.finditer(source):
            text = m["text"]
            if text is not None:
                if not stack[-1][3]:
                    if "&" in text:
                        text = html.unescape(text)
                    buf.append(text)
                    if links:
                        linked += len(text)
                continue
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "br":
                buf.append(" ")
                continue
            if m["end"]:
                if tag == "a":
                    links = 0
                # the end of an inline element does not reach beyond the block around it
                k = len(stack) - 1
                while k and stack[k][0] != tag and (tag in BLOCK or tag in LEFT_OUT or stack[k][0] not in BLOCK):
                    k -= 1
                if k == 0 or stack[k][0] != tag:
                    continue
                if tag in BLOCK:
                    flush()
                while len(stack) > k:
                    pop()
                continue
            if tag == "a":
                links = 1
            if tag in BLOCK:
                flush()
                links = 0
                if any(e[0] == "p" for e in stack[-8:]):
                    # a block closes an open paragraph, if nothing but inline elements lies between
                    k = len(stack) - 1
                    while stack[k][0] not in BLOCK and k:
                        k -= 1
                    if stack[k][0] == "p":
                        while len(stack) > k:
                            pop()
            if tag in CLOSES:
                k = len(stack) - 1
                while k and (stack[k][0] not in BLOCK or stack[k][0] in CLOSES[tag]):
                    if stack[k][0] in CLOSES[tag]:
                        while len(stack) > k:
                            pop()
                    k -= 1
            if tag in VOID:
                continue
            attrs = m["attrs"]
            if attrs.endswith("/") and tag not in BLOCK:
                continue
            classes, own_out, good, main = read_attributes(tag, attrs) if attrs else ("", 0, False, tag in ("article", "main"))
            _, path, node, out, _ = stack[-1]
            if main and out == LAYOUT:
                out = 0
            out = max(out, own_out, LEFT_OUT.get(tag, 0))
            if tag in BLOCK:
                path = f"{path}/{tag}{classes}"
            inner, is_container = node, tag in CONTAINERS and not out
            if is_container:
                inner = self._open(path, (1.5 if main else 1.0) * (1.25 if good else 1.0) * (0.8 if tag == "body" else 1.0))
                parents[inner] = node
            stack.append((tag, path, inner, out, is_container))
        flush()
        while stack:
            pop()

    def best(self, path: str | None = None) -> int | None:
        """The container with the best score, among those of a path if given."""
        some = [i for i in range(len(self.paths)) if path is None or self.paths[i] == path]
        return max(some, key=lambda i: (self.scores[i] * self.weights[i], -i), default=None)

    def score(self, i: int) -> float:
        return self.scores[i] * self.weights[i]

    def text(self, i: int) -> str:
        a, b = self.spans[i]
        return "\n\n".join(self.blocks[a:b])


def host(url):
    """Host of a URL, lower-cased, without port and credentials; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, score): every page's vote."""

    def run(batches):
        for pdf in batches:
            rows = []
            for h, source in zip(pdf["host"], pdf["html"]):
                page = Page(source)
                i = page.best()
                if page.score(i) > 0:
                    rows.append((h, page.paths[i], page.score(i)))
            yield pd.DataFrame(rows, columns=["host", "path", "score"])

    return pages.select(host(F.col("url")).alias("host"), "html").mapInPandas(run, "host string, path string, score double")


def consensus(pages: DataFrame) -> DataFrame:
    """(host, winner): the path with the most votes of each host."""
    counted = votes(pages).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("score")).alias("score"))
    # max takes the largest struct; of equal counts and scores the smaller path must win
    ranked = counted.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("s"), "path")).alias("top"))
    return ranked.select("host", F.col("top.path").alias("winner"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    winners = materialize(consensus(own), "winners")
    joined = own.withColumn("host", host(F.col("url"))).join(winners, "host", "left").select("page_id", "url", "html", "winner")

    def run(batches):
        for pdf in batches:
            out = []
            for source, winner in zip(pdf["html"], pdf["winner"]):
                page = Page(source)
                i = page.best(winner) if isinstance(winner, str) else None
                if i is None or page.score(i) <= 0:
                    i = page.best()
                out.append(page.text(i))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": out, "n_chars": [len(t) for t in out]})

    return joined.mapInPandas(run, "page_id long, url string, text string, n_chars long")
