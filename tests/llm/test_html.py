"""HTML extraction: hand-made pages, and a slow extractor over a tree of elements for all pages."""

import re
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from logweave.llm import html_extract as H

ARTICLE = "<p>" + "The article has many plain words to read. " * 12 + "</p>"
TEXT = " ".join(("The article has many plain words to read. " * 12).split())


def read(source):
    page = H.Page(source)
    return page.text(page.best())


@pytest.mark.parametrize("classes", ["entry-content no-sidebar", "post ad-free", "article overflow-hidden", "has-sidebar layout", "post type-post category-advertising tag-social"])
def test_compound_classes_that_mark_nothing(classes):
    assert read(f'<body><div class="{classes}">{ARTICLE}</div></body>') == TEXT


@pytest.mark.parametrize(
    "inner, want",
    [
        ('<div class="overflow-hidden"><p>kept</p></div>', "kept"), ("<svg class='i'/><p>kept</p>", "kept"), ('<svg-icon name="x"></svg-icon><p>kept</p>', "kept"),
        ("<style-tip><p>kept</p></style-tip>", "kept"), ("<svg><title>t</title><text>x</text></svg><p>kept</p>", "kept"), ('<p title="display: none" aria-hidden="true">kept</p>', "kept"),
        ("<p hidden>gone</p>", ""), ('<p style="color:red; display : none">gone</p>', ""), ('<div class="comments"><article class="comment-body"><p>gone</p></article></div>', ""),
        ('<div id="disqus_thread"><p>gone</p></div>', ""), ('<div class="ad"><article><p>gone</p></article></div>', ""), ('<div class="cookie-notice"><p>gone</p></div>', ""),
        ('<div class="adSlot"><p>gone</p></div>', ""), ('<div role="complementary"><p>gone</p></div>', ""), ("<p>kept <span>in</span></span></p>", "kept in"),
        ("<p>kept&nbsp;&lt;b&gt;&#x41;</p", "kept <b>A"), ("<p>kept</p><scr", "kept"), ("<!--> --><p>kept</p><!-- <p>gone</p>", "-->\n\nkept"), ("<select><option>a</select><p>kept</p>", "kept"),
    ],
)
def test_inner_elements(inner, want):
    assert read(f"<body><article>{ARTICLE}{inner}") == "\n\n".join(x for x in (TEXT, want) if x)


def test_article_inside_layout_wrappers():
    for wrap in ('<form id="aspnet">', '<div class="header-fixed">', '<div class="sidebar-right page">', '<div class="search">'):
        assert read(f"<body>{wrap}<main>{ARTICLE}</main></body>") == TEXT
    for wrap in ("<aside>", "<nav>", '<div class="sidebar">', '<div class="comment-list">'):
        assert read(f"<body>{wrap}<article>{ARTICLE}</article></body>") == ""


class Node:
    def __init__(self, tag, attrs, up):
        self.tag, self.up, self.kids = tag, up, []
        classes, own, self.good, self.main = H.read_attributes(tag, " ".join(f'{k}="{v}"' if v is not None else k for k, v in attrs))
        outer = up.out if up else 0
        self.out = max(0 if self.main and outer == H.LAYOUT else outer, own, H.LEFT_OUT.get(tag, 0))
        self.path = (up.path if up else "") + (f"/{tag}{classes}" if tag in H.BLOCK else "")
        self.box = tag in H.CONTAINERS and not self.out


class Tree(HTMLParser):
    """A tree of elements, closed as browsers do for the elements that pages leave open."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.top = self.at = Node("", [], None)
        self.top.box = True
        self.feed(re.sub(r"<[a-zA-Z/!?][^<>]*\Z", "", source))
        self.close()

    def upto(self, tags, stop):
        n = self.at
        while n.up and n.tag not in tags:
            if stop(n.tag):
                return None
            n = n.up
        return n if n.up else None

    def handle_starttag(self, tag, attrs):
        if tag in H.BLOCK and (n := self.upto({"p"}, lambda t: t in H.BLOCK)):
            self.at = n.up
        while tag in H.CLOSES and (n := self.upto(H.CLOSES[tag], lambda t: t in H.BLOCK)):
            self.at = n.up
        n = Node(tag, attrs, self.at)
        self.at.kids.append(n)
        if tag not in H.VOID:
            self.at = n

    def handle_endtag(self, tag):
        inline = tag not in H.BLOCK and tag not in H.LEFT_OUT
        if n := self.upto({tag}, lambda t: inline and t in H.BLOCK):
            self.at = n.up

    def handle_data(self, data):
        if self.at.tag not in H.RAW.split("|"):
            self.at.kids.append(data)


def slow(source):
    """(containers as (score, order, path, blocks), in page order) of a page."""
    boxes, blocks, run = [], [], []  # run: (text, linked, box)

    def flush():
        text = " ".join("".join(t for t, _, _ in run).split())
        if text:
            worth = max(0, len(text) - 2 * sum(len(t) for t, linked, _ in run if linked))
            box = run[-1][2]
            box["own"] += worth
            if box["up"]:
                box["up"]["own"] += worth / 2
            blocks.append(text)
        run.clear()

    def walk(n, box, linked):
        is_block = n.tag in H.BLOCK
        if is_block:
            flush()
        if n.box:
            box = {"own": 0.0, "up": box, "path": n.path, "w": (1.5 if n.main else 1) * (1.25 if n.good else 1) * (0.8 if n.tag == "body" else 1) * (1 if n.up else 0.5), "from": len(blocks)}
            boxes.append(box)
        if n.tag == "br":
            run.append((" ", False, box))
        for k in n.kids:
            if isinstance(k, str):
                if not n.out:
                    run.append((k, linked or n.tag == "a", box))
            else:
                walk(k, box, (linked or n.tag == "a") and k.tag not in H.BLOCK)
        if is_block or n.up is None:
            flush()
        if n.box:
            box["to"] = len(blocks)

    walk(Tree(source).top, None, False)
    return [(b["own"] * b["w"], b["path"], "\n\n".join(blocks[b["from"] : b["to"]])) for b in boxes]


def choose(boxes, path=None):
    some = [b for b in boxes if path is None or b[1] == path]
    return max(some, key=lambda b: b[0], default=None)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_all_pages_agree_with_the_slow_extractor(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    host = {r["page_id"]: r["h"] for r in pages.select("page_id", H.host(F.col("url")).alias("h")).collect()}
    read_ = {r["page_id"]: slow(r["html"] or "") for r in pages.collect()}
    votes = {}
    for i, boxes in read_.items():
        b = choose(boxes)
        if b[0] > 0:
            n, s = votes.setdefault(host[i], {}).get(b[1], (0, 0))
            votes[host[i]][b[1]] = (n + 1, s + round(b[0]))
    winner = {h: min((-n, -s, p) for p, (n, s) in v.items())[2] for h, v in votes.items()}
    got = H.extract(pages).collect()
    assert len(got) == len(read_)
    for r in got:
        boxes = read_[r["page_id"]]
        b = choose(boxes, winner.get(host[r["page_id"]]))
        if b is None or b[0] <= 0:
            b = choose(boxes)
        assert (r["text"], r["n_chars"]) == (b[2], len(b[2])), r["page_id"]


def test_defined_results(spark):
    rows = [(1, "http://a.b/1", None), (2, None, f"<main>{ARTICLE}</main>"), (2, None, f"<main>{ARTICLE}</main>"), (None, "no url", ""), (4, "http://a.b/2", ARTICLE * 3000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1)).withColumn("winner", F.lit("x")).withColumn("text", F.lit("y"))
    got = Counter((r["page_id"], r["url"], r["n_chars"]) for r in H.extract(df).collect())
    assert got == Counter({(1, "http://a.b/1", 0): 1, (2, None, len(TEXT)): 2, (None, "no url", 0): 1, (4, "http://a.b/2", 3000 * (len(TEXT) + 2) - 2): 1})
    assert H.extract(df.limit(0)).count() == 0
