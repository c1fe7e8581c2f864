"""Selectors against a walk over the tree, node by node."""

import random

import pytest
from pyspark.sql import functions as F

from taleweave.operators import pages as pg
from taleweave.operators import selectors as sel

PAGE = """<html><head><title>Book index</title></head><body>
<nav><a href="/start">Start</a><a href="/end">End</a></nav>
<article class="chapter">
  <h1>Chương 34: Bí ẩn</h1>
  <div class="body"><p>Hắn bước vào phòng.</p>
<p>Cánh cửa kêu một tiếng.</p></div>
</article>
<div id="content-list">
  <a href="chuong-1">Chương 1</a><a href="/truyen/x/chuong-2">Chương 2</a><a href="https://other.example/c3">Chương 3</a>
</div></body></html>"""


def frame(spark, *html):
    return spark.createDataFrame([(k, h) for k, h in enumerate(html)], "page_id long, html string")


class Node:
    def __init__(self, row, above):
        self.row, self.tag, self.attrs, self.above, self.children = row, row.tag, row.attrs, above, []

    @property
    def siblings(self):
        return self.above.children if self.above else [self]

    def before(self):
        return self.siblings[: self.siblings.index(self)]

    def around(self):
        return [self.above, *self.above.around()] if self.above else []


def tree(rows):
    nodes = {}
    for r in sorted(rows, key=lambda r: r.pos):
        n = nodes[r.pos] = Node(r, nodes.get(r.parent))
        if n.above:
            n.above.children.append(n)
    return list(nodes.values())


def has(n, c):
    return c in n.attrs.get("class", "").split()


def same(n):
    return [x for x in n.siblings if x.tag == n.tag]


WALKS = {
    "div": lambda n: n.tag == "div",
    "*": lambda n: True,
    "div p": lambda n: n.tag == "p" and any(a.tag == "div" for a in n.around()),
    "div > p": lambda n: n.tag == "p" and n.above is not None and n.above.tag == "div",
    "p + p": lambda n: n.tag == "p" and bool(n.before()) and n.before()[-1].tag == "p",
    "b~i": lambda n: n.tag == "i" and any(x.tag == "b" for x in n.before()),
    ".x": lambda n: has(n, "x"),
    "p.x.y": lambda n: n.tag == "p" and has(n, "x") and has(n, "y"),
    "#k1 b": lambda n: n.tag == "b" and any(a.attrs.get("id") == "k1" for a in n.around()),
    "div.x > div b, i": lambda n: n.tag == "i" or n.tag == "b" and any(a.tag == "div" and a.above is not None and a.above.tag == "div" and has(a.above, "x") for a in n.around()),
    "div div > p": lambda n: n.tag == "p" and n.above is not None and n.above.tag == "div" and any(a.tag == "div" for a in n.above.around()),
    "p ~ div b + i": lambda n: n.tag == "i" and bool(n.before()) and n.before()[-1].tag == "b" and any(a.tag == "div" and any(x.tag == "p" for x in a.before()) for a in n.around()),
    "[data]": lambda n: "data" in n.attrs,
    "[data='v w']": lambda n: n.attrs.get("data") == "v w",
    "[data~=w]": lambda n: "w" in n.attrs.get("data", "").split(),
    "[data|=v]": lambda n: n.attrs.get("data", "") == "v" or n.attrs.get("data", "").startswith("v-"),
    "[data^=v]": lambda n: n.attrs.get("data", "").startswith("v"),
    "[data$=W i]": lambda n: n.attrs.get("data", "").lower().endswith("w"),
    "[data*='']": lambda n: False,
    ":first-child": lambda n: n.siblings[0] is n,
    "b:last-child": lambda n: n.tag == "b" and n.siblings[-1] is n,
    ":only-child": lambda n: len(n.siblings) == 1,
    "p:nth-child(2n)": lambda n: n.tag == "p" and (len(n.before()) + 1) % 2 == 0,
    ":nth-child(-n+2)": lambda n: len(n.before()) < 2,
    ":nth-last-child(2)": lambda n: n.siblings[::-1].index(n) == 1,
    "p:first-of-type": lambda n: n.tag == "p" and same(n)[0] is n,
    ":last-of-type": lambda n: same(n)[-1] is n,
    ":nth-of-type(odd)": lambda n: same(n).index(n) % 2 == 0,
    ":not(p):not(.x, b)": lambda n: n.tag not in ("p", "b") and not has(n, "x"),
    ":is(p, b):empty": lambda n: n.tag in ("p", "b") and not n.children and n.row.text_at == n.row.text_end,
    ":root > body > :not(:empty)": lambda n: n.above is not None and n.above.tag == "body" and (bool(n.children) or n.row.text_at < n.row.text_end),
}


def some_page(r):
    def part(depth):
        tag = r.choice(["div", "div", "p", "b", "i", "section"])
        attrs = "".join(x for x in (r.choice(["", "", ' class="x"', ' class="y x"', " class=y"]), r.choice(["", "", ' id="k1"']), r.choice(["", "", ' data="v w"', " data=v-1", ' data="V"', " data"])))
        inside = "".join(r.choice(["text ", "", "&amp; "]) + part(depth + 1) for _ in range(r.randint(0, 3 if depth < 4 else 0)))
        return f"<{tag}{attrs}>{inside}{r.choice(['', 'end'])}</{tag}>"

    return "<html><body>" + "".join(part(0) for _ in range(r.randint(1, 4))) + "</body></html>"


def test_selectors_against_tree_walks(spark):
    r = random.Random(5)
    found = pg.elements(pg.parsed(frame(spark, *[some_page(r) for _ in range(40)]))).cache()
    by_page = {}
    for row in found.collect():
        by_page.setdefault(row.page_id, []).append(row)
    trees = {p: tree(rows) for p, rows in by_page.items()}
    assert sum(map(len, trees.values())) > 500
    wrong, met = {}, 0
    for selector, walk in WALKS.items():
        got = sorted((x.page_id, x.pos) for x in sel.matched(found, selector).select("page_id", "pos").collect())
        want = sorted((p, n.row.pos) for p, nodes in trees.items() for n in nodes if walk(n))
        met += bool(want)
        if got != want:
            wrong[selector] = (len(got), len(want))
    assert not wrong and met >= len(WALKS) - 2


def test_numbers_and_stretches(spark):
    read = pg.parsed(frame(spark, PAGE, None, "", "no tags", "<p>a<p>b<div>c</div>", "<ul><li>1<li>2<ul><li>3</ul></ul>", "<b>open <i>x</b> y"))
    rows = pg.elements(read).collect()
    assert {r.page_id for r in rows} == {0, 4, 5, 6}
    assert [(r.tag, r.parent, r.nth, r.after) for r in sorted(rows, key=lambda r: r.pos) if r.page_id == 4] == [("p", -1, 1, 2), ("p", -1, 2, 1), ("div", -1, 3, 0)]
    assert [(r.pos, r.parent, r.last) for r in sorted(rows, key=lambda r: r.pos) if r.page_id == 5] == [(0, -1, 4), (1, 0, 1), (2, 0, 4), (3, 2, 4), (4, 3, 4)]
    cut = {(r.page_id, r.tag): (r.text, r.html) for r in pg.tagged(read, "article", "b", "i", "a").collect()}
    assert cut[6, "b"] == ("open x", "open <i>x") and cut[6, "i"] == ("x", "x")
    assert cut[0, "article"][1].startswith("\n  <h1>")


def test_first_and_all(spark):
    read = pg.parsed(frame(spark, PAGE))
    first = lambda s: sel.first_text(read, s).first().text
    assert first("h1") == "Chương 34: Bí ẩn"
    assert first(".body p") == "Hắn bước vào phòng."
    assert first("table td") == "" and first("nav a.never") == "" and first("a[href") == "Start"
    assert first("article") == "Chương 34: Bí ẩn Hắn bước vào phòng. Cánh cửa kêu một tiếng."
    links = sorted(pg.contents(sel.matched(pg.elements(read), "div#content-list a"), read).collect(), key=lambda r: r.pos)
    assert [(x.text, x.attrs["href"]) for x in links] == [("Chương 1", "chuong-1"), ("Chương 2", "/truyen/x/chuong-2"), ("Chương 3", "https://other.example/c3")]


@pytest.mark.parametrize("bad", ["", ",", "a,", "a >", "p:unknown", "::", "a:not(b c)", "p:nth-child(x)", "&"])
def test_not_selectors(bad):
    with pytest.raises(ValueError):
        sel.compiled(bad)


def test_a_deep_page_is_not_repeated(spark):
    """Text and markup are kept once, however deep the elements lie."""
    deep = "<div>" * 3_000 + "x" * 2_000 + "</div>" * 3_000
    read = pg.parsed(frame(spark, deep))
    assert read.select(F.length("text")).first()[0] == 2_000
    assert pg.elements(read).where("text_end - text_at = 2000").count() == 3_000
    assert sel.matched(pg.elements(read), "div div > div:empty").count() == 0


def test_references_in_headlines_are_read_as_html5_has_them(spark):
    """A reference that a tag ends without its semicolon is one, and so is a quotation mark (F4 to F7 of round 4)."""
    pages = pg.parsed(frame(spark, "<article><h1>Ly.&amp;&amp; and&amp</h1><p>x</p></article>", "<article><h1>token = &quot;0b96</h1><p>x</p></article>"))
    want = ["Ly.&& and&", 'token = "0b96']
    assert [r.text for r in sel.first_text(pages, "article h1").orderBy("page_id").collect()] == want
    assert [r.title for r in pg.readable(pages).orderBy("page_id").collect()] == want
