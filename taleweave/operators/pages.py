"""Elements of pages, readable text and links.

Each page is parsed once, in slices of Arrow batches, into its text and its elements; an element names its stretch of the text and of
the markup instead of repeating them, so a page costs its size and not its size times its depth. What is wanted is cut out
on demand; scoring, choosing and resolving are column work. Selectors are in taleweave.operators.selectors.

Elements are numbered in the order of their start tags (pos); last is the largest number inside, so that a holds b if
a.pos < b.pos <= a.last. parent is the number of the element around (-1: none), nth and after count the siblings up to and
behind it, nth_type and after_type those of its tag. Tags that a later one ends (a paragraph by a block, a list item by the
next) end there; formatting that was open is not taken up again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from taleweave.functions import markup
from taleweave.operators.slices import slices

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Start tags that end an open element, and the tags behind which that element is not looked for.
_BLOCKS = "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
ENDS = {t: ({"p"}, {"table", "td", "th", "button", "caption", "object"}) for t in _BLOCKS} | {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
NUMBERS = ("pos", "last", "parent", "nth", "after", "nth_type", "after_type", "text_at", "text_end", "links", "html_at", "html_end")
ELEMENT = "struct<" + ", ".join(f"{n}: int" for n in NUMBERS) + ", tag: string, attrs: map<string,string>>"


class _Elements(HTMLParser):
    """All elements of a page, as lists of NUMBERS with the tag and the attributes behind them, and the page's text."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.lines, self.open, self.found, self.parts = [0], [], [], []
        self.tags, self.size, self.linked = Counter(), 0, 0
        self.children: dict[int, Counter] = {-1: Counter()}
        for line in html.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(html)
        self.close()
        while self.open:
            self._shut(len(html))
        self.text = "".join(self.parts)
        for e in self.found:
            own = self.children[e[2]]
            e[4], e[6] = own[None] - e[3], own[e[-2]] - e[5]

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _shut(self, end: int) -> None:
        e = self.open.pop()
        self.tags[e[-2]] -= 1
        e[1], e[8], e[9], e[11] = len(self.found) - 1, self.size, self.linked - e[9], max(end, e[10])

    def handle_starttag(self, tag, attrs) -> None:
        closed, scope = ENDS.get(tag, ((), ()))
        if any(self.tags[t] for t in closed):
            depth = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][-2] in scope), -1)
            first = next((k for k in range(depth + 1, len(self.open)) if self.open[k][-2] in closed), len(self.open))
            while len(self.open) > first:
                self._shut(self._at())
        pos, parent = len(self.found), self.open[-1][0] if self.open else -1
        own = self.children[parent]
        own[None] += 1
        own[tag] += 1
        inner = self._at() + len(self.get_starttag_text() or "")
        named: dict[str, str] = {}
        for k, v in attrs:
            named.setdefault(k, v or "")
        self.found.append([pos, pos, parent, own[None], 0, own[tag], 0, self.size, self.size, self.linked, inner, inner, tag, named])
        if tag in VOID:
            self.found[-1][9] = 0
        else:
            self.children[pos] = Counter()
            self.open.append(self.found[-1])
            self.tags[tag] += 1

    def handle_endtag(self, tag) -> None:
        if self.tags[tag]:
            while self.open[-1][-2] != tag:
                self._shut(self._at())
            self._shut(self._at())

    def handle_data(self, data) -> None:
        self.parts.append(data)
        self.size += len(data)
        self.linked += len(data) if self.tags["a"] else 0


_KIND = pa.struct([(n, pa.int32()) for n in NUMBERS] + [("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        done = [_Elements(h or "") for h in batch.column(1).to_pylist()]
        flat = [e for d in done for e in d.found]
        columns = [pa.array([e[k] for e in flat], pa.int32()) for k in range(len(NUMBERS))]
        columns += [pa.array([e[-2] for e in flat], pa.string()), pa.array([list(e[-1].items()) for e in flat], _KIND.field("attrs").type)]
        starts = [0]
        for d in done:
            starts.append(starts[-1] + len(d.found))
        found = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_KIND)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([d.text for d in done], pa.string()), found], names=["page_id", "html", "text", "found"])


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, html, text (of the whole page) and found (its elements, see ELEMENT) of pages (page_id, html). Null and
    empty pages have no elements."""
    return pages.select("page_id", "html").mapInArrow(_parse, f"page_id long, html string, text string, found array<{ELEMENT}>")


def cut(whole: Column, at: Column, end: Column) -> Column:
    """Characters at .. end - 1."""
    return whole.substr(at + 1, end - at)


def elements(read: DataFrame) -> DataFrame:
    """page_id and the numbers, tag and attrs of every element of parsed() pages."""
    return read.select("page_id", F.inline("found"))


def tagged(read: DataFrame, *tags: str) -> DataFrame:
    """page_id, pos, attrs, text and html (inner markup) of the elements of some tags, in parsed() pages."""
    e = read.select("page_id", F.col("text").alias("whole"), F.col("html").alias("markup"), F.filter("found", lambda e: e["tag"].isin(*tags)).alias("found"))
    each = F.transform("found", lambda e: F.struct(e["pos"].alias("pos"), e["tag"].alias("tag"), e["attrs"].alias("attrs"), cut(F.col("whole"), e["text_at"], e["text_end"]).alias("text"), cut(F.col("markup"), e["html_at"], e["html_end"]).alias("html")))
    return e.select("page_id", F.inline(each))


_PLACES = ("pos", "attrs", "text_at", "text_end", "html_at", "html_end")


def contents(hits: DataFrame, read: DataFrame) -> DataFrame:
    """page_id, pos, attrs, text (squeezed) and html of found elements: a page's hits meet its row once. hits: rows of
    elements()."""
    own = hits.groupBy("page_id").agg(F.collect_list(F.struct(*_PLACES)).alias("hits"))
    met = read.select("page_id", F.col("text").alias("whole"), F.col("html").alias("markup")).join(own, "page_id")
    each = F.transform("hits", lambda e: F.struct(e["pos"].alias("pos"), e["attrs"].alias("attrs"), markup.squeeze(cut(F.col("whole"), e["text_at"], e["text_end"])).alias("text"), cut(F.col("markup"), e["html_at"], e["html_end"]).alias("html")))
    return met.select("page_id", F.inline(each))


def firsts(hits: DataFrame) -> DataFrame:
    """The first hit of each page, with what contents() needs."""
    return hits.groupBy("page_id").agg(F.min_by(F.struct(*_PLACES), "pos").alias("first")).select("page_id", "first.*")


def readable(read: DataFrame) -> DataFrame:
    """page_id, title, text of parsed() pages: the prose of the best container. Candidates count their characters less three
    times those in links; the last of the best wins; the title is the first h1, else the title element."""
    has = lambda e, a, p: F.coalesce(F.contains(F.element_at(e["attrs"], F.lit(a)), F.lit(p)), F.lit(False))

    def kind(e: Column) -> Column:
        return (
            F.when(e["tag"] == "article", 0).when(e["tag"] == "main", 1).when((e["tag"] == "div") & has(e, "id", "content"), 2)
            .when((e["tag"] == "div") & has(e, "class", "content"), 3).when((e["tag"] == "div") & has(e, "class", "chapter"), 4).when(e["tag"] == "body", 5)
        )

    text_of = lambda e: cut(F.col("text"), e["text_at"], e["text_end"])
    usable = F.filter("found", lambda e: kind(e).isNotNull() & (markup.squeeze(text_of(e)) != ""))
    scored = F.transform(usable, lambda e: F.struct(F.greatest(e["text_end"] - e["text_at"] - 3 * e["links"], F.lit(0)).alias("score"), kind(e).alias("kind"), e["pos"].alias("pos"), e["html_at"].alias("at"), e["html_end"].alias("end")))
    titles = F.transform(F.filter("found", lambda e: e["tag"].isin("h1", "title")), lambda e: F.struct(e["tag"].alias("tag"), e["pos"].alias("pos"), text_of(e).alias("text")))
    best = read.select("page_id", F.array_min(titles)["text"].alias("title"), F.array_max(scored).alias("best"), "html")
    html = F.coalesce(cut(F.col("html"), F.col("best.at"), F.col("best.end")), F.lit(""))
    return best.select("page_id", markup.squeeze(F.coalesce("title", F.lit(""))).alias("title"), markup.squeeze_lines(markup.prose(markup.text_of(html))).alias("text"))


@F.pandas_udf(StringType())
def absolute(base: pd.Series, href: pd.Series) -> pd.Series:
    """href against the page it was found on; nothing stays nothing, and what cannot be resolved stays as it is."""

    def resolve(b: str | None, h: str | None) -> str:
        h = (h or "").strip()
        try:
            return urljoin(b or "", h) if h else ""
        except ValueError:
            return h

    return pd.Series([resolve(b, h) for b, h in zip(base, href, strict=True)])


def listing(pages: DataFrame) -> DataFrame:
    """n, url, title per page: its links in order, as a table of contents has them."""
    links = tagged(parsed(pages), "a").join(pages.select("page_id", "url"), "page_id")
    links = links.withColumn("href", absolute(F.col("url"), F.element_at("attrs", F.lit("href")))).where("href <> ''")
    n = F.row_number().over(W.partitionBy("page_id").orderBy("pos"))
    return links.select("page_id", n.alias("n"), F.col("href").alias("url"), markup.squeeze(F.col("text")).alias("title"))
