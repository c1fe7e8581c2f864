"""Following links against a breadth-first walk in plain Python."""

import random

from pyspark.sql import functions as F

from taleweave.operators import discover as dis
from taleweave.plans import chapters


def breadth_first(pages, links, entries, budget=None):
    to, seen, taken, now, turn = {}, {}, {}, sorted(set(entries)), 0
    for a, b in links:
        to.setdefault(a, set()).add(b)
    while now:
        new = []
        for u in sorted(x for x in now if x in pages and x not in seen):
            if budget is None or taken.get(pages[u], 0) < budget:
                taken[pages[u]] = taken.get(pages[u], 0) + 1
                seen[u] = (pages[u], turn)
                new.append(u)
        now = sorted({b for u in new for b in to.get(u, ())})
        turn += 1
    return sorted((u, h, t) for u, (h, t) in seen.items())


def frames(spark, pages, links, entries):
    return spark.createDataFrame(list(pages.items()), "url string, host string"), spark.createDataFrame(links, "url string, to string"), spark.createDataFrame([(e,) for e in entries], "url string")


def test_reachable_with_and_without_budget(spark):
    r = random.Random(3)
    pages = {f"u{k:03d}": f"h{k % 5}" if k % 3 else "hot" for k in range(200)}
    links = [(f"u{r.randrange(200):03d}", f"u{r.randrange(230):03d}") for _ in range(260)] + [("u001", "u001"), ("u001", "u002"), ("u001", "u002")]
    entries = ["u001", "u010", "u010", "nowhere"]
    for budget in (None, 1, 7, 40):
        got = sorted(tuple(x) for x in dis.reachable(*frames(spark, pages, links, entries), budget=budget).collect())
        assert got == breadth_first(pages, links, entries, budget)
    assert dis.reachable(*frames(spark, pages, links, []), budget=3).count() == 0


def test_rounds_are_bounded(spark):
    chain = [(f"u{k}", f"u{k + 1}") for k in range(6)] + [("u6", "u0")]
    pages = {f"u{k}": None for k in range(7)}
    got = dis.reachable(*frames(spark, pages, chain, ["u2"])).collect()
    assert sorted((x.round, x.url) for x in got) == [(k, f"u{(k + 2) % 7}") for k in range(7)]
    assert dis.reachable(*frames(spark, pages, chain, ["u2"]), most_rounds=3).count() == 3


def test_budget_query_against_plain_walk(spark, data):
    hosts, entries = chapters._entries(spark, data)
    links = [(x.url, x.to) for x in chapters.site_links(spark, data).collect()]
    got = sorted(tuple(x) for x in chapters.discover_budget(spark, data).collect())
    assert got == breadth_first({x.url: x.host for x in hosts.collect()}, links, [x.url for x in entries.collect()], 8)


def test_listing_walks(spark):
    nexts = spark.createDataFrame([("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("b1", "b1"), ("c1", None)], "url string, next string")
    entries = spark.createDataFrame([("A", "a1"), ("A2", "a3"), ("B", "b1"), ("C", "c1"), ("D", "d1"), ("E", None)], "site string, url string")
    got = sorted((x.site, x.turn, x.url) for x in dis.walked(entries, nexts).collect())
    assert got == [("A", 0, "a1"), ("A", 1, "a2"), ("A", 2, "a3"), ("A2", 0, "a3"), ("A2", 1, "a1"), ("A2", 2, "a2"), ("B", 0, "b1"), ("C", 0, "c1"), ("D", 0, "d1")]
    assert dis.walked(entries, nexts, most=2).where("site = 'A'").count() == 2
    links = spark.createDataFrame([("a1", 0, "/c-1", "one"), ("a1", 1, "/c-2/", "two"), ("a2", 0, "/c-2/", "again"), ("a2", 1, "/about", "x"), ("a2", 2, "/v2/c-10.html", "ten"), ("a3", 0, "", "y")], "url string, pos int, to string, title string")
    found = dis.chapters(dis.walked(entries, nexts).where("site = 'A'"), links.withColumn("n", dis.trailing_number(F.col("to")))).orderBy("n").collect()
    assert [(x.n, x.url, x.title, x.total) for x in found] == [(1, "/c-1", "one", 10), (2, "/c-2/", "two", 10), (10, "/v2/c-10.html", "ten", 10)]
