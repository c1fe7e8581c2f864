"""Elements and readable text of pages, speech preparation, casts, the queue of writes and the rest of the chapter work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taleweave.functions import markup, web
from taleweave.functions import text as tx
from taleweave.operators import cues as cu
from taleweave.operators import discover as dis
from taleweave.operators import index as ix
from taleweave.operators import jsontext as js
from taleweave.operators import ledger as led
from taleweave.operators import mentions as mn
from taleweave.operators import pages as pg
from taleweave.operators import queue as qu
from taleweave.operators import selectors as sel
from taleweave.operators import sequential as seq
from taleweave.operators import speech as sp
from taleweave.plans.common import S, pick, sql_list, sql_pick, sql_text, sql_trim, table
from taleweave.plans.ledger import _TASKS, NOW, tasks
from taleweave.plans.web import _HOST, _prose, _text
from taleweave.registry import query
from taleweave.scratch import fresh_path, written


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


@query("s02_json_documents", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_documents(spark, sf_dir):
    from taleweave.sources import files

    path = fresh_path(spark, "documents")
    body = F.concat(F.lit('{\n  "event_id": '), F.col("event_id").cast("string"), F.lit(',\n  "props": '), "props", F.lit("\n}"))
    bodies = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 1000).alias("thousand")).agg(F.collect_list(body).alias("bodies"))
    bodies.select("thousand", F.concat(F.lit("["), F.array_join("bodies", ",\n"), F.lit("]")).alias("value")).write.partitionBy("thousand").text(path)
    return files.documents(spark, path, "event_id long, props struct<k:long>").select("event_id", F.col("props.k").alias("k"))


@query("s06_manifest_append", "SELECT o_orderkey AS chapter, md5(o_orderpriority) AS sha FROM orders")
def manifest_append(spark, sf_dir):
    path = fresh_path(spark, "manifest")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chapter"), F.md5("o_orderpriority").alias("sha"))
    for part in (0, 1):
        rows.where(F.col("chapter") % 2 == part).write.mode("append").json(path)
    return spark.read.schema(rows.schema).json(path)


@query("p06_css_select", r"SELECT page_id, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<script.*?</script>|<!--.*?-->', '', 'g'), '<a[ >]')) FROM pages) GROUP BY page_id")
def css_select(spark, sf_dir):
    return sel.matched(pg.elements(pg.parsed(pages(spark, sf_dir))), "a").groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


_CLEAN = r"regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g')"
_PARAGRAPHS = "len(regexp_extract_all(h, '<p>'))"
_LINKS = r"len(regexp_extract_all(h, '<li><a href='))"
#: Selectors, and what they select in a page by its markup alone: the paragraphs of an article follow its headline as siblings.
SELECTORS = {
    "nav li > a, nav > a": _LINKS,
    "nav > a": "0",
    "article p": _PARAGRAPHS,
    "h1 + p": f"least({_PARAGRAPHS}, 1)",
    "article > p ~ p": f"greatest({_PARAGRAPHS} - 1, 0)",
    "p > b > br": "len(regexp_extract_all(h, '<p><b>[^<]*<br>'))",
    "div.ad ~ article p:first-of-type": f"least({_PARAGRAPHS}, 1)",
    "ul > li:nth-child(2n+1) a[href^='/']": f"({_LINKS} + 1) // 2",
    "li:not(:first-child):not(:last-child)": f"greatest({_LINKS} - 2, 0)",
    "html[lang=fr] footer, html[lang|=DE i] footer": r"CAST(regexp_matches(h, '<html lang=\"(fr|de)\">') AS INTEGER)",
    "title, h1": "2",
    "[class~=ad]:not(p), #none": "1",
    "a[href$=',' i], a[href*='.']": r"len(regexp_extract_all(h, '<li><a href=\"[^\"]*(,|\.[^\"]*)\"'))",
    "body > *:last-child": "1",
}
_SELECTED = " UNION ALL ".join(f"SELECT page_id, {sql_text(s)} AS selector, CAST({n} AS BIGINT) AS n FROM h" for s, n in SELECTORS.items())


@query("p06_selectors", f"WITH h AS (SELECT page_id, {_CLEAN} AS h FROM pages) SELECT * FROM ({_SELECTED}) WHERE n > 0".replace('\\"', '"'))
def selectors(spark, sf_dir):
    """How many elements each selector selects in each page."""
    found = written(pg.elements(pg.parsed(pages(spark, sf_dir))), "elements")
    hits = [sel.matched(found, s).select("page_id", F.lit(s).alias("selector")) for s in SELECTORS]
    return reduce(DataFrame.unionByName, hits).groupBy("page_id", "selector").agg(F.count(F.lit(1)).alias("n"))


@query("p06_first_text", rf"""SELECT page_id, trim(regexp_replace(replace(regexp_extract({_CLEAN}, '<h1>([^<]*)</h1>', 1), '&amp;', '&'), '{S}+', ' ', 'g'), ' ') AS text FROM pages""")
def first_text(spark, sf_dir):
    """The text of the first headline inside an article, else of the title."""
    return sel.first_text(pg.parsed(pages(spark, sf_dir)), "article h1, article > h2")


_ARTICLE, _BODY = (rf"regexp_extract(html, '(?s)<{t}>(.*?)(?:</{t}>|\z)', 1)" for t in ("article", "body"))
_SHOWN = r"length(regexp_replace(regexp_replace(regexp_replace(%s, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g'), '&[a-z]+;', '_', 'g'))"
_LINKED = rf"3 * list_sum(list_transform(list_append(regexp_extract_all({_BODY}, '<a [^>]*>([^<]*)</a>', 1), ''), lambda x: length(regexp_replace(x, '&[a-z]+;', '_', 'g'))))"
_BEST = f"CASE WHEN {_SHOWN % _BODY} - {_LINKED} >= {_SHOWN % _ARTICLE} THEN {_BODY} ELSE {_ARTICLE} END"
_READ = rf"""SELECT page_id, trim(regexp_replace(replace(regexp_extract({_CLEAN}, '<h1>([^<]*)</h1>', 1), '&amp;', '&'), '{S}+', ' ', 'g'), ' ') AS title,
  regexp_replace(regexp_replace(array_to_string(list_transform(regexp_split_to_array({_prose(_text('best'))}, '\r?\n'), lambda l: {sql_trim('l')}), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+\z', '', 'g') AS text
  FROM (SELECT page_id, html, {_BEST} AS best FROM pages)"""


@query("p07_readable", _READ)
def readable(spark, sf_dir):
    return pg.readable(pg.parsed(pages(spark, sf_dir)))


@query("p10_absolute_url", r"""SELECT page_id, site || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') || 'next?p=2' AS next, '' AS "none"
  FROM (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS site, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)""")
def absolute_url(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", pg.absolute(F.col("url"), F.lit("../next?p=2")).alias("next"), pg.absolute(F.col("url"), F.lit(" ")).alias("none"))


@query("s10_crawl_chapter", f"""SELECT page_id, title, CASE WHEN page_id % 5 = 4 THEN 'blocked:challenge' WHEN page_id % 5 = 3 THEN 'absent' WHEN strlen(text) > {web.MAX_BYTES} THEN 'blocked:unknown' WHEN strlen(text) < {web.MIN_BYTES} THEN 'blocked:empty' ELSE 'text' END AS outcome FROM ({_READ})""")
def crawl_chapter(spark, sf_dir):
    """Readable text of each page and the outcome of its crawl."""
    status = F.element_at(F.array(*[F.lit(c) for c in (200, 200, 200, 404, 503)]), (F.col("page_id") % 5 + 1).cast("int"))
    read = pg.readable(pg.parsed(pages(spark, sf_dir))).withColumn("class", web.block_class(status))
    gone = F.coalesce(F.col("class") == "gone", F.lit(False))
    return read.select("page_id", "title", web.outcome(F.when(~gone, F.col("class")), gone, F.col("text")).alias("outcome"))


@query("s11_discover", r"SELECT page_id, count(*) AS chapters, max(n) AS last FROM (SELECT page_id, unnest(range(1, len(l) + 1)) AS n FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<script.*?</script>|<!--.*?-->', '', 'g'), '<a href=\"[^\"]+\"') AS l FROM pages)) GROUP BY page_id")
def discover(spark, sf_dir):
    return pg.listing(pages(spark, sf_dir)).groupBy("page_id").agg(F.count(F.lit(1)).alias("chapters"), F.max("n").cast("long").alias("last"))


@query("x01_crawl_script", rf"""SELECT page_id, CASE WHEN length(host) % 2 = 0 THEN {_prose(_text(_ARTICLE))} ELSE {_prose(_text(_BODY))} END AS text FROM (SELECT *, {_HOST} AS host FROM pages)""")
def crawl_script(spark, sf_dir):
    """A site's selectors as parameter rows (container tag, attribute, part, title tag), joined by host and applied."""
    hosts = pages(spark, sf_dir).select("page_id", web.host(F.col("url")).alias("host"))
    sites = hosts.select("host").distinct().select("host", F.when(F.length("host") % 2 == 0, "article").otherwise("body").alias("container"))
    found = pg.tagged(pg.parsed(pages(spark, sf_dir)), "article", "body").join(hosts, "page_id").join(sites, "host").where(F.col("tag") == F.col("container"))
    first = found.groupBy("page_id").agg(F.min_by("html", "pos").alias("html"))
    return first.select("page_id", markup.prose(markup.text_of(F.col("html"))).alias("text"))


def site_links(spark, sf_dir):
    """url, pos, href, title and to: the items of each page's navigation. No page of the table links another one by its
    address, so an address stands for the page whose number among all it hashes to."""
    read = pg.parsed(pages(spark, sf_dir))
    items = pg.contents(sel.matched(pg.elements(read), "nav li > a[href]"), read)
    number = F.conv(F.substring(F.md5("href"), 1, 8), 16, 10).cast("long") % pages(spark, sf_dir).count()
    items = items.select("page_id", "pos", F.element_at("attrs", F.lit("href")).alias("href"), F.col("text").alias("title")).withColumn("target", number)
    urls = pages(spark, sf_dir).select("page_id", "url")
    return items.join(urls, "page_id").join(urls.select(F.col("page_id").alias("target"), F.col("url").alias("to")), "target").select("url", "pos", "href", "title", "to")


_SITE_LINKS = rf"""
  cleaned AS (SELECT page_id, url, {_CLEAN} AS h FROM pages),
  items AS (SELECT page_id, url, unnest(regexp_extract_all(h, '<li><a href="([^"]*)"', 1)) AS raw, unnest(regexp_extract_all(h, '<li><a href="[^"]*">([^<]*)', 1)) AS shown, unnest(range(len(regexp_extract_all(h, '<li><a href="')))) AS pos FROM cleaned),
  named AS (SELECT page_id, url, pos, replace(raw, '&amp;', '&') AS href, trim(replace(shown, '&amp;', '&'), ' ') AS title FROM items),
  links AS (SELECT n.url, n.pos, n.href, n.title, p.url AS "to" FROM named n JOIN pages p ON p.page_id = ('0x' || substr(md5(n.href), 1, 8))::BIGINT % (SELECT count(*) FROM pages)),
  hosts AS (SELECT url, regexp_replace(lower(regexp_extract(regexp_replace(url, '^.*?://', ''), '^([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages)"""


def _entries(spark, sf_dir):
    hosts = pages(spark, sf_dir).select("page_id", "url", web.host(F.col("url")).alias("host"))
    return hosts, hosts.groupBy("host").agg(F.min_by("url", "page_id").alias("url")).select(F.col("host").alias("site"), "url")


@query("x01_discover", f"""WITH RECURSIVE {_SITE_LINKS},
  reach(url) AS (SELECT arg_min(url, page_id) FROM pages UNION SELECT l."to" FROM reach r JOIN links l ON l.url = r.url)
  SELECT url, host FROM reach JOIN hosts USING (url)""")
def discover_all(spark, sf_dir):
    """All pages that links lead to from the first page."""
    hosts, _ = _entries(spark, sf_dir)
    entry = hosts.agg(F.min_by("url", "page_id").alias("url"))
    return dis.reachable(hosts, site_links(spark, sf_dir), entry).select("url", "host")


@query("x01_discover_budget")
def discover_budget(spark, sf_dir):
    """The same from the first page of every host, with at most eight pages a host."""
    hosts, entries = _entries(spark, sf_dir)
    return dis.reachable(hosts, site_links(spark, sf_dir), entries, budget=8)


@query("x03_discover", rf"""WITH RECURSIVE {_SITE_LINKS},
  nexts AS (SELECT url, arg_min("to", pos) AS next FROM links GROUP BY url),
  entries AS (SELECT host AS site, arg_min(p.url, page_id) AS url FROM pages p JOIN hosts h ON p.url = h.url GROUP BY host),
  walk(site, url, turn, path) AS (
    SELECT site, url, 0, [url] FROM entries
    UNION ALL SELECT w.site, n.next, w.turn + 1, list_append(w.path, n.next) FROM walk w JOIN nexts n ON n.url = w.url WHERE w.turn < 59 AND NOT list_contains(w.path, n.next)
  ), listed AS (
    SELECT w.site, l."to" AS url, arg_min(l.title, (w.turn, l.pos)) AS title, TRY_CAST(nullif(regexp_extract(l."to", '(\d+)\D*$', 1), '') AS BIGINT) AS n
    FROM walk w JOIN links l ON l.url = w.url GROUP BY w.site, l."to"
  )
  SELECT site, n, url, title, max(n) OVER (PARTITION BY site) AS total FROM listed WHERE n IS NOT NULL""")
def discover_listing(spark, sf_dir):
    """The chapters of each host's listing: the first link of a page stands for its next page, and walks run into loops."""
    links = written(site_links(spark, sf_dir), "site-links")
    _, entries = _entries(spark, sf_dir)
    walk = dis.walked(entries, links.groupBy("url").agg(F.min_by("to", "pos").alias("next")))
    return dis.chapters(walk, links.withColumn("n", dis.trailing_number(F.col("to"))))


@query("x02_host_functions", r"SELECT page_id, regexp_replace(lower(regexp_extract(regexp_replace(url, '^.*?://', ''), '^([^/?#:]*)', 1)), '^www\.', '') AS host, 'https://x.example/' || lpad(CAST(page_id AS VARCHAR), CAST(greatest(5, length(CAST(page_id AS VARCHAR))) AS INTEGER), '0') AS next FROM pages")
def host_functions(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", web.host(F.col("url")).alias("host"), web.expand_template(F.lit("https://x.example/{n:05}"), F.col("page_id")).alias("next"))


@query("x02_page_functions", rf"""WITH {_SITE_LINKS.strip()}, n AS (SELECT page_id, count(*) AS links, arg_min(href, pos) AS href FROM named GROUP BY page_id)
  SELECT page_id, trim(regexp_replace(replace(regexp_extract({_CLEAN}, '<h1>([^<]*)</h1>', 1), '&amp;', '&'), '{S}+', ' ', 'g'), ' ') AS title, {_prose(_text(_ARTICLE))} AS text, coalesce(links, 0) AS links,
    coalesce(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href, '') AS first FROM pages LEFT JOIN n USING (page_id)""")
def page_functions(spark, sf_dir):
    """What a site's script asks of a page: the text of one element, another with its paragraphs, all links, one resolved."""
    read = written(pg.parsed(pages(spark, sf_dir)), "parsed")
    links = pg.contents(sel.matched(pg.elements(read), "nav li > a[href]"), read)
    links = links.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.min_by(F.element_at("attrs", F.lit("href")), "pos").alias("href"))
    out = sel.first_text(read, "h1").withColumnRenamed("text", "title").join(sel.first_prose(read, "article"), "page_id").join(links, "page_id", "left").join(pages(spark, sf_dir).select("page_id", "url"), "page_id")
    return out.select("page_id", "title", "text", F.coalesce("links", F.lit(0)).alias("links"), pg.absolute(F.col("url"), F.col("href")).alias("first"))


@query("x03_site_parameters", r"SELECT host, count(*) AS pages, min(lang) AS lang FROM (SELECT regexp_replace(lower(regexp_extract(regexp_replace(url, '^.*?://', ''), '^([^/?#:]*)', 1)), '^www\.', '') AS host, regexp_extract(url, '://[^/]+/([a-z]{2})/', 1) AS lang FROM pages) GROUP BY host")
def site_parameters(spark, sf_dir):
    p = pages(spark, sf_dir).select(web.host(F.col("url")).alias("host"), F.regexp_extract("url", "://[^/]+/([a-z]{2})/", 1).alias("lang"))
    return p.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.min("lang").alias("lang"))


# ---- speech --------------------------------------------------------------------------------------------------------


@query("f04_quoted_sentences")
def quoted_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sp.quoted_sentences(F.col("text"))).alias("pos", "sentence"))


@query("f09_short_chunk_merge")
def short_chunk_merge(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.minor_parts(F.col("text")).alias("chunks")).where(F.size("chunks") > 0)
    gaps = F.transform(F.slice("chunks", 1, F.size("chunks") - 1), lambda x: F.when(x.contains("\n"), "para").otherwise(tx.gap_class(x)))
    return c.select("conv_id", "turn", F.posexplode(sp.merged_short(F.col("chunks"), gaps, F.lit(30))).alias("chunk", "text"))


@query("o14_balanced_lines")
def balanced_lines(spark, sf_dir):
    words = F.filter(F.split("text", rf"{S}+"), lambda w: w != "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(sp.balanced(words, F.lit(42))).alias("row", "line"))


@query("f15_cue_splitting")
def cue_splitting(spark, sf_dir):
    """Each turn as cues of two rows and six seconds at most, spoken at fifteen letters a second; users' cues bear a label."""
    c = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 100.0
    label = F.when(F.col("role") == "user", "User: \"").otherwise("")
    found = cu.split_cues(F.col("text"), start, start + F.length("text") / 15.0, label)
    return c.select("conv_id", "turn", F.posexplode(found).alias("cue", "c")).select("conv_id", "turn", "cue", F.round("c.start", 6).alias("start"), F.round("c.end", 6).alias("end"), F.col("c.text").alias("text"))


@query("f13_paragraph_speech", """SELECT doc_id, CAST(pos AS INTEGER) AS pos, trim(p[1], ' ') AS before, trim(p[2], ' ') AS speech, trim(p[3], ' ') AS after FROM (SELECT doc_id, unnest(range(len(l))) AS pos, string_split(unnest(l), '"') AS p FROM (SELECT doc_id, regexp_split_to_array(text, '\\n') AS l FROM documents)) WHERE len(p) = 3""")
def paragraph_speech(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("p", F.split("line", '"', -1))
    part = lambda k: F.trim(F.col("p")[k])
    return p.where(F.size("p") == 3).select("doc_id", "pos", part(0).alias("before"), part(1).alias("speech"), part(2).alias("after"))


@query("p22_embedded_term")
def embedded_term(spark, sf_dir):
    """Chapters with every 40th word in quotes: short ones inside a sentence stay narration."""
    quoted = F.transform(F.split("text", " "), lambda w, k: F.when(k % 40 == 7, F.concat(F.lit('"'), w, F.lit('"'))).otherwise(w))
    d = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("chapter"), F.array_join(quoted, " ").alias("text"))
    return seq.quote_events(d).groupBy("chapter", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("f34_json_repair", rf"""SELECT conv_id, turn, CAST(json_object('conv', conv_id, 'text', said, 'tags', ['a', 'b']) AS VARCHAR) AS body FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN regexp_replace(text, ' (\w+) (\w+) ', ' "\1" \2 ', 'g') ELSE regexp_replace(text, ' (\w+) (\w+) ', ' "\1" \2 ') END AS said FROM conversations WHERE text IS NOT NULL AND NOT contains(text, chr(92)))""")
def json_repair(spark, sf_dir):
    """A model's answers as it writes them: in a fence, with bare quotes in a text, raw line ends and trailing commas."""
    c = table(spark, sf_dir, "conversations").where("text is not null and not contains(text, '\\\\')")
    first = F.regexp_replace("text", r"\A((?s).*?) (\w+) (\w+) ", '$1 "$2" $3 ')
    said = F.when(F.col("turn") % 2 == 0, F.regexp_replace("text", r" (\w+) (\w+) ", ' "$1" $2 ')).otherwise(first)
    body = F.concat(F.lit('```json\n{"conv": '), "conv_id", F.lit(', "text": "'), said, F.lit('", "tags": ["a", "b",],\n}\n```'))
    return c.select("conv_id", "turn", sp.repaired_json(body).alias("body"))


@query("p33_sound_items", "SELECT conv_id, turn, turn % 3 = 1 AND turn % 2 = 0 AS sound FROM conversations")
def sound_items(spark, sf_dir):
    t = F.col("turn")
    c = table(spark, sf_dir, "conversations").withColumns({"start": F.when(t % 3 == 1, "rain"), "line": F.when(t % 2 == 1, F.col("text"))})
    keyed = F.col("start").isNotNull()
    return c.select("conv_id", "turn", (keyed & F.col("line").isNull()).alias("sound"))


@query("p34_speaker_predicates", "SELECT conv_id, turn, lower(trim(role)) IN ('anonymous', 'system') AS anonymous, CASE WHEN role = 'system' OR (conv_id + turn) % 5 = 0 THEN 'narration' ELSE 'dialogue' END AS kind FROM conversations")
def speaker_predicates(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    retracted = c.where("(conv_id + turn) % 5 = 0").select("conv_id", "turn", F.lit(True).alias("retracted"))
    kind = F.when((F.col("role") == "system") | F.col("retracted"), "narration").otherwise("dialogue")
    return c.join(retracted, ["conv_id", "turn"], "left").select("conv_id", "turn", F.lower(F.trim("role")).isin("anonymous", "system").alias("anonymous"), kind.alias("kind"))


@query(
    "a26_onsets",
    """WITH s AS (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
      m AS (SELECT vec_id, i, avg(abs(x)) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM s),
      p AS (SELECT *, max(m) OVER (PARTITION BY vec_id) AS peak FROM m)
    SELECT vec_id, CAST(min(i) FILTER (m >= 0.05::DOUBLE * peak) AS INTEGER) AS rise, CAST(min(i) FILTER (m >= 0.25::DOUBLE * peak) AS INTEGER) AS onset,
      CAST(min(i) FILTER (m >= 0.9::DOUBLE * peak) AS INTEGER) AS attack FROM p GROUP BY vec_id""",
)
def onsets(spark, sf_dir):
    """Box average of |x|, and where it first crosses 5, 25 and 90 percent of its peak."""
    around = W.partitionBy("vec_id").orderBy("i").rowsBetween(-1, 1)
    s = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("m", F.avg(F.abs(F.col("x").cast("double"))).over(around))
    s = s.withColumn("peak", F.max("m").over(W.partitionBy("vec_id")))
    first = lambda share: F.min(F.when(F.col("m") >= share * F.col("peak"), F.col("i")))
    return s.groupBy("vec_id").agg(first(0.05).alias("rise"), first(0.25).alias("onset"), first(0.9).alias("attack"))


# ---- chapters and casts --------------------------------------------------------------------------------------------


@query("a06_scene_per_run", "WITH v AS (SELECT conv_id, turn // 3 AS run, scene, count(*) AS n, min(turn) AS first FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'cave' WHEN 1 THEN '' ELSE 'road' END AS scene FROM conversations) WHERE scene <> '' GROUP BY ALL) SELECT conv_id, run, arg_max(scene, (n, first)) AS scene FROM v GROUP BY conv_id, run")
def scene_per_run(spark, sf_dir):
    t = F.col("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", F.floor(t / 3).alias("run"), t.alias("turn"), F.when(t % 4 == 0, "cave").when(t % 4 == 1, "").otherwise("road").alias("scene"))
    v = c.where("scene <> ''").groupBy("conv_id", "run", "scene").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"))
    return v.groupBy("conv_id", "run").agg(F.max_by("scene", F.struct("n", "first")).alias("scene"))


@query("o11_rule_order", "SELECT doc_id, arg_min(v, pos) AS value FROM (SELECT doc_id, text FROM documents), (VALUES (0, 'tion', 'a'), (1, 'ent', 'b'), (2, 'the', 'c')) r(pos, k, v) WHERE contains(lower(text), k) GROUP BY doc_id")
def rule_order(spark, sf_dir):
    from taleweave.operators.match import first_rule

    d = table(spark, sf_dir, "documents").withColumn("value", first_rule(F.col("text"), [(("tion",), "a"), (("ent",), "b"), (("the",), "c")], ""))
    return d.where("value <> ''").select("doc_id", "value")


@query("f43_attribution_metadata", "SELECT conv_id, list_sort(list_distinct(list(CASE WHEN trim(lower(role)) = 'system' THEN 'Narrator' ELSE upper(substr(trim(role), 1, 1)) || substr(trim(role), 2) END))) AS roster FROM conversations GROUP BY conv_id")
def attribution_metadata(spark, sf_dir):
    r = F.trim("role")
    name = F.when(F.lower(r) == "system", "Narrator").otherwise(F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30)))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set(name)).alias("roster"))


_TOKENS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
_STOPPED = ", ".join(sql_text(w) for w in dict.fromkeys((*tx.ALIAS_STOP, *tx.TITLE_SUFFIXES)))


def opening_claims(spark, sf_dir):
    """Names out of the texts themselves: a document's first word for every fifth, its first two for every third."""
    word, between = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
    heads = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", rf"^(?:{between})?({word}{between}{word})", 1).alias("two")).where("two <> ''")
    one = heads.where("doc_id % 5 = 0").select(F.regexp_extract("two", f"^{word}", 0).alias("form"), F.concat(F.lit("Q"), "doc_id").alias("owner"))
    return one.unionByName(heads.where("doc_id % 3 = 0").select(F.col("two").alias("form"), F.concat(F.lit("P"), "doc_id").alias("owner")))


@query(
    "f43_mentions",
    rf"""WITH RECURSIVE tok AS (SELECT doc_id, regexp_extract_all(text, '{_TOKENS}') AS t FROM documents),
    heads AS (SELECT doc_id, CASE WHEN regexp_matches(t[1], '^[\p{{L}}\p{{N}}]') THEN t ELSE t[2:4] END AS t FROM tok),
    claims AS (SELECT t[1] AS form, 'Q' || doc_id AS owner FROM heads WHERE doc_id % 5 = 0 AND len(t) > 2 UNION ALL SELECT t[1] || t[2] || t[3], 'P' || doc_id FROM heads WHERE doc_id % 3 = 0 AND len(t) > 2),
    own AS (SELECT form, min(owner) AS owner FROM claims WHERE lower(form) NOT IN ({_STOPPED}) GROUP BY form HAVING count(DISTINCT owner) = 1),
    pieces AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS piece FROM tok),
    placed AS (SELECT doc_id, pos, sum(length(piece)) OVER o - length(piece) AS start, piece AS one, piece || lead(piece, 1) OVER o || lead(piece, 2) OVER o AS three FROM pieces WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    hits AS (SELECT doc_id, pos, start, arg_max(form, n) AS form, arg_max(owner, n) AS owner, max(n) AS n FROM (
      SELECT p.doc_id, p.pos, p.start, o.form, o.owner, 1 AS n FROM placed p JOIN own o ON o.form = p.one UNION ALL SELECT p.doc_id, p.pos, p.start, o.form, o.owner, 3 FROM placed p JOIN own o ON o.form = p.three) GROUP BY doc_id, pos, start),
    nexts AS (SELECT doc_id, pos, CASE WHEN a >= pos + n THEN a WHEN b >= pos + n THEN b ELSE c END AS next FROM (SELECT *, lead(pos, 1) OVER o AS a, lead(pos, 2) OVER o AS b, lead(pos, 3) OVER o AS c FROM hits WINDOW o AS (PARTITION BY doc_id ORDER BY pos))),
    walk(doc_id, pos) AS (SELECT doc_id, min(pos) FROM hits GROUP BY doc_id UNION ALL SELECT n.doc_id, n.next FROM walk w JOIN nexts n ON n.doc_id = w.doc_id AND n.pos = w.pos WHERE n.next IS NOT NULL)
    SELECT doc_id, form, owner, count(*) AS times, CAST(min(start) AS BIGINT) AS first FROM walk JOIN hits USING (doc_id, pos) GROUP BY doc_id, form, owner""",
)
def surface_mentions(spark, sf_dir):
    """Every name of one document's opening in all documents: from left to right, the longest at each place."""
    chapters = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chapter"), "text")
    return mn.mentions(chapters, opening_claims(spark, sf_dir)).withColumnRenamed("chapter", "doc_id")


def answers(spark, sf_dir):
    """Chapters out of conversations and an answer to each: who speaks a turn is its first word, and the first two words
    mention it; the bible has the first speakers of every third conversation with a form that only describes them."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.regexp_extract_all("text", F.lit(mn.WORD)).alias("w")).where("size(w) > 2")
    chapters = c.groupBy(F.col("conv_id").alias("chapter")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    who = F.when(F.col("turn") % 4 == 3, F.lit("Stranger")).when(F.col("turn") % 5 == 4, F.concat(F.lit("anonymous:anon-"), F.col("turn"))).otherwise(F.col("w")[0])
    speakers = c.select(F.col("conv_id").alias("chapter"), F.col("turn").cast("string").alias("id"), who.alias("speaker"))
    roster = c.select(F.col("conv_id").alias("chapter"), F.col("turn").alias("pos"), who.alias("name"))
    told = c.select(F.col("conv_id").alias("chapter"), F.concat(F.col("w")[0], F.lit(" "), F.col("w")[1]).alias("form"), F.when(F.col("turn") % 2 == 0, F.col("w")[0]).otherwise("Narrator").alias("owner"))
    newcomers = c.where("turn % 2 = 0").select(F.col("conv_id").alias("chapter"), F.col("w")[0].alias("name"))
    epithet = F.concat(F.lit("người "), F.lower(F.col("w")[1]), F.lit(" "), F.lower(F.col("w")[2]))
    first = c.where("turn = 0 and conv_id % 3 = 0").select(F.col("conv_id").alias("pos"), F.concat(F.lit("Old "), F.col("w")[0]).alias("name"), F.array(F.col("w")[0], F.lit("Stranger"), epithet).alias("aliases"))
    bible = first.groupBy("name").agg(F.min("pos").alias("pos"), F.min_by("aliases", "pos").alias("aliases"))
    return chapters, roster, speakers, told, newcomers, bible


@query("f43_attribution")
def attribution(spark, sf_dir):
    """Rosters, speakers, mentions and undescribed newcomers of all chapters after the answers are made fit."""
    cast, lines, kept, alone = mn.attribution(*answers(spark, sf_dir))
    shape = lambda df, kind, key, value: df.select("chapter", F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"))
    out = [shape(cast, "roster", F.col("pos").cast("string"), F.col("name")), shape(lines, "speaker", F.col("id"), F.col("speaker")), shape(kept, "mention", F.col("form"), F.col("owner")), shape(alone, "newcomer", F.col("name"), F.lit("unknown"))]
    return reduce(DataFrame.unionByName, out)


@query("f61_chunk_key", "SELECT conv_id, turn // 4 AS chunk, substr(sha256(string_agg(turn || '|' || md5(text), ';' ORDER BY turn)), 1, 16) AS key FROM conversations GROUP BY ALL")
def chunk_key(spark, sf_dir):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws("|", "turn", F.md5("text")).alias("p")))), lambda x: x["p"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 4).alias("chunk")).agg(F.substring(F.sha2(F.array_join(parts, ";"), 256), 1, 16).alias("key"))


_VOICES = """v AS (SELECT n_nationkey AS voice, n_nationkey % 2 AS gender, row_number() OVER (PARTITION BY n_nationkey % 2 ORDER BY used, n_name) - 1 AS t, count(*) OVER (PARTITION BY n_nationkey % 2) AS n FROM (SELECT n_nationkey, n_name, count(c_custkey) AS used FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)),
  bad AS (SELECT c_custkey, c_custkey % 2 AS gender, row_number() OVER (PARTITION BY c_custkey % 2 ORDER BY c_custkey) - 1 AS k FROM customer WHERE c_nationkey % 2 <> c_custkey % 2)"""


def repaired(spark, sf_dir):
    """Speakers whose voice contradicts their gender, each with the least used voice of the stated one, round by round."""
    c = table(spark, sf_dir, "customer")
    used = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("used"))
    n = table(spark, sf_dir, "nation").join(used, "n_nationkey", "left")
    voices = n.select(F.col("n_nationkey").alias("voice"), (F.col("n_nationkey") % 2).cast("long").alias("gender"), F.coalesce("used", F.lit(0)).alias("used"), F.col("n_name").alias("place"))
    wrong = c.where("c_nationkey % 2 <> c_custkey % 2").select(F.lit(0).alias("chapter"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("speaker"), (F.col("c_custkey") % 2).alias("gender"))
    return seq.assign_voices(wrong, voices)


@query("o07_gender_replacement", f"WITH {_VOICES} SELECT c_custkey, voice FROM bad JOIN v ON v.gender = bad.gender AND v.t = bad.k % v.n")
def gender_replacement(spark, sf_dir):
    return repaired(spark, sf_dir).select(F.col("pos").alias("c_custkey"), "voice")


@query("m13_gender_repair", f"WITH {_VOICES} SELECT c.c_custkey, coalesce(v.voice, c.c_nationkey) AS voice FROM customer c LEFT JOIN bad USING (c_custkey) LEFT JOIN v ON v.gender = bad.gender AND v.t = bad.k % v.n")
def gender_repair(spark, sf_dir):
    fixed = repaired(spark, sf_dir).select(F.col("pos").alias("c_custkey"), "voice")
    return table(spark, sf_dir, "customer").join(fixed, "c_custkey", "left").select("c_custkey", F.coalesce("voice", "c_nationkey").alias("voice"))


@query("m08_claim_voice", "WITH moved AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer WHERE c_nationkey = 3 AND c_custkey <> 3), free AS (SELECT n_nationkey AS voice, row_number() OVER (ORDER BY n_nationkey) - 1 AS t, count(*) OVER () AS n FROM nation WHERE n_nationkey <> 3 AND n_nationkey % 2 = 1) SELECT c.c_custkey, CASE WHEN c.c_custkey = 3 THEN 3 ELSE coalesce(voice, c_nationkey) END AS voice FROM customer c LEFT JOIN moved USING (c_custkey) LEFT JOIN free ON t = k % n")
def claim_voice(spark, sf_dir):
    """Character 3 takes voice 3 for itself; every other user of it moves to a free voice."""
    c = table(spark, sf_dir, "customer")
    voices = table(spark, sf_dir, "nation").where("n_nationkey <> 3 and n_nationkey % 2 = 1").select(F.col("n_nationkey").alias("voice"), F.lit(0).alias("gender"), F.lit(0).alias("used"), F.col("n_nationkey").alias("place"))
    users = c.where("c_nationkey = 3 and c_custkey <> 3").select(F.lit(0).alias("chapter"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("speaker"), F.lit(0).alias("gender"))
    moved = seq.assign_voices(users, voices).select(F.col("pos").alias("c_custkey"), "voice")
    return c.join(moved, "c_custkey", "left").select("c_custkey", F.when(F.col("c_custkey") == 3, 3).otherwise(F.coalesce("voice", "c_nationkey")).alias("voice"))


@query("m10_reconcile_apply", "SELECT o_orderkey, CASE WHEN o_custkey % 10 IN (3, 6) THEN o_custkey // 10 * 10 ELSE o_custkey END AS speaker FROM orders")
def reconcile_apply(spark, sf_dir):
    """Folds of characters carried through to the lines."""
    folds = table(spark, sf_dir, "customer").where("c_custkey % 10 in (3, 6)").select(F.col("c_custkey").alias("o_custkey"), (F.floor(F.col("c_custkey") / 10) * 10).alias("survivor"))
    return table(spark, sf_dir, "orders").join(folds, "o_custkey", "left").select("o_orderkey", F.coalesce("survivor", "o_custkey").alias("speaker"))


_WORKERS = "workers AS (SELECT 'w' || s_suppkey AS worker, list_element(['merge', 'render', 'digest', 'crawl'], s_suppkey % 4 + 1) AS stage, s_suppkey AS place FROM supplier)"


@query("t05_offer", f"WITH {_TASKS}, {_WORKERS}, w AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY place) AS k FROM workers), t AS (SELECT stage, chapter, take, row_number() OVER (PARTITION BY stage ORDER BY chapter, take) AS k FROM tasks WHERE state = 'pending') SELECT worker, stage, chapter, take FROM w JOIN t USING (stage, k)")
def offer(spark, sf_dir):
    """One tick of the scheduler: the workers of each stage, in order of asking, get its pending rows in order."""
    s = F.col("s_suppkey")
    workers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("w"), s).alias("worker"), pick(("merge", "render", "digest", "crawl"), s % 4).alias("stage"), s.alias("place"))
    w = ix.numbered(workers, ["stage"], F.floor(F.col("place") / 1000), ["place"])
    t = tasks(spark, sf_dir).where("state = 'pending'").select("stage", "chapter", "take")
    t = ix.numbered(t, ["stage"], F.floor(F.col("chapter") / 1000), ["chapter", "take"])
    return w.join(t, ["stage", "k"]).select("worker", "stage", "chapter", "take")


_LEASE = "CASE stage WHEN 'crawl' THEN 600 WHEN 'digest' THEN 1200 WHEN 'render' THEN 5400 ELSE 1800 END"
_RANKED = "t AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY state <> 'pending', chapter, take) AS k FROM tasks WHERE state = 'pending' OR stage = 'digest' AND state IN ('assigned', 'running'))"


@query(
    "t05_racing",
    f"""WITH {_TASKS}, {_WORKERS}, asking AS (SELECT 'box ' || (place + 100000 * r) AS worker, stage, place + 100000 * r AS place FROM workers, range(150) x(r)), w AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY place) AS k FROM asking), {_RANKED},
    o AS (SELECT w.worker AS offered, t.stage, t.chapter, t.take FROM w JOIN t USING (stage, k)),
    m AS (SELECT a.*, offered, coalesce(offered IS NOT NULL AND stage = 'digest' AND state IN ('assigned', 'running') AND NOT (worker = offered OR list_contains(racers, offered)), false) AS race FROM tasks a LEFT JOIN o USING (chapter, take, stage))
    SELECT chapter, take, stage, CASE WHEN offered IS NOT NULL AND NOT race THEN 'assigned' ELSE state END AS state, CASE WHEN offered IS NOT NULL AND NOT race THEN offered ELSE worker END AS worker, CASE WHEN race THEN list_append(racers, offered) ELSE racers END AS racers,
      CAST(CASE WHEN offered IS NULL THEN lease_until ELSE {NOW} + {_LEASE} END AS BIGINT) AS lease_until FROM m""",
)
def racing(spark, sf_dir):
    """One tick taken up: workers get pending rows, and digesters beyond those race digests that others hold."""
    s, r = F.col("s_suppkey"), F.explode(F.sequence(F.lit(0), F.lit(149)))
    asking = table(spark, sf_dir, "supplier").withColumn("r", r).select(F.concat(F.lit("box "), s + 100000 * F.col("r")).alias("worker"), pick(("merge", "render", "digest", "crawl"), s % 4).alias("stage"), (s + 100000 * F.col("r")).alias("place"))
    w = ix.numbered(asking, ["stage"], F.floor(F.col("place") / 1000), ["place"])
    rows = tasks(spark, sf_dir)
    ready = rows.where((F.col("state") == "pending") | ((F.col("stage") == "digest") & led.held(F.col("state")))).select("stage", "chapter", "take", (F.col("state") != "pending").cast("long").alias("busy"))
    ready = ix.numbered(ready, ["stage"], F.struct("busy", F.floor(F.col("chapter") / 1000)), ["busy", "chapter", "take"])
    offers = w.hint("merge").join(ready.hint("merge"), ["stage", "k"])  # each supplier asks 150 times: far larger than the planner takes it to be, and no broadcast
    offers = offers.select("worker", "stage", "chapter", "take")
    return led.accepted(rows.select("chapter", "take", "stage", "state", "worker", "racers", "lease_until"), offers, NOW)


@query("t12_write_queue", f"WITH {_TASKS}, busy AS (SELECT DISTINCT chapter FROM tasks WHERE state IN ('assigned', 'running')), q AS (SELECT o_orderkey AS id, o_custkey AS chapter FROM orders WHERE o_orderstatus = 'P') SELECT id, chapter FROM q ANTI JOIN busy USING (chapter)")
def write_queue(spark, sf_dir):
    """Queued writes that no live row of their chapter blocks."""
    busy = tasks(spark, sf_dir).where(led.held(F.col("state"))).select("chapter").distinct()
    q = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("chapter"))
    return q.join(busy, "chapter", "left_anti").select("id", "chapter")


_STAGE_LIST = sql_list(qu.STAGES)


@query(
    "t12_write_tick",
    f"""WITH {_TASKS}, held AS (SELECT chapter % 50 AS queue, chapter, stage, take, chapter || '/' || stage || '/' || take AS line, list_append(racers, worker) AS holders, lease_until // 3600 AS updated FROM tasks WHERE state IN ('assigned', 'running')),
    beats AS (SELECT event_id % 50 AS queue, 'w' || user_id % 12 AS worker, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS ts, CASE WHEN event_type = 'view' THEN user_id END AS chapter, event_id FROM events),
    fresh AS (SELECT queue, worker, arg_max(chapter, (ts, event_id)) AS chapter FROM (SELECT queue, worker, ts, event_id, coalesce(chapter, -1) AS chapter FROM beats) GROUP BY queue, worker HAVING {NOW // 3600} - max(ts) < 30),
    writes AS (SELECT o_custkey % 50 AS queue, o_orderkey AS "at", 'write ' || o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN ['render', 'merge'] WHEN 1 THEN {_STAGE_LIST} ELSE ['digest'] END AS stages, CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE [o_custkey, o_custkey + 50] END AS chapters FROM orders WHERE o_orderstatus = 'P'),
    met AS (SELECT w.queue, w."at", h.line, EXISTS (SELECT 1 FROM fresh f WHERE f.queue = h.queue AND list_contains(h.holders, f.worker)) OR h.stage = 'digest' AND {NOW // 3600} - h.updated < 120 AS races
      FROM writes w JOIN held h ON h.queue = w.queue AND list_contains(w.stages, h.stage) AND (w.chapters IS NULL OR list_contains(w.chapters, h.chapter))),
    sums AS (SELECT queue, "at", bool_or(races) AS races, count(*) AS n, array_to_string(list_sort(list(line))[1:4], ', ') AS shown FROM met GROUP BY queue, "at"),
    state AS (SELECT w.*, coalesce(n, 0) AS n, shown, coalesce(races, false) OR len(w.stages) = 4 AND EXISTS (SELECT 1 FROM fresh f WHERE f.queue = w.queue AND f.chapter >= 0 AND (w.chapters IS NULL OR list_contains(w.chapters, f.chapter))) AS racing FROM writes w LEFT JOIN sums s USING (queue, "at")),
    ahead AS (SELECT *, count(*) FILTER (racing) OVER (PARTITION BY queue ORDER BY "at") AS stops FROM state)
    SELECT queue, "at", id, CASE WHEN stops = 0 THEN 'run' WHEN racing AND stops = 1 THEN 'head' ELSE 'behind' END AS outcome,
      CASE WHEN stops = 0 THEN '' WHEN n = 0 THEN 'a worker is still on it' WHEN n > 4 THEN n || ' row(s) in the way, e.g. ' || shown ELSE n || ' row(s) in the way: ' || shown END AS note FROM ahead""",
)
def write_tick(spark, sf_dir):
    """One tick of fifty ledgers' queues: which writes run, which one is blocked by what, and which wait behind it."""
    key = F.col("o_orderkey")
    stages = F.when(key % 3 == 0, F.array(F.lit("render"), F.lit("merge"))).when(key % 3 == 1, F.array(*[F.lit(x) for x in qu.STAGES])).otherwise(F.array(F.lit("digest")))
    chapters = F.when(key % 40 != 0, F.array("o_custkey", F.col("o_custkey") + 50))
    writes = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select((F.col("o_custkey") % 50).alias("queue"), key.alias("at"), F.concat(F.lit("write "), key).alias("id"), stages.alias("stages"), chapters.alias("chapters"))
    held = tasks(spark, sf_dir).select((F.col("chapter") % 50).alias("queue"), "chapter", "take", "stage", "state", F.array_append("racers", F.col("worker")).alias("holders"), F.floor(F.col("lease_until") / 3600).alias("updated"))
    beats = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 50).alias("queue"), F.concat(F.lit("w"), F.col("user_id") % 12).alias("worker"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).alias("ts"),
        F.when(F.col("event_type") == "view", F.col("user_id")).alias("chapter"), "event_id",
    )
    last = beats.groupBy("queue", "worker").agg(F.max_by(F.struct("ts", "chapter"), F.struct("ts", "event_id")).alias("b")).select("queue", "worker", "b.*")
    return qu.ticked(writes, held, last, NOW // 3600)


def event_log(spark, sf_dir):
    """The events as a stream of one file."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def lease_log(events):
    """Pools of the users' remainders by 16: purchases and errors bring chunks home, all else asks for up to seven."""
    home = F.col("event_type").isin("purchase", "error")
    n = F.when(home, F.col("event_id") % 200).otherwise(F.col("event_id") % 7 + 1)
    return events.select((F.col("user_id") % 16).alias("key"), F.col("event_id").alias("seq"), "ts", F.when(home, "submit").otherwise("ask").alias("kind"), n.alias("n"))


@query("t20_pool_stream")
def pool_stream(spark, sf_dir):
    """What every ask of a log of work pools gets, up to the last moment but one of the log."""
    from taleweave.streaming import live, pools

    return live.drained(pools.pool_leases(lease_log(event_log(spark, sf_dir)), 200, 180, "0 seconds"), fresh_path(spark, "pools"), state_store=live.ROCKS)


def write_log(events):
    """Ledgers of the users' remainders by 12: views are ticks, purchases ask for a write, clicks begin and all else ends a row."""
    e, kind = F.col("event_id"), F.col("event_type")
    stage = pick(qu.STAGES, e)
    write = F.concat(F.lit('["w'), e, F.lit('", ["'), stage, F.lit('", "'), pick(qu.STAGES, e + 1), F.lit('"], '), F.when(e % 4 == 0, F.lit("null")).otherwise(F.concat(F.lit("["), e % 5, F.lit(", "), e % 3, F.lit("]"))), F.lit("]"))
    what = F.when(kind == "view", "tick").when(kind == "purchase", "write").when(kind == "click", "live").otherwise("free")
    return events.select((F.col("user_id") % 12).alias("key"), e.alias("seq"), "ts", what.alias("kind"), F.when(kind == "purchase", write).alias("write"), (e % 5).alias("chapter"), stage.alias("stage"))


@query("t12_write_stream")
def write_stream(spark, sf_dir):
    """Which writes of a log run when, and what blocks the others when they are asked for."""
    from taleweave.streaming import live, pools

    return live.drained(pools.write_queue(write_log(event_log(spark, sf_dir)), "0 seconds"), fresh_path(spark, "writes"), state_store=live.ROCKS)



def registries(spark, sf_dir):
    """Each event as a small registry in JSON, written by hand as it were."""
    body = F.concat(F.lit('{\n  "id": '), "event_id", F.lit(',\n  "props": '), "props", F.lit(',\n  "type": "'), "event_type", F.lit('"\n}'))
    return js.members(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), body.alias("text")))


@query("s37_json_members", """WITH e AS (SELECT event_id AS id, CAST(event_id AS VARCHAR) AS a, props AS b, '"' || event_type || '"' AS c FROM events)
    SELECT id, 'id' AS key, 10 AS start, a AS raw FROM e UNION ALL SELECT id, 'props', CAST(10 + length(a) + 13 AS INTEGER), b FROM e UNION ALL SELECT id, 'type', CAST(10 + length(a) + 13 + length(b) + 12 AS INTEGER), c FROM e""")
def json_members(spark, sf_dir):
    """Members of each registry with the place and the text of their values."""
    each = registries(spark, sf_dir).select("id", "text", F.explode("found").alias("m"))
    return each.select("id", F.col("m.key").alias("key"), F.col("m.start").alias("start"), js.value_of(F.col("text"), F.col("m")).alias("raw"))


@query("s37_json_edits", """SELECT event_id AS id, '{' || chr(10) || '  "id": ' || event_id || CASE WHEN event_id % 5 = 0 THEN '' ELSE ',' || chr(10) || '  "props": ' || props END || ',' || chr(10) || '  "type": ' ||
    CASE WHEN event_id % 3 = 0 THEN '["edited"]' ELSE '"' || event_type || '"' END || CASE WHEN event_id % 7 = 0 THEN ',' || chr(10) || '  "new": 1' ELSE '' END || chr(10) || '}' AS text FROM events""")
def json_edits(spark, sf_dir):
    """Registries with one member changed, one taken out, one new; the others to the letter as they were."""
    found = registries(spark, sf_dir)
    ids = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    change = lambda by, key, value: ids.where(F.col("id") % by == 0).select("id", F.lit(key).alias("key"), F.lit(value).cast("string").alias("value"))
    return js.edited(found, change(3, "type", '["edited"]').unionByName(change(5, "props", None)).unionByName(change(7, "new", "1")))


@query("s19_wav_blocks", """WITH s AS (SELECT vec_id // 50 AS file, (vec_id % 50) * 64 + i AS place, greatest(-32768, least(32767, floor(CAST(x AS DOUBLE) * 32768 + 0.5))) AS pcm FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings)),
    r AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY place) - 1 AS place, pcm FROM s)
    SELECT CAST(file AS BIGINT) AS file, place // 1000 AS block, count(*) AS n, 16000 AS rate, max(abs(pcm)) / 32768 AS peak, CAST(sum(pcm) AS BIGINT) AS total, CAST(count(*) FILTER (abs(pcm) >= 6553.6) AS BIGINT) AS loud FROM r GROUP BY file, place // 1000""")
def wav_blocks(spark, sf_dir):
    """Fifty vectors a WAV file, read back in blocks of 1,000 samples: peak, sum and loud samples of every block."""
    from taleweave.sources import samples as sm

    vectors = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 50).alias("file")).agg(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("x")))).alias("v"))
    rows = vectors.select(F.concat(F.lit("clip-"), "file", F.lit(".wav")).alias("name"), F.lit(16_000).alias("rate"), F.flatten(F.transform("v", lambda v: v["x"])).alias("samples"))
    folder = fresh_path(spark, "clips")
    sm.write(rows, folder).agg(F.sum("bytes")).first()
    spark.dataSource.register(sm.Samples)
    read = spark.read.format("samples").option("path", folder).option("block", 1000).load()
    pcm = F.transform("samples", lambda x: F.round(x * 32768).cast("long"))
    size = F.transform(pcm, F.abs)
    return read.select(
        F.regexp_extract("path", r"clip-(\d+)\.wav$", 1).cast("long").alias("file"), "block", "n", "rate", (F.array_max(size) / 32768).alias("peak"),
        F.aggregate(pcm, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(F.filter(size, lambda x: x >= 6553.6)).cast("long").alias("loud"),
    )


@query("t02_liveness_stream")
def liveness_stream(spark, sf_dir):
    """When each user comes online and falls silent for six hours, as a stream of the events."""
    from taleweave.streaming import live

    beats = event_log(spark, sf_dir).select("user_id", "ts")
    return live.drained(live.liveness(beats, 6 * 3600, "0 seconds"), fresh_path(spark, "liveness"), state_store=live.ROCKS)
