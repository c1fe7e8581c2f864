"""Pages to prose and verdicts; addresses, refusals and chapter numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.functions import markup, web
from taleweave.plans.common import S, sql_squeeze, sql_trim, table
from taleweave.registry import query


def _block(x: str, tag: str) -> str:
    return rf"regexp_replace({x}, '(?is)<{tag}.*?(?:</{tag}[^>]*(?:>|\z)|\z)', '', 'g')"


def _text(x: str) -> str:
    named = rf"regexp_replace({_block(_block(x, 'script'), 'style')}, '<(/*)([^ \t\n\r\f\x0B/>]*)[^>]*(?:>|\z)', chr(1) || '\2' || chr(2), 'g')"
    lines = rf"regexp_replace({named}, '(?i)\x01(?:{'|'.join(markup.BLOCK_TAGS)})\x02', chr(10), 'g')"
    return rf"regexp_replace({lines}, '\x01[^\x02]*\x02', '', 'g')"


def _entities(x: str) -> str:
    for entity, plain in markup.ENTITIES:
        x = f"""replace({x}, '{entity}', '{plain.replace("'", "''")}')"""
    code = "CAST(CASE WHEN lower(substr(e, 3, 1)) = 'x' THEN '0x' || regexp_extract(e, '&#[xX]([0-9a-fA-F]+);', 1) ELSE regexp_extract(e, '&#([0-9]+);', 1) END AS INTEGER)"
    x = rf"list_reduce(list_prepend({x}, list_distinct(regexp_extract_all({x}, '&#(?:[0-9]{{1,7}}|[xX][0-9a-fA-F]{{1,6}});'))), lambda s, e: replace(s, e, CASE WHEN {code} = 38 THEN chr(3) ELSE chr({code}) END))"
    return f"replace(replace({x}, '&amp;', '&'), chr(3), '&')"


_LINES = rf"list_transform(regexp_split_to_array(%s, '\r?\n'), lambda l: {sql_trim('l')})"


def _prose(x: str) -> str:
    kept = rf"list_filter({_LINES % _entities(x)}, lambda l: NOT regexp_matches(l, '^(?:[.!?…]|{S})*\z'))"
    return f"CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, chr(10) || chr(10)) || chr(10) ELSE '' END"


_HOST = r"regexp_replace(lower(regexp_extract(regexp_replace(regexp_extract(regexp_replace(url, '^.*?://', ''), '^([^/?#]*)', 1), '^.*@', ''), '^([^:]*)', 1)), '^www\.', '')"
_MARKERS = ("cf_chl_opt", "challenges.cloudflare.com", "cf-mitigated", "Just a moment")  # fixed values


@query("p01_strip_tags", f"SELECT page_id, {_text('html')} AS text FROM pages")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.text_of(F.col("html")).alias("text"))


@query("p02_remove_block", f"SELECT page_id, length({_block('html', 'script')}) AS without_script, length({_block('html', 'style')}) AS without_style FROM pages")
def remove_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    length = lambda tag: F.length(markup.remove_block(html, tag)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", length("script").alias("without_script"), length("style").alias("without_style"))


@query("p03_decode_entities", f"SELECT page_id, {_entities('html')} AS text FROM pages")
def decode_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.decode_entities(F.col("html")).alias("text"))


@query("p04_sanitize_prose", f"SELECT page_id, {_prose(_text('html'))} AS prose FROM pages")
def sanitize_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.prose(markup.text_of(F.col("html"))).alias("prose"))


@query("p05_fold_end_marks")
def fold_end_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.select("doc_id", "line", markup.fold_end_marks(F.regexp_replace("text", r"\.", ". .")).alias("folded"))


@query("p08_squeeze", f"SELECT doc_id, {sql_squeeze('text')} AS text FROM documents")
def squeeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", markup.squeeze(F.col("text")).alias("text"))


@query(
    "p09_squeeze_lines",
    rf"SELECT page_id, regexp_replace(regexp_replace(array_to_string({_LINES % _text('html')}, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+\z', '', 'g') AS text FROM pages",
)
def squeeze_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.squeeze_lines(markup.text_of(F.col("html"))).alias("text"))


@query("p11_host_key", f"SELECT page_id, {_HOST} AS host FROM pages")
def host_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.host(F.col("url")).alias("host"))


def _status(df: DataFrame) -> DataFrame:
    """An answer's status for each page, spread over the classes by page_id."""
    codes = F.array(*[F.lit(c) for c in (200, 204, 401, 403, 404, 407, 410, 429, 500, 503, 200, 200)])
    return df.withColumn("status", F.element_at(codes, (F.col("page_id") % 12 + 1).cast("int")))


_STATUS = "[200, 204, 401, 403, 404, 407, 410, 429, 500, 503, 200, 200][page_id % 12 + 1]"
_CLASS = "CASE WHEN status BETWEEN 200 AND 299 THEN NULL WHEN status IN (404, 410) THEN 'gone' WHEN status = 429 THEN 'rate_limit' WHEN status IN (401, 402, 407) THEN 'login_required' WHEN status IN (403, 503) THEN 'challenge' ELSE 'unknown' END"
_CHALLENGED = "status = 200 AND (" + " OR ".join(f"contains(regexp_replace(html, '(?is)(<script.*?</|<style.*?</)|<!--.*?(?:-->|\\z)', '\\1', 'g'), '{m}')" for m in _MARKERS) + ")"


def challenged(status, html):
    live = markup.without_comments(html)
    found = F.lit(False)
    for marker in _MARKERS:
        found = found | F.contains(live, F.lit(marker))
    return (status == 200) & found


@query("p12_interstitial", f"SELECT page_id, {_CHALLENGED} AS challenged FROM (SELECT page_id, {_STATUS} AS status, html FROM pages)")
def interstitial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(table(spark, sf_dir, "pages")).select("page_id", challenged(F.col("status"), F.col("html")).alias("challenged"))


_VERDICT = """CASE WHEN challenged THEN 'cloudflare' WHEN class IS NOT NULL THEN 'refused' WHEN strlen(prose) = 0 THEN 'no_container'
  WHEN strlen(prose) < 200 THEN 'too_short' WHEN strlen(prose) > 4194304 THEN 'too_long' ELSE 'ok' END"""
_PROBED = f"""probed AS (SELECT page_id, url, status, {_CLASS} AS class, {_CHALLENGED} AS challenged, {_prose(_text('html'))} AS prose
  FROM (SELECT *, {_STATUS} AS status FROM pages))"""


def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _status(table(spark, sf_dir, "pages"))
    prose = markup.prose(markup.text_of(F.col("html")))
    return pages.select("page_id", "url", "status", challenged(F.col("status"), F.col("html")).alias("challenged"), prose.alias("prose"))


@query("p13_probe_verdict", f"WITH {_PROBED} SELECT page_id, {_VERDICT} AS verdict, CAST(strlen(prose) AS INTEGER) AS bytes FROM probed")
def probe_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = web.verdict(F.col("status"), F.col("challenged"), F.col("prose"))
    return probed(spark, sf_dir).select("page_id", verdict.alias("verdict"), F.octet_length("prose").alias("bytes"))


@query(
    "site_rollup",
    f"""WITH {_PROBED}, judged AS (SELECT {_HOST} AS host, {_VERDICT} AS verdict, length(prose) AS chars FROM probed)
    SELECT host, count(*) AS pages, round(avg(chars), 3) AS mean_chars, count(*) FILTER (verdict = 'ok') AS ok,
      count(*) FILTER (verdict = 'refused') AS refused, count(*) FILTER (verdict = 'too_short') AS too_short FROM judged GROUP BY host""",
)
def site_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to prose to verdicts by host."""
    verdict = web.verdict(F.col("status"), F.col("challenged"), F.col("prose"))
    judged = probed(spark, sf_dir).select(web.host(F.col("url")).alias("host"), verdict.alias("verdict"), F.length("prose").alias("chars"))
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return judged.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("chars"), 3).alias("mean_chars"), count("ok"), count("refused"), count("too_short"))


@query("p14_block_class", f"SELECT page_id, status, {_CLASS} AS class, CASE WHEN status = 429 THEN 30 END AS retry_after FROM (SELECT page_id, {_STATUS} AS status FROM pages)")
def block_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("status")
    return _status(table(spark, sf_dir, "pages")).select("page_id", "status", web.block_class(status).alias("class"), web.retry_after(status).alias("retry_after"))


_PARSED = "CASE " + " ".join(f"WHEN name IN ({', '.join(repr(s) for s in syn)}) THEN '{c}'" for c, syn in web.CLASSES.items()) + " ELSE 'unknown' END"
_NAMES = ("Captcha", " 429 ", "paywall", "js", "404", "empty", "teapot", "rate-limit", "login")


@query(
    "p15_parse_class",
    f"""SELECT page_id, class, class IN ('rate_limit', 'challenge', 'unknown') AS retryable
    FROM (SELECT page_id, {_PARSED} AS class FROM (SELECT page_id, lower(trim({list(_NAMES)}[page_id % 9 + 1], ' ')) AS name FROM pages))""",
)
def parse_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("page_id") % 9 + 1).cast("int"))
    cls = table(spark, sf_dir, "pages").select("page_id", web.parse_class(name).alias("class"))
    return cls.withColumn("retryable", web.retryable(F.col("class")))


@query(
    "p16_outcome_guard",
    f"""WITH {_PROBED} SELECT page_id, CASE WHEN class IS NOT NULL AND class <> 'gone' THEN 'blocked:' || class WHEN class = 'gone' THEN 'absent'
      WHEN strlen(prose) > 4194304 THEN 'blocked:unknown' WHEN strlen(prose) < 200 THEN 'blocked:empty' ELSE 'text' END AS outcome FROM probed""",
)
def outcome_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    cls = web.block_class(F.col("status"))
    gone = F.coalesce(cls == "gone", F.lit(False))
    return probed(spark, sf_dir).select("page_id", web.outcome(F.when(~gone, cls), gone, F.col("prose")).alias("outcome"))


_TEMPLATE = "https://books.example/{n}/part-{n:04}?x={y}"


@query(
    "p17_expand_template",
    "SELECT doc_id, 'https://books.example/' || doc_id || '/part-' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(4, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') || '?x={y}' AS url FROM documents",
)
def expand_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", web.expand_template(F.lit(_TEMPLATE), F.col("doc_id")).alias("url"))


_SITES = ("example.net", "tiontion.example.com", "example.org", "example.com")


@query(
    "p18_known_site",
    f"""WITH sites AS (SELECT unnest({list(_SITES)}) AS site, unnest(range(4)) AS pos), hosts AS (SELECT page_id, {_HOST} AS host FROM pages)
    SELECT page_id, host, arg_min(site, pos) AS site FROM hosts LEFT JOIN sites ON host = site OR ends_with(host, '.' || site) GROUP BY page_id, host""",
)
def known_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taleweave.operators.match import known_site as match

    sites = spark.createDataFrame([(s, k) for k, s in enumerate(_SITES)], "site string, pos int")
    hosts = table(spark, sf_dir, "pages").select("page_id", web.host(F.col("url")).alias("host"))
    return match(hosts, sites).select("page_id", "host", "site")


@query("s12_template_index", r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(regexp_replace(url, '^.*?://', ''), '^([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages),
    span AS (SELECT host, count(*) AS pages, min(page_id) AS first FROM h GROUP BY host)
    SELECT host, CAST(n AS BIGINT) AS n, 'https://' || host || '/' || CASE WHEN first % 2 = 0 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 5, '0') END AS url, false AS absent FROM (SELECT *, unnest(range(first, first + pages)) AS n FROM span)""")
def template_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site's template over its own range: as many chapters as it has pages, from its first one."""
    hosts = table(spark, sf_dir, "pages").select("page_id", web.host(F.col("url")).alias("host"))
    span = hosts.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first"))
    n = span.select("host", "first", F.explode(F.sequence("first", F.col("first") + F.col("pages") - 1)).alias("n"))
    plain, padded = (web.expand_template(F.lit(f"/{t}"), F.col("n")) for t in ("{n}", "{n:05}"))
    return n.select("host", "n", F.concat(F.lit("https://"), "host", F.when(F.col("first") % 2 == 0, plain).otherwise(padded)).alias("url"), F.lit(False).alias("absent"))


@query(
    "s13_discovered_index",
    """WITH listing AS (SELECT page_id AS n, url FROM pages WHERE page_id % 3 <> 0), wanted AS (SELECT unnest(range(lo, hi + 1)) AS n FROM (SELECT min(n) AS lo, max(n) AS hi FROM listing)), total AS (SELECT max(n) - 9 AS total FROM listing)
    SELECT n, CASE WHEN n > total THEN NULL ELSE url END AS url, n > total AS absent FROM wanted LEFT JOIN listing USING (n), total""",
)
def discovered_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taleweave.operators.index import densify

    listing = table(spark, sf_dir, "pages").where("page_id % 3 <> 0").select(F.col("page_id").alias("n"), "url")
    low, high = listing.agg(F.min("n"), F.max("n")).first()
    return densify(listing, low, high - low + 1, total=high - 9)


@query(
    "s14_index_reuse",
    """SELECT doc_id, CASE WHEN cnt = 0 THEN false WHEN hand THEN covers ELSE covers AND same END AS usable FROM (
      SELECT doc_id, doc_id % 4 AS cnt, doc_id % 3 = 0 AS hand, doc_id % 5 <> 0 AS same, 10 <= doc_id AND doc_id + 20 <= 210 AS covers FROM documents)""",
)
def index_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taleweave.operators.index import usable

    d, asked = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select("doc_id", usable(asked % 4, asked % 3 == 0, asked % 5 != 0, F.lit(10), F.lit(200), asked, F.lit(20)).alias("usable"))
