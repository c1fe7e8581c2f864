"""Addresses, answers and refusals of web pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of a chapter in bytes, interstitial markers, synonyms of refusal classes.
MIN_BYTES, MAX_BYTES = 200, 4 * 1024 * 1024
CLASSES = {
    "challenge": ("challenge", "captcha", "cloudflare"),
    "rate_limit": ("rate_limit", "rate-limit", "ratelimit", "429"),
    "login_required": ("login_required", "login", "paywall"),
    "js_required": ("js_required", "js"),
    "gone": ("gone", "404", "410"),
    "empty": ("empty",),
}
RETRYABLE = ("rate_limit", "challenge", "unknown")


def host(url: Column) -> Column:
    """Host without scheme, user, port and leading www., lower-cased."""
    rest = F.regexp_replace(url, "^.*?://", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    bare = F.regexp_extract(F.regexp_replace(authority, "^.*@", ""), "^([^:]*)", 1)
    return F.regexp_replace(F.lower(bare), r"^www\.", "")


def block_class(status: Column) -> Column:
    """Class of a refusal by status; null for success."""
    return (
        F.when(status.between(200, 299), F.lit(None).cast("string")).when(status.isin(404, 410), "gone").when(status == 429, "rate_limit")
        .when(status.isin(401, 402, 407), "login_required").when(status.isin(403, 503), "challenge").otherwise("unknown")
    )


def retry_after(status: Column) -> Column:
    return F.when(status == 429, 30)


def parse_class(name: Column) -> Column:
    key, out = F.lower(F.trim(name)), F.lit("unknown")
    for cls, synonyms in reversed(CLASSES.items()):
        out = F.when(key.isin(*synonyms), cls).otherwise(out)
    return out


def retryable(cls: Column) -> Column:
    return cls.isin(*RETRYABLE)


def outcome(blocked: Column, absent: Column, text: Column) -> Column:
    """Refusal before absence before text; text that is too short or too long is a refusal."""
    size = F.octet_length(text)
    return (
        F.when(blocked.isNotNull(), F.concat(F.lit("blocked:"), blocked)).when(absent, "absent").when(text.isNull(), "invalid")
        .when(size > MAX_BYTES, "blocked:unknown").when(size < MIN_BYTES, "blocked:empty").otherwise("text")
    )


def verdict(status: Column, challenged: Column, text: Column) -> Column:
    """What a probe of a page says, first matching rule."""
    size = F.octet_length(text)
    return (
        F.when(status == 0, "unreachable").when(challenged, "cloudflare").when(block_class(status).isNotNull(), "refused")
        .when(size == 0, "no_container").when(size < MIN_BYTES, "too_short").when(size > MAX_BYTES, "too_long").otherwise("ok")
    )


def expand_template(template: Column, n: Column) -> Column:
    """{n} and zero-padded {n:0W} (W up to 32) replaced by n; other braces stay."""
    widths = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{n:0([1-9]|[12][0-9]|3[0-2])\}"), F.lit(1)))
    digits = n.cast("string")
    padded = lambda w: F.lpad(digits, F.greatest(w.cast("int"), F.length(digits)), F.lit("0"))
    out = F.aggregate(widths, template, lambda s, w: F.replace(s, F.concat(F.lit("{n:0"), w, F.lit("}")), padded(w)))
    return F.replace(out, F.lit("{n}"), digits)
