"""Markup to prose: tags, entities, paragraphs. All plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that break a line, and the named entities that story pages use.
BLOCK_TAGS = ("br", "p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article", "main", "blockquote")
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"))
END_MARKS = ".!?…"
SPACE = r"[ \t\n\r\f\x0B]"


def remove_block(html: Column, tag: str) -> Column:
    """Without every <tag ...>...</tag>; one that never closes takes the rest of the text."""
    return F.regexp_replace(html, rf"(?is)<{tag}.*?(?:</{tag}[^>]*(?:>|\z)|\z)", "")


def strip_tags(html: Column) -> Column:
    """Tags out, a line break for each block tag. Every tag becomes its bare name between two control marks first, so
    that a '<' inside a tag is never taken for another one."""
    named = F.regexp_replace(html, r"<(/*)([^ \t\n\r\f\x0B/>]*)[^>]*(?:>|\z)", "\x01$2\x02")
    lines = F.regexp_replace(named, rf"(?i)\x01(?:{'|'.join(BLOCK_TAGS)})\x02", "\n")
    return F.regexp_replace(lines, "\x01[^\x02]*\x02", "")


def text_of(html: Column) -> Column:
    return strip_tags(remove_block(remove_block(html, "script"), "style"))


def decode_entities(text: Column) -> Column:
    """Named and numeric references, each decoded once. Code point 38 waits behind a mark so that it starts nothing new."""
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(0)))

    def code(entity: Column) -> Column:
        body = F.regexp_extract(entity, "&#[xX]?([0-9a-fA-F]+);", 1)
        return F.when(F.lower(F.substring(entity, 3, 1)) == "x", F.conv(body, 16, 10)).otherwise(F.conv(body, 10, 10)).cast("long")

    def plain(entity: Column) -> Column:
        n = code(entity)
        usable = n.between(0, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(n == 38, F.lit("\x03")).when(usable, char).otherwise(entity)

    text = F.aggregate(found, text, lambda s, e: F.replace(s, e, plain(e)))
    return F.replace(F.replace(text, F.lit("&amp;"), F.lit("&")), F.lit("\x03"), F.lit("&"))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def squeeze(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def fold_end_marks(line: Column) -> Column:
    """Spaced runs of end marks become their distinct marks in order, a dot as an ellipsis: '. . !' gives '…!'.

    The distinct marks of a run are found by removing any mark that occurs earlier in it, one mark after another."""
    run = rf"[.!?…](?:{SPACE}*[.!?…])*{SPACE}+[.!?…](?:{SPACE}*[.!?…])*"
    found = F.array_distinct(F.regexp_extract_all(line, F.lit(run), F.lit(0)))
    longest = F.array_sort(found, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).otherwise(F.when(a == b, 0).otherwise(1)))

    def compact(marks: Column) -> Column:
        letters = F.split(F.replace(F.regexp_replace(marks, rf"{SPACE}+", ""), F.lit("."), F.lit("…")), "")
        return F.array_join(F.array_distinct(letters), "")

    folded = F.aggregate(longest, line, lambda s, r: F.replace(s, r, compact(r)))
    return F.when(line.rlike(rf"[.!?…]{SPACE}+[.!?…]"), folded).otherwise(line)  # most lines have no such run


def prose(text: Column) -> Column:
    """Chapter shape: entities decoded, lines trimmed and folded, lines of end marks alone dropped, one blank line
    between paragraphs and a newline at the end; empty if nothing is left."""
    lines = F.transform(F.split(decode_entities(text), r"\r?\n"), lambda x: trim(fold_end_marks(trim(x))))
    kept = F.filter(lines, lambda x: ~x.rlike(rf"^(?:[.!?…]|{SPACE})*\z"))
    return F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "\n\n"), F.lit("\n"))).otherwise(F.lit(""))


def squeeze_lines(text: Column) -> Column:
    """Lines trimmed, at most one blank line in a row, none at the ends."""
    lines = F.array_join(F.transform(F.split(text, r"\r?\n"), trim), "\n")
    return F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), r"^\n+|\n+\z", "")


def without_comments(html: Column) -> Column:
    """Comments out, except inside script and style, whose text is not markup. Such an element is matched first at its
    place and put back by the group reference."""
    return F.regexp_replace(html, r"(?is)(<script.*?(?=</|\z)|<style.*?(?=</|\z))|<!--.*?(?:-->|\z)", "$1")
