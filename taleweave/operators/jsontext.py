"""Members of JSON texts by their place, and edits that leave every other character as it is.

A text is scanned once for the members of its outermost object or the items of its outermost array; a value is found by its
end, not read. Edits are replacements of stretches, put together again with column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleweave.operators.slices import slices

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+|"', re.S)
MEMBER = "array<struct<key: string, at: int, start: int, end: int>>"


def scan(text: str) -> list[tuple[str | None, int, int, int]] | None:
    """(key, start of the member, start and end of its value) in order; array items have no key. None if the text is no
    object or array, or is broken at its outermost level."""
    tokens = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
    if not tokens or tokens[0][0] not in "{[":
        return None
    closing, k, out = {"{": "}", "[": "]"}, 1, []
    shut = closing[tokens[0][0]]
    while k < len(tokens):
        if tokens[k][0] == shut and (not out or tokens[k - 1][0] != ","):
            return out
        key, at = None, tokens[k][1]
        if shut == "}":
            if tokens[k][0][0] != '"' or len(tokens[k][0]) < 2 or k + 1 >= len(tokens) or tokens[k + 1][0] != ":":
                return None
            try:
                key = json.loads(tokens[k][0], strict=False)
            except ValueError:
                return None
            k += 2
        open_, start = [], k
        while k < len(tokens):
            t = tokens[k][0]
            if t in closing:
                open_.append(closing[t])
            elif t in "]}":
                if not open_ or open_[-1] != t:
                    break
                open_.pop()
            elif not open_ and t in ",:":
                break
            elif not open_ and k > start or t == '"':
                return None  # two values side by side, or a quote without an end
            k += 1
            if not open_:
                break
        if k == start or open_ or k >= len(tokens) or tokens[k][0] not in (",", shut):
            return None
        out.append((key, at, tokens[start][1], tokens[k - 1][2]))
        if tokens[k][0] == shut:
            return out
        k += 1
    return None


def members(texts: DataFrame) -> DataFrame:
    """id, text and found: the members of each text, see MEMBER (places in characters); null for texts that scan() refuses.
    texts: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("key", pa.string()), ("at", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, 1):
            found = [scan(t) if t is not None else None for t in batch.column(1).to_pylist()]
            rows = [f and [dict(zip(("key", "at", "start", "end"), m, strict=True)) for m in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind)], names=["id", "text", "found"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(run, f"id {kind}, text string, found {MEMBER}")


def value_of(text: Column, member: Column) -> Column:
    return text.substr(member["start"] + 1, member["end"] - member["start"])


def edited(found: DataFrame, edits: DataFrame, indent: str = "  ") -> DataFrame:
    """id, text after edits (id, key, value: JSON; null takes the member out). Of keys that repeat, the last is meant. A new
    key goes behind the last member, on a line of its own; a member that goes takes the comma with it. Texts that were
    refused come back as they are. found: as members() gives it; edits: one a key of a text."""
    wanted = edits.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("edits"))
    met = found.join(wanted, "id", "left")
    last = F.map_from_entries(F.transform(F.array_distinct(F.transform("found", lambda m: m["key"])), lambda k: F.struct(k, F.array_max(F.transform(F.filter("found", lambda m: m["key"] == k), lambda m: m["start"])))))
    met = met.withColumn("last", F.when(F.col("found").isNotNull(), last))

    def touched(m: Column) -> Column:
        return F.map_contains_key(F.col("edits"), m["key"]) & (F.element_at("last", m["key"]) == m["start"])

    kept = F.filter("found", lambda m: ~(touched(m) & F.element_at("edits", m["key"]).isNull()))
    body = F.transform(kept, lambda m: F.when(touched(m), F.concat(F.col("text").substr(m["at"] + 1, m["start"] - m["at"]), F.element_at("edits", m["key"]))).otherwise(F.col("text").substr(m["at"] + 1, m["end"] - m["at"])))
    gone = F.size(kept) < F.size("found")
    fresh = F.filter(F.array_sort(F.map_keys("edits")), lambda k: ~F.exists("found", lambda m: m["key"] == k) & F.element_at("edits", k).isNotNull())
    lines = F.transform(fresh, lambda k: F.concat(F.lit(indent), F.concat(F.lit('"'), F.regexp_replace(k, r'(["\\])', r"\\$1"), F.lit('": ')), F.element_at("edits", k)))
    met = met.withColumns({"body": body, "gone": gone, "lines": lines})
    first, stop = F.element_at("found", 1), F.element_at("found", -1)
    head = F.when(F.size("found") > 0, F.col("text").substr(F.lit(1), first["at"])).otherwise(F.regexp_extract("text", r"\A(\s*\{)", 1))
    tail = F.when(F.size("found") > 0, F.col("text").substr(stop["end"] + 1, F.length("text"))).otherwise(F.regexp_extract("text", r"(?s)\A\s*\{(.*)\z", 1))

    def between(k: Column) -> Column:
        """The text between members k - 1 and k (from 1) of the old ones."""
        a, b = F.element_at("found", k - 1), F.element_at("found", k)
        return F.col("text").substr(a["end"] + 1, b["at"] - a["end"])

    each = F.transform("body", lambda b, k: F.when(k == 0, b).otherwise(F.concat(F.when(F.col("gone"), F.concat(F.lit(","), F.regexp_extract(between(F.lit(2)), r",(\s*)", 1))).otherwise(between(k + 1)), b)))
    joined = F.concat(F.array_join(each, ""), F.when(F.size("lines") > 0, F.concat(F.when(F.size("body") > 0, F.lit(",\n")).otherwise(F.lit("\n")), F.array_join("lines", ",\n"))).otherwise(F.lit("")))
    closing = F.when((F.size("lines") > 0) & ~tail.contains("\n"), F.concat(F.lit("\n"), tail)).otherwise(tail)
    return met.select("id", F.when(F.col("found").isNull() | F.col("edits").isNull(), F.col("text")).otherwise(F.concat(head, joined, closing)).alias("text"))
