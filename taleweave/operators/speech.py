"""Sentences, short chunks, balanced lines and repaired JSON for speech and captions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from taleweave.functions.markup import SPACE, trim
from taleweave.operators import cues
from taleweave.operators.slices import ROWS


def quoted_sentences(text: Column) -> Column:
    """Sentences that are not cut inside straight quotes or brackets, a closing mark going with its sentence; text whose
    quotes or brackets do not pair is cut as if there were none. Spans inside are hidden behind other marks while the
    text is cut."""
    quotes = F.regexp_count(text, F.lit('"')) % 2 == 0
    brackets = F.regexp_count(text, F.lit(r"[(\[{]")) == F.regexp_count(text, F.lit(r"[)\]}]"))

    def hidden(t: Column) -> Column:
        spans = F.array_distinct(F.regexp_extract_all(t, F.lit(r'"[^"]*"|\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}'), F.lit(0)))
        return F.aggregate(spans, t, lambda s, x: F.replace(s, x, F.translate(x, ".!?…", "\x04\x05\x06\x07")))

    def cut(t: Column) -> Column:
        marked = F.regexp_replace(t, rf"([.!?…](?:{SPACE}*[.!?…])*[\"'’”)\]}}]*)(?={SPACE}|\z)", "$1\x01")
        parts = F.transform(F.split(marked, "\x01"), lambda s: trim(F.translate(s, "\x04\x05\x06\x07", ".!?…")))
        return F.filter(parts, lambda s: s.rlike(r"[\p{L}\p{N}]"))

    return F.when(quotes & brackets, cut(hidden(text))).otherwise(cut(text))


@F.pandas_udf(ArrayType(StringType()))
def merged_short(chunks: pd.Series, gaps: pd.Series, least: pd.Series) -> pd.Series:
    """Chunks shorter than `least` join a neighbour, the shortest first: rather not over a paragraph, rather a short one."""
    return pd.Series([_merge(list(c), list(g), n) for c, g, n in zip(chunks, gaps, least, strict=True)])


def _merge(chunks: list[str], gaps: list[str], least: int) -> list[str]:
    while len(chunks) > 1:
        short = min(range(len(chunks)), key=lambda k: len(chunks[k]))
        if len(chunks[short]) >= least:
            break
        sides = [(gaps[g] == "para", len(chunks[o]), g) for o, g in ((short + 1, short), (short - 1, short - 1)) if 0 <= o < len(chunks)]
        at = min(sides, key=lambda s: s[:2])[2]
        chunks[at : at + 2] = [f"{chunks[at]} {chunks[at + 1]}"]
        del gaps[at]
    return chunks


@F.pandas_udf(ArrayType(StringType()))
def balanced(words: pd.Series, width: pd.Series) -> pd.Series:
    """As many rows as greedy filling needs, of the least sum of squared widths, none wider than asked."""
    return pd.Series([_balance(list(w), n) for w, n in zip(words, width, strict=True)])


def _balance(words: list[str], width: int) -> list[str]:
    ends = cues.balanced([len(w) for w in words], 1, width)
    return [" ".join(words[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


@F.pandas_udf(StringType())
def repaired_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The document as compact JSON after small repairs (fences, raw controls, trailing commas, stray quotes, one level of
    escaping too much); null if that is not enough. A batch is answered in slices."""
    for text in texts:
        for at in range(0, len(text), ROWS):
            yield pd.Series([_repair(t) for t in text.iloc[at : at + ROWS]], dtype=object)


def _repair(text: str | None) -> str | None:
    raw = re.sub(r"^﻿*\s*(?:```json)?|```\s*\Z", "", text or "").strip()
    for body in (raw, raw.replace('\\"', '"').replace("\\n", "\n")):
        while True:  # every repair takes a comma or a bare quote away
            try:
                return json.dumps(json.loads(body, strict=False), ensure_ascii=False, separators=(",", ":"))
            except json.JSONDecodeError as broken:
                fixed = re.sub(r",(\s*[}\]])", r"\1", body)
                if fixed == body:
                    at = body.rfind('"', 0, broken.pos)
                    inside = at > 0 and body[at - 1] != "\\" and re.match(r"\s*[^\s,:}\]]", body[broken.pos :])
                    fixed = f"{body[:at]}\\{body[at:]}" if inside else body
                if fixed == body:
                    break
                body = fixed
    return None
