"""Exact token counts of every prefix of a text, by prefix dynamic programming.

The count is stored at every character of a text, so a truncation point or a budget question is a lookup and nothing is
encoded again. A text falls into words by the vocabulary's split; the counts inside a word come from PrefixSegmenter
(kept per distinct word), those before it add up. A prefix can split otherwise than the text that it begins:

- white space at the end of a prefix is one word, though in the text its last character may belong to the next word;
- the first letter of a two-letter contraction is a word of its own until the second follows;
- a special token's string is ordinary text until its last character.

Null and empty texts have no tokens and no prefixes. Repeated rows are counted one by one. Special strings in a text are
special tokens, as is the library's default; nothing is added, cut or padded.
Very long texts are counted whole; an empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from taleweave.llm.prefix_dp import PrefixSegmenter

#: Text of these characters alone is split by the pattern below; other text by the library's own splitter.
PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-ž‐-‧€]*")
_LETTER, _DIGIT = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ž", "0-9\xb2\xb3\xb9\xbc-\xbe"
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\\s{_LETTER}{_DIGIT}]+|\\s+(?!\\S)|\\s+")
SPACE = re.compile("[\t-\r \x85\xa0  -     　]{2,}")
CONTRACTIONS = ("'re", "'ve", "'ll")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: visible Latin-1 characters stand
    for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class PrefixCounter:
    MOST_WORDS, LONG = 600_000, 48

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splitter = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or splitter.get("type") != "ByteLevel" or not splitter["use_regex"] or splitter["add_prefix_space"] or spec["normalizer"] or model.get("end_of_word_suffix"):
            raise ValueError("only byte-level pair vocabularies without a normaliser are counted")
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        ranks = {(a, b): k for k, (a, b) in enumerate(pairs)}
        special = {x["content"] for x in spec["added_tokens"]}
        self.segmenter = PrefixSegmenter(set(model["vocab"]) - special, lambda a, b: ranks.get((a, b)))
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Counts at every byte of a word, as packed int32."""
        known = self.words.get(word)
        if known is None:
            text = word.encode().decode("latin-1").translate(self.letters)
            known = np.array(self.segmenter.counts(text), "<i4").tobytes()
            if len(word) <= self.LONG:
                if len(self.words) >= self.MOST_WORDS:
                    self.words.clear()
                self.words[word] = known
        return known

    def split(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def _segment(self, text: str) -> np.ndarray:
        """Tokens of every byte prefix of a text without special tokens, the last one exact for the text itself."""
        words = self.split(text)
        known, get = self.words.get, self._word
        parts = [known(w) or get(w) for w in words]
        out = np.frombuffer(bytearray().join(parts), "<i4")
        if len(parts) > 1:
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
            ends = np.cumsum(sizes)
            totals = np.cumsum(out[ends - 1], dtype=np.int32)
            out[ends[0] :] += np.repeat(totals[:-1], sizes[1:])
        return out

    def _exact(self, text: str, at: np.ndarray) -> np.ndarray:
        """at: counts of _segment; changes those of prefixes that split otherwise than the text."""
        spaces = list(SPACE.finditer(text))
        if not len(at) or not spaces and "'" not in text:
            return at
        total = int(at[-1])
        if len(at) == len(text):
            byte = lambda k: k
        else:
            raw = np.frombuffer(text.encode(), np.uint8)
            where = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)).tolist()
            byte = where.__getitem__
        for m in spaces:
            a, b = byte(m.start()), byte(m.end())
            at[a:b] = np.frombuffer(self._word(m.group()), "<i4") + (int(at[a - 1]) if a else 0)
        offset = 0
        for w in self.split(text) if "'" in text else ():
            if w in CONTRACTIONS:
                at[byte(offset) + 1] = (int(at[byte(offset) - 1]) if offset else 0) + 2
            offset += len(w)
        at[-1] = total
        return at

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of the first 1, 2, ... characters of text, each as the library gives them for that prefix alone."""
        pieces, last = [], 0
        before = 0
        for m in self.special.finditer(text) if self.special else ():
            pieces.append((text[last : m.start()], m.group()))
            last = m.end()
        pieces.append((text[last:], ""))
        out: list[np.ndarray] = []
        for plain, mark in pieces:
            part = self._exact(plain, self._segment(plain))
            if len(part) != len(plain):
                raw = np.frombuffer(plain.encode() + b"\0", np.uint8)
                part = part[(raw[1:] & 0xC0) != 0x80]
            out.append(part + before if before else part)
            if mark:
                own = [int(self._segment(plain + mark[:k])[-1]) for k in range(1, len(mark))]
                out.append(np.array(own, np.int32) + before)
                before += (int(part[-1]) if len(part) else 0) + 1
                out.append(np.array([before], np.int32))
        return np.concatenate(out) if len(out) > 1 else out[0]

    def total(self, text: str) -> int:
        counts = self.prefix_counts(text)
        return int(counts[-1]) if len(counts) else 0


@functools.lru_cache(maxsize=1)
def kept_counter(path: str) -> PrefixCounter:
    """One counter per Python worker, so that its words serve all tasks that the worker runs."""
    return PrefixCounter(path)


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most budget tokens. Counts may fall again, so the last one counts."""
    fit = np.flatnonzero(counts <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0


def count_tokens(documents: DataFrame, path: str, budgets: tuple[int, ...] = (512,), prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, fits (characters of the longest prefix within each budget), and with prefixes the
    count at every character."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_counter(path)
        for batch in batches:
            n_bytes, n_tokens, fits, every = [], [], [], []
            for text in batch.column(1).to_pylist():
                counts = counter.prefix_counts(text or "")
                n_bytes.append(len((text or "").encode()))
                n_tokens.append(int(counts[-1]) if len(counts) else 0)
                fits.append([longest_within(counts, b) if n_tokens[-1] > b else len(counts) for b in budgets])
                if prefixes:
                    every.append(counts.tolist())
            columns = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(fits, pa.list_(pa.int64()))]
            if prefixes:
                columns.append(pa.array(every, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "fits", "prefix_counts"][: len(columns)])

    kind = "doc_id long, n_bytes long, n_tokens long, fits array<long>" + ", prefix_counts array<int>" * prefixes
    return documents.select("doc_id", "text").mapInArrow(count, kind)
