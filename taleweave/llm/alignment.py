"""Groups of tokens in which two tokenizers cover the same bytes, and how often their ids meet in a corpus.

1. Each byte of a text is labelled by what ends there: no token, a token of A, one of B, or both ('.', 'a', 'b', 'c').
   Scanning the labels for spans up to each 'c' gives the groups; the labels in a span count its tokens of A and of B.
   Within a span every label but '.' ends one stretch that one token of A and one of B share: a link.
2. A text falls into segments, each white space and what follows up to the next white space. No token of a byte-level
   vocabulary that splits words crosses the end of a segment, nor does a piece of B unless a piece of its vocabulary goes on
   with that white space; so segments are encoded and scanned one by one, and recent ones are kept by each task. Texts with
   such white space (carriage returns, for one), with any but the six ASCII characters, or with the piece model's own space
   mark are one segment.
3. In how many documents an id pair is linked is added up by a shuffle of partial sums, at most one row per pair and
   PAIRS_HELD pairs met by a task. The highest count of an id of A is a second sum over at most its vocabulary.
4. Documents keep their distinct pairs with the number of links, packed. The pairs of most documents, at most DICTIONARY,
   found by a histogram of counts, go to every task; only the others, which few documents hold, are joined by a shuffle.

A's token bytes are its byte-level letters decoded. B's are its pieces in UTF-8, with the mark U+2581 as a space and <0xHH>
as a byte; B puts a space before the text itself, and so it is put before the text for A. Special strings in texts are plain
text. A text that is null or empty, or whose joined bytes of A or B differ from space + text, has no tokens. Rows are
documents one by one, also those that repeat; rows without doc_id count too. Very long texts are taken whole, other columns
are not looked at, an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleweave.llm.token_counts import byte_letters
from taleweave.scratch import written

DICTIONARY, PAIRS_HELD = 262_144, 2_000_000
#: White space and spaces of which the tokenizers, or Python, may think differently, and the mark of the piece model.
ODD = re.compile("[\x00\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤▁　﻿]")
SEGMENT = re.compile(r"\s*\S+|\s+")
SPAN = re.compile(rb"[^c]*c")
MARK = "\u2581"


class Segment(NamedTuple):
    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    digest: bytes  # a1,a2|b1;a3|b2,b3
    pairs: bytes  # one number (A id * ids of B + B id) per link, 8 bytes each


def labels(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> bytes:
    """One label per byte. ends: offsets behind each token's last byte."""
    marks = np.zeros(size, np.uint8)
    marks[ends_a - 1] |= 1
    marks[ends_b - 1] |= 2
    return np.frombuffer(b".abc", np.uint8)[marks].tobytes()


def groups(label: bytes) -> list[tuple[int, int]]:
    """Tokens of A and of B in each span up to a place where both end."""
    return [(s.count(b"a") + 1, s.count(b"b") + 1) for s in SPAN.findall(label)]


def links(label: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of A and of B of every pair that shares bytes."""
    marks = np.frombuffer(label.translate(bytes.maketrans(b"abc", b"\1\2\3"), b"."), np.uint8)
    in_a, in_b = (marks & 1).astype(np.int64), (marks >> 1).astype(np.int64)
    return np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b


class Aligner:
    #: Segments that are kept, their characters at most, and the characters that are encoded or cut at once.
    MOST_SEGMENTS, LONG, CHUNK, GROUP = 500_000, 64, 100_000, 2_000_000

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letter = {c: b for b, c in byte_letters().items()}
        tokens = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(tokens.values(), default=-1) + 1)
        for t, k in tokens.items():
            self.bytes_a[k] = bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(MARK, " ").encode() for p in pieces]
        self.sizes = [np.array([len(x) for x in known], np.int64) for known in (self.bytes_a, self.bytes_b)]
        self.lone = self.b.piece_to_id(MARK)
        crossed = {m for p in pieces for m in re.findall(r"(?<=\S)\s|(?<= )[^\S ]", p.replace(MARK, " "))}
        self.apart = " " not in crossed and pieces[self.lone] == MARK
        self.odd = re.compile("|".join([ODD.pattern, *map(re.escape, sorted(crossed))]))
        self.n_b = len(pieces)
        self.known: dict[str, Segment | None] = {}

    def ids(self, part: str) -> tuple[list[int], list[int]]:
        """Ids of both tokenizers for a part of space + text."""
        of_a = self.a.encode(part, add_special_tokens=False).ids
        if part[0] == " ":
            return of_a, self.b.encode(part[1:]) if len(part) > 1 else [self.lone]
        of_b = self.b.encode(part)  # the model's own space comes first, and merges with nothing before white space
        return of_a, of_b[1:] if of_b[0] == self.lone else []

    def align(self, segments: list[str]) -> list[Segment | None]:
        """Of segments that follow each other; None for one whose tokens' bytes are not its own."""
        whole = "".join(segments)
        raw, ids = whole.encode(), self.ids(whole)
        ends = np.cumsum([len(s.encode()) for s in segments])
        right = all(b"".join([known[k] for k in own]) == raw for known, own in zip((self.bytes_a, self.bytes_b), ids, strict=True))
        if right:
            (of_a, of_b), (ends_a, ends_b) = (np.array(x, np.int64) for x in ids), (np.cumsum(n[x]) for n, x in zip(self.sizes, ids, strict=True))
            label = labels(ends_a, ends_b, len(raw))
            right = all(label[e - 1] == 99 for e in ends.tolist())
        if not right:
            return [None] if len(segments) == 1 else [x for s in segments for x in self.align([s])]
        (at_a, at_b), where = links(label), np.flatnonzero(np.frombuffer(label, np.uint8) != 46)
        pairs = of_a[at_a] * self.n_b + of_b[at_b]
        text_a, text_b, parts, i, j = list(map(str, ids[0])), list(map(str, ids[1])), [], 0, 0
        for m, n in groups(label):
            parts.append(f"{text_a[i]}|{text_b[j]}" if m == n == 1 else ",".join(text_a[i : i + m]) + "|" + ",".join(text_b[j : j + n]))
            i, j = i + m, j + n
        both = where[np.frombuffer(label, np.uint8)[where] == 99]
        cuts = [np.searchsorted(x, ends - 1) + 1 for x in (ends_a - 1, ends_b - 1, both, where)]
        counts = [np.diff(c, prepend=0).tolist() for c in cuts]
        out, g, x, packed = [], 0, 0, pairs.tobytes()
        for a, b, n_groups, n_links in zip(*counts, strict=True):
            out.append(Segment(a, b, n_groups, n_links, ";".join(parts[g : g + n_groups]).encode(), packed[8 * x : 8 * (x + n_links)]))
            g, x = g + n_groups, x + n_links
        return out

    def _learn(self, segments: list[str]) -> dict[str, Segment | None]:
        """Segments by their text, encoded many at once; what ends in white space would run into the next one."""
        found, chunk, size = {}, [], 0
        for s in segments:
            if s[-1].isspace():
                found[s] = self.align([s])[0]
                continue
            chunk.append(s)
            size += len(s)
            if size >= self.CHUNK:
                found.update(zip(chunk, self.align(chunk), strict=True))
                chunk, size = [], 0
        if chunk:
            found.update(zip(chunk, self.align(chunk), strict=True))
        return found

    def many(self, texts: list[str | None]) -> Iterator[list[Segment]]:
        """The segments of space + text for each text; none if it has no tokens."""
        cut, size = [], 0
        for text in texts:
            whole = " " + (text or "")
            cut.append([] if not text else [whole] if not self.apart or self.odd.search(text) else SEGMENT.findall(whole))
            size += len(whole)
            if size >= self.GROUP:
                yield from self._looked_up(cut)
                cut, size = [], 0
        yield from self._looked_up(cut)

    def _looked_up(self, cut: list[list[str]]) -> Iterator[list[Segment]]:
        if len(self.known) > self.MOST_SEGMENTS:
            self.known.clear()
        known = self.known
        missing = {s for c in cut for s in c if s not in known}
        long = self._learn([s for s in missing if len(s) > self.LONG])
        known.update(self._learn([s for s in missing if len(s) <= self.LONG]))
        for c in cut:
            out = [known[s] if s in known else long[s] for s in c]
            yield [] if None in out else out

    def segments(self, text: str | None) -> list[Segment]:
        return next(self.many([text]))


@functools.lru_cache(maxsize=1)
def kept_aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per Python worker, so that its segments serve all tasks that the worker runs."""
    return Aligner(path_a, path_b)


def aligned(documents: DataFrame, path_a: str, path_b: str, texts: bool = False) -> DataFrame:
    """row (unique), doc_id, n_a, n_b, n_groups, n_links, groups_sha256 (of the groups as a1,a2|b1;a3|b2,b3; '' without
    tokens), pairs (distinct id pairs, packed int64) and times (links of each, packed int64) of every document, and with
    texts the groups themselves."""
    kinds = [("row", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())]
    schema = pa.schema(kinds + [("groups", pa.string())] * texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = kept_aligner(path_a, path_b), TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc_id, found in zip(batch.column(0).to_pylist(), aligner.many(batch.column(1).to_pylist()), strict=True):
                sums = map(sum, list(zip(*found, strict=True))[:4]) if found else (0, 0, 0, 0)
                digest = b";".join([s.digest for s in found])
                pairs, times = np.unique(np.frombuffer(b"".join([s.pairs for s in found]), np.int64), return_counts=True)
                values = [row, doc_id, *sums, hashlib.sha256(digest).hexdigest() if found else "", pairs.astype("<i8").tobytes(), times.astype("<i8").tobytes(), digest.decode()]
                for column, x in zip(out, values, strict=False):
                    column.append(x)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, schema.types, strict=True)], schema=schema)

    kind = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    return documents.select("doc_id", "text").mapInArrow(run, kind + ", groups string" * texts)


def pair_counts(found: DataFrame, n_b: int) -> DataFrame:
    """pair, docs (documents that hold it linked), best (whether no pair of its A id is in more). found: pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def added() -> pa.RecordBatch:
            pairs, docs = np.unique(np.frombuffer(b"".join(held), "<i8"), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(docs, pa.int64())], names=["pair", "docs"])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                held.append(x)
                size += len(x) >> 3
                if size >= PAIRS_HELD:
                    yield added()
                    held, size = [], 0
        yield added()

    counts = found.select("pairs").mapInArrow(count, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = written(counts, "pair-counts").withColumn("a", F.expr(f"pair div {n_b}"))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return written(counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "pairs")


def frequent(counts: DataFrame, most: int = DICTIONARY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pair (ascending), docs and best of at most `most` pairs: all that are in as many documents as the least of them, by
    a histogram of counts in steps of a sixteenth of a power of two."""
    level = F.floor(F.log2("docs") * 16).cast("int")
    total, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most 1,008 rows
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    rows = [] if least is None else counts.where(level >= least).select("pair", "docs", "best").collect()
    rows.sort()
    return tuple(np.array([r[k] for r in rows], t) for k, t in enumerate((np.int64, np.int64, bool)))


def correspondences(documents: DataFrame, path_a: str, path_b: str, dictionary: int = DICTIONARY) -> DataFrame:
    """Per row of documents: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many documents as any of
    its A id), count_sum (documents of the pair, added up over the links) and groups_sha256."""
    import sentencepiece

    found = written(aligned(documents, path_a, path_b), "alignments")
    counts = pair_counts(found, sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size())
    sent = documents.sparkSession.sparkContext.broadcast(frequent(counts, dictionary))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, best = sent.value
        for batch in batches:
            n_best, count_sum, rare = [], [], []
            for pairs, times in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
                p, t = np.frombuffer(pairs, "<i8"), np.frombuffer(times, "<i8")
                at = np.searchsorted(known, p)
                hit = np.append(known, -1)[at] == p
                at, n = at[hit], t[hit]
                n_best.append(int(n[best[at]].sum()))
                count_sum.append(int((n * docs[at]).sum()))
                rare.append(list(zip(p[~hit].tolist(), t[~hit].tolist(), strict=True)))
            kind = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))
            columns = [*batch.columns[:6], batch.column(8), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), pa.array([[{"pair": a, "times": b} for a, b in r] for r in rare], kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "rare"])

    kind = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rare array<struct<pair long, times long>>"
    order = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "pairs", "times", "groups_sha256"]
    met = written(found.select(*order).mapInArrow(look_up, kind), "pairs-met")
    others = met.select("row", F.inline("rare")).join(counts, "pair").groupBy("row")
    others = others.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("docs")).alias("more_sum"))
    whole = met.drop("rare").join(others, "row", "left")
    sums = [(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256")
