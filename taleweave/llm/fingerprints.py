"""Fixed-size fingerprints of documents: one-permutation MinHash with optimal densification, packed low-order bits.

1. Each distinct shingle is hashed once. The hash range is cut into BINS bins and a bin's value is its least hash; an empty
   bin takes the value of the first non-empty bin that a fixed random sequence of its own names.
2. Of each bin's value, mixed with the bin's number, BITS low-order bits are kept, packed two bins a byte at four bits. The
   number keeps bins that copy one value from agreeing by chance all together.
3. Two sets of likeness J agree in a bin with probability J + (1 - J) / 2 ** BITS, so the share s of bins that agree
   estimates J without bias as (s - 2 ** -BITS) / (1 - 2 ** -BITS), cut to 0 and 1: likeness(). With 256 bins of four bits
   its standard deviation is at most 0.033, at 128 bytes a document.

A document's set are its shingles of five words (A-Z lower-cased, runs of non-space characters); fewer words are one
shingle. Texts that are null, empty or without words have the empty fingerprint, which is like itself (1) and unlike all
others (0). Equal texts have equal fingerprints, whatever their rows hold besides.

with_neighbours() deals the rows by ranges of doc_id, so texts are shuffled once and each task meets its rows in order.
Only the first and last text of each task leave it, and are matched by the task's number. Order: doc_id, rows without one
last, rows of one doc_id by the text's hash and the text; rows that repeat both stand next to each other and are split over
tasks by row number. Very long texts are taken whole, other columns are not looked at, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taleweave.llm.near_dup import _MUL, _mix, shingle_hashes
from taleweave.scratch import written

BINS, BITS, WIDTH = 256, 4, 5


class Fingerprinter:
    """Fingerprints of sorted distinct 64-bit hashes. bits: 1, 2, 4 or 8; bins: a multiple of 8 / bits."""

    def __init__(self, bins: int = BINS, bits: int = BITS) -> None:
        if bits not in (1, 2, 4, 8) or bins % (8 // bits):
            raise ValueError("bits must be 1, 2, 4 or 8 and fill whole bytes")
        self.bins, self.bits = bins, bits
        self.edges = np.array([-(-(k << 64) // bins) for k in range(bins)], np.uint64)
        self.own = _mix(np.arange(1, bins + 1, dtype=np.uint64))
        self.looks: list[np.ndarray] = []

    def _looks_at(self, attempt: int) -> np.ndarray:
        """The bin that each bin names in its k-th attempt."""
        while len(self.looks) <= attempt:
            seeds = np.arange(self.bins, dtype=np.uint64) + np.uint64(self.bins * len(self.looks) + 1)
            self.looks.append((_mix(seeds * _MUL[1]) % np.uint64(self.bins)).astype(np.int64))
        return self.looks[attempt]

    def values(self, hashes: np.ndarray) -> np.ndarray:
        """One hash per bin, without empty bins. hashes: sorted, not empty."""
        first = np.searchsorted(hashes, self.edges)
        full = first < np.append(first[1:], len(hashes))
        values = hashes[np.minimum(first, len(hashes) - 1)]
        empty, attempt = np.flatnonzero(~full), 0
        while len(empty):
            look = self._looks_at(attempt)[empty]
            found = full[look]
            values[empty[found]] = values[look[found]]
            empty, attempt = empty[~found], attempt + 1
        return values

    def fingerprint(self, hashes: np.ndarray) -> bytes:
        if not len(hashes):
            return b""
        low = (_mix(self.values(hashes) + self.own) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        per = 8 // self.bits
        shifted = low.reshape(-1, per) << (np.arange(per, dtype=np.uint8) * np.uint8(self.bits))
        return np.bitwise_or.reduce(shifted, axis=1).astype(np.uint8).tobytes()

    def of_text(self, text: str | None, width: int = WIDTH) -> bytes:
        return self.fingerprint(shingle_hashes((text or "").encode(), width))

    def likeness(self, a: bytes, b: bytes) -> float:
        """The estimated likeness of the two sets, corrected for bins that agree by chance."""
        if not a or not b:
            return float(a == b)
        differ = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
        parts = differ[:, None] >> (np.arange(8 // self.bits, dtype=np.uint8) * np.uint8(self.bits))
        share = float(np.mean((parts & np.uint8((1 << self.bits) - 1)) == 0))
        chance = 2.0**-self.bits
        return min(1.0, max(0.0, (share - chance) / (1 - chance)))


def fingerprints(documents: DataFrame, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (binary) of every row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Fingerprinter(bins, bits)
        for batch in batches:
            found = [own.of_text(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "fingerprint"])

    return documents.select("doc_id", "text").mapInArrow(sketch, "doc_id long, fingerprint binary")


def spliced(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by as many of the beginning of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_KIND = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = [x.split(" ")[0] for x in _KIND.split(", ")]


def _compared(own: Fingerprinter, width: int, doc_id: int | None, text: str, mark: bytes, following: str, next_mark: bytes) -> tuple:
    edited = spliced(text, following)
    edited_mark = mark if edited == text else own.of_text(edited, width)
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), mark, edited_mark, own.likeness(mark, edited_mark), own.likeness(mark, next_mark)


def _batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
    columns = [x.split(" ") for x in kind.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(columns)], names=[n for n, _ in columns])


def with_neighbours(documents: DataFrame, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (binary), near_edited and near_next; the
    edited text is spliced() with the next row's, after the last row the first one's."""
    inside = _KIND + ", part int, first boolean, last boolean, edge string"

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = Fingerprinter(bins, bits), TaskContext.get().partitionId()
        held: tuple | None = None  # the row whose follower has not come yet: doc_id, text, fingerprint, whether it is the first
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                mark = own.of_text(text, width)
                if held:
                    out.append((*_compared(own, width, held[0], held[1], held[2], text, mark), part, held[3], False, held[1] if held[3] else None))
                held = doc_id, text, mark, held is None
            yield _batch(out, inside)
        if held:
            yield _batch([(held[0], len(held[1]), None, held[2], None, None, None, part, held[3], True, held[1])], inside)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Fingerprinter(bins, bits)
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield _batch([_compared(own, width, *r) for r in rows], _KIND)

    plain = documents.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("n"))
    order = [F.col("doc_id").asc_nulls_last(), "h", "text", "n"]
    ranged = plain.repartitionByRange(F.col("doc_id").asc_nulls_last(), "h", "n").sortWithinPartitions(*order)
    met = written(ranged.select("doc_id", "text").mapInArrow(meet, inside), "fingerprints")

    firsts = met.where("first").select("part", F.col("edge").alias("following"), F.col("fingerprint").alias("next_mark"))
    tasks = met.where("first").select("part")  # one row per task
    turn = tasks.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())).alias("next_part"))
    lasts = met.where("last").select("part", "doc_id", F.col("edge").alias("text"), F.col("fingerprint").alias("mark"))
    ends = lasts.join(turn, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part")
    ends = ends.select("doc_id", "text", "mark", "following", "next_mark").mapInArrow(close, _KIND)
    return met.where("not last").select(*_NAMES).unionByName(ends)
