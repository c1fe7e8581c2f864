"""Token ids in fixed-width bit-packed files.

Documents are dealt by ranges of doc_id, encoded, and written in that order as raw files. Each id takes the fewest bits
that hold the largest id of the vocabulary. A file (little-endian throughout) is

    magic "TWBP", version, bits, ids per block, documents, ids            32 bytes
    doc_id of every document                                               int64
    first id of every document, and the number of ids                      uint64, documents + 1
    byte offset of every block in the payload, and the payload's length    uint64, blocks + 1
    payload: blocks of packed ids; every block starts on a byte

so that any id range is found by one division and unpacked by numpy without touching the rest of the file.

A task writes under a name of its own attempt and renames at the end; a task that runs again writes the same bytes, and
readers take only names without an attempt. Cases: null text encodes as empty text (the end id alone); null doc_id sorts
first and reads back as null; repeated rows are written one by one, those of one doc_id and text in any order; very long
texts are encoded whole and make their file as long as needed; an empty table writes no file; columns other than doc_id and
text are not looked at.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taleweave.scratch import fresh_path, written

MAGIC, VERSION, BLOCK, HEADER = b"TWBP", 1, 4096, 32
NO_ID = np.iinfo(np.int64).min
#: A file ends at the first document that brings it to so many ids.
FILE_IDS = 4_000_000


# ---- packing -----------------------------------------------------------------------------------------------------


def width_of(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids one after another, lowest bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data, bits: int, first: int, count: int) -> np.ndarray:
    """ids first .. first + count - 1 of packed data, as uint32."""
    raw = np.frombuffer(data, np.uint8)
    if bits == 16:
        return raw[2 * first : 2 * (first + count)].view("<u2").astype(np.uint32)
    at = np.arange(first, first + count, dtype=np.int64) * bits
    byte, raw = at >> 3, np.concatenate([raw, np.zeros(5, np.uint8)])
    word = np.zeros(count, np.uint64)
    for k in range((bits + 14) // 8):
        word |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def file_bytes(doc_ids: list[int], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    starts = np.zeros(len(lengths) + 1, "<u8")
    np.cumsum(lengths, out=starts[1:])
    blocks = [pack(ids[k : k + BLOCK], bits) for k in range(0, len(ids), BLOCK)]
    offsets = np.zeros(len(blocks) + 1, "<u8")
    np.cumsum([len(b) for b in blocks], out=offsets[1:])
    head = MAGIC + np.array([VERSION, bits, BLOCK], "<u4").tobytes() + np.array([len(doc_ids), len(ids)], "<u8").tobytes()
    return b"".join([head, np.asarray(doc_ids, "<i8").tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """A file's content; reading one document touches only the blocks that hold it."""

    def __init__(self, data: bytes) -> None:
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a packed token file")
        version, self.bits, self.block = (int(x) for x in np.frombuffer(data, "<u4", 3, 4))
        if version != VERSION:
            raise ValueError(f"version {version} of packed token files is not known")
        docs, self.n_ids = (int(x) for x in np.frombuffer(data, "<u8", 2, 16))
        self.doc_ids = np.frombuffer(data, "<i8", docs, HEADER)
        self.starts = np.frombuffer(data, "<u8", docs + 1, HEADER + 8 * docs).astype(np.int64)
        blocks = -(-self.n_ids // self.block)
        at = HEADER + 8 * docs + 8 * (docs + 1)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.payload = memoryview(data)[at + 8 * (blocks + 1) :]

    def ids(self, first: int, last: int) -> np.ndarray:
        parts = []
        for k in range(first // self.block, -(-last // self.block) if last > first else 0):
            low, high = max(first, k * self.block), min(last, (k + 1) * self.block)
            parts.append(unpack(self.payload[self.offsets[k] : self.offsets[k + 1]], self.bits, low - k * self.block, high - low))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


# ---- encoding ----------------------------------------------------------------------------------------------------

#: Letters of the Latin blocks: for text of these alone, NFC and lower-casing work letter by letter, and as no piece of the
#: vocabulary's split reaches over white space, every word between white space is encoded by itself. All other text, and
#: text with a special token's bracket, goes to the library whole.
PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-įı-ž‐-‧€]*")
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-ž]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\s0-9\xb2\xb3\xb9\xbc-\xbea-z\xaa\xb5\xba\xdf-\xf6\xf8-ž]+")


class Encoder:
    """Exact ids of whole texts. by_word: the vocabulary lower-cases and drops white space (see PLAIN), so the library is
    asked once per distinct piece, for all new pieces of a text together; otherwise every text goes to the library whole.

    Packed ids of words and pieces are kept up to MOST; when they are full the later half goes, as frequent words come
    early."""

    MOST, LONG = 600_000, 48

    def __init__(self, path: str, by_word: bool) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words: dict[str, bytes] | None = {} if by_word else None
        vocabulary = self.tokenizer.get_vocab() if by_word else {}
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of pieces of SPLIT: encoded as one text, cut after each token that ends a word."""
        ids = np.array(self.tokenizer.encode(" ".join(pieces), add_special_tokens=False).ids, "<u4")
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(cuts) != len(pieces) or cuts[-1] != 4 * len(ids):
            return [np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in pieces]
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        split = {w: SPLIT.findall(w) for w in new}
        known = self.words
        pieces = list({p for parts in split.values() for p in parts if p not in known})
        found = dict(zip(pieces, self._pieces(pieces), strict=True)) if pieces else {}
        for w, parts in split.items():
            if w not in found:
                found[w] = b"".join([found[p] if p in found else known[p] for p in parts])
        if len(known) + len(found) > self.MOST:
            self.words = dict(itertools.islice(known.items(), self.MOST // 2))
        self.words.update((w, ids) for w, ids in found.items() if len(w) < self.LONG)
        return found

    def __call__(self, text: str) -> bytes:
        """ids as little-endian uint32."""
        if self.words is None or "<|" in text or not PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.lower().split()
        known = self.words
        new = set(words).difference(known)
        if new:
            found = self._learn(list(new))
            return b"".join([found[w] if w in found else known[w] for w in words])
        return b"".join(map(known.__getitem__, words))


@functools.lru_cache(maxsize=1)
def kept_encoder(path: str, by_word: bool) -> Encoder:
    """One encoder per Python worker, so that its words serve all tasks that the worker runs."""
    return Encoder(path, by_word)


def splits_by_word(path: str) -> bool:
    """Whether the vocabulary file describes the split and the normaliser that Encoder's word path stands for."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = [x["pattern"].get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
    return kinds == ["NFC", "Replace", "Lowercase"] and split == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]


# ---- Spark jobs --------------------------------------------------------------------------------------------------


def write_token_files(documents: DataFrame, out: str, vocabulary_path: str, vocabulary: int, end_id: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files and returns their manifest: file (its name, in order of doc_id), docs, ids."""
    bits, by_word = width_of(vocabulary), splits_by_word(vocabulary_path)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = kept_encoder(vocabulary_path, by_word), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        attempt = TaskContext.get().taskAttemptId()
        fs, root = pafs.FileSystem.from_uri(out)
        docs: list[int] = []
        chunks: list[bytes] = []

        def flush():
            nonlocal number, docs, chunks
            name = f"part-{part:06d}-{number:05d}.tok"
            fs.create_dir(root, recursive=True)
            ids = np.frombuffer(b"".join(chunks), "<u4")
            with fs.open_output_stream(f"{root}/_{name}.{attempt}") as f:
                f.write(file_bytes(docs, [len(c) // 4 for c in chunks], ids, bits))
            fs.move(f"{root}/_{name}.{attempt}", f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [name], "docs": [len(docs)], "ids": [len(ids)]}, schema=schema)
            docs, chunks, number = [], [], number + 1
            return row

        schema = pa.schema([("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(NO_ID if doc_id is None else doc_id)
                chunks.append(encoder(text or "") + end)
                held += len(chunks[-1]) // 4
                if held >= file_ids:
                    yield flush()
                    held = 0
        if docs:
            yield flush()

    dealt = documents.select("doc_id", "text").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return written(dealt.mapInArrow(save, "file string, docs long, ids long"), "token-manifest")


def read_token_files(out: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    starts = manifest.select("file", (F.sum("ids").over(W.orderBy("file")) - F.col("ids")).alias("file_start"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tok").load(out)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(starts, "file").select("file_start", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = TokenFile(data)
                flat = memoryview(f.ids(0, f.n_ids).astype("<u4").tobytes())
                crcs = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(f.starts[:-1], f.starts[1:], strict=True)]
                ids = [None if d == NO_ID else d for d in f.doc_ids.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(f.starts[:-1] + start), pa.array(np.diff(f.starts)), pa.array(crcs, pa.int64())], schema=schema)

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def pack_documents(documents: DataFrame, vocabulary_path: str, vocabulary: int, end_id: int, out: str | None = None) -> DataFrame:
    """Writes the files (to a new folder of the shared scratch, unless out is given) and reads them back."""
    out = out or fresh_path(documents.sparkSession, "tokens")
    manifest = write_token_files(documents, out, vocabulary_path, vocabulary, end_id)
    if manifest.isEmpty():
        return manifest.select(F.lit(0).cast("long").alias("doc_id"), F.col("ids").alias("start"), F.col("ids").alias("n_tokens"), F.col("ids").alias("ids_crc32"))
    return read_token_files(out, manifest)
