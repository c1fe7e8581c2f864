"""Vector codes by product quantisation, with codebooks from delta-maintained Lloyd rounds.

A vector is cut into equal consecutive parts; each part position has a codebook of its own, and a vector's code names the
nearest entry of every part (squared Euclidean distance, ties to the lower index). All arithmetic is in whole numbers.

1. Each codebook starts as that part of the `entries` smallest ids' vectors (rows of one id by their components, rows
   without an id last), in ascending order.
2. A round is one pass over the written table of the round before: every task assigns its vectors' parts anew, writes each
   vector with its assignment, and adds up, for the parts whose assignment differs from the written one, plus one vector
   at the new entry and minus one at the old. A task hands on at most one row per part and entry, and none for entries
   without a change; only those rows are shuffled.
3. The running sums (count and component sums per part and entry, parts x entries rows in all) are a written table too:
   the old ones and the changes added up. An entry becomes the componentwise floor of sum / count; entries without
   members stay. The codebooks, entries x dimensions numbers, go to the driver and to every task.
4. Each part is assigned a last time by the final codebooks.

Every table is written, so a lost executor costs the tasks it ran. A round reads the table of the round before only, which
is then deleted.

Cases: vectors that are null or hold a null or non-finite component take no part, nor do vectors of another length than the
first codebook's, or whose length the parts do not divide. Fewer vectors than entries make smaller codebooks; no vectors
give no rows. Rows that repeat an id are coded each. Null ids and labels are kept, null labels add up together. Floors of
components saturate at +-2 ** 62; where distances leave the range in which doubles are exact, whole numbers of any size
take over, and errors saturate at 2 ** 63 - 1. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleweave.scratch import discard, fresh_path, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Inner products of doubles are exact up to here.
EXACT, LARGEST = float(2**53), 2**63 - 1
#: The rows of one label are added up and met in so many parts.
SALTS = 64


@dataclass
class Codebooks:
    """entries: (parts, entries, width) whole numbers (int64, or of any size if large)."""

    entries: np.ndarray

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.entries.shape

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry per (vector, part), and its squared distance."""
        parts, _, width = self.shape
        cut = vectors.reshape(len(vectors), parts, width).transpose(1, 0, 2)
        peak = max((float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (vectors, self.entries)), default=0.0)
        if 4 * peak * peak * max(width, 1) < EXACT:
            x, c = cut.astype(np.float64), self.entries.astype(np.float64)
            far = (c * c).sum(axis=2)[:, None, :] - 2 * (x @ c.transpose(0, 2, 1))
            at = far.argmin(axis=2)  # the first of equal ones
            near = np.take_along_axis(far, at[:, :, None], axis=2)[:, :, 0] + (x * x).sum(axis=2)
            return at.T, near.T.astype(np.int64)
        x, c = cut.astype(object), self.entries.astype(object)
        at, near = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], object)
        for p in range(parts):
            for i in range(x.shape[1]):
                all_far = [int(((x[p, i] - e) ** 2).sum()) for e in c[p]]
                near[p, i] = min(all_far)
                at[p, i] = all_far.index(near[p, i])
        return at.T, near.T

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """The codebooks after a round. sums: (part, entry) to count and component sums."""
        new = self.entries.astype(object)
        for (part, entry), (n, total) in sums.items():
            if n > 0:
                new[part, entry] = [int(s) // n for s in total]
        return Codebooks(new.astype(np.int64))

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and place within the part, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (floor(scale * x) of every component), without vectors that are null or hold a null or non-finite
    component."""
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    floors = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(2.0**62)), F.lit(-(2.0**62)))))
    return embeddings.where(whole).select("vec_id", "label", floors.alias("v"))


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The vectors of the smallest ids, cut into parts; None without vectors."""

    def smallest(usable: DataFrame) -> list[list[int]]:
        return [r["v"] for r in usable.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]

    rows = smallest(vectors.where(F.size("v") % parts == 0))
    if any(len(v) != len(rows[0]) for v in rows):
        rows = smallest(vectors.where(F.size("v") == len(rows[0])))
    return Codebooks(np.array(rows, np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2).copy()) if rows else None


_ROW = "vec_id long, label long, x binary, code binary, error decimal(38,0), part int, entry int, n long, sums array<decimal(38,0)>"
_SCHEMA = pa.schema(
    [("vec_id", pa.int64()), ("label", pa.int64()), ("x", pa.binary()), ("code", pa.binary()), ("error", pa.decimal128(38)), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38)))]
)


def _packed(vectors: np.ndarray) -> list[bytes]:
    """Each vector in the fewest bytes a component of 2, 4 and 8 that hold the batch."""
    peak = int(np.abs(vectors).max(initial=0))
    kind = "<i2" if peak < 2**15 else "<i4" if peak < 2**31 else "<i8"
    return [v.tobytes() for v in vectors.astype(kind)]


def _unpacked(packed: list[bytes], dims: int) -> np.ndarray:
    """Vectors of one batch of _packed(), which may come from several."""
    by_width = {w: [k for k, x in enumerate(packed) if len(x) == w * dims] for w in (2, 4, 8)}
    out = np.zeros((len(packed), dims), np.int64)
    for w, rows in by_width.items():
        if rows and dims:
            out[rows] = np.frombuffer(b"".join(packed[k] for k in rows), f"<i{w}").reshape(-1, dims)
    return out


def assigned(rows: DataFrame, books: Codebooks, deltas: bool = True) -> DataFrame:
    """rows (vec_id, label, x, code) with the code by these codebooks and, for parts whose code differs from the row's,
    one row per (part, entry) and task with the change of its count and sums. Those rows alone have a part."""
    parts, n_entries, width = books.shape
    kind = "u1" if n_entries <= 256 else "<u4"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, n_entries), np.int64)
        sums = np.zeros((parts, n_entries, width), object)
        for batch in batches:
            ids, labels, packed, before = (c.to_pylist() for c in batch.columns)
            vectors = _unpacked(packed, parts * width)
            code, error = books.assign(vectors)
            if deltas:
                cut = vectors.reshape(len(vectors), parts, width)
                old = np.array([np.frombuffer(b, kind) if b is not None else np.full(parts, -1) for b in before], np.int64).reshape(len(vectors), parts)
                for sign, entry, changed in ((1, code, old != code), (-1, old, (old != code) & (old >= 0))):
                    row, part = np.nonzero(changed)
                    at = entry[row, part] + part * n_entries
                    counts += sign * np.bincount(at, minlength=parts * n_entries).reshape(parts, n_entries)
                    order = np.argsort(at, kind="stable")
                    heads = np.flatnonzero(np.append(True, np.diff(at[order]) != 0)) if len(at) else []
                    moved = cut[row, part][order]
                    if len(at) and width:
                        large = float(np.abs(moved).max(initial=0)) * len(at) >= 2.0**62
                        totals = np.add.reduceat(moved.astype(object) if large else moved, heads, axis=0)
                        for k, total in zip(at[order][heads].tolist(), totals, strict=True):
                            sums[k // n_entries, k % n_entries] += sign * total.astype(object)
            n = len(ids)
            codes = [c.tobytes() for c in code.astype(kind)]
            errors = list(map(int, error.sum(axis=1)))
            columns = [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(packed, pa.binary()), pa.array(codes, pa.binary()), pa.array(errors, pa.decimal128(38)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.decimal128(38)))]
            yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)
        if deltas:
            changed = [(p, e) for p in range(parts) for e in range(n_entries) if counts[p, e] or any(sums[p, e])]
            empty = [pa.nulls(len(changed), t) for t in _SCHEMA.types[:5]]
            found = [pa.array([p for p, _ in changed], pa.int32()), pa.array([e for _, e in changed], pa.int32()), pa.array([int(counts[k]) for k in changed], pa.int64()), pa.array([[int(s) for s in sums[k]] for k in changed], pa.list_(pa.decimal128(38)))]
            yield pa.RecordBatch.from_arrays([*empty, *found], schema=_SCHEMA)

    return rows.select("vec_id", "label", "x", "code").mapInArrow(assign, _ROW)


def added(sums: DataFrame, width: int) -> DataFrame:
    """part, entry, n, sums added up over rows of the same part and entry."""
    each = [F.sum(F.col("sums")[k]).cast("decimal(38,0)").alias(f"s{k}") for k in range(width)]
    found = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each)
    return found.select("part", "entry", "n", F.array(*[F.col(f"s{k}") for k in range(width)]).cast("array<decimal(38,0)>").alias("sums"))


def quantised(vectors: DataFrame, books: Codebooks, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """vec_id, label, code (one byte a part, four beyond 256 entries) and error (decimal) of every vector, and the codebooks
    after the rounds. vectors: as whole_vectors() gives them."""
    parts, _, width = books.shape

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.array(batch.column(2).to_pylist(), np.int64).reshape(batch.num_rows, -1)
            columns = [batch.column(0), batch.column(1), pa.array(_packed(flat), pa.binary()), pa.nulls(batch.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "x", "code"])

    whole = vectors.where(F.size("v") == parts * width).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "v")
    spark, rows, sums, before = vectors.sparkSession, whole.mapInArrow(pack, "vec_id long, label long, x binary, code binary"), None, None
    for _ in range(rounds):
        path = fresh_path(spark, "assigned")
        assigned(rows, books).write.parquet(path)
        table = spark.read.schema(_ROW).parquet(path)
        change = table.where("part is not null").select("part", "entry", "n", "sums")
        sums = written(added(change if sums is None else sums.unionByName(change), width), "running-sums")
        books = books.moved({(r["part"], r["entry"]): (r["n"], r["sums"]) for r in sums.collect()})  # parts x entries rows at most
        rows = table.where("part is null")
        if before:
            discard(spark, before)
        before = path
    last = written(assigned(rows, books, deltas=False).select("vec_id", "label", "code", "error"), "codes")
    if before:
        discard(spark, before)
    return last, books


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Per kept row of embeddings: vec_id, code (hexadecimal, two digits a part up to 256 entries), error (long), label_error
    (the errors of all rows of its label) and codebooks_sha256. embeddings: vec_id, label, embedding."""
    vectors = whole_vectors(embeddings, scale)
    books = first_codebooks(vectors, parts, entries)
    if books is None:
        return vectors.where("false").selectExpr("CAST(vec_id AS BIGINT) AS vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    last, books = quantised(vectors, books, rounds)
    key = [F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0)).alias("label")]
    rows = last.select("vec_id", "code", "error", *key, F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int").alias("salt"))
    salted = rows.groupBy("none", "label", "salt").agg(F.sum("error").alias("error"))
    whole = salted.groupBy("none", "label").agg(F.sum("error").alias("label_error"))
    of = salted.select("none", "label", "salt").join(whole, ["none", "label"])
    fits = lambda c: F.least(c, F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias(c)
    out = rows.join(of, ["none", "label", "salt"])
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), fits("error"), fits("label_error"), F.lit(books.digest()).alias("codebooks_sha256"))
