"""Exact top-k inner-product search by MaxScore over sharded postings.

A component that can be negative is turned into two terms: for a query weight q > 0 a vector scores q * (x - low) and
for q < 0 it scores |q| * (high - x), with low and high the shard's extremes of that component; both are never
negative, and the sum differs from the inner product by a constant of the query. Each shard keeps its vectors by
component, so a term's postings are one contiguous row. For a query the terms are sorted by their bounds
|q| * (high - low); the longest prefix of small bounds whose sum cannot lift a vector over the k-th best score so far is
non-essential. The postings of the essential terms are traversed whole, for some queries at once; the rest are probed, largest bound first, only
for vectors that can still compete, ties included. Shards give k rows each and a window merges them.

Queries and shards meet in blocks of bounded size, one task row per (shard, query block); only the query blocks are sent to
every shard. Rows are dealt to blocks by their place in a written table, so rows that repeat an id spread like others.
Vectors that are null or hold a null or non-finite component, or a null id, take no part. Vectors of another length than
a query's do not meet it; empty vectors meet each other and score 0. Repeated ids count as rows of their own, apart from
the query's own id; a query whose id repeats gives the k best of its rows together. Columns other than id and v are
ignored. No candidates: no rows. Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taleweave.scratch import written

SHARD_ROWS, QUERY_ROWS = 4096, 1024
#: Queries whose essential terms are traversed together.
AT_ONCE = 64
#: Inner products of doubles are exact up to here.
EXACT = float(2**53)


class Shard:
    """Vectors by component. vectors: (rows, dims) of integers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, by_dim = ids[order], vectors[order].T
        peak = float(np.abs(vectors, dtype=np.float64).max(initial=0))
        self.peak = peak
        self.rows = np.ascontiguousarray(by_dim)
        self.low, self.high = self.rows.min(axis=1), self.rows.max(axis=1)
        self.postings = (self.rows - self.low[:, None]).astype(np.float64)
        self.span = (self.high - self.low).astype(np.float64)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query id, id, score) of the k best for each query, best first, ties to the smaller id. queries: (rows, dims) of
        integers, own: their ids. The essential terms of a few queries at a time are traversed as one matrix product."""
        out: list[tuple[int, int, int]] = []
        first = max(k + 1, len(self.ids) // 16)
        sample, sampled = self.rows[:, :first].astype(np.float64), self.ids[:first]
        for at in range(0, len(own), AT_ONCE):
            q, ids = queries[at : at + AT_ONCE].astype(np.float64), own[at : at + AT_ONCE].tolist()
            large = self.peak * np.abs(q).sum(axis=1) * 2 >= EXACT
            floors = np.full(len(ids), -np.inf)
            for n, seen in enumerate(q @ sample):  # full scores of a few rows: a first k-th best, own row aside
                seen = seen[sampled != ids[n]]
                floors[n] = np.partition(seen, -k)[-k] if len(seen) >= k else -np.inf
            bound = np.abs(q) * self.span
            base = np.where(q > 0, q * self.low, q * self.high).sum(axis=1)
            flip = np.where(q < 0, bound, 0.0)
            order = np.argsort(bound, axis=1)
            reach = np.cumsum(np.take_along_axis(bound, order, axis=1), axis=1)
            cuts = (reach < (floors - base)[:, None]).sum(axis=1)
            essential = np.empty(q.shape, bool)
            np.put_along_axis(essential, order, np.arange(q.shape[1]) >= cuts[:, None], axis=1)
            parts = np.where(essential, q, 0.0) @ self.postings + np.where(essential, flip, 0.0).sum(axis=1)[:, None]
            for n, i in enumerate(ids):
                if large[n]:
                    best = self._plain(queries[at + n], i, k)
                else:
                    best = self._probed(q[n], i, k, floors[n] - base[n], parts[n], order[n, : cuts[n]], reach[n], flip[n], base[n])
                out += [(i, x, s) for s, x in best]
        return out

    def _probed(self, q: np.ndarray, own: int, k: int, need: float, part: np.ndarray, order: np.ndarray, reach: np.ndarray, flip: np.ndarray, base: float) -> list[tuple[int, int]]:
        """The k best (score, id) by the sums of the essential terms and, for rows that can still compete, of the others
        (order: ascending bounds, whose running sums reach has)."""
        alive, cut = np.arange(len(self.ids)), len(order)
        mine = slice(np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right"))
        if mine.start < mine.stop:  # the query's own rows do not count among the k
            alive, part = np.delete(alive, mine), np.delete(part, mine)
        left = reach[cut - 1] if cut else 0.0
        for at in range(cut - 1, -1, -8):
            if len(alive) > k:
                need = max(need, float(np.partition(part, -k)[-k]))
            keep = part + left >= need
            if not keep.all():
                alive, part = alive[keep], part[keep]
            probe = order[max(0, at - 7) : at + 1]
            if 8 * len(alive) > len(self.ids):  # whole rows are read faster than many single places
                more = (q[probe] @ self.postings[probe])[alive]
            else:
                more = q[probe] @ self.postings[probe[:, None], alive]
            part = part + more + flip[probe].sum()
            left = reach[at - 8] if at >= 8 else 0.0
        return self._best(part + base, self.ids[alive], k)

    def _plain(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """For components too large for doubles: integers of any size."""
        scores = [sum(a * b for a, b in zip(query.tolist(), x, strict=True)) for x in self.rows.T.tolist()]
        found = [(-s, i) for s, i in zip(scores, self.ids.tolist(), strict=True) if i != own]
        return [(-s, i) for s, i in sorted(found)[:k]]

    @staticmethod
    def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
        if len(scores) > k:
            near = scores >= np.partition(scores, -k)[-k]
            scores, ids = scores[near], ids[near]
        best = np.lexsort((ids, -scores))[:k]
        return [(int(scores[b]), int(ids[b])) for b in best]


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """One row per value of key and length: ids, vectors (int64, little-endian)."""

    def pack(table: pa.Table) -> pa.Table:
        lengths = np.array([len(v) for v in table.column("v").to_pylist()])
        ids, vectors = table.column("id").to_numpy(), table.column("v").to_pylist()
        out: dict[str, list] = {"block": [], "dims": [], "ids": [], "vectors": []}
        for d in np.unique(lengths):
            own = np.flatnonzero(lengths == d)
            out["block"].append(table.column(key)[0].as_py())
            out["dims"].append(int(d))
            out["ids"].append(ids[own].astype("<i8").tobytes())
            out["vectors"].append(np.array([vectors[i] for i in own], "<i8").tobytes())
        return pa.table(out, schema=pa.schema([("block", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]))

    return rows.groupBy(key).applyInArrow(pack, "block int, dims int, ids binary, vectors binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Both frames: id long, v array<long>. Returns query_id, rank, id, score."""
    usable = F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    vectors, queries = (written(df.where(usable).select("id", "v"), "topk-rows") for df in (vectors, queries))
    n_shards = max(1, -(-vectors.count() // shard_rows))
    n_blocks = max(1, -(-queries.count() // query_rows))
    spread = lambda df, n: df.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    shards = written(_blocks(spread(vectors, n_shards), "part"), "topk-shards").withColumnRenamed("block", "shard")
    blocks = written(_blocks(spread(queries, n_blocks), "part"), "topk-queries")
    sent = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), "dims", F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"))
    # the planner takes sent for as small as blocks, and would gather one copy for each shard in the driver to broadcast them
    pairs = shards.join(sent.hint("merge"), ["shard", "dims"]).select("dims", "ids", "vectors", "qids", "qvectors")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, ids, data, qids, qdata in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own_ids, asked = np.frombuffer(ids, "<i8"), np.frombuffer(qids, "<i8")
                shard = Shard(own_ids, np.frombuffer(data, "<i8").reshape(len(own_ids), dims))
                out = shard.search(np.frombuffer(qdata, "<i8").reshape(len(asked), dims), asked, k)
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(3)], names=["query_id", "id", "score"])

    found = pairs.mapInArrow(search, "query_id long, id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """id, v: floor(scale * x) of every component; rows with null or non-finite components go."""
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return embeddings.where(whole).select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
