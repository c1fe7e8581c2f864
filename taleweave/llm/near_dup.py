"""Near-duplicate groups of documents: one-permutation MinHash with optimal densification, banded buckets, stars.

1. A document's set holds one 64-bit hash per distinct shingle. The hash range is cut into BINS bins; a bin's value is
   its least hash, and an empty bin copies the value of a bin that a fixed random sequence of its own names.
2. Rows of equal sets form a class; everything below works on classes, so copies never meet pair by pair.
3. BANDS bands of BINS / BANDS values each name a bucket. Within a bucket every class is paired with one centre only, the
   class that shares most bucket places over all its bands, so a bucket of n classes gives n - 1 candidates.
4. A candidate whose sizes or one-byte bin values (see likely()) cannot belong to a near pair goes; the others are
   confirmed on the full sets, recomputed from the texts. Confirmed links give components (alternating stars over written
   tables, never on the driver).
5. Two classes can be near while neither is near the centre. Buckets of over FULL classes that still hold several
   components get new stars, one class of each component around a centre drawn anew, up to ROUNDS times or until a star
   joins nothing. This only joins large groups cheaply; no result depends on it.
6. What then lies in one bucket but in different components is paired without exception: in buckets of up to FULL
   classes directly, and the classes of larger buckets by an exact prefix-filter join on their full sets (rare_pairs()),
   whose candidates include every near pair, whether or not it shares a bucket. Pairs inside a component need no test.

The number of jobs is fixed but for components(), which takes a number of turns that grows with the logarithm of the
longest chain. Besides likely(), only a pair that shares no bucket can be missed: one of similarity 0.8 with probability
(1 - 0.8 ** 5) ** 40 = 1e-7, one of 0.85 with 6e-11.

Words are runs of non-space characters, A-Z lower-cased. A text of fewer words than a shingle is one shingle; null text
or text without words has an empty set and is linked with nothing. A null doc_id is linked with nothing and kept, with a
null component. Every row is a document: rows that repeat a doc_id with another text are judged by that text. Very long
texts are sets like any other. An empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleweave.scratch import written

BINS, BANDS = 200, 40
ROUNDS, FULL, SALTS, BLOCK = 2, 16, 16, 1024
#: A key with more rows than this is split over SALTS tasks before it is joined.
HOT = 512
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MUL[0]
    x = (x ^ (x >> np.uint64(29))) * _MUL[1]
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out + each[k : len(each) - width + 1 + k] * _MUL[2])
    return np.unique(out)


class Sketcher:
    EDGES = np.array([-(-(k << 64) // BINS) for k in range(BINS)], np.uint64)

    def __init__(self) -> None:
        self.turns: list[np.ndarray] = []
        self.salt = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def _turn(self, k: int) -> np.ndarray:
        """The bin that each empty bin looks at in its k-th attempt."""
        while len(self.turns) <= k:
            seeds = np.arange(BINS, dtype=np.uint64) + np.uint64(BINS * len(self.turns) + 1)
            self.turns.append((_mix(seeds * _MUL[2]) % np.uint64(BINS)).astype(np.int64))
        return self.turns[k]

    def bands(self, hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bucket ids and one byte of each bin of a non-empty sorted set."""
        first = np.searchsorted(hashes, self.EDGES)
        full = first < np.append(first[1:], len(hashes))
        values = hashes[np.minimum(first, len(hashes) - 1)]
        empty = np.flatnonzero(~full)
        for k in range(1 << 30):
            if not len(empty):
                break
            look = self._turn(k)[empty]
            found = full[look]
            values[empty[found]] = values[look[found]]
            empty = empty[~found]
        out = self.salt.copy()
        for column in values.reshape(BANDS, -1).T:
            out = _mix(out + column)
        return out.view(np.int64), (_mix(values) >> np.uint64(32)).astype(np.uint8).tobytes()


def sketches(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, set_key (two hashes of the whole set; null if empty), signature,
    bands."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, none = Sketcher(), (np.zeros(0, np.int64), None)
        for batch in batches:
            sizes, keys, found = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                h = shingle_hashes(text, width)
                sizes.append(len(h))
                keys.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                found.append(sketcher.bands(h) if len(h) else none)
            starts = np.concatenate([[0], np.cumsum([len(b) for b, _ in found])]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([b for b, _ in found]) if found else np.zeros(0, np.int64)))
            columns = [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array([g for _, g in found], pa.binary()), flat]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_shingles", "set_key", "signature", "bands"])

    kind = "doc_id long, text_key long, n_shingles long, set_key binary, signature binary, bands array<long>"
    return documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(sketch, kind)


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow the similarity and whose bins agree in a share of no less than six standard
    deviations below it (a near pair falls below with probability 1e-9). Bins that copy another count with it, so a set of
    n shingles is worth half of min(n, BINS) independent bins at least (0.51 at 200 shingles, more at other sizes).
    classes: id, n_shingles, signature."""
    share = percent / 100

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (3, 4)]
            filled = 0.5 * np.minimum(np.asarray(batch.column(2)), BINS)
            keep = pa.array((sides[0] == sides[1]).mean(axis=1) >= share - 6 * np.sqrt(share * (1 - share) / filled))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    a = classes.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("signature").alias("sig_a"))
    b = classes.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("signature").alias("sig_b"))
    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    met = pairs.join(a, "a").join(b, "b").where(100 * low >= percent * high)
    return met.select("a", "b", low.alias("low"), "sig_a", "sig_b").mapInArrow(close, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. texts: id, text. The pairs of an a that
    many pairs share, such as a star's centre, are dealt to SALTS copies of its text."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def full(doc: int, text: bytes) -> np.ndarray:
            if doc not in recent:
                recent[doc] = shingle_hashes(text, width)
                if len(recent) > 64:
                    recent.popitem(last=False)
            recent.move_to_end(doc)
            return recent[doc]

        for batch in batches:
            keep = []
            ids_a, ids_b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, ta, tb in zip(ids_a, ids_b, batch.column(2), batch.column(3), strict=True):
                x, y = full(a, ta.as_buffer().to_pybytes()), full(b, tb.as_buffer().to_pybytes())
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    a, b = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    hot = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    hot = written(hot.where(F.col("n") > HOT).select("a", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "hot-centres")
    if hot.isEmpty():
        met = pairs.join(a, "a")
    else:
        salted = pairs.withColumn("own", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        salted = salted.join(hot.select("a", F.col("salt").alias("own"), F.lit(True).alias("hot")), ["a", "own"], "left")
        salted = salted.select("a", "b", F.when(F.col("hot"), F.col("own")).otherwise(-1).alias("salt"))
        met = salted.join(a.withColumn("salt", F.lit(-1)).unionByName(a.join(hot, "a")), ["a", "salt"])
    return met.join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, component (least id reachable) for every id in links (a, b), by alternating large and small stars."""

    def stars(edges: DataFrame, small: bool) -> DataFrame:
        """edges: (u, v), u > v. Large: v > u joins the least neighbour of u; small: u and its lesser ones join the least."""
        around = edges if small else edges.union(edges.select("v", "u"))
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        met = around.join(least, "u")
        if small:
            out = met.select(F.col("v"), F.col("m")).where("v <> m").union(least.select("u", "m"))
        else:
            out = met.where("v > u").select(F.col("v"), F.least("m", "u").alias("m"))
        return out.toDF("u", "v").where("u > v")

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links-once")
    before = mark(edges)
    while before[0]:
        edges = written(stars(stars(edges, False), True).distinct(), "stars")
        if (now := mark(edges)) == before:
            break
        before = now
    least = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return written(least.union(edges.select("v", "v")).groupBy("id").agg(F.min("component").alias("component")), "components")


def _salt(n: str = "n", *columns: str) -> Column:
    """For rows of a key with n rows in all: one of SALTS numbers where n is over HOT, else 0."""
    return F.when(F.col(n) > HOT, F.pmod(F.xxhash64(*(columns or ["id"])), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))


def _salts(n: str = "n") -> Column:
    """All salts of a key with n rows."""
    return F.explode(F.sequence(F.lit(0), F.when(F.col(n) > HOT, F.lit(SALTS - 1)).otherwise(F.lit(0))))


def divided(places: DataFrame, found: DataFrame) -> DataFrame:
    """The places (bucket, id, n) of buckets that hold several components, each with its component; n stays the number of
    classes in the bucket. found: id, component."""
    rows = places.select("bucket", "id", "n").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    spread = rows.groupBy("bucket", "n").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    spread = spread.select("bucket", _salts().alias("salt"))
    return written(rows.withColumn("salt", _salt()).join(spread, ["bucket", "salt"]).drop("salt"), "divided-buckets")


def redrawn(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (centre a, member b) of point 5: stars over one class of each component of a bucket. rows: bucket, id, n,
    component. Equal buckets draw equal centres."""
    one = rows.groupBy("bucket", "n", "component").agg(F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("id"))
    centres = one.groupBy("bucket", "n").agg(F.min_by("id", F.xxhash64("component", F.lit(turn))).alias("centre"))
    met = one.withColumn("salt", _salt()).join(centres.select("bucket", "centre", _salts().alias("salt")), ["bucket", "salt"])
    return met.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()


def across(rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components, as point 6 above has it. rows: bucket, id, n, component; texts: id,
    text."""
    one, other = (rows.where(F.col("n") <= FULL).select("bucket", F.col("id").alias(i), F.col("component").alias(c)) for i, c in (("a", "mine"), ("b", "theirs")))
    pairs = one.join(other, "bucket").where("mine <> theirs and a < b").select("a", "b").distinct()
    large = written(rows.where(F.col("n") > FULL).select("id", "component").distinct(), "large-buckets")
    return pairs if large.isEmpty() else pairs.union(rare_pairs(large, texts, width, percent)).distinct()


def rare_pairs(classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can be near, by a prefix filter on the full sets.

    All sets are put in one order, rare shingles first. Let x be the smaller of two sets (by size, then id) and y the
    other, and I what they share. Near means (100 + p) * I >= p * (|x| + |y|), so I is at least 2p / (100 + p) of |x| and at
    least p / 100 of |y|. The first shingle that they share therefore lies among the first |x| - ceil(2p|x| / (100 + p)) + 1
    of x and the first |y| - ceil(p|y| / 100) + 1 of y, and at that place what is left of both still allows I. Only x's
    shorter prefix is looked up, so a passage common to a whole family is looked up by no one unless x has little else.

    Shingles of more than FULL sets have their counts; rows of one are dealt over blocks of about BLOCK rows a side, so no
    task holds a common shingle. classes: id, component."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, component, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                h = shingle_hashes(text.as_buffer().to_pybytes(), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), x)) for x in (doc, component)] + [pa.array(h)], names=["id", "component", "key"])

    rows = classes.join(texts, "id").select("id", "component", "text").mapInArrow(explode, "id long, component long, key long")
    rows = written(rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")), "shingles")
    common = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FULL)
    common = written(common, "common-shingles").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")))  # one document's set
    sets = rows.join(common, ["key", "salt"], "left").groupBy("id", "component").agg(ordered.alias("all")).withColumn("size", F.size("all").cast("long"))
    probed = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    looked_up = F.col("size") - F.ceil(F.col("size") * (2 * percent) / (100 + percent)) + 1
    first = sets.select("id", "component", "size", looked_up.alias("looked_up"), F.posexplode(F.slice("all", F.lit(1), probed.cast("int"))).alias("at", "x"))
    first = first.select("id", "component", "size", (F.col("at") + 1).alias("at"), (F.col("at") < F.col("looked_up")).alias("looked_up"), F.col("x.key").alias("key"), F.col("x.n").alias("n"))
    first = written(first, "first-shingles")

    counts = first.groupBy("key", "n").agg(F.count_if("looked_up").alias("xs"), F.count(F.lit(1)).alias("ys")).where("xs > 0 and ys > 1")
    counts = written(counts, "prefix-counts").select("key", "xs", "ys", _salts().alias("salt"))
    first = first.withColumn("salt", _salt()).join(counts, ["key", "salt"]).drop("salt", "n")
    blocks = {side: F.ceil(F.col(side) / BLOCK).cast("int") for side in ("xs", "ys")}
    own = {side: F.pmod(F.xxhash64("id"), blocks[side]).cast("int") for side in blocks}
    every = {side: F.explode(F.sequence(F.lit(0), blocks[side] - 1)) for side in blocks}
    named = lambda end: [F.col(c).alias(f"{c}_{end}") for c in ("id", "component", "size", "at")]
    x = first.where("looked_up").select("key", own["xs"].alias("xb"), every["ys"].alias("yb"), *named("x"))
    y = first.select("key", own["ys"].alias("yb"), every["xs"].alias("xb"), *named("y"))
    met = x.join(y, ["key", "xb", "yb"]).where("component_x <> component_y and (size_x < size_y or size_x = size_y and id_x < id_y)")
    enough = (100 + percent) * (F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y")) + 1) >= percent * (F.col("size_x") + F.col("size_y"))
    return met.where(enough & (100 * F.col("size_x") >= percent * F.col("size_y"))).select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).distinct()


def _judged(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles, component (a number; null if the row is linked with nothing), component_id."""
    sketched = written(sketches(documents, width), "sketches")
    usable = sketched.where("doc_id is not null and set_key is not null")
    classes = usable.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "signature", "bands")])
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "set_key", "rep.doc_id", "rep.text_key", "n_shingles", "signature", "bands"), "classes")
    signatures = classes.select("id", "n_shingles", "signature")
    places = classes.select("id", F.explode("bands").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    places = written(places.join(shared, "bucket"), "places")
    here = classes.join(places.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "text_key")
    same = documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    texts = written(same.join(here, ["doc_id", "text_key"]).select("id", "text").dropDuplicates(["id"]), "texts")

    shares = places.groupBy("id").agg(F.sum("n").alias("shares"))
    centres = places.join(shares, "id").groupBy("bucket", "n").agg(F.max_by("id", F.struct(F.col("shares"), -F.col("id"))).alias("centre"))
    met = places.withColumn("salt", _salt()).join(centres.select("bucket", "centre", _salts().alias("salt")), ["bucket", "salt"])
    stars = met.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()

    def links(candidates: DataFrame) -> DataFrame:
        return written(confirmed(written(likely(candidates, signatures, percent), "likely"), texts, width, percent), "links")

    all_links = links(stars)
    found = components(all_links)
    rows = divided(places, found)
    for turn in range(ROUNDS):
        more = links(redrawn(rows.where(F.col("n") > FULL), turn))
        if more.isEmpty():
            break
        all_links = all_links.union(more)
        found = components(all_links)
        rows = divided(rows, found)
    more = links(across(rows, texts, width, percent))
    if not more.isEmpty():
        found = components(all_links.union(more))
    named = classes.select("id", "set_key", "doc_id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = named.join(least, "component").select("set_key", "component", "component_id")
    out = sketched.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(of, "set_key", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of documents: doc_id, n_shingles, component_id (least doc_id reachable), kept (doc_id = component_id)."""
    judged = _judged(documents, width, percent)
    return judged.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_copies(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """documents less all but one row of each group, one with the group's least doc_id. Rows without doc_id stay; rows whose
    text has no words are groups by doc_id."""
    kept = _judged(documents, width, percent).where("doc_id = component_id")
    kept = kept.groupBy("doc_id", "component").agg(F.min("text_key").alias("text_key")).drop("component")
    plain = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("text_key"))
    one = plain.where("doc_id is not null").join(written(kept, "kept"), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return one.select("row.*").unionByName(documents.where("doc_id is null"))
