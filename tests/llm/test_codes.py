import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from taleweave.llm import codes, queries

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds):
    """Lloyd without deltas in plain whole numbers. rows: (vec_id, v, label)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in rows]
    books = [[list(x[p]) for x in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        members = [[[] for _ in b] for b in books]
        for x in cut:
            for p in range(parts):
                members[p][near(p, x[p])[1]].append(x[p])
        for p in range(parts):
            for k, own in enumerate(members[p]):
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[near(p, x[p]) for p in range(parts)] for x in cut]
    errors = [sum(d for d, _ in f) for f in found]
    label = {}
    for (_, _, g), e in zip(rows, errors, strict=True):
        label[g] = label.get(g, 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), e, label[r[2]], sha) for r, f, e in zip(rows, found, errors, strict=True)), key=repr)


def result(df, **more):
    return sorted((tuple(r) for r in codes.compressed(df, **more).collect()), key=repr)


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(16, 64, 2), (4, 7, 5), (1, 300, 0), (64, 1, 1)])
def test_table_against_brute_force(spark, data, parts, entries, rounds):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r.vec_id, [int(np.floor(256 * float(x))) for x in r.embedding], r.label) for r in df.collect()]
    got = result(df.repartition(5), parts=parts, entries=entries, rounds=rounds)
    if entries > 256:
        wide = [(i, "".join(f"{int(c[k : k + 8][6:8] + c[k : k + 8][4:6] + c[k : k + 8][2:4] + c[k : k + 8][:2], 16):x}" for k in range(0, len(c), 8)), *rest) for i, c, *rest in got]
        assert sorted((r[0], *r[2:]) for r in wide) == sorted((r[0], *r[2:]) for r in brute(rows, parts, entries, rounds))
    else:
        assert got == brute(rows, parts, entries, rounds)


def test_only_changes_are_handed_on(spark, data):
    """A round without a change shuffles nothing, and the running sums are those of all vectors."""
    vectors = codes.whole_vectors(spark.read.parquet(f"{data}/embeddings.parquet"))
    books = codes.first_codebooks(vectors)
    last, _ = codes.quantised(vectors, books, 0)
    start = vectors.join(last.select("vec_id", "code"), "vec_id").withColumn("x", F.expr("null").cast("binary"))
    packed = {r.vec_id: codes._packed(np.array([r.v]))[0] for r in vectors.collect()}
    rows = spark.createDataFrame([(r.vec_id, r.label, packed[r.vec_id], bytes(r.code)) for r in start.collect()], "vec_id long, label long, x binary, code binary")
    assert codes.assigned(rows, books).where("part is not null").count() == 0
    one = rows.withColumn("code", F.when(F.col("vec_id") == 100, F.concat(F.expr("x'3f'"), F.expr("substring(code, 2)"))).otherwise(F.col("code")))
    changed = codes.assigned(one, books).where("part is not null").collect()
    assert {(r.part, r.n) for r in changed} <= {(0, 1), (0, -1)} and sum(r.n for r in changed) == 0


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [0.5, -0.001, 0.25, 1.0], 1), (2, None, 1), (3, [nan, 1.0, 0.0, 0.0], 1), (4, [-inf, 1.0, 0.0, 0.0], 1), (6, [None, 1.0, 0.0, 0.0], 1), (7, [1.0, 2.0], 1), (8, [1.0, 2.0, 3.0], 1),
            (None, [0.1, 0.2, 0.3, 0.4], None), (5, [0.5, -0.001, 0.25, 1.0], 1), (5, [0.4, 0.0, 0.0, 0.0], None), (9, [0.0, 0.0, 0.0, 0.0], 2)]
    whole = lambda v: [int(np.floor(256 * float(np.float32(x)))) for x in v]
    used = [(i, whole(v), g) for i, v, g in rows if v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    df = spark.createDataFrame(rows, KIND)
    for frame in (df, df.withColumns({n: F.lit("x") for n in ("code", "error", "part", "entry", "x", "v", "salt", "rows")})):
        assert result(frame, parts=2, entries=3, rounds=2) == brute(used, 2, 3, 2)
    assert result(spark.createDataFrame([], KIND)) == []
    assert result(spark.createDataFrame([(1, None, 1)], KIND)) == []
    assert [r[:3] for r in result(spark.createDataFrame([(1, [], 1)], KIND))] == [(1, "00" * 16, 0)]


def test_large_components(spark):
    """Beyond the range of exact doubles."""
    rows = [(k, [float(np.float32(x)) for x in (2.0**40 + k * 2.0**18, -(2.0**44), k, 1.0)], 0) for k in range(6)]
    df = spark.createDataFrame(rows, KIND)
    assert result(df, parts=2, entries=3, rounds=2) == brute([(i, [int(np.floor(256 * x)) for x in v], g) for i, v, g in rows], 2, 3, 2)
    huge = result(spark.createDataFrame([(1, [3e38, 0.0], 1), (2, [-3e38, 0.0], 1)], KIND), parts=1, entries=1)
    assert max(r[2] for r in huge) == codes.LARGEST


def test_ties_take_the_lower_index():
    books = codes.Codebooks(np.array([[[0, 0], [2, 0], [2, 0]]]))
    assert books.assign(np.array([[1, 0], [2, 0]]))[0].tolist() == [[0], [1]]


def test_query_reads_the_whole_table(spark, data):
    got = queries.op12_codes(spark, data)
    assert got.count() == spark.read.parquet(f"{data}/embeddings.parquet").count()
