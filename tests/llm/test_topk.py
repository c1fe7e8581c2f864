import numpy as np
from pyspark.sql import functions as F

from taleweave.llm import topk


def brute(vectors, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<long>")


def test_against_brute_force_with_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) for x in rng.integers(-3, 4, 12)]) for i in range(900)] + [(900 + i, [1] * 12) for i in range(60)]
    got = topk.top_k(frame(spark, rows), frame(spark, rows).where("id % 50 = 0"), 5, shard_rows=100, query_rows=7)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, [r for r in rows if r[0] % 50 == 0], 5)


def test_large_values_and_few_candidates(spark):
    big = 2**30
    rows = [(0, [big, -big]), (1, [big, big]), (2, [-big, 1]), (50, [big + 1, 3])]
    got = topk.top_k(frame(spark, rows), frame(spark, rows).where("id % 50 = 0"), 5)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, [rows[0], rows[3]], 5)


def test_cases(spark):
    rows = [(0, None), (1, [1, None]), (None, [1, 2]), (2, [1, 2]), (3, [1, 2, 3]), (100, [4, 4]), (100, [4, 5])]
    got = topk.top_k(frame(spark, rows), frame(spark, rows).where("id % 50 = 0"), 5)
    assert {(r.query_id, r.id) for r in got.collect()} == {(100, 2)}
    assert topk.top_k(frame(spark, []), frame(spark, []), 5).count() == 0


def test_quantised(spark):
    rows = [(1, [0.5, -0.001], 0), (2, None, 0), (3, [float("nan"), 1.0], 0), (4, [float("inf"), 1.0], 0), (5, [None, 1.0], 0), (6, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("clash"))
    got = {r.id: r.v for r in topk.quantised(df).collect()}
    assert got == {1: [128, -1], 6: []}


def test_table_against_numpy(spark, data):
    v = topk.quantised(spark.read.parquet(f"{data}/embeddings.parquet"))
    rows = [(r.id, list(r.v)) for r in v.collect()]
    got = sorted(tuple(r) for r in topk.top_k(v, v.where("id % 50 = 0"), 5).collect())
    assert got == brute(rows, [r for r in rows if r[0] % 50 == 0], 5)


def test_empty_vectors_as_queries_and_candidates(spark):
    rows = [(0, []), (50, []), (7, []), (3, [1, 2]), (100, [2, 2])]
    got = topk.top_k(frame(spark, rows), frame(spark, rows).where("id % 50 = 0"), 5)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, [rows[0], rows[1], rows[4]], 5)


def test_one_id_on_most_rows(spark):
    """Rows of the query's own id do not push other rows out of the k best, and spread over the shards."""
    rows = [(50, [9, k % 7]) for k in range(50_000)] + [(k, [1, k % 5]) for k in range(51, 91)]
    vectors = frame(spark, rows)
    got = topk.top_k(vectors, frame(spark, [(50, [9, 3]), (100, [0, 1])]), 5, shard_rows=5_000)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, [(50, [9, 3]), (100, [0, 1])], 5)


def test_queries_are_not_broadcast(spark):
    """They are sent to every shard, and the planner does not see that this multiplies them: a broadcast would gather all in the driver."""
    rows = [(i, [i % 7, 3]) for i in range(300)]
    got = topk.top_k(frame(spark, rows), frame(spark, rows).where("id % 50 = 0"), 5, shard_rows=20, query_rows=2)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
