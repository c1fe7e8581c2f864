import re
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from taleweave.llm import mixing
from taleweave.scratch import written
from tests.llm.helpers import awkward, clashing, empty
from tests.llm.test_near_dup import brute as components
from tests.llm.test_quality import statistics


def test_stages_against_plain_versions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sets = [docs]
    for name, stage in corpus_pipeline.STAGES:
        sets.append(written(stage(spark, sets[-1], data), "test"))
        assert name == corpus_pipeline.STAGES[-1][0] or sets[-1].columns == docs.columns
    raw, kept, one, mix, ids = (s.collect() for s in sets)
    failed = {r.doc_id for r in raw if (s := statistics(r.text))[0] < 20 or 100 * s[4] > 30 * s[0]}
    assert {r.doc_id for r in kept} <= {r.doc_id for r in raw} - failed and len(kept) > 0.8 * (len(raw) - len(failed))
    parts = components([(r.doc_id, r.text) for r in kept], 5, 80)
    assert {r.doc_id for r in one} == {c for _, c in parts.values()}
    copies = {r.doc_id: r.copies for r in mixing.mix(sets[2].withColumn("doc_id", F.col("doc_id"))).collect()}
    taken = Counter(r.doc_id for r in mix)
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in one}
    by, target = Counter(), {r.source: r.target for r in mixing.mix(sets[2]).collect()}
    for r in one:
        rate = target[r.source] / max(1, sum(words[x.doc_id] for x in one if x.source == r.source))
        assert abs(taken[r.doc_id] - rate) < 1, "copies are the expected number, rounded up or down"
        by[r.source] += taken[r.doc_id] * words[r.doc_id]
    assert set(taken) <= set(copies) and all(abs(by[s] - t) <= 2 * max(words[r.doc_id] for r in one if r.source == s) + 0.2 * t for s, t in target.items())
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted((r.doc_id, tuple(r.ids)) for r in ids) == sorted((r.doc_id, tuple(library.encode(r.text))) for r in mix)
    assert all(r.round_trip for r in ids)


def test_awkward_rows_pass_through(spark):
    df = clashing(awkward(spark))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, "").columns == df.columns
    assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() == 9


def test_clashing_columns_keep_their_values(spark):
    df = clashing(awkward(spark))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert all(r["__row"] == r["__copy"] == r["number"] == "x" for r in stage(spark, df, "").collect())


def test_empty_table(spark):
    docs = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0 and (name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns)
        docs = out if out.columns == docs.columns else docs


def test_registered(spark, data):
    import __spark_entry__

    assert {n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
    assert __spark_entry__.queries()["pipeline"](spark, data).count() > 0
