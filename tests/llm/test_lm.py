import math
import zlib
from collections import Counter

import numpy as np
import pytest

from taleweave.llm import lm, recurrent
from tests.llm.helpers import awkward, clashing, documents, empty


def base(rows):
    own = {k: [*lm.words(t), b""] for k, (_, t) in enumerate(rows)}
    held = {k: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for k, (d, _) in enumerate(rows)}
    c = Counter(w for k, ws in own.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    return [(rows[k][0], held[k], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for k, ws in own.items()]


def test_counts_and_base_score(spark):
    df = awkward(spark)
    want = sorted(map(repr, ((d, h, t, k, n, round(b, 6)) for d, h, t, k, n, b in base([(r.doc_id, r.text) for r in df.collect()]))))
    for own in (df, clashing(df)):
        got = lm.score(own).collect()
        assert sorted(repr((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert lm.score(empty(spark)).count() == 0


def test_without_training_documents(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = lm.score(documents(spark, [(held, "a b", "en", "a", 0)])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)


def test_small_dictionary_changes_no_count(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = sorted((d, h, t, k, n, round(b, 5)) for d, h, t, k, n, b in base([(r.doc_id, r.text) for r in docs.collect()]))
    monkeypatch.setattr(lm.dictionary, "__defaults__", (300,))
    monkeypatch.setattr(lm, "HELD", 1000)
    got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in lm.score(docs).collect())
    assert got == want


def test_query_score_recomputed(spark, data, monkeypatch):
    """The score from its parts: the network over the symbols, counts for the words that share symbol 0."""
    long = "x" * 80
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows += [(1_000_000 + k, f"the {long} " * (k % 3 + 1)) for k in range(40)] + [(2_000_000, None), (2_000_001, f"{long}y never seen")]
    seen, real = {}, lm.learn

    def learn(encoded, weights, *more):
        seen["weights"], seen["flat"] = weights, real(encoded, weights, *more)
        return seen["flat"]

    monkeypatch.setattr(lm, "learn", learn)
    monkeypatch.setattr(lm, "SYMBOLS", 50)
    monkeypatch.setattr(lm.dictionary, "__defaults__", (300,))
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}

    c = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2 for w in [*lm.words(t), b""])
    named = [b"", *sorted((w for w in c if w and len(w) <= 64), key=lambda w: (-c[w], w))][:50]
    at = {w: k + 1 for k, w in enumerate(named)}
    tokens = sum(n for w, n in c.items() if w not in at)
    shared = tokens + len(c) - 50 + 1
    assert seen["weights"].tolist() == [tokens, *(c[w] for w in named)]
    assert sum((n + 1) / shared for w, n in c.items() if w not in at) + 1 / shared == pytest.approx(1.0)
    network = recurrent.Model(seen["weights"], 1).unpack(seen["flat"])
    assert len(got) == len(rows) and c[long.encode()] > 0
    for d, t in rows:
        own = [*lm.words(t), b""]
        natural = network.score([np.array([at.get(w, 0) for w in own], np.uint16)])[0]
        want = natural / math.log(10) + sum(math.log10((c[w] + 1) / shared) for w in own if w not in at)
        assert got[d].score == pytest.approx(want, rel=1e-4)
        assert got[d].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (sum(c.values()) + len(c) + 1)) for w in own), rel=1e-9)


def model(symbols=12, seed=1):
    return recurrent.Model(np.random.default_rng(seed).integers(1, 50, symbols), 1)


def test_probabilities_sum_to_one_and_scores_carry_the_state():
    m = model()
    prefix = [3, 1, 7, 7, 2]
    alone = lambda docs: m.score([np.array(d, np.uint16) for d in docs])
    before = alone([prefix])[0]
    following = alone([[*prefix, k] for k in range(12)])
    assert np.exp(following - before).sum() == pytest.approx(1.0, abs=1e-4)
    long = np.random.default_rng(2).integers(0, 12, 1000)
    step = alone([long])[0]
    assert alone([prefix, long, [4], long])[1] == pytest.approx(step, rel=1e-5)  # other lanes do not matter


def test_gradients_against_differences():
    m = model()
    rng = np.random.default_rng(0)
    given, target = rng.integers(0, 12, (6, 3)), rng.integers(0, 12, (6, 3))
    first, used = np.zeros((6, 3), bool), np.ones((6, 3), bool)
    first[0] = first[3, 1] = True
    used[4:, 2] = False
    start = {k: v.copy() for k, v in m.p.items()}

    def loss():
        states, _, _ = m._steps(given, first, np.zeros((3, recurrent.HIDDEN), np.float32), False)
        out, _, _ = m._output(states.reshape(-1, recurrent.HIDDEN)[used.ravel()], target.ravel()[used.ravel()], False)
        return -float(out.sum())

    m.g2 = {k: np.zeros_like(v) for k, v in m.p.items()}
    with np.errstate(all="ignore"):
        m._learn(given, target, first, used, np.zeros((3, recurrent.HIDDEN), np.float32))
    sizes = {k: np.sqrt(g) for k, g in m.g2.items()}  # |gradient| up to one common factor
    m.p = {k: v.copy() for k, v in start.items()}
    ratios = []
    for name in m.p:
        for at in list(np.argwhere(sizes[name] > 0.3 * sizes[name].max()))[:6]:
            k, eps = tuple(at), 1e-2
            m.p[name][k] += eps
            up = loss()
            m.p[name][k] -= 2 * eps
            down = loss()
            m.p[name][k] += eps
            ratios.append(abs(up - down) / (2 * eps) / sizes[name][k])
    assert np.std(ratios) < 0.05 * np.mean(ratios)


def test_learns_and_beats_unigrams():
    rng = np.random.default_rng(6)
    step = rng.permutation(12)

    def document(n):
        out = [int(rng.integers(12))]
        while len(out) < n:
            out.append(int(step[out[-1]]) if rng.random() < 0.9 else int(rng.integers(12)))
        return np.array(out, np.uint16)

    docs, held = [document(120) for _ in range(150)], [document(200) for _ in range(10)]
    m = recurrent.Model(np.bincount(np.concatenate(docs), minlength=12), 1)
    plain = m.score(held).sum()
    for _ in range(12):
        m.train(docs)
    assert m.score(held).sum() > 0.75 * plain
    packed = recurrent.Model(np.bincount(np.concatenate(docs), minlength=12), 1).unpack(m.pack())
    assert packed.score(held).tolist() == m.score(held).tolist()


def test_held_out_score_beats_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in lm.score(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
