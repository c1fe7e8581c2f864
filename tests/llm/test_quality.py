import re
from collections import Counter

import numpy as np
import pytest

from taleweave.llm import quality
from tests.llm.helpers import awkward, clashing, documents, empty


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def statistics(text):
    ws = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(ws[k : k + 8]) for k in range(len(ws) - 7))
    covered = {k + j for k in range(len(ws) - 7) if windows[tuple(ws[k : k + 8])] > 1 for j in range(8)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_statistics_of_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for r in quality.statistics(docs).collect():
        assert tuple(r[c] for c in quality.STATISTICS) == statistics(r.text), r.doc_id
    texts = ["a b c d e f g h " * 3, "x\nx\n\n \nx ", "a b c d e f g h i a b c d e f g h", "#a *b|<>", "１ 　2 x y"]
    for r in quality.statistics(documents(spark, [(k, t, "en", "a", 0) for k, t in enumerate(texts)])).collect():
        assert tuple(r[c] for c in quality.STATISTICS) == statistics(r.text)


def estimate(x):
    """The concentration steps in numpy; quantiles are lower order statistics, as the sketch gives for small groups."""
    q = lambda a, p: np.sort(a)[max(0, int(np.ceil(p * len(a))) - 1)]
    floor = np.diag(np.square(quality.FLOOR))
    mean = np.array([q(c, 0.5) for c in x.T])
    cov = np.diag([((q(c, 0.75) - q(c, 0.25)) / 1.349) ** 2 for c in x.T]) + floor
    for _ in range(quality.STEPS):
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        half = x[d <= q(d, 0.5)]
        mean, cov = half.mean(axis=0), np.cov(half.T, bias=True) + floor
    d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    return mean, cov, max(1.0, q(d, 0.5) / quality.MEDIAN)


def features(s):
    n = max(s[0], 1)
    return [np.log(n), np.log(max(s[1], 1) / n), np.sqrt(s[2] / n), np.sqrt(10 * s[3] / n), np.sqrt(s[4] / n)]


def test_verdicts_against_numpy(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(400):
        n = int(rng.integers(15, 200))
        text = " ".join(f"{'abcdefgh'[int(rng.integers(8))]}{int(rng.integers(1000))}" + ("###" if k % 37 == 0 else "") for _ in range(n))
        rows.append((k, text, ["en", "de", None][k % 3], ["big", "big", "big", "small"][k % 4] if k % 50 else None, 0))
    stats = {r[0]: statistics(r[1]) for r in rows}
    failed = {k: s[0] < 20 or 100 * s[4] > 30 * s[0] for k, s in stats.items()}
    groups = {}
    for r in rows:
        if not failed[r[0]]:
            groups.setdefault((r[2], r[3]), []).append(r[0])
    usable = [r for r in rows if not failed[r[0]]]

    def judges(key):
        """The documents whose estimate a group gets: its own, its language's, its source's or all."""
        levels = [lambda r: (r[2], r[3]) == key, lambda r: r[2] == key[0], lambda r: r[3] == key[1]]
        sets = [[r[0] for r in usable if same(r)] for same in levels]
        return next((s for s in sets if len(s) >= quality.LEAST), [r[0] for r in usable])

    found = {r.doc_id: r for r in quality.judge(documents(spark, rows)).collect()}
    assert any(len(ks) >= quality.LEAST for ks in groups.values()) and any(len(ks) < quality.LEAST for ks in groups.values())
    for key, ks in groups.items():
        mean, cov, scale = estimate(np.array([features(stats[k]) for k in judges(key)]))
        for k in ks:
            d = np.array(features(stats[k])) - mean
            want = d @ np.linalg.inv(cov) @ d / scale
            assert found[k].distance == pytest.approx(want, rel=1e-6), key
            assert found[k].kept == (want <= quality.CUTOFF)
    for k, bad in failed.items():
        assert found[k].base_failed == bad and (not bad or not found[k].kept)
    assert not all(found[k].kept for k in stats if k % 37 == 0 and not failed[k])


def test_cases(spark):
    for df in (awkward(spark), clashing(awkward(spark))):
        rows = quality.judge(df).collect()
        assert len(rows) == 9 and all(r.base_failed for r in rows if r.doc_id != 5)
        kept = quality.accepted(df)
        assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}
    assert quality.judge(empty(spark)).count() == 0 and quality.accepted(empty(spark)).count() == 0


def test_clean_documents_stay(spark, data):
    judged = quality.judge(spark.read.parquet(f"{data}/documents.parquet"))
    good = judged.join(spark.read.parquet(f"{data}/labels.parquet").where("quality = 1"), "doc_id").where("not base_failed")
    assert good.count() > 20 and good.where("not kept").count() == 0


def test_words_parted_by_symbols_are_junk(spark):
    """A symbol for every second word or so, next to prose of the same length and words."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(300):
        words = [f"{'abcdefgh'[int(rng.integers(8))]}{int(rng.integers(1000))}" for _ in range(int(rng.integers(40, 200)))]
        rows.append((k, (" | " if k % 20 == 0 else " ").join(words), "en", "a", 0))
    kept = {r.doc_id: r.kept for r in quality.judge(documents(spark, rows)).collect()}
    assert kept == {k: k % 20 != 0 for k in range(300)}


def test_labelled_junk_with_symbols_is_rejected(spark, data):
    judged = quality.judge(spark.read.parquet(f"{data}/documents.parquet"))
    junk = judged.join(spark.read.parquet(f"{data}/labels.parquet").where("quality = 0"), "doc_id").where("n_symbols > 0")
    assert junk.count() > 0 and junk.where("kept").count() == 0
