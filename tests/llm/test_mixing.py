import re
from collections import defaultdict

import pytest

from taleweave.llm import mixing
from tests.llm.helpers import awkward, clashing, documents, empty


def targets(sizes: dict, share=1.0, weights=(1, 2, 3), most=3):
    """Water filling step by step: whoever is above the cap stays there, the rest is shared again."""
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped, total = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        got = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if got[s] > most * sizes[s]]
        if not over:
            return {**got, **capped}
        capped.update({s: float(most * sizes[s]) for s in over})


def test_targets_and_copies(spark):
    rows = [(k, "w " * (1 + k * 7 % 90), "en", "abcde"[k % 5] if k % 11 else None, 0) for k in range(2000)]
    rows += [(5000, "one", "en", "tiny", 0)]
    out = mixing.mix(documents(spark, rows)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    want = targets(dict(sizes))
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.03 * want[s] + 90
    assert len(out) == len(rows)


def test_reruns_agree_and_cases(spark):
    for df in (awkward(spark), clashing(awkward(spark))):
        a, b = (sorted(map(repr, mixing.mix(df).collect())) for _ in range(2))
        assert a == b and len(a) == 9
    words = {r.doc_id: r["size"] for r in mixing.mix(awkward(spark)).collect()}
    assert words[2] == words[3] == words[4] == 0 and words[5] == 30_000
    assert words[7] == len(re.findall(r"[^\x20\x09-\x0D]+", "Ünï cödé … 漢字 🙂"))
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def test_mixed_repeats_rows(spark):
    df = clashing(awkward(spark))
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert set(map(repr, out.collect())) <= set(map(repr, df.collect()))
