import random
import re

from taleweave.llm import near_dup
from tests.llm.helpers import awkward, clashing, documents, empty


def sets(text, width):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not ws:
        return frozenset()
    width = min(width, len(ws))
    return frozenset(tuple(ws[k : k + width]) for k in range(len(ws) - width + 1))


def brute(rows, width, percent):
    own = {d: sets(t, width) for d, t in rows if d is not None}
    root = {d: d for d in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(own)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(own[a] & own[b])
            if own[a] and own[b] and 100 * both >= percent * (len(own[a]) + len(own[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(own[d]), find(d)) for d in ids}


def compare(spark, rows, width, percent):
    got = near_dup.near_duplicates(documents(spark, [(d, t, "en", "a", 0) for d, t in rows]), width, percent).collect()
    want = brute(rows, width, percent)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id), r.doc_id


def test_table_against_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    compare(spark, rows, 3, 85)
    compare(spark, rows, 5, 80)


def test_chains_of_near_copies(spark):
    """Neighbours in a chain are near, its ends are not: one component, found link by link."""
    rng = random.Random(4)
    text = [f"w{k}" for k in range(160)]
    rows = []
    for k in range(60):
        rows.append((1000 - k, " ".join(text)))
        text = text[2:] + [f"n{k}", f"m{k}"]
    rows += [(2000 + k, " ".join(rng.choices(["a", "b", "c"], k=40))) for k in range(80)]
    compare(spark, rows, 3, 85)


def test_many_different_texts_in_every_bucket(spark):
    """All share a passage and 0.78 of their shingles, so every bucket is large; forty of them are near to one other each."""
    passage = " ".join(f"p{k}" for k in range(400))
    rows = []
    for k in range(400):
        own = [f"s{k // 2 if k < 40 else k}_{j}" for j in range(12)] + [f"o{k}_{j}" for j in range(43)]
        rows.append((k, " ".join([passage, *own])))
    compare(spark, rows, 5, 80)


def family(n):
    """Texts of 1,002 shared words, 7 words shared by two and 88 of their own: the two are at 0.8512, all others at 0.8403."""
    passage = [f"p{k}" for k in range(1002)]
    return [(k, " ".join([*passage, *(f"s{k // 2}_{j}" for j in range(7)), *(f"o{k}_{j}" for j in range(88))])) for k in range(n)]


def test_family_at_the_threshold_loses_no_link(spark):
    compare(spark, family(300), 3, 85)


def test_prefix_join_alone_finds_every_link(spark, monkeypatch):
    """Without further stars and without small buckets, and with hot keys and blocks of a few rows."""
    for name, value in (("ROUNDS", 0), ("FULL", 1), ("HOT", 4), ("SALTS", 3), ("BLOCK", 5)):
        monkeypatch.setattr(near_dup, name, value)
    rng = random.Random(9)
    rows = family(40)
    for k in range(60):
        base = [f"b{k % 6}_{j}" for j in range(120)]
        for at in rng.sample(range(120), rng.randrange(0, 9)):
            base[at] = f"c{k}_{at}"
        rows.append((1_000 + k, " ".join(base[: rng.randrange(100, 121)])))
    compare(spark, rows, 3, 85)
    compare(spark, rows, 5, 80)


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text), (5, "a b c d e f g"), (7, text + " end"), (7, "h i j k l m n"), (9, "a b c d e f g"), (9, ""), (9, "")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(documents(spark, [(*r, "en", "a", 0) for r in rows])).collect())
    assert got == [(5, 3, 5, True), (5, 56, 5, True), (7, 3, 7, True), (7, 57, 5, False), (9, 0, 9, True), (9, 0, 9, True), (9, 3, 5, False)]
    left = near_dup.without_copies(documents(spark, [(*r, "en", "a", 0) for r in rows])).collect()
    assert sorted((r.doc_id, r.text[:5]) for r in left) == [(5, "a b c"), (5, "w0 w1"), (7, "h i j"), (9, "")]


def test_groups_of_copies_and_short_texts(spark):
    rows = [(k, "One TWO three four five six") for k in range(200)] + [(300, "one two"), (301, "ONE two"), (302, "two one"), (303, "x"), (304, "x")]
    compare(spark, rows, 3, 85)


def test_cases(spark):
    for df in (awkward(spark), clashing(awkward(spark))):
        got = near_dup.near_duplicates(df).collect()
        assert len(got) == 9
        by = {}
        for r in got:
            by.setdefault(r.doc_id, []).append(r)
        assert by[None][0].kept and by[None][0].component_id is None
        assert [x.component_id for x in by[6]] == [1, 1] and not by[6][0].kept
        assert by[2][0].n_shingles == by[3][0].n_shingles == by[4][0].n_shingles == 0
        left = near_dup.without_copies(df)
        assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(["1", "2", "3", "4", "5", "7", "None"])
    assert near_dup.near_duplicates(empty(spark)).count() == 0 and near_dup.without_copies(empty(spark)).count() == 0
