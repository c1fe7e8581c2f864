import hashlib

import numpy as np

from taleweave.llm import queries
from taleweave.llm.fingerprints import BITS, Fingerprinter, fingerprints, spliced, with_neighbours
from taleweave.llm.near_dup import shingle_hashes
from tests.llm.helpers import awkward, clashing, documents, empty


def plain_fingerprint(hashes, own):
    """Bin by bin with Python numbers."""
    if not len(hashes):
        return b""
    least = {}
    for h in map(int, hashes):
        k = h * own.bins >> 64
        least[k] = min(least.get(k, h), h)
    low = []
    for k in range(own.bins):
        at, turn = k, 0
        while at not in least:
            at, turn = int(own._looks_at(turn)[k]), turn + 1
        x = (least[at] + int(own.own[k])) % 2**64
        for shift, factor in ((31, 0x9E3779B97F4A7C15), (29, 0xC2B2AE3D27D4EB4F)):
            x = (x ^ x >> shift) * factor % 2**64
        low.append((x ^ x >> 32) % 2**own.bits)
    per = 8 // own.bits
    return bytes(sum(v << own.bits * j for j, v in enumerate(low[k : k + per])) for k in range(0, own.bins, per))


def jaccard(a, b):
    x, y = (set(shingle_hashes(t.encode(), 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_bins_and_bits():
    rng = np.random.default_rng(1)
    for bins, bits in ((256, 4), (64, 1), (32, 2), (16, 8)):
        own = Fingerprinter(bins, bits)
        for n in (0, 1, 2, 30, 5_000):
            hashes = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            assert own.fingerprint(hashes) == plain_fingerprint(hashes, own)


def test_likeness_is_unbiased():
    rng, own = np.random.default_rng(2), Fingerprinter()
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        for n in (40, 400, 4_000):
            off = []
            for _ in range(60):
                h = rng.integers(0, 2**64, 3 * n, dtype=np.uint64)
                both = round(2 * n * share / (1 + share))
                a, b = np.sort(h[:n]), np.sort(np.concatenate([h[:both], h[n : 2 * n - both]]))
                off.append(own.likeness(own.fingerprint(a), own.fingerprint(b)) - both / (2 * n - both))
            assert abs(np.mean(off)) < 0.02 and np.std(off) < (0.09 if n < 256 else 0.05)
    assert own.likeness(b"", b"") == 1.0 and own.likeness(b"", own.of_text("a")) == 0.0


def test_single_shingles_are_unlike():
    own = Fingerprinter()
    marks = [own.of_text(f"w{k}") for k in range(300)]
    assert max(own.likeness(a, b) for a, b in zip(marks, marks[1:], strict=False)) < 0.2


def brute(rows):
    own = Fingerprinter()
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        marks = [own.of_text(t) for t in (text, edited, after)]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1], own.likeness(*marks[:2]), own.likeness(marks[0], marks[2])))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in with_neighbours(df).collect()), key=repr)


def test_table_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(docs.repartition(7)) == brute(rows)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.op11_fingerprints(spark, data).collect()
    assert len(got) == len(rows) and all(len(r.fingerprint) in (0, 64 * BITS) for r in got)
    ordered = sorted(texts)
    after = {d: texts[ordered[(k + 1) % len(ordered)]] for k, d in enumerate(ordered)}
    off = [r.near_edited - jaccard(texts[r.doc_id], spliced(texts[r.doc_id], after[r.doc_id])) for r in got]
    assert abs(np.mean(off)) < 0.02 and np.sqrt(np.mean(np.square(off))) < 0.08
    assert np.mean([abs(r.near_next - jaccard(texts[r.doc_id], after[r.doc_id])) for r in got]) < 0.02


def test_order_ties_and_few_rows(spark):
    assert result(documents(spark, [(3, "abcdefgh", None, None, None)])) == brute([(3, "abcdefgh")])
    rows = [(k // 2, "same words here now and then", "x", "y", 1) for k in range(300)] + [(1000 + k, f"text {k} " * (k % 7), "x", "y", 1) for k in range(100)]
    assert result(documents(spark, rows).repartition(9)) == brute([r[:2] for r in rows])


def test_cases(spark):
    base = awkward(spark)
    rows = [(r.doc_id, r.text) for r in base.collect()]
    for df in (base, clashing(base)):
        assert result(df) == brute(rows)
    assert result(empty(spark)) == []
    marks = {r.doc_id: bytes(r.fingerprint) for r in fingerprints(base).collect()}
    assert marks[1] == marks[6] and marks[2] == marks[3] == marks[4] == b""
