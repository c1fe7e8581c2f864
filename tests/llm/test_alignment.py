import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from taleweave.llm import alignment
from taleweave.llm.token_counts import byte_letters
from tests.llm.helpers import awkward, clashing, documents, empty

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ALIGNER, PIECES, WORDS = alignment.Aligner(A, B), sentencepiece.SentencePieceProcessor(model_file=B), Tokenizer.from_file(A)
WORDS.encode_special_tokens = True
LETTER = {c: b for b, c in byte_letters().items()}


def tokens(text):
    """(id, start, end) of both tokenizers over the whole of space + text."""
    if not text:
        return [], []
    whole, out = (" " + text).encode(), []
    found = WORDS.encode(" " + text, add_special_tokens=False)
    for ids, each in (
        (found.ids, [bytes(LETTER[c] for c in t) for t in found.tokens]),
        ((ids := PIECES.encode(text)), [bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode() for p in map(PIECES.id_to_piece, ids)]),
    ):
        if b"".join(each) != whole:
            return [], []
        at, rows = 0, []
        for i, x in zip(ids, each, strict=True):
            rows.append((i, at, at + len(x)))
            at += len(x)
        out.append(rows)
    return tuple(out)


def plain(text):
    """Groups as a text, and all overlapping pairs, token by token."""
    a, b = tokens(text)
    pairs = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
    parts, i, j = [], 0, 0
    for end in sorted({x[2] for x in a} & {y[2] for y in b}):
        m = next(k for k in range(i, len(a)) if a[k][2] == end) + 1
        n = next(k for k in range(j, len(b)) if b[k][2] == end) + 1
        parts.append(",".join(str(x[0]) for x in a[i:m]) + "|" + ",".join(str(y[0]) for y in b[j:n]))
        i, j = m, n
    return len(a), len(b), parts, pairs


def brute(rows):
    """rows: (doc_id, text); one result per row."""
    each = [(doc_id, *plain(text)) for doc_id, text in rows]
    docs = Counter(p for *_, pairs in each for p in set(pairs))
    best = {}
    for (a, _), n in docs.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for doc_id, n_a, n_b, parts, pairs in each:
        sha = hashlib.sha256(";".join(parts).encode()).hexdigest() if n_a else ""
        out.append((doc_id, n_a, n_b, len(parts), len(pairs), sum(docs[p] == best[p[0]] for p in pairs), sum(docs[p] for p in pairs), sha))
    return sorted(out, key=repr)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=30), st.text("ab 'streld\n\t\r\x0b\x00\x1c\x85\xa0 　▁1é漢🙂.,<|endoftext|>", max_size=40)))
def test_text_equals_token_by_token(text):
    found = ALIGNER.segments(text)
    n_a, n_b, parts, pairs = plain(text)
    assert b";".join(s.digest for s in found).decode() == ";".join(parts)
    got = [divmod(int.from_bytes(s.pairs[k : k + 8], "little"), ALIGNER.n_b) for s in found for k in range(0, len(s.pairs), 8)]
    assert Counter(got) == Counter(pairs)
    assert [sum(s[k] for s in found) for k in range(4)] == [n_a, n_b, len(parts), len(pairs)]


def test_special_strings_marks_and_spaces():
    assert ALIGNER.apart
    for text in ("a<|endoftext|>b", "</s> <s>x", "x   y\n\n z  ", "\n", " ", "   ", "\nfoo", "\n\n  foo\t\tbar ", "it's we'll", "a▁b", "▁", "<0x41>", "\x00a", "don't  \r\n  stop", "x\x85 y", " 　a", "x" * 300):
        assert b";".join(s.digest for s in ALIGNER.segments(text)).decode() == ";".join(plain(text)[2]), text


def test_labels_and_groups():
    import numpy as np

    label = alignment.labels(np.array([1, 3, 6, 7]), np.array([3, 4, 7]), 7)
    assert label == b"a.cb.ac" and alignment.groups(label) == [(2, 1), (2, 2)]
    assert [x.tolist() for x in alignment.links(label)] == [[0, 1, 2, 2, 3], [0, 0, 1, 2, 2]]


@pytest.mark.parametrize("dictionary", [0, 50, alignment.DICTIONARY])
def test_table_against_brute_force(spark, data, dictionary):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("length(text) < 1500")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in alignment.correspondences(docs, A, B, dictionary).collect()), key=repr)
    assert got == brute(rows)


def test_cases(spark):
    base = awkward(spark)
    rows = [(r.doc_id, r.text) for r in base.collect() if r.doc_id != 5]
    for df in (base, clashing(base)):
        got = sorted((tuple(r) for r in alignment.correspondences(df.where("coalesce(doc_id, 0) <> 5"), A, B, 5).collect()), key=repr)
        assert got == brute(rows)
    assert alignment.correspondences(empty(spark), A, B).count() == 0
    long = alignment.correspondences(base.where("doc_id = 5"), A, B).first()
    assert long.n_links == long.n_a + long.n_b - long.n_groups and long.n_groups > 29_999
    words = alignment.aligned(documents(spark, [(1, "a b", None, None, None)]), A, B, texts=True).first()
    assert words.groups == ";".join(plain("a b")[2])


def test_no_more_pairs_than_asked(spark):
    counts = spark.createDataFrame([(k, 1 + k % 7, True) for k in range(1000)], "pair long, docs long, best boolean")
    for most in (0, 1, 142, 150, 999, 1000):
        known, docs, _ = alignment.frequent(counts, most)
        assert len(known) <= most and set(docs.tolist()) == set(range(8 - len(set(docs.tolist())), 8))
    assert len(alignment.frequent(counts, 1000)[0]) == 1000
