import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from taleweave.llm import token_files
from taleweave.scratch import fresh_path
from tests.llm.helpers import awkward, clashing, documents, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300), st.data())
def test_packing_round_trip(bits, ids, draw):
    own = np.array([x & ((1 << bits) - 1) for x in ids], np.uint32)
    data = token_files.pack(own, bits)
    assert len(data) == -(-len(own) * bits // 8)
    a = draw.draw(st.integers(0, len(own)))
    b = draw.draw(st.integers(a, len(own)))
    assert token_files.unpack(data, bits, a, b - a).tolist() == own[a:b].tolist()


def test_random_access():
    ids = np.arange(20_000, dtype=np.uint32) % 3_001
    f = token_files.TokenFile(token_files.file_bytes([4, 9, 12], [5_000, 0, 15_000], ids, 12))
    assert f.document(0).tolist() == ids[:5_000].tolist() and len(f.document(1)) == 0
    assert f.ids(4_095, 4_099).tolist() == ids[4_095:4_099].tolist() and f.document(2).tolist() == ids[5_000:].tolist()
    with pytest.raises(ValueError):
        token_files.TokenFile(b"nope" + bytes(60))


def library(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def expected(rows, end=2):
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library(text), end]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_against_the_library(spark):
    df = awkward(spark)
    for own in (df, clashing(df)):
        got = token_files.pack_documents(own, PATH, 49_408, 2).collect()
        assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, expected([(r.doc_id, r.text) for r in df.collect()])))
    assert token_files.pack_documents(empty(spark), PATH, 49_408, 2).count() == 0


def test_many_files_and_texts_of_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = fresh_path(spark, "tokens")
    manifest = token_files.write_token_files(docs, out, PATH, 49_408, 2, file_ids=5_000)
    assert manifest.count() > 5
    got = {r.doc_id: tuple(r) for r in token_files.read_token_files(out, manifest).collect()}
    for want in expected([(r.doc_id, r.text) for r in docs.collect()]):
        assert got[want[0]] == want


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_word_path_equals_the_library(text):
    encoder = _encoder()
    assert np.frombuffer(encoder(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def _encoder(cache=[]):  # noqa: B006
    if not cache:
        cache.append(token_files.Encoder(PATH, token_files.splits_by_word(PATH)))
        assert cache[0].words is not None
    return cache[0]


def test_special_and_mixed_texts():
    encoder = _encoder()
    for text in ("<|endoftext|> a", "a<|startoftext|>B's C'LL", "ÀÉ Straße İ ı ſ K", "don't  WON'T\n\n12 34five", "​﻿x", "ﬁne Å"):
        assert np.frombuffer(encoder(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_rows_in_order_of_files(spark):
    rows = [(k * 7 % 101, f"text {k}", "en", "a", 1) for k in range(101)]
    got = sorted(tuple(r) for r in token_files.pack_documents(documents(spark, rows), PATH, 49_408, 2).collect())
    assert [r[1] for r in got] == sorted(r[1] for r in got)
