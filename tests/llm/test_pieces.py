import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from taleweave.llm.piece_fst import BEGIN, INSIDE, MARK, Normaliser, Pieces, Transducer, encode_documents
from tests.llm.helpers import awkward, clashing, empty

PATH = public_tokenizers.path("piece_bpe_32k.model")
MACHINE, LIBRARY = Transducer.load(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(text):
    return np.frombuffer(MACHINE.encode(text), "<u4").tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=50))
def test_encoding_equals_the_library(text):
    assert ids(text) == LIBRARY.encode(text)


def test_texts_of_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r for r in encode_documents(docs, PATH).collect()}
    for r in docs.collect():
        want = LIBRARY.encode(r.text)
        assert list(got[r.doc_id].ids) == want and got[r.doc_id].round_trip
        assert got[r.doc_id].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())


@settings(max_examples=100, deadline=None)
@given(st.text(st.characters(blacklist_categories=["Cs"], blacklist_characters="▁\0"), max_size=40))
def test_decoding_round_trip(text):
    assert MACHINE.decode(ids(text)) == text


UNIGRAM = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("▁a", -2.2, 1), ("▁ab", -6.0, 1), ("ba", -1.0, 1), ("aba", -9.0, 1)]


def every_path(machine, text):
    """(weight, pieces) of all paths of the composition, by plain recursion."""
    if not text:
        return [(0.0, [])]
    weights = {p: 1.0 if machine.pairs else -s for p, s in machine.given.items()}
    out = []
    for k in range(1, len(text) + 1):
        head = text[:k]
        if head in weights or k == 1:
            out += [(weights.get(head, machine.machine.fallback) + w, [head, *rest]) for w, rest in every_path(machine, text[k:])]
    return out


def built(pieces, pairs, **more):
    machine = Transducer(pieces, pairs, **more)
    machine.given = {p: s for p, s, kind in pieces if kind == 1}
    return machine


def test_machines_have_a_state_per_prefix():
    weights = {"a": 1.0, "ab": 2.0, "abc": 1.0, "b": 1.0, "▁": 1.0, "▁xy": 1.0}
    machine = Pieces(weights)
    prefixes = {p[:k] for p in weights for k in range(len(p) + 1)}
    assert len(machine.arcs) == len(machine.ends) == len(prefixes)
    assert sum(map(len, machine.arcs)) == len(prefixes) - 1 and sum(e is not None for e in machine.ends) == len(weights)
    whole = {p.piece for p in model().pieces if p.type in (1, 4)}
    assert len(MACHINE.machine.arcs) == len({p[:k] for p in whole for k in range(len(p) + 1)})


def model():
    from sentencepiece import sentencepiece_model_pb2 as schema

    m = schema.ModelProto()
    with open(PATH, "rb") as f:
        m.ParseFromString(f.read())
    return m


@settings(max_examples=150, deadline=None)
@given(st.text("ab▁c", max_size=9))
def test_unigram_path_is_the_least_of_all(text):
    machine = built(UNIGRAM, False)
    weight, path = machine.shortest(text)
    assert "".join(path) == text and weight == pytest.approx(min(w for w, _ in every_path(machine, text)))


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=9))
def test_pair_model_leaves_one_path_of_finite_weight(text):
    pieces = [("<unk>", 0.0, 2), ("a", -9.0, 1), ("b", -8.0, 1), ("c", -7.0, 1), ("ab", -1.0, 1), ("bc", -2.0, 1), ("abc", -3.0, 1), ("aa", -4.0, 1), ("cab", -5.0, 1)]
    machine = built(pieces, True)
    finite = [(w, p) for w, p in every_path(machine, text) if all(machine.merges.merged(a + b) == [a, b] for a, b in zip(p, p[1:], strict=False)) and machine.merges.merged(p[0]) == [p[0]]]
    assert finite == [machine.shortest(text)] and finite[0][1] == machine.merges.merged(text)


@settings(max_examples=100, deadline=None)
@given(st.text("a b", max_size=12))
def test_normaliser_that_squeezes(text):
    want = "".join(MARK + w for w in text.split())
    assert Normaliser(True, True).run(text, BEGIN) == want
    assert Normaliser(True, False).run(text, BEGIN) == (MARK + text.replace(" ", MARK) if text else "")
    assert Normaliser(False, False).run(text, INSIDE) == text.replace(" ", MARK)


@settings(max_examples=100, deadline=None)
@given(st.text("ab ▁x", max_size=12))
def test_parts_equal_the_whole(text):
    machine = built(UNIGRAM, False, squeeze=True)
    whole = machine.shortest(machine.normaliser.run(text.replace(MARK, " "), BEGIN))[0]
    names = {i: p for i, (p, _, _) in enumerate(UNIGRAM)}
    got = [names[i] for i in np.frombuffer(machine.encode(text.replace(MARK, " ")), "<u4").tolist()]
    assert "x" in text or sum(-machine.given[g] for g in got) == pytest.approx(whole)


def test_cases(spark):
    for df in (awkward(spark), clashing(awkward(spark))):
        rows = encode_documents(df, PATH).collect()
        assert len(rows) == 9 and all(r.round_trip for r in rows)
        assert {r.doc_id: r.n_pieces for r in rows}[2] == 0
    assert encode_documents(empty(spark), PATH).count() == 0
