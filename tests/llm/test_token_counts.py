import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from taleweave.llm.token_counts import PrefixCounter, count_tokens, longest_within
from tests.llm.helpers import awkward, clashing, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
COUNTER, LIBRARY = PrefixCounter(PATH), Tokenizer.from_file(PATH)


def count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=30), st.text("ab 'stvelrdm\n\t1é漢<|endoftext|>", max_size=40)))
def test_every_prefix_equals_the_library(text):
    assert COUNTER.prefix_counts(text).tolist() == [count(text[: k + 1]) for k in range(len(text))]


def test_special_strings_and_spaces():
    for text in ("a<|endoftext|>b", "<|endoftext|><|endoftext|>", "x   y\n\n z  ", "it's we'll 've 'r", "<|endoftext", "  <|endoftext|>  ", " 　a  b\x85"):
        assert COUNTER.prefix_counts(text).tolist() == [count(text[: k + 1]) for k in range(len(text))], text


def test_table_and_budget(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r for r in count_tokens(docs, PATH, (100, 512)).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        assert g.n_tokens == count(r.text) and g.n_bytes == len(r.text.encode())
        if g.n_tokens > 100:
            assert count(r.text[: g.fits[0]]) <= 100
    assert longest_within(COUNTER.prefix_counts("one two three"), 2) == len("one two")


def test_cases(spark):
    for df in (awkward(spark), clashing(awkward(spark))):
        rows = count_tokens(df, PATH, prefixes=True).collect()
        assert len(rows) == 9
        for r in rows:
            assert r.n_tokens == (r.prefix_counts[-1] if r.prefix_counts else 0)
        assert {r.doc_id: r.n_tokens for r in rows}[2] == 0
    assert count_tokens(empty(spark), PATH).count() == 0
