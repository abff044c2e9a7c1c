import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexgrove.llm import token_counts as tc
from lexgrove.llm.queries import op5_token_counts
from tests.llm.conftest import SMALL

PATH = tc.tokenizer_path()
LIBRARY, OURS = Tokenizer.from_file(PATH), tc.Merges(PATH)


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_query_matches_the_library(spark, rows):
    want = dict(zip(rows, library([r.text or "" for r in rows.values()]), strict=True))
    for r in op5_token_counts(spark, SMALL).collect():
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want[r.doc_id], len((rows[r.doc_id].text or "").encode()), want[r.doc_id] > 512)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aab é's 12\n\t\x0b\x1c\x85\xa0　!?한<|endoftext|>İ"), max_size=40), min_size=1, max_size=4))
def test_any_text(texts):
    assert OURS.count_texts(texts) == library(texts)


def test_hard_texts():
    texts = ["", " ", "  ", " a", "a ", "a  b", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "a" * 5001, "ab" * 3000, "\n\n a", "it's we'll", "x" * 100_000]
    texts += ["".join(map(chr, np.random.default_rng(i).integers(1, 0x3000, 200))) for i in range(50)]
    assert OURS.count_texts(texts) == library(texts)


def test_odd_rows(odd, none):
    want = sorted(zip([r.doc_id or -1 for r in odd.collect()], library([r.text or "" for r in odd.collect()]), strict=True))
    assert sorted((r.doc_id or -1, r.n_tokens) for r in tc.count_tokens(odd).collect()) == want
    assert tc.count_tokens(none).count() == 0
