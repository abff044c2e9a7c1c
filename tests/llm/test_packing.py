import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexgrove.llm import packing
from lexgrove.llm.queries import op9_packing
from tests.llm.conftest import SMALL


def ids_of(texts):
    tok = Tokenizer.from_file(packing.tokenizer_path())
    return [e.ids + [1] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(pieces, docs):
    """pieces of documents (number -> ids) tile them and their sequences; returns the padding."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == docs.keys()
    for d, own in by_doc.items():
        ids, at = docs[d], 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_query(spark, rows):
    ids = dict(zip(rows, ids_of([r.text for r in rows.values()]), strict=True))
    assert check(op9_packing(spark, SMALL).collect(), ids) == 0


def test_groups_are_bounded_and_still_whole(docs, rows):
    ids = dict(zip(rows, ids_of([r.text for r in rows.values()]), strict=True))
    assert check(packing.pack_documents(docs, group_tokens=5000).collect(), ids) == 0


def test_first_fit_decreasing():
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in rng.integers(1, 3000, 400)]
    seqs = packing.pack(sizes)
    assert sum(p[2] for s in seqs for p in s) == sum(sizes)
    cut = len({p[0] for s in seqs for p in s if p[2] < 2048 and sizes[p[0]] < 2048 and p[2] != sizes[p[0]]})
    assert cut < 20  # most documents stay whole
    tree = packing.Tournament(5, 10)
    assert [tree.place(n) for n in (6, 5, 4, 5, 10)] == [0, 1, 0, 1, 2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbÉé's 12\n\t\x0b\x1c\x85\xa0\u3000!?.,||한İΣσ\u0301<|endoftext|>"), max_size=40), min_size=1, max_size=4))
def test_any_text(texts):
    assert packing.encode(texts, packing.tokenizer_path()) == [np.array(x[:-1], "<u2").tobytes() for x in ids_of(texts)]


def test_odd_rows(odd, none):
    pieces = packing.pack_documents(odd).collect()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    want = ids_of([t for _, t in texts])
    assert sum(p.length for p in pieces) == sum(map(len, want))
    for (d, _), ids in zip(texts, want, strict=True):
        assert any(p.doc_id == d and p.doc_tokens == len(ids) for p in pieces)
    assert packing.encode([t or "" for _, t in texts], packing.tokenizer_path()) == [np.array(x[:-1], "<u2").tobytes() for x in want]
    assert packing.pack_documents(none).count() == 0


def test_a_row_that_is_a_third_of_all_is_dealt_out(spark):
    """No task packs over twice the mean, and every copy is packed whole."""
    docs = spark.createDataFrame([(k, f"word{k} and more") for k in range(8000)] + [(-1, "the same")] * 3000 + [(None, None)] * 1000, "doc_id long, text string")
    pieces = packing.pack_documents(docs.repartition(4)).cache()
    tasks = [r["count"] for r in pieces.groupBy(F.shiftright("sequence_id", 33).alias("task")).count().collect()]
    assert len(tasks) == 8 and max(tasks) < 2 * sum(tasks) / len(tasks)
    whole = pieces.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
    n = {r.doc_id: r.n // r.doc_tokens for r in whole}
    assert n[-1] == 3000 and n[None] == 1000 and sum(n.values()) == 12000 and all(r.n % r.doc_tokens == 0 for r in whole)
    deal = np.array([5, 7, 5, 5, 7, 9], np.int64)
    assert sorted(packing.spread(deal)) == sorted(packing.spread(deal[::-1].copy())) and len(set(packing.spread(deal))) == 6
