"""Tokens, lines and sentences made in each document's own row: the same as by windows and groups, with nothing shuffled or stored."""

import os

import pytest
from pyspark.sql import functions as F

from lexgrove.operators import corpus as C
from lexgrove.operators import rules as R
from lexgrove.operators.graph import shared_folder
from lexgrove.plans import all_queries, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    texts = ["One two. Three! four\n\n five?", "", None, "\n \n", "a", "no end here\nnor here,", ". ! ?\n;", "x" * 50 + ". " + "é y\tz.\n" * 40]
    return spark.createDataFrame([(i, f"s{i % 2}", t) for i, t in enumerate(texts, 1)], "doc_id long, source string, text string")


def rows(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_annotated_equals_windows(odd):
    want = C.with_order(C.with_sentences(C.identified(C.tokens(odd))), odd)
    got = C.annotated(odd, C.documents_in_order(odd))
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns)) and want.count() > 100


def test_spans_and_trigrams_equal_groups(odd):
    tok = C.with_sentences(C.identified(C.tokens(odd)))
    columns = ["doc_id", "first_token", "last_token", "n_tokens", "text"]
    for key, own in (("line", C.line_spans(odd)), ("sent", C.sentence_spans(odd))):
        want = rows(C.span(["doc_id", key], tok), [key, *columns])
        assert rows(own.withColumn("text", C.words_text()), [key, *columns]) == want
        assert rows(R.span_of_places(tok, ["doc_id", key]), [key, *columns[:4]]) == [w[:5] for w in want]
    grams = C.trigrams(tok)
    assert rows(C.sentence_trigrams(odd), grams.columns) == rows(grams, grams.columns)


def test_word_numbers_listed(spark):
    lists = [[1, 2, 3], [1], [2, 3], [1, 3], [1, 1, 3], [1, 2, 2]]
    lines = spark.createDataFrame(list(enumerate(lists)), "doc_id long, words array<int>").withColumn("line", F.lit(1).cast("long"))
    want = R.word_numbers(lines.select("doc_id", "line", F.explode("words").alias("word")))
    assert rows(R.listed_numbers(lines), ["id"]) == rows(want, ["id"]) and want.count() == 4


def test_queries_of_rows_shuffle_no_tokens_and_store_none(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name in ("b3_line", "b4_sentence", "q6_split_lines", "x4_cells", "l3b_word_numbers", "a5_line_text"):
        text = plan(registry.QUERIES[name](spark, SF))
        assert text.count("Exchange") <= 1 and "Aggregate" not in text and "Sort" not in text, name  # at most the texts are dealt out
    before = {d for d, _, _ in os.walk(shared_folder(spark).removeprefix("file:"))}
    for name in ("b1_token", "w2_next_id", "q1_lemma_occurrences", "x1_resolve", "l4_line_span"):
        assert registry.QUERIES[name](spark, SF).count() > 0
    new = {d for d, _, _ in os.walk(shared_folder(spark).removeprefix("file:"))} - before
    assert not [d for d in new if os.path.basename(d) in ("token", "line", "sentence", "lemma")]
