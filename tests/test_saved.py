import pytest

from lexgrove.plans import saved as S


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(1, "s1", "The cat sat. The\ndog sat on the cat. The cat sat on it.", "en"), (2, "s2", "Now the cat sat on the mat.", "en"), (3, "s1", "", "en")]
    return S.Corpus(spark.createDataFrame(rows, "doc_id long, source string, text string, lang string"))


def test_scopes_and_types(corpus):
    assert [r.ord for r in S.run(corpus, "lemma_occurrences", {"lemma": "the"}).collect()] == [1, 4, 8, 10, 16, 20]
    assert [r.ord for r in S.run(corpus, "lemma_occurrences", {"lemma": "the", "scope": "s1 1:2"}).collect()] == [8, 10]
    assert [tuple(r) for r in S.run(corpus, "lemma_by_book", {"lemma": "cat"}).collect()] == [("s1", 3), ("s2", 1)]
    assert [tuple(r) for r in S.run(corpus, "split_lines", {}).collect()] == [(1, 1, 2), (1, 2, 2)]
    assert [tuple(r) for r in S.run(corpus, "shared_trigrams", {"a": "s1 1", "b": "s2"}).collect()] == [("cat", "sat", "on", 1, 1), ("sat", "on", "the", 1, 1), ("the", "cat", "sat", 2, 1)]
    assert [r.surface for r in S.run(corpus, "token", {"token": "s1 1:2!2", "width": "1"}).collect()] == ["dog", "sat", "on"]
    assert S.run(corpus, "token", {"token": "doc:n0000000010000200002"}, limit=2).count() == 2


@pytest.mark.parametrize(("name", "raw", "why"), [
    ("nothing", {}, "no saved query"), ("lemma_by_book", {}, "needs lemma"), ("lemma_by_book", {"lemma": "a", "x": "1"}, "no parameter x"),
    ("token", {"token": "cat"}, "no token id"), ("token", {"token": "s1 1:1!1", "width": "many"}, "whole number"),
    ("lemma_occurrences", {"lemma": "a", "scope": "s9 1:1"}, "unknown book"), ("lemma_occurrences", {"lemma": "a", "scope": "s1 1:9"}, "not in this corpus"), ("lemma_occurrences", {"lemma": "a", "scope": "s1 1:2-1"}, "backwards"),
])
def test_refusals(corpus, name, raw, why):
    with pytest.raises(S.ParamError, match=why):
        S.run(corpus, name, raw)


def test_queries_on_relations(spark):
    docs = spark.createDataFrame([(1, "s1", "Anna saw him. He saw Anna.")], "doc_id long, source string, text string")
    n = [f"doc:n0000000010000100{k:03}" for k in range(1, 7)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    corpus = S.Corpus(
        docs, refers_to=frame([(n[3], n[2], 1), (n[2], n[5], 1), (n[2], n[0], 2), (n[5], n[3], 1)], "src string, dst string, ord long"),
        has_subject=frame([(n[1], n[0], 1), (n[4], n[3], 1)], "src string, dst string, ord long"),
        frame_arg=frame([(n[1], n[0], "A0", False, 1), (n[1], n[2], "A1", False, 2), (n[4], None, "A0", True, 1)], "src string, dst string, arg_role string, implicit boolean, ord long"),
        groups=frame([("g1", "c1", "s"), ("g2", "c2", "o")], "id string, parent string, role string"), inside=frame([("g1", n[0]), ("g2", n[5])], "anc string, leaf string"),
        features=frame([(n[0], "g1", None, "noun", "nominative"), (n[1], "c1", "v", "verb", None), (n[4], "c2", "v", "verb", None), (n[5], "g2", None, "noun", "accusative"), (n[3], "c2", "s", "pronoun", "nominative")], "id string, parent string, role string, pos string, gcase string"),
    )
    run = lambda name, **raw: [tuple(r) for r in S.run(corpus, name, raw).collect()]
    assert [r[1] for r in run("referent_chain", token="s1 1:1!4")] == [n[3], n[2], n[5]]
    assert [(r[0], r[3]) for r in run("subject_lemma_tree", lemma="anna")] == [(n[1], n[0])] and [(r[0], r[3]) for r in run("subject_lemma_tree", lemma="lemma:he")] == [(n[4], n[3])]
    assert [(r[0], r[3]) for r in run("subject_lemma_subjref", lemma="he", scope="s1 1:1")] == [(n[4], n[3])]
    assert [(r[0], r[3], r[6]) for r in run("frame_args", verb_lemma="saw")] == [(n[1], n[0], False), (n[4], None, True)]
    assert [r[4] for r in run("frame_args", verb_lemma="saw", role="A1")] == ["him"]
    with pytest.raises(S.ParamError, match="unknown book"):
        S.run(corpus, "token", {"token": "s9 1:1!1"})
    with pytest.raises(S.ParamError, match="no refers_to"):
        S.run(S.Corpus(docs), "referent_chain", {"token": n[0]})


WRITTEN = """
-- name: words_by_key
-- doc: Words of a key in a passage, composed.
-- param: word lemma
-- param: scope passage optional
-- param: least int = 1
SELECT nfc(surface) AS form, count(*) AS n FROM token
WHERE search_key(surface) = search_key(:word) AND ord BETWEEN :scope_first AND :scope_last
GROUP BY ALL HAVING count(*) >= :least ORDER BY form
"""


def test_queries_written_as_sql(spark):
    docs = spark.createDataFrame([(1, "s1", "Ῥόδον, ῥοδον ῥόδον’\nrose"), (2, "s2", "ΡΟΔΟΝ Rose")], "doc_id long, source string, text string")
    corpus = S.Corpus(docs)
    run = lambda **raw: [tuple(r) for r in S.run_sql(corpus, WRITTEN, raw).collect()]
    assert run(word="ροδον") == [("ΡΟΔΟΝ", 1), ("ῥοδον", 1), ("ῥόδον’", 1), ("Ῥόδον", 1)]
    assert run(word="'; DROP VIEW token; --") == [] and run(word="rose", scope="s2") == [("Rose", 1)] and run(word="rose", least="2") == []
    for raw, why in (({}, "needs word"), ({"word": "a", "x": "1"}, "no parameter x"), ({"word": "a", "least": "two"}, "whole number"), ({"word": "a", "scope": "s9"}, "unknown book")):
        with pytest.raises(S.ParamError, match=why):
            S.run_sql(corpus, WRITTEN, raw)
    with pytest.raises(S.ParamError, match="cannot read parameter"):
        S.parse_sql("-- name: a\n-- param: b number\nSELECT 1")
    with pytest.raises(S.ParamError, match="has a name"):
        S.parse_sql("SELECT 1")
