import numpy as np
import pytest

from lexgrove.llm import compact_windows as cw
from lexgrove.llm.queries import op8_substring_dedup
from tests.llm.conftest import SMALL


def test_windows_cover_every_passage_once():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 120).astype(np.uint64)
    values[40:70] = values[40]  # ties
    for least in (1, 5, 20):
        left, c, right = cw.windows(values, np.array([0, 90]), np.array([90, 120]), least)
        for start, end in ((0, 90), (90, 120)):
            for a in range(start, end):
                for b in range(a + least - 1, end):
                    hit = np.flatnonzero((left <= a) & (a <= c) & (c <= b) & (b <= right))
                    assert len(hit) == 1 and values[c[hit[0]]] >> np.uint64(24) == values[a : b + 1].min() >> np.uint64(24)


def test_query_finds_what_brute_force_finds(spark, rows):
    out = op8_substring_dedup(spark, SMALL).collect()
    words = {i: (r.text or "").lower().split() for i, r in rows.items()}
    seen, want = {}, {}
    for i in sorted(words):  # runs of 50 words that an earlier document has
        runs = {tuple(words[i][k : k + 50]) for k in range(len(words[i]) - 49)}
        for run in runs:
            if run in seen:
                want.setdefault(i, set()).add(seen[run])
        for run in runs:
            seen.setdefault(run, i)
    found = {r.doc_id for r in out} | {r.source_doc for r in out}
    assert set(want) <= {r.doc_id for r in out} and {j for v in want.values() for j in v} <= found
    classes = {r.doc_id: r.class_id for r in out} | {r.source_doc: r.class_id for r in out}
    assert all(classes[i] == classes[j] for i, js in want.items() for j in js)
    for r in out:
        a, b = (cw.tokens(" ".join(words[d][s : e + 1])) for d, s, e in ((r.doc_id, r.start_word, r.end_word), (r.source_doc, r.source_start, r.source_end)))
        assert r.similarity >= 0.8 and len(np.intersect1d(a, b)) / len(np.union1d(a, b)) == r.similarity and r.end_word - r.start_word >= 49


def _fresh(seed):
    rng = np.random.default_rng(seed)
    return lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]


def _found(spark, docs):
    """The classes that documents of two or more are in."""
    out = cw.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    by = {}
    for r in out:
        by.setdefault(r.class_id, set()).update((r.doc_id, r.source_doc))
    return list(by.values()), out


@pytest.mark.parametrize("n_words", [50, 60, 100, 200])
def test_recall_of_pairs_by_similarity(spark, n_words):
    """Of all pairs of passages at 0.8 or more, by how many words are replaced at random places."""
    fresh, rng, docs, want = _fresh(n_words), np.random.default_rng(1), [], []
    for i in range(120):
        one = fresh(n_words)
        two = one.copy()
        for k in rng.integers(0, n_words, i % (2 + n_words // 50)):
            two[k] = fresh(1)[0]
        a, b = cw.tokens(" ".join(one)), cw.tokens(" ".join(two))
        if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8:
            want.append((2 * i, 2 * i + 1))
        docs += [(2 * i, " ".join([*fresh(40), *one, *fresh(70)])), (2 * i + 1, " ".join([*fresh(90), *two, *fresh(20)]))]
    found = {(r.source_doc, r.doc_id) for r in _found(spark, docs)[1]}
    assert len(want) > 60 and len(found & set(want)) >= 0.9 * len(want) and all(b == a + 1 and a % 2 == 0 for a, b in found)


def test_passages_behind_foreign_leaders(spark):
    """Two first documents hold pieces of a passage that two later ones hold whole."""
    fresh, docs = _fresh(7), []
    for g in range(20):
        passage = fresh(60)
        pieces = [passage[k : k + 10] for k in range(0, 60, 10)]
        docs += [(10 * g + k, " ".join(w for p in pieces[k::2] for w in [*fresh(30), *p])) for k in (0, 1)]
        docs += [(10 * g + k, " ".join([*fresh(50), *passage, *fresh(50)])) for k in (2, 3)]
    groups, _ = _found(spark, docs)
    assert sorted(map(sorted, groups)) == [[10 * g + 2, 10 * g + 3] for g in range(20)]


def test_passages_around_a_common_sentence(spark):
    """Pairs share ten words beside a sentence of forty that all have, one also with a replaced word; a group shares thirty."""
    fresh, docs = _fresh(5), []
    common = fresh(40)
    docs.append((0, " ".join([*fresh(60), *common, *fresh(60)])))  # has the sentence, and no passage
    for i in range(60):
        passage = [*fresh(10), *common, *fresh(10)]
        other = passage.copy()
        if i % 2:
            other[30] = "other"
        docs += [(2 * i + k, " ".join([*fresh(60), *p, *fresh(60)])) for k, p in ((1, passage), (2, other))]
    tail = fresh(30)
    docs += [(1000 + i, " ".join([*fresh(60), *common, *tail, *fresh(60)])) for i in range(30)]
    groups, out = _found(spark, docs)
    whole = [g for g in groups if min(g) < 1000]
    assert len([g for g in whole if len(g) == 2]) >= 58 and all(len(g) == 2 and max(g) == min(g) + 1 for g in whole)
    assert [sorted(g) for g in groups if min(g) >= 1000] == [list(range(1000, 1030))]


def test_near_copies_and_a_common_passage(spark):
    fresh = _fresh(0)
    passage, docs = fresh(70), []
    for i in range(40):
        own = passage.copy()
        if i % 2:
            own[35] = "other"
        docs.append((i, " ".join([*fresh(30), *own, *fresh(80)])))
    docs += [(100 + i, " ".join(fresh(200))) for i in range(40)]
    groups, out = _found(spark, docs)
    assert groups == [set(range(40))]
    assert all(28 <= r.start_word <= 48 and 79 <= r.end_word <= 101 for r in out)


def test_crowded_keys_and_many_partitions_change_nothing(spark, docs, monkeypatch):
    def classes():
        out = cw.repeated_passages(docs).collect()
        return {r.doc_id: r.class_id for r in out} | {r.source_doc: r.class_id for r in out}

    plain = classes()
    for name, value in (("SAMPLE", 1), ("CROWD", 3), ("SALTS", 4)):
        monkeypatch.setattr(cw, name, value)
    assert len(cw._crowded(docs.selectExpr("doc_id AS doc", "0S AS variant", "text"), 46)) > 5
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert classes() == plain  # pairs may differ where partitions meet
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_texts_are_looked_at_in_pieces(spark, monkeypatch):
    fresh = _fresh(8)
    monkeypatch.setattr(cw, "PIECE", 100)
    passage = fresh(60)
    docs = [(1, " ".join([*fresh(470), *passage, *fresh(500)])), (2, " ".join([*fresh(70), *passage, *fresh(10)]))]
    assert _found(spark, docs)[0] == [{1, 2}]


def test_repeated_ids_keep_each_text(spark):
    fresh = _fresh(9)
    a, b = fresh(60), fresh(60)
    docs = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*fresh(9), *a])), (3, " ".join([*fresh(9), *b])), (3, " ".join([*fresh(9), *b]))]
    assert _found(spark, docs)[0] == [{1, 2, 3}]


def test_copies_are_members_of_one_text(spark, monkeypatch):
    """Copies of a text have no windows of their own, yet each has its row and its class, also by what the text shares with another."""
    fresh, seen, pairs = _fresh(11), [], cw._pairs
    passage, short = fresh(60), " ".join(fresh(49))
    copy = " ".join([*fresh(20), *passage, *fresh(20)])
    docs = [(i, copy) for i in range(5, 305)] + [(7, copy), (3, " ".join([*fresh(30), *passage]))] + [(i, short) for i in range(400, 500)]
    monkeypatch.setattr(cw, "_pairs", lambda own, least: seen.append(own.count()) or pairs(own, least))
    groups, out = _found(spark, docs)
    assert seen == [3] and groups == [{3, *range(5, 305)}]
    assert sorted(r.doc_id for r in out if r.source_doc == 5) == list(range(6, 305))
    assert all((r.start_word, r.end_word, r.source_start, r.source_end, r.similarity) == (0, 99, 0, 99, 1.0) for r in out if r.source_doc == 5)
    assert {(r.doc_id, r.source_doc) for r in out if r.doc_id == 5} == {(5, 3)}


def test_odd_rows(odd, none):
    out = cw.repeated_passages(odd)
    assert out.columns == ["doc_id", "start_word", "end_word", "source_doc", "source_start", "source_end", "similarity", "class_id"]
    assert out.count() == 0  # the long text repeats itself only
    twice = odd.union(odd.where("doc_id = 6").selectExpr("doc_id + 100", *(f"`{c}`" for c in odd.columns[1:])))
    assert {r.doc_id for r in cw.repeated_passages(twice).collect()} == {106}
    assert cw.repeated_passages(none).count() == 0
