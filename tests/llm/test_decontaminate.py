import random

import numpy as np

from lexgrove.llm import decontaminate as dc
from lexgrove.llm.queries import op6_benchmark_decontamination
from tests.llm.conftest import SMALL


def plain_words(text):
    return "".join(c if c.isalnum() or c in "́" else " " for c in (text or "").lower()).split()


def test_query_finds_every_whole_item_and_leaves_the_rest(spark, rows):
    items = {r.item_id: plain_words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in op6_benchmark_decontamination(spark, SMALL).collect()}
    must, may = set(), set()
    for d, r in rows.items():
        words = plain_words(r.text)
        have = {tuple(words[k : k + 3]) for k in range(len(words) - 2)}
        for i, w in items.items():
            runs = [k for k in range(len(w) - 2) if tuple(w[k : k + 3]) in have]
            share = len({k + j for k in runs for j in range(3)}) / len(w)
            if " ".join(w) in " ".join(words):
                must.add((d, i))
            if share >= 0.6:
                may.add((d, i))
    assert must and must <= got <= may


def test_wand_finds_all_above_the_threshold():
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, [vocab[int(k)] for k in rng.zipf(1.3, 12) % 60]) for i in range(80)]
    df = {t: sum(t in w for _, w in items) for t in vocab}
    index = dc.Index(items, df, len(items), 12.0, 0.5)
    queries = [sorted({int(t) for t in rng.integers(0, len(index.terms), 15)}) for _ in range(60)]
    bounds = index.bounds(np.repeat(np.arange(60), [len(q) for q in queries]), np.concatenate(queries), 60)
    found = 0
    for query, bound in zip(queries, bounds, strict=True):
        scores = np.zeros(len(items))
        for block in index.blocks:
            for t in set(query) & block.keys():
                scores[block[t][0]] += block[t][1]
        for k, block in enumerate(range(0, len(items), dc.BLOCK)):
            own = scores[block : block + dc.BLOCK]
            assert own.max() <= bound[k] + 1e-5
            want = {block + i: x for i, x in enumerate(own) if x >= 0.5}
            got = dict(index.wand(set(query), k))
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
            found += len(want)
    assert found > 20


def test_shards_find_the_same(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    once = sorted(map(tuple, dc.contaminated(docs, items).collect()))
    monkeypatch.setattr(dc, "INDEX_WORDS", 500)
    assert [r[:3] for r in sorted(map(tuple, dc.contaminated(docs, items).collect()))] == [r[:3] for r in once]


def test_odd_rows(spark, odd, none):
    one = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = spark.createDataFrame([(1, one, 5), (2, None, 5), (3, "", 5), (None, "x", 5), (1, one, 5)], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(odd, items).collect()}
    assert got == {(4, 1), (5, 1)}
    clean = dc.decontaminate(odd, items)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 5
    assert dc.contaminated(none, items).count() == 0 and dc.decontaminate(odd, items.where("false")).count() == odd.count()


def test_recall_of_items_with_replaced_words(spark):
    """Every item of the 0.01 tables between foreign words, with no, one or two words replaced at random places."""
    rng = random.Random(3)
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rows, want = [], {}
    for r in items.collect():
        words = " ".join(r.text.split()).split(" ")
        for k in range(12):
            own = words.copy()
            for at in rng.sample(range(len(own)), k % 3):
                own[at] = f"other{rng.randrange(10**6)}"
            rows.append((r.item_id * 100 + k, " ".join([*(f"a{rng.randrange(10**6)}" for _ in range(rng.randrange(150))), *own, *(f"b{rng.randrange(10**6)}" for _ in range(90))])))
            want.setdefault(k % 3, set()).add((r.item_id * 100 + k, r.item_id))
    found = {(r.doc_id, r.item_id) for r in dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    share = [len(found & want[k]) / len(want[k]) for k in range(3)]
    assert share[0] == 1 and share[1] >= 0.97 and share[2] >= 0.9, share


def test_small_batches_of_passages_change_nothing(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    plain = sorted(map(tuple, dc.contaminated(docs, items).collect()))
    monkeypatch.setattr(dc, "CELLS", 500)
    assert sorted(map(tuple, dc.contaminated(docs, items).collect())) == plain


def test_rows_without_id_and_equal_passages(spark):
    item = " ".join(f"q{k}" for k in range(20))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(None, "x y " + item), (None, "clean"), (5, item), (5, "clean"), (6, f"{item} {'z ' * 200}{item}")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in dc.decontaminate(docs, items).collect()) == [(0, "clean"), (5, "clean")]
    assert {r.doc_id: r.start_word for r in dc.contaminated(docs, items).collect()} == {5: 0, 6: 0}  # a tie goes to the first passage
