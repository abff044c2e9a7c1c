import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lexgrove.llm import langid
from tests.llm.conftest import SMALL
from tests.llm.test_decontaminate import plain_words
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_packing import check, ids_of
from tests.llm.test_similar_texts import grams, plain_groups


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and gives, the documents first."""
    docs = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for _, f in corpus_pipeline.STAGES:
        out = f(spark, docs[-1], SMALL)
        docs.append(spark.createDataFrame(out.collect(), out.schema))
    return docs


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[1:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]


def test_language_keeps_clean_documents(stages):
    assert texts(stages[1]).items() <= texts(stages[0]).items() and stages[1].count() >= 0.98 * stages[0].count()


def test_language_rejects_what_a_text_by_itself_is_unsure_of(stages):
    before, model = texts(stages[0]), langid.fit(stages[0])
    want = set()
    for i, text in before.items():
        (lang,), (score,) = model.predict([text])
        if lang != "und" and score >= corpus_pipeline.MIN_SCORE:
            want.add(i)
    assert texts(stages[1]).keys() == want


def test_lines(stages):
    before, after = texts(stages[1]), texts(stages[2])
    want = plain_lines(sorted(before.items()))
    gone = {i for i, t in want.items() if not t.strip(" \n") and before[i].strip(" \n")}
    assert after == {i: t for i, t in want.items() if i not in gone}
    assert stages[2].where(F.col("n_chars") != F.length("text")).count() == 0


def test_near_duplicates(stages):
    before, after = texts(stages[2]), texts(stages[3])
    want, _ = plain_groups({i: grams(t) for i, t in before.items()})
    gone = {i for i, least in want.items() if i != least}
    assert after.items() <= before.items() and before.keys() - gone <= after.keys()
    assert len(gone - after.keys()) >= 0.9 * len(gone)


def test_benchmark(spark, stages):
    items = [plain_words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before, after = texts(stages[3]), texts(stages[4])
    share, whole = {}, set()
    for i, text in before.items():
        words = plain_words(text)
        have = {tuple(words[k : k + 3]) for k in range(len(words) - 2)}
        share[i] = max(len({k + j for k in range(len(w) - 2) if tuple(w[k : k + 3]) in have for j in range(3)}) / len(w) for w in items)
        whole |= {i} if any(" ".join(w) in " ".join(words) for w in items) else set()
    assert whole and {i for i, x in share.items() if x < 0.6} <= after.keys() and not whole & after.keys()


def test_packing(stages):
    before = texts(stages[4])
    assert check(stages[5].collect(), dict(zip(before, ids_of(list(before.values())), strict=True))) == 0


def test_empty_and_odd_documents(spark, odd, none):
    only = [f for f in odd.columns if f in ("doc_id", "text", "lang", "source", "n_chars")]
    left = []
    for docs in (none.select(*only), odd.select(*only)):
        for _, f in corpus_pipeline.STAGES:
            docs = f(spark, docs, SMALL)
        left.append(docs.collect())
    assert left[0] == [] and {None, 4, 5, 6, 7, 9, 10} >= {r.doc_id for r in left[1]} >= {6, 7}
    for i in {r.doc_id for r in left[1]}:  # every id of a document that is left lies in one piece
        own = sorted((r.start, r.length, r.doc_tokens) for r in left[1] if r.doc_id == i)
        assert [a for a, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))] and own[-1][0] + own[-1][1] == own[-1][2]
