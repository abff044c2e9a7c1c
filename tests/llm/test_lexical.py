import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from lexgrove.llm import lexical as X
from lexgrove.llm.queries import ORACLES, op11_ranked_search
from tests.llm.conftest import SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, top=20):
    """(id, text) rows of both -> rows, by scoring every document."""
    tfs = [(i, Counter(ts), len(ts)) for i, t in docs if (ts := plain_terms(t))]
    n_docs, n_terms = len(tfs), sum(x[2] for x in tfs)
    df = Counter(t for _, c, _ in tfs for t in c)
    out = []
    for item, text in items:
        scores = defaultdict(int)
        for k, (_, c, n) in enumerate(tfs):
            m = 100 - 25 + 25 * n * n_docs // n_terms
            for t in plain_terms(text):
                if t in c:
                    scores[k] += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
        best = sorted(((-s, tfs[k][0] is not None, tfs[k][0] or 0) for k, s in scores.items() if s > 0))[:top]
        out += [(item, r + 1, i if has else None, -s) for r, (s, has, i) in enumerate(best)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_matches_sql(spark, duck):
    got = rows_of(op11_ranked_search(spark, SMALL))
    assert got == sorted(duck.sql(ORACLES["op11_ranked_search"]).fetchall(), key=str) and len(got) > 400


def test_brute_force(spark, monkeypatch):
    """Common and rare words, repeated words, many equal scores, copies; shards, small buckets and few seeds give the same."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(200)] + ["é", "Ñu", "ı2"]
    draw = lambda n: " ".join(words[min(int(rng.expovariate(0.03)), 202)] for _ in range(n))
    docs = [(i, draw(rng.choice([0, 1, 3, 10, 40, 300]))) for i in range(400)]
    docs += [(1000 - i, docs[7 + i % 3][1].upper()) for i in range(60)] + [(None, docs[8][1]), (5000, None), (7, docs[7][1])]
    items = [(i, draw(rng.choice([1, 2, 8, 30]))) for i in range(40)] + [(40, "w1 w1 w1 W1"), (41, "none"), (42, ""), (None, "w2"), (43, None), (3, "w5-w6"), (3, "w5-w6")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, list(dict.fromkeys(items)))
    assert rows_of(X.ranked_search(d, q)) == want
    monkeypatch.setattr(X, "SEEDS", 30)
    assert rows_of(X.ranked_search(d, q, shard_chars=400)) == want
    assert rows_of(X.ranked_search(d, q, top=3)) == plain(docs, list(dict.fromkeys(items)), 3)


def test_buckets_are_passed_over(monkeypatch):
    """With a threshold, a bucket of short vectors is not looked into, and within one only documents that can reach it are scored."""
    rng = np.random.default_rng(1)
    item = X.Item(np.array([3, 1], np.int32), np.array([900, 10]), np.sqrt(np.array([900.0**2 + 100, 100.0, 0.0])))
    owner, t = np.repeat(np.arange(100), 3), np.tile(np.array([1, 2, 3], np.int32), 100)
    impact = rng.integers(1, 1000, 300)
    scored = []
    monkeypatch.setattr(X.Searched, "_offer", lambda self, i, rid, known, score, at: scored.extend(at.tolist()))
    rid, known = np.arange(100), np.ones(100, bool)
    exact = 10 * impact[0::3] + 900 * impact[2::3]
    for least in (1, 500_000, 850_000, 2_000_000):
        scored.clear()
        X.Searched([item], np.array([least]), 20).bucket(rid, known, owner, t, impact)
        assert scored == np.flatnonzero(exact >= least).tolist()


def test_odd_rows(spark, odd, none, duck):
    items = odd.select("item_id", "text", "rank", "score")
    got = rows_of(X.ranked_search(odd, items))
    rows = odd.collect()
    assert got == plain([(r.doc_id, r.text) for r in rows], list(dict.fromkeys((r.item_id, r.text) for r in rows))) and got
    assert X.ranked_search(none, items).count() == 0 and X.ranked_search(odd, none).count() == 0
