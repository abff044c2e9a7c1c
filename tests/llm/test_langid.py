import math

import numpy as np

import zlib

from lexgrove.llm import langid
from lexgrove.llm.queries import op10_language_id


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op10_language_id(spark, sf).collect()
    assert len(out) == len(truth) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    test = [r for r in out if r.held_out]
    right = [r for r in test if r.lang_pred == truth[r.doc_id]]
    assert len(right) / len(test) >= 0.97
    assert abs(sum(r.score for r in test) / len(test) - len(right) / len(test)) < 0.06  # calibrated
    assert sum(r.score < 0.5 for r in test) / len(test) < 0.02


def test_l1_makes_the_weights_sparse(docs):
    model = langid.fit(docs)
    assert model.langs == ["de", "en", "es", "fr"] and (model.weights == 0).mean() > 0.5


def test_odd_rows(odd, none):
    model = langid.fit(odd)
    out = langid.predict(odd, model)
    assert out.columns == [*[c for c in odd.columns if c != "score"], "lang_pred", "score"]
    for r in out.collect():
        has = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred != "und") == has and (has or r.score == 0)
    empty = langid.fit(none)
    assert empty.langs == [] and langid.predict(none, empty).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}


def plain_buckets(text):
    """The bucket of each gram, a code point at a time."""
    cps = [ord(c.lower()[0]) if c.isalpha() else 32 for c in f" {text} "]
    out = []
    for n in langid.ORDERS:
        for i in range(len(cps) - n + 1):
            h = cps[i] * 0x9E3779B1 % 2**32
            for k in range(1, n):
                h = (h ^ cps[i + k]) * (0x85EBCA6B + 2 * k) % 2**32
            out.append(((h ^ h >> 15) * (0x2C1B3C6D + 2 * n) % 2**32) >> 16)
    return out


def test_scores_are_those_of_a_plain_scorer(docs, rows):
    model = langid.fit(docs)
    out = {r.doc_id: r for r in langid.predict(docs.select("doc_id", "text"), model).collect()}
    for i in list(rows)[:60]:
        text = rows[i].text or ""
        own = plain_buckets(text)
        z = [sum(float(model.weights[b, k]) for b in own) / len(own) / model.temperature for k in range(len(model.langs))]
        e = [math.exp(x - max(z)) for x in z]
        if any(c.isalpha() for c in text):
            assert out[i].lang_pred == model.langs[e.index(max(e))] and abs(out[i].score - max(e) / sum(e)) < 1e-4
        else:
            assert (out[i].lang_pred, out[i].score) == ("und", 0)


def test_ftrl_takes_the_steps_of_a_plain_one():
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(40, 6, replace=False)), rng.random(6), int(rng.integers(3))) for _ in range(30)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.01
    z, n = ([[0.0] * 3 for _ in range(langid.BUCKETS + 1)] for _ in range(2))

    def weight(i, k):
        return 0.0 if abs(z[i][k]) <= l1 else ((l1 if z[i][k] > 0 else -l1) - z[i][k]) / ((beta + math.sqrt(n[i][k])) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(2):
        for r in order.permutation(len(rows)):
            at, x, y = rows[r]
            w = {(i, k): weight(i, k) for i in at for k in range(3)}
            s = [sum(v * w[i, k] for i, v in zip(at, x)) for k in range(3)]
            total = sum(math.exp(v) for v in s)
            for i, v in zip(at, x):
                for k in range(3):
                    g = v * (math.exp(s[k]) / total - (k == y))
                    z[i][k] += g - (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / alpha * w[i, k]
                    n[i][k] += g * g
    got = langid.ftrl(rows, 3, epochs=2)
    assert all(abs(got[i, k] - weight(i, k)) < 1e-9 for i in range(41) for k in range(3))


def test_ties_go_to_the_first_language(spark):
    model = langid.Model(["aa", "bb"], np.zeros((langid.BUCKETS + 1, 2)), 1.0)
    out = langid.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).first()
    assert (out.lang_pred, out.score) == ("aa", 0.5)


def test_the_sample_is_bounded(docs, monkeypatch):
    seen = []
    plain = langid.ftrl
    monkeypatch.setattr(langid, "ftrl", lambda rows, n: seen.append(sum(len(a) for a, _, _ in rows)) or plain(rows, n))
    langid.fit(docs)
    langid.fit(docs, max_grams=seen[0] // 4)
    assert seen[1] < seen[0] / 2
