import random
import re
from collections import Counter, defaultdict

from lexgrove.llm import collocations as K
from lexgrove.llm.queries import ORACLES, op12_phrase_collocations
from tests.llm.conftest import SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest=5, top=2000):
    """(lang, text) -> rows, by counting every phrase."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(ws)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, of in f.items():
        cands = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in cands.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if (i, j) != (0, len(p)) and a >= of[p[i:j]]}
        scored = []
        for p, a in cands.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p), of[p[:k]], of[p[k:]]))
        scored.sort(key=lambda x: (x[0], x[1], x[2].encode()))
        out += [(lang, i + 1, p, -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(scored[:top])]
    return sorted(out)


def test_query_matches_sql(spark, duck):
    got = sorted(map(tuple, op12_phrase_collocations(spark, SMALL).collect()))
    assert got == sorted(duck.sql(ORACLES["op12_phrase_collocations"]).fetchall()) and got


def test_brute_force(spark, docs, rows):
    want = [(r.lang, r.text) for r in rows.values()]
    for least, top, wave in ((3, 2000, 20), (5, 7, 4)):
        got = sorted(map(tuple, K.collocations(docs, least=least, top=top, wave=wave).collect()))
        assert got == plain(want, least, top=top)


def test_few_words_in_many_orders(spark):
    """Phrases in phrases, runs of one word, and equal scores at the last rank."""
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", None]), " ".join(rng.choice(["a", "b", "B", "cc", "d.", "é"]) for _ in range(rng.randrange(30)))) for _ in range(120)]
    rows += [("x", "p q r s t u v"), ("x", "o p q r s t u v w"), ("y", "z z z z z z"), ("y", None), (None, "")] * 4
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    for least, longest, top in ((4, 5, 2000), (4, 3, 9)):
        got = sorted(map(tuple, K.collocations(docs, least=least, longest=longest, top=top, wave=4).collect()))
        assert got == plain(rows, least, longest, top) and got


def test_slices_meet(spark, monkeypatch):
    """Phrases across the places where a long text is sliced are counted once."""
    text = " ".join(f"w{k % 7} x{k % 5}" for k in range(300))
    docs = spark.createDataFrame([(1, "x", text)], "doc_id long, lang string, text string")
    monkeypatch.setattr(K, "SLICE", 64)
    assert sorted(map(tuple, K.collocations(docs, least=10, wave=50).collect())) == plain([("x", text)], 10)


def test_odd_rows(odd, none):
    rows = [(r.lang, r.text) for r in odd.collect()]
    got = sorted(map(tuple, K.collocations(odd, least=2).collect()))
    assert got == plain(rows, 2) and got
    assert K.collocations(none).count() == 0 and K.collocations(odd, least=10**6).count() == 0
