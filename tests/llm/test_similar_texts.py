import numpy as np
import pyarrow as pa
import pytest

from lexgrove.llm import similar_texts
from tests.llm.conftest import SMALL


def grams(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_groups(sets, similarity=0.8):
    """id -> smallest id reachable, by all pairs that share a shingle; also these pairs."""
    root, links, having = {i: i for i in sets}, set(), {}
    for i, s in sets.items():
        for g in s or {b""}:
            having.setdefault(g, []).append(i)
    tried = {(a, b) for ids in having.values() for a in ids for b in ids if a < b}
    links = {(a, b) for a, b in tried if alike(sets[a], sets[b]) >= similarity}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, links


def edited(words, n, rng):
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"x{rng.integers(1 << 40)}"
    return " ".join(out)


def grouped(spark, texts, **how):
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(7)
    return {r.doc_id: r.component_id for r in similar_texts.similar_groups(docs, **how).collect()}


@pytest.mark.parametrize("homes", [4096, 3])
def test_pairs_at_all_similarities(spark, homes):
    """Recall of 0.9 or more for pairs 0.8 alike, nothing below 0.8."""
    rng, texts = np.random.default_rng(2), {}
    for d in range(600):
        words = [f"w{rng.integers(5000)}" for _ in range(60 + 3 * (d % 100))]
        texts[2 * d] = " ".join(words)
        texts[2 * d + 1] = edited(words, 1 + int(len(words) * 0.03 * rng.random()), rng)
    share = {d: alike(grams(texts[2 * d]), grams(texts[2 * d + 1])) for d in range(600)}
    got = grouped(spark, texts, homes=homes)
    hit = {d: got[2 * d + 1] == 2 * d for d in share}
    assert not any(hit[d] for d in share if share[d] < 0.8)
    for least, most in ((0.8, 0.85), (0.85, 1.01)):
        there = [hit[d] for d in share if least <= share[d] < most]
        assert len(there) > 80 and np.mean(there) >= 0.9


def test_large_group_of_near_copies(spark):
    """Every copy that a link joins to others is in the group, though a forest is reported, not all pairs."""
    rng, words = np.random.default_rng(3), [f"w{i}" for i in range(200)]
    texts = {k: edited(words, k % 4, rng) for k in range(800)} | {1000 + k: f"other text number {k} of its own words {k} {k}" for k in range(50)}
    want, _ = plain_groups({i: grams(t) for i, t in texts.items()})
    got = grouped(spark, texts, homes=64)
    assert np.mean([got[i] == want[i] for i in texts]) >= 0.99 and all(got[i] == i for i in texts if i >= 1000)


def test_documents_against_brute_force(spark, rows):
    sets = {i: grams(r.text) for i, r in rows.items()}
    want, links = plain_groups(sets)
    got = {r.doc_id: r.component_id for r in similar_texts.similar_groups(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    assert got.keys() == want.keys() and np.mean([got[a] == got[b] for a, b in links]) >= 0.9
    assert all(want[i] == want[c] for i, c in got.items())  # no group that exact links don't join


def test_candidates_do_not_depend_on_batches():
    """Groups cut anywhere by batches, wide or not, give forests that join the same."""
    rng = np.random.default_rng(5)
    key = np.sort(np.concatenate((rng.integers(0, 40, 3000), np.repeat([50, 51], 700))))
    lo = rng.integers(0, 1 << 63, 4) [rng.integers(0, 4, len(key))] ^ (1 << rng.integers(0, 62, len(key)))
    found = []
    for size in (len(key), 97, 1):
        batches = (pa.RecordBatch.from_arrays([pa.array(key[i : i + size]), pa.array(lo[i : i + size])], names=["key", "lo"]) for i in range(0, len(key), size))
        pairs = [(a, b) for b in similar_texts._candidates(batches, 16) for a, b in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)]
        forest = similar_texts.Forest()
        for a, b in pairs:
            forest.join(a, b)
        found.append({x: forest.root(x) for x in set(lo.tolist())})
    assert found[0] == found[1] == found[2] and len(set(found[0].values())) == 4


def test_odd_rows(spark, odd, none):
    got = [(r.doc_id, r.component_id) for r in similar_texts.similar_groups(odd).collect()]
    assert len(got) == odd.count() and {(1, 1), (2, 1), (3, 1), (None, 1), (4, 4), (None, 4), (6, 6), (7, 7)} <= set(got)
    kept = similar_texts.drop_similar(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 4, 5, 6, 7} <= set(ids) and not {2, 3, None} & set(ids)
    assert similar_texts.drop_similar(none).count() == 0 and similar_texts.similar_groups(none).count() == 0


def test_links_that_simhash_leaves_out_are_found(spark):
    """With no more than one sample most pairs meet at no anchor, and still every link counts."""
    rng, texts = np.random.default_rng(9), {}
    for d in range(150):
        words = [f"w{rng.integers(5000)}" for _ in range(70 + 2 * (d % 60))]
        texts[2 * d] = " ".join(words)
        texts[2 * d + 1] = edited(words, max(1, int(len(words) * 0.02)), rng)
    sets = {i: grams(t) for i, t in texts.items()}
    want, links = plain_groups(sets)
    assert len(links) > 80 and sum(alike(sets[a], sets[b]) < 0.85 for a, b in links) > 40
    assert grouped(spark, texts, segments=1) == want
