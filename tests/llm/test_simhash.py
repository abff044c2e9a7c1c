import numpy as np
import pytest
import xxhash

from lexgrove.llm import simhash
from lexgrove.llm.common import components
from lexgrove.llm.queries import op4_simhash_near_dedup
from tests.llm.conftest import SMALL


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(prints, distance=4):
    root = {i: i for i in prints}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= distance and (a := find(i)) != (b := find(j)):
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_matches_brute_force(spark, rows):
    out = op4_simhash_near_dedup(spark, SMALL).collect()
    prints = {i: plain_fingerprint(r.text) for i, r in rows.items()}
    assert {r.doc_id: r.fingerprint for r in out} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in out} == plain_components(prints)


@pytest.mark.parametrize(("segments", "homes"), [(2, 4096), (3, 3), (4, 4096)])
def test_no_link_is_lost(spark, segments, homes):
    rng = np.random.default_rng(segments)
    base = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    prints = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for bit in rng.choice(64, rng.integers(1, 8), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    fps = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    found = components(simhash.links(fps, segments=segments, homes=homes)).collect()
    ours = {p: p for p in prints} | {r.id % (1 << 64): r.root % (1 << 64) for r in found}
    want = plain_components({p: p for p in prints})
    groups = lambda d: sorted(sorted(k for k in d if d[k] == r) for r in set(d.values()))
    assert groups(ours) == groups(want)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark, odd, none):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    by = {(r.doc_id, r.fingerprint): r.component_id for r in out}
    assert by[(1, 0)] == by[(2, 0)] == by[(3, 0)] == by[(None, 0)] == 1
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 4, 5, 6, 7} <= set(ids) and 2 not in ids
    assert simhash.drop_near_duplicates(none).count() == 0
