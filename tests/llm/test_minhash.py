import random
import re

import numpy as np
import pyarrow as pa

from lexgrove.llm import minhash as M
from lexgrove.llm.queries import op13_minhash_near_dedup
from tests.llm.conftest import SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, width=2):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()


def plain(rows, percent=80, width=2):
    """(id, text) -> (id, size, component, kept) by all pairs."""
    sets = [(i, plain_set(t, width)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (_, p) in enumerate(sets):
        for y, (_, q) in enumerate(sets[:x]):
            if p and q and 100 * len(p & q) >= percent * len(p | q):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(i, least.get(find(x), i))
    return sorted((i, len(p), least[find(x)], i == least[find(x)]) for x, (i, p) in enumerate(sets))


def test_query_against_all_pairs(spark, rows):
    got = sorted(map(tuple, op13_minhash_near_dedup(spark, SMALL).collect()))
    assert got == plain([(i, r.text) for i, r in rows.items()]) and sum(not r[3] for r in got) > 5


def drawn(seed=1):
    """Copies at about 0.8 of texts of every length: chains, originals between copies that aren't alike each other, and a template that all share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    out = []
    for n in (2, 3, 5, 6, 9, 12, 20, 40, 80, 200, 600):
        for _ in range(6):
            text = [word() for _ in range(n)]
            for _ in range(4):
                out.append(" ".join(text))
                for _ in range(max(1, n // rng.choice([16, 19, 22, 30]))):
                    text[rng.randrange(n)] = word()
    template = [word() for _ in range(150)]
    for _ in range(60):
        text = list(template)
        for _ in range(rng.choice([4, 8, 12, 16])):
            text[rng.randrange(150)] = word()
        out.append(" ".join(text))
    rng.shuffle(out)
    return list(enumerate(out))


def test_no_link_is_lost(spark):
    rows = drawn()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent, width in ((80, 2), (80, 5)):
        got = sorted(map(tuple, M.near_duplicates(docs, percent=percent, width=width).collect()))
        assert got == plain(rows, percent, width) and len({r[2] for r in got}) < len(rows) - 5


def test_nodes_that_their_centre_keeps_apart(spark, monkeypatch):
    """Buckets of many nodes in which stars join little: rounds and salts find what is left."""
    monkeypatch.setattr(M, "ASKED", 1)
    monkeypatch.setattr(M, "GROWTH", 2)
    monkeypatch.setattr(M, "HOMES", 8)
    monkeypatch.setattr(M, "HOT", 2)
    monkeypatch.setattr(M, "CROWDED", 2)
    rows = drawn(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, M.near_duplicates(docs).collect())) == plain(rows)


def test_sets_that_travel_whole_lose_no_link():
    rng = np.random.default_rng(5)
    base = rng.choice(1 << 40, 150, replace=False)
    sets = [np.unique(np.concatenate((rng.choice(base, k, replace=False), rng.choice(1 << 40, 150 - k)))) for k in rng.integers(100, 151, 80)]
    few = np.array([x.astype(np.uint16).tobytes() if i % 10 else b"" for i, x in enumerate(sets)], object)
    x, y = (i.ravel() for i in np.indices((80, 80)))
    keep = M._may_link(x, y, M._whole(few), M._whole(few), 80).reshape(80, 80)
    alike = np.array([[len(np.intersect1d(p, q)) / len(np.union1d(p, q)) for q in sets] for p in sets])
    whole = np.array([len(f) > 0 for f in few])
    assert keep[alike >= 0.8].all() and keep[~whole].all() and keep[:, ~whole].all()
    assert not keep[np.outer(whole, whole) & (alike < 0.77)].any()
    assert M._may_link(x[:0], y[:0], M._whole(few), M._whole(few), 80).shape == (0,)


def test_signatures_estimate_similarity():
    rng, probes = np.random.default_rng(3), M._probes()
    for n in (4, 20, 300, 5000):
        equal, near = [], []
        for _ in range(40):
            h = rng.integers(0, 2**63, n + n // 4, dtype=np.uint64) * np.uint64(2)
            p, q = np.sort(h[:n]), np.sort(h[n // 8 : n + n // 8])
            sigs = np.stack([M.signature(p, probes), M.signature(q, probes)])
            want = len(np.intersect1d(p, q)) / len(np.union1d(p, q))
            equal.append((sigs[0] == sigs[1]).mean() - want)
            bits = M.packed(sigs)
            near.append((M.equal_bins(bits[0], bits[1]) / M.BINS - 1 / 16) / (15 / 16) - want)
        assert abs(np.mean(equal)) < 0.05 and abs(np.mean(near)) < 0.05


def test_odd_rows(spark, odd, none):
    got = [tuple(r) for r in M.near_duplicates(odd).collect()]
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r)
    assert len(got) == odd.count() and M.near_duplicates(odd).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert by[1] == [(1, 0, 1, True)] and by[2] == [(2, 0, 2, True)] and by[3] == [(3, 0, 3, True)]  # without words: linked with nothing
    assert [r[1:] for r in by[4]] == [(11, 4, True)] * 2 + [(12, 4, True)] or sorted(r[1:] for r in by[4]) == [(11, 4, True), (11, 4, True), (12, 4, True)]
    assert sorted(by[None], key=str) == sorted([(None, 11, 4, False), (None, 0, None, True)], key=str)  # the null id joins 4's texts
    assert by[6][0][1] == 1 and by[7][0][1] == 1
    assert M.near_duplicates(none).count() == 0


def test_a_bucket_gives_fewer_links_than_it_has_nodes():
    """Nodes in chains whose ends aren't alike, all in one bucket: pairs that are no links and links inside a component aren't emitted."""
    rng = np.random.default_rng(7)
    chains = []
    for n in (40, 400, 1500):
        for _ in range(10):
            own = rng.choice(1 << 62, n, replace=False).astype(np.uint64)
            for _ in range(12):
                chains.append(np.unique(own))
                own = np.concatenate((own[n // 12 :], rng.choice(1 << 62, n // 12).astype(np.uint64)))
    sets, least = chains, M.least_equal(80)
    sigs = np.stack([M.signature(x, M._probes()) for x in (np.unique(x * np.uint64(4)) for x in sets)])
    ids = pa.array(np.arange(len(sets)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int64)), pa.array([False] * len(sets)), ids, ids, pa.array([x.tobytes() for x in M.packed(sigs)], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["key", "replica", "node", "root", "bits", "set"])
    got = [(a, b) for out in M._settled(iter([batch.slice(0, 100), batch.slice(100)]), least, 80) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)]
    assert len(got) < len(sets) and all(M.alike(sets[a], sets[b], 80) for a, b in got)
    up = {}
    for a, b in got:
        up[M._top(up, max(a, b))] = M._top(up, min(a, b))
    assert len({M._top(up, x) for x in range(len(sets))}) == 30
