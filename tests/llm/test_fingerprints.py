import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from lexgrove.llm import fingerprints as fp
from lexgrove.llm.queries import op3_document_fingerprints
from tests.llm.conftest import SMALL


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(out, rows):
    """rows: (id, text) by descending id, the order of next."""
    out = {r.doc_id: r for r in out}
    errors = []
    for k, (i, text) in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)][1], len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        r = out[i]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [(r.near_edited - jaccard(text, edited)), (r.near_next - jaccard(text, after))]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == fp.BINS * fp.BITS // 4
        if text == edited:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
    return errors


def test_query(spark, rows):
    ordered = [(i, rows[i].text or "") for i in sorted(rows, reverse=True)]
    errors = check(op3_document_fingerprints(spark, SMALL).collect(), ordered)
    assert max(map(abs, errors)) < 0.2 and abs(sum(errors) / len(errors)) < 0.01
    same = {}
    for r in op3_document_fingerprints(spark, SMALL).collect():
        same.setdefault(rows[r.doc_id].text, set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in same.values())


def test_many_ranges(docs, rows, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_RANGE", 7)
    check(fp.fingerprints_with_edits(docs).collect(), [(i, rows[i].text or "") for i in sorted(rows, reverse=True)])


def test_ids_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_RANGE", 20)
    ids = sorted({random.Random(3).randrange(-(1 << 63), 1 << 63) for _ in range(200)} | {(1 << 60) + k for k in range(150)} | {-1, 0, 1, (1 << 63) - 1, -(1 << 63)}, reverse=True)
    rows = [(i, f"text {k % 7} of {k} " * (k % 5)) for k, i in enumerate(ids)]
    check(fp.fingerprints_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_rows_that_repeat_an_id(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_RANGE", 5)
    rows = [(9, "abcdef"), *[(7, "ghijkl")] * 4, (7, "mnopqr"), (None, "stuvwx"), (None, "stuvwx"), (None, None), (2, "yz0123")]
    out = fp.fingerprints_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    digests = Counter((r.doc_id, r.edited_sha256) for r in out)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(out) == 10 and all(r.edited_sha256 and 0 <= r.near_next <= 1 for r in out) and digests[7, sha("ghijgh")] >= 3
    assert digests[2, sha("yz01st")] + digests[2, sha("yz01")] == 1 and digests[None, sha("stuvst")] >= 1


def test_probing_ends_at_a_filled_bin_drawn_evenly(spark):
    """With one to five shingles no bin stays empty, and two disjoint sets agree by chance only."""
    df = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(5 + k % 5))) for k in range(100)], "k int, t string")
    sigs = [r.s for r in fp.with_signature(df, F.col("t"), "s").collect()]
    assert all(len(s) == fp.BINS and None not in s for s in sigs)
    shares = [Counter(s).most_common(1)[0][1] / fp.BINS for k, s in enumerate(sigs) if k % 5 == 4]  # low bytes are mixed with the bin
    assert max(shares) < 0.2


def test_densified_bins_estimate_small_sets(spark):
    """Sets of few shingles, where most bins are empty."""
    words = [f"w{k}" for k in range(400)]
    pairs = [(k, " ".join(words[k : k + 14]), " ".join(words[k + s : k + 14 + s])) for k in range(300) for s in (1, 3)]
    df = spark.createDataFrame(pairs, "k int, a string, b string")
    both = fp.with_signature(fp.with_signature(df, F.col("a"), "sa"), F.col("b"), "sb")
    errors = [r.x - jaccard(r.a, r.b) for r in both.select("a", "b", fp.likeness(F.col("sa"), F.col("sb")).alias("x")).collect()]
    assert abs(sum(errors) / len(errors)) < 0.02


def test_odd_rows(spark, odd, none):
    out = fp.fingerprints_with_edits(odd).collect()
    assert len(out) == odd.count()
    assert {r.fingerprint for r in out if r.doc_id in (1, 2, 3)} == {"00" * fp.BINS}
    one = fp.fingerprints_with_edits(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1
    assert fp.fingerprints_with_edits(none).count() == 0
