import random

from lexgrove.llm import line_dedup
from lexgrove.llm.queries import ORACLES, op7_line_dedup
from tests.llm.conftest import SMALL


def plain(texts, min_lines=3, min_chars=40):
    """(id, text) in order -> id -> remaining text."""
    seen_line, seen_run, out = set(), set(), {}
    for i, text in texts:
        lines = text.split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for n, k in enumerate(at):
            if lines[k] in seen_line and len(lines[k]) >= min_chars:
                gone.add(k)
            seen_line.add(lines[k])
            run = tuple(lines[j] for j in at[n : n + min_lines])
            if len(run) == min_lines:
                if run in seen_run:
                    gone.update(at[n : n + min_lines])
                seen_run.add(run)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_query_matches_sql(spark, duck):
    got = sorted(map(tuple, op7_line_dedup(spark, SMALL).collect()))
    assert got == sorted(duck.sql(ORACLES["op7_line_dedup"]).fetchall()) and sum(r[2] for r in got) > 50


def test_brute_force(docs, rows):
    for n in (2, 3, 5):
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, min_lines=n, min_line_chars=30).collect()}
        assert got == plain([(i, rows[i].text) for i in sorted(rows)], n, 30)


def test_a_maximal_run_goes_once(spark):
    a = "\n".join("abcdefg")
    docs = spark.createDataFrame([(1, a), (2, "x\n" + a + "\n\ny"), (3, "a\nb"), (4, "z\nz\nz\nz\nz")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: (a, 0), 2: ("x\n\ny", 7), 3: ("a\nb", 0), 4: ("z", 4)}


def test_runs_are_maximal(spark):
    """Runs of 3 to 100 lines among lines of their own, each copied once or more; a run in a run, and one that overlaps itself."""
    rng, docs, want = random.Random(4), [], set()
    fresh = lambda n: [f"l{rng.randrange(10**9)}" for _ in range(n)]
    for k, n in enumerate([3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 100]):
        run, a, b, c = fresh(n), rng.randrange(5), rng.randrange(9), rng.randrange(9)
        docs += [(10 * k, [*fresh(a), *run, *fresh(2)]), (10 * k + 1, [*fresh(b), *run, *fresh(1)]), (10 * k + 2, [*fresh(c), *run])]
        want |= {(10 * k + 1, b, b + n - 1, n, 10 * k, a), (10 * k + 2, c, c + n - 1, n, 10 * k, a)}
    whole = fresh(30)
    docs += [(500, fresh(1) + whole[10:20] + fresh(1)), (501, whole), (502, whole), (503, ["z"] * 40)]
    want |= {(501, 10, 19, 10, 500, 1), (502, 0, 29, 30, 501, 0), (503, 1, 39, 39, 503, 0)}  # 502 has the run of 500 within that of 501
    out = line_dedup.repeated_runs(spark.createDataFrame([(i, "\n".join(x)) for i, x in docs], "doc_id long, text string"))
    assert {tuple(r) for r in out.collect()} == want


def plain_runs(texts):
    """(id, text) in order -> runs: from each line the longest repeat of anything earlier, if it reaches further than the one before; source: the first that shares so much."""
    at = [(i, k, line) for i, t in texts for k, line in enumerate(t.split("\n"))]
    ends = {i: max(n for n, x in enumerate(at) if x[0] == i) + 1 for i, _ in texts}

    def shared(x, y):
        n = 0
        while x + n < ends[at[x][0]] and y + n < ends[at[y][0]] and at[x + n][2] == at[y + n][2]:
            n += 1
        return n

    out, reached = set(), {}
    for y, (i, k, _) in enumerate(at):
        n, x = max(((shared(x, y), -x) for x in range(y)), default=(0, 0))
        if n and k + n > reached.get(i, 0):
            reached[i] = k + n
            out.add((i, k, k + n - 1, n, at[-x][0], at[-x][1]))
    return out


def test_runs_against_all_pairs_of_positions(spark):
    """Short alphabets, so that every document shares runs of all lengths with many others, itself included."""
    rng = random.Random(9)
    for letters, n, lengths in ((2, 8, (2, 5)), (5, 16, (3, 4, 9))):
        texts = [(i, "\n".join(rng.choice("abcdefghijkl"[:letters]) for _ in range(rng.randrange(1, 30)))) for i in range(n)]
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        assert {tuple(r) for r in line_dedup.repeated_runs(docs, min_lines=1).collect()} == plain_runs(texts)
        for m in lengths:
            got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, min_lines=m, min_line_chars=99).collect()}
            assert got == plain(texts, m, 99)


def test_copies_behind_a_shorter_shared_prefix(spark):
    """An earlier document shares two lines of a run that only a later one has whole."""
    docs = spark.createDataFrame([(1, "L1\nL2\nx1"), (2, "y0\nL1\nL2\nL3\ny1"), (3, "z0\nL1\nL2\nL3\nz1")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: ("L1\nL2\nx1", 0), 2: ("y0\nL1\nL2\nL3\ny1", 0), 3: ("z0\nz1", 3)}
    long = [f"L{k}" for k in range(7)]
    docs = spark.createDataFrame([(1, "\n".join(long[:5])), (2, "\n".join(long)), (3, "\n".join(long))], "doc_id long, text string")
    assert {tuple(r) for r in line_dedup.repeated_runs(docs).collect()} == {(2, 0, 4, 5, 1, 0), (3, 0, 6, 7, 2, 0)}


def test_repeated_rows_are_one_document(spark):
    a, b = "\n".join(f"line {k}" for k in range(6)), "\n".join(f"line {k}" for k in range(1, 5))
    docs = spark.createDataFrame([(1, a)] * 2000 + [(2, b)] * 1000, "doc_id long, text string")
    got = {(r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {(1, a, 0), (2, "", 4)}
    assert line_dedup._lines(docs, "doc_id", "text").count() == 10


def test_doubling_ends_when_ranks_are_unique(spark):
    text = "\n".join(f"line {k}" for k in range(37))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "line 3\nother")], "doc_id long, text string")
    lines = line_dedup._lines(docs, "doc_id", "text")
    levels = line_dedup._doubled(lines)
    assert sorted(levels) == [1, 2, 4, 8, 16, 32] and levels[32].count() == 12


def test_size_estimates_do_not_multiply_by_rounds(spark):
    """Each round's joins multiplied the sizes that the driver guesses; 150 lines take eight rounds up and down."""
    text = "\n".join(f"line {k}" for k in range(150))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "line 3\nother")], "doc_id long, text string")
    lines = line_dedup._lines(docs, "doc_id", "text")
    bits = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    levels = line_dedup._doubled(lines)
    assert len(levels) == 8 and max(map(bits, levels.values())) < 1000
    assert bits(line_dedup.repeated_lines(docs)) < 4000
    assert {tuple(r) for r in line_dedup.repeated_runs(docs).collect()} == {(2, 0, 149, 150, 1, 0)}


def test_odd_rows(odd, none):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed"] and out.count() == odd.count()
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].text is None and by[2][0].text == "" and by[3][0].text == " \n\t\n "
    assert by[None][0].n_removed + by[None][1].n_removed == 0  # null ids come first
    assert all(r.text == "" for r in by[4] if not r.text.endswith("x"))
    assert by[5][0].text == "\nb\nc"  # the run of three goes with its first line
    assert line_dedup.dedup_lines(none).count() == 0
