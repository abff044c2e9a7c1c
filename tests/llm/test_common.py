import random

import pytest

from lexgrove.llm import common


def plain(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("most", [40, 1 << 17])
def test_components_by_parts(spark, monkeypatch, most):
    """Links of one task and of many: chains, stars, repeated links, links of an id to itself, null ends."""
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(100)] + [(500, 500 + k) for k in range(1, 80)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)]
    links += [*links[:30], (7, 7), (None, 3), (4, None), (2000, 2000)]
    rng.shuffle(links)
    monkeypatch.setattr(common, "TASK_LINKS", most)
    df = spark.createDataFrame(links, "a long, b long")
    got = [(r.id, r.root) for r in common.components_by_parts(df).collect()]
    assert dict(got) == plain(links) and len(got) == len(dict(got))
    named = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string")
    assert {tuple(r) for r in common.components_by_parts(named).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert common.components_by_parts(df.where("false")).count() == 0


def test_attach_with_and_without_hot_keys(spark, monkeypatch):
    left = spark.createDataFrame([(k % 5 if k % 2 else 7, k) for k in range(400)], "k int, v int")
    by = left.groupBy("k").count().withColumnRenamed("count", "n_rows").selectExpr("k", "n_rows", "k * 10 AS x").where("k <> 3")
    want = sorted((r.k, r.v, r.k * 10) for r in left.collect() if r.k != 3)
    for rows in (1000, 50):
        monkeypatch.setattr(common, "HOT_ROWS", rows)
        for look in (False, True):
            assert sorted(map(tuple, common.attach(left, by, ["k"], 400, look=look).select("k", "v", "x").collect())) == want


def test_attach_keeps_rows_without_a_match_if_asked(spark, monkeypatch):
    """With hot keys and without, as the rows of the most frequent key tell; nothing is broadcast where there is none."""
    left = spark.createDataFrame([(k % 5 if k % 2 else 7, k) for k in range(400)], "k int, v int")
    by = left.groupBy("k").count().withColumnRenamed("count", "n_rows").selectExpr("k", "n_rows", "k * 10 AS x").where("k <> 3")
    want = sorted((r.k, r.v, -1 if r.k == 3 else r.k * 10) for r in left.collect())
    for rows in (1000, 50):
        monkeypatch.setattr(common, "HOT_ROWS", rows)
        got = common.attach(left, by, ["k"], 400, most=200, how="left")
        assert sorted(map(tuple, got.selectExpr("k", "v", "coalesce(x, -1)").collect())) == want
        assert ("Broadcast" in got._jdf.queryExecution().executedPlan().toString()) == (rows == 50)


def test_size_estimates_of_components_do_not_multiply_by_rounds(spark):
    """A long chain takes many rounds; the size that the driver guesses for the result stays a number of few digits."""
    links = spark.range(3000).selectExpr("id AS a", "id + 1 AS b")
    out = common.components(links)
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 200
    assert out.count() == 3001 and out.select("root").distinct().count() == 1
