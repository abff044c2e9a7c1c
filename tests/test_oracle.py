"""Every query with an SQL twin gives the twin's rows."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from lexgrove.plans.corpus_queries import TABLES
from lexgrove.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    ours = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def nodes(plan):
    """All physical nodes below and including this one, through adaptive stages and subqueries."""
    out, left = [], [plan]
    while left:
        p = left.pop()
        name = p.nodeName()
        out.append(p)
        if name == "AdaptiveSparkPlan":
            left.append(p.inputPlan())
        elif "QueryStage" in name:
            left.append(p.plan())
        for side in (p.children(), p.subqueries()):
            left += [side.apply(i) for i in range(side.size())]
    return out


def test_no_window_spans_a_whole_table(spark):
    """Windows without a partition stand over a row for each range only, which an aggregate made; none stands over tokens."""
    for name in ("w1_global_ord", "b1_token", "w2_next_id", "l3_token_order", "x1_resolve"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan()
        for p in nodes(plan):
            assert "EvalPython" not in p.nodeName()
            if p.nodeName() == "Window" and not p.partitionSpec().size():
                assert any("Aggregate" in x.nodeName() for x in nodes(p)[1:6]), p.toString()


def test_the_walk_of_a_plan_finds_global_windows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    bad = spark.range(10).withColumn("k", F.row_number().over(Window.orderBy("id")))
    assert any(p.nodeName() == "Window" and not p.partitionSpec().size() for p in nodes(bad._jdf.queryExecution().executedPlan()))


def test_scans_prune_and_push(spark):
    plan = QUERIES["q5_subject_edges"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan
