"""Work that must not grow faster than the tables: keys that hold most rows, whole groups in one row, words cut and sorted twice."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lexgrove.operators import rules
from lexgrove.operators import audit as A
from lexgrove.operators import corpus as C
from lexgrove.operators import graph as G
from lexgrove.plans import all_queries, graph_queries, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_give_the_join_and_no_task_a_whole_key(spark):
    left = spark.range(5000).select(F.when(F.col("id") < 4500, 0).when(F.col("id") < 4990, F.col("id") % 300).alias("k"), F.col("id").alias("a"))
    right = spark.range(900).select(F.when(F.col("id") < 700, 0).when(F.col("id") < 890, F.col("id") % 300).alias("k"), F.col("id").alias("b"))
    got = G.joined_in_cells(left, right, "k", "a", "b", block=64)
    want = left.join(right, "k")
    assert got.count() == want.count() > 3_000_000
    assert got.columns == ["k", "a", "b"] and got.exceptAll(want.where("k > 0")).where("k > 0").count() == 0 and got.distinct().count() == want.count()
    text = plan(graph_queries.q4(spark, SF))
    assert "_i" in text and "_j" in text


def test_tree_documents_hold_one_customer_each(spark):
    d = graph_queries.tree_documents(spark, SF)
    most = spark.read.parquet(f"{SF}/orders.parquet").groupBy("o_custkey").count().agg(F.max("count")).first()[0]
    assert d.select(F.max(F.size(F.split("text", "<w ")) - 1)).first()[0] == most
    assert d.count() == d.select("doc").distinct().count() == spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").distinct().count()


@pytest.mark.parametrize("name", ["j10_span_join", "a4_contiguous"])
def test_words_are_not_dealt_out(spark, name):
    """At most the texts are; words stay where they are cut."""
    assert plan(registry.QUERIES[name](spark, SF)).count("Exchange") <= 1


def test_words_that_look_like_token_ids_come_once(spark, tmp_path):
    ids = [f"doc:n{d:09}{line:05}{w:05}" for d, line, w in ((1, 1, 1), (1, 1, 2), (2, 1, 1), (9, 9, 9), (3, 1, 1))]
    texts = [" ".join(ids) + " doc:l00000000100001", "book:s x lemma:x", "", None]
    spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts, 1)], "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.ident for r in registry.QUERIES["f6_kind_of"](spark, str(tmp_path)).collect()]
    k = C.identified(C.tokens(spark.read.parquet(f"{tmp_path}/documents.parquet")))
    want = set()
    for r in k.collect():
        want |= {r.id, f"doc:l{r.doc_id:09}{r.line:05}", "book:s", f"lemma:{r.lemma}", r.surface}
    assert sorted(got) == sorted(want)


def test_punctuation_ends_at_the_end_of_a_word_alone(spark):
    """A line separator is no white space; marks before it stand inside the word, as the SQL has it."""
    words = ["a.", "a. ", "?!", "a,.;", "a.,", "a.b", "x\u0085"]
    d = spark.createDataFrame([(1, "s", " ".join(words))], "doc_id long, source string, text string")
    got = [(r.surface, r.after) for r in C.tokens(d).orderBy("word").collect()]
    assert got == [("a", "."), ("a. ", ""), ("", "?!"), ("a", ",.;"), ("a", ".,"), ("a.b", ""), ("x\u0085", "")]
    assert [r.sent for r in C.tokens_in_order(d).orderBy("word").collect()] == [0, 1, 1, 2, 3, 4, 4]


def test_coverage_finds_both_sides_in_one_join_and_keeps_nulls(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (1,), (4,), (None,)], "k int")
    out = A.coverage(a, b, ["k"])
    assert sorted(map(tuple, out.collect()), key=repr) == [("extra", 4), ("extra", None), ("missing", 2), ("missing", 2), ("missing", None)]
    assert plan(A.coverage(a, b, ["k"])).count("Join") == 1


def test_fields_are_compared_by_line_not_by_word(spark, tmp_path):
    """No word is shuffled as a row; rows that repeat an id meet all words of their number, as by word."""
    text = plan(registry.QUERIES["m3_field_mismatch"](spark, SF))
    joins = [x for x in text.splitlines() if "Join" in x]
    assert len(joins) == 1 and "line#" in joins[0] and "word#" not in joins[0]
    a = spark.createDataFrame([(1, "x y z", ". "), (1, "x", ""), (2, " a", "! "), (3, "q", "")], "k int, f string, g string")
    b = spark.createDataFrame([(1, "x Y", ", "), (2, " a", " !"), (4, "q", "")], "k int, f string, g string")
    assert sorted(map(tuple, A.listed_mismatches(a, b, ["k"], ["f", "g"]).collect())) == [("f", 1), ("g", 4)]
    assert sorted(map(tuple, A.listed_mismatches(a, b.where("k = 4"), ["k"], ["f"]).collect())) == [("f", 0)]
    rows = [(10, "s", "a b, c.\n\n d!"), (10, "s", "a B"), (11, "s", "é."), (50, "s", "x"), (None, "s", "y"), (20, "s", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, registry.QUERIES["m3_field_mismatch"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(registry.ORACLES["m3_field_mismatch"]).fetchall()) and got[1][1] > 5


def test_ordered_digest_sorts_once(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    roots = {tuple(A.ordered_digest(df.repartition(n), ["k"]).first()) for n in (1, 3, 8)}
    assert len(roots) == 1 and next(iter(roots))[0] == 5000


def test_references_are_sought_as_the_numbers_they_are(spark):
    """Each reference by its own column: no row is unfolded into a string for each of its references; keys of other types still meet."""
    a = spark.sql("SELECT id AS x, if(id % 5 = 0, NULL, cast(id % 7 AS string)) AS y FROM range(40)")
    n, m = spark.sql("SELECT id AS k FROM range(38)"), spark.sql("SELECT cast(id AS int) AS k FROM range(5)")
    lost = rules.dangling_all([("a", a, {"x": ("n", "k"), "y": ("m", "k")})], {("n", "k"): n, ("m", "k"): m})
    assert sorted(map(tuple, lost.collect())) == [("a.x", "dangling-edge", "38"), ("a.x", "dangling-edge", "39"), ("a.y", "dangling-edge", "5"), ("a.y", "dangling-edge", "6")]
    assert "Generate" not in lost._jdf.queryExecution().executedPlan().toString()


def test_cycles_of_any_length_are_found(spark, tmp_path):
    """Squares modulo the safe prime 2039: all of the 1018 squares but 1 are one cycle."""
    spark.range(1, 2040).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    got = sorted(r.root for r in registry.QUERIES["g4_cycles"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert got == sorted(r[0] for r in con.sql(registry.ORACLES["g4_cycles"]).fetchall()) == [1, 2]
