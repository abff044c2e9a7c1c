"""Small cases: search keys, ids, aliases, references, chains, cycles, rules, agreement, sources, scoring."""

import hashlib
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lexgrove.functions import text as T
from lexgrove.operators import audit as A
from lexgrove.operators import corpus as C
from lexgrove.operators import graph as G
from lexgrove.operators import passages as P
from lexgrove.operators import rules as R
from lexgrove.sources import io
from lexgrove.sources.dom import dom_forest
from lexgrove.sources.trees import leaf_closure, tree_errors, tree_forest

def plain_key(text):
    """The key by its definition: decompose, drop marks, fold case, drop what T leaves out."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return "".join("σ" if c == "ς" else c for c in bare.lower() if c not in T.ELISION + T.PUNCTUATION)


def test_search_keys_are_what_their_definition_says(spark):
    words = ["Ὀδυσσεύς", "πολύτροπον,", "ἄνδρα", "μοι", "ᾤχετο", "δ’", "θ᾽", "Τροίης", "ΠΤΟΛΙΕΘΡΟΝ", "ΐ", "ᾳ", "ὧν·", "Straße", "Çedilla", "mañana;", "naïf.", "Ångström", "résumé", ""]
    drawn = random.Random(1)
    letters = [chr(c) for c in (*range(0x391, 0x3CF), *range(0x1F00, 0x1F16), *range(0xC0, 0x17F)) if unicodedata.category(chr(c))[0] == "L"]
    words += ["".join(drawn.choices(letters, k=6)) for _ in range(300)]
    rows = [(unicodedata.normalize(form, w), plain_key(w)) for w in words for form in ("NFC", "NFD")]
    got = spark.createDataFrame(rows, "a string, b string").select("b", T.search_key(F.col("a")).alias("k")).collect()
    assert [r.k for r in got] == [r.b for r in got]


def test_nfc(spark):
    df = spark.createDataFrame([("é",), ("ά",), (None,)], "a string")
    assert [r.k for r in df.select(T.nfc(F.col("a")).alias("k")).collect()] == ["é", "ά", None]


def test_kinds_and_parts(spark):
    ids = [("doc:n" + "1" * 19, "token"), ("doc:l" + "0" * 14, "line"), ("doc:s:n" + "2" * 19, "sentence"), ("doc:g:n" + "2" * 19 + ".3", "group"), ("book:src1", "book"), ("lemma:θεός", "lemma"), ("n" + "1" * 19, None), ("doc:n" + "1" * 18, None)]
    df = spark.createDataFrame(ids, "i string, k string")
    assert all(r.k == r.found for r in df.withColumn("found", T.kind_of(F.col("i"))).collect())
    doc, line, word = T.token_parts(F.col("i"))
    assert tuple(df.select(doc, line, word).first()) == (111111111, 11111, 11111)


#: code, name or alias, whether of one chapter
BOOKS = [("ODY", "Odyssey", False), ("ODY", "Od", False), ("ILI", "Iliad", False), ("HYM", "Hymn", True), ("HYM", "Hy", True), ("ELE", "2 Elegies", False), ("OED", "Oed", False), ("OEC", "Oed", False)]


def _parse(spark, texts):
    refs = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    books = spark.createDataFrame(sorted({(c, s) for c, _, s in BOOKS}), "code string, single boolean")
    return P.parse_refs(refs, "i", "t", books, spark.createDataFrame([(c, a) for c, a, _ in BOOKS], "code string, alias string"))


def _canonical(spark, texts):
    out = {}
    for r in _parse(spark, texts).withColumn("canon", P.canonical()).orderBy("i", "n").collect():
        assert r.error is None, (texts[r.i], r.error)
        out.setdefault(r.i, []).append((r.canon, r.partial))
    return [("; ".join(c for c, _ in v), any(p for _, p in v)) for _, v in sorted(out.items())]


def test_every_span_reads_back_as_it_is_written(spark):
    """All spans of small numbers, written canonically and with other dashes, spaces and stops."""
    spans = [f"ODY {c}" for c in (1, 24)] + ["ODY 2-9", "ILI", "HYM"]
    spans += [f"ODY {c}:{v}{t}" for c in (1, 7) for v in (1, 12) for t in ("", f"-{v + 3}", f"-{c + 1}:2", "!4", "!4-9")]
    loose = [s.replace("ODY", " od. ").replace(":", ".").replace("-", " – ") for s in spans if s.startswith("ODY")]
    assert _canonical(spark, spans) == [(s, False) for s in spans]
    assert [c for c, _ in _canonical(spark, loose)] == [s for s in spans if s.startswith("ODY")]


def test_what_numbers_count_depends_on_what_stands_before(spark):
    cases = {
        "Odyssey 5:3, 8, 11-12": ("ODY 5:3; ODY 5:8; ODY 5:11-12", False), "Odyssey 5:3; 8": ("ODY 5:3; ODY 8", False),
        "Odyssey 5, 8": ("ODY 5; ODY 5:8", False), "Odyssey 5:3-6:2, 9": ("ODY 5:3-6:2; ODY 6:9", False), "Hymn 9": ("HYM 1:9", False),
        "hymn 9-10, 30": ("HYM 1:9-10; HYM 1:30", False), "Hy 1:9": ("HYM 1:9", False), "2elegies 4:1b": ("ELE 4:1", True), "Iliad 2:3a-5c; 4": ("ILI 2:3-5; ILI 4", True),
        "book:ILI": ("ILI", False), "doc:l00000002300004": (None, False), "doc:n0000000230000400005": (None, False),
    }
    ids = [k for k in cases if k.startswith("doc")]
    rest = [k for k in cases if k not in ids]
    assert _canonical(spark, rest) == [cases[k] for k in rest]
    assert [(r.book, r.c1, r.v1, r.w1) for r in _parse(spark, ids).orderBy("i").collect()] == [(None, 23, 4, None), (None, 23, 4, 5)]


def test_refusals(spark):
    bad = {"Odyssey 9:4ff": "open-ended", "Odyssey 9:4f, 7": "open-ended", "Oed 2": "ambiguous", "Iliad 6:9-8": "backwards", "Iliad 6-5": "backwards", "Aeneid 2:2": "unknown book", "book:AEN": "unknown book", "Iliad 1:0": "count from 1", "lemma:ἀνήρ": "lemma id", "doc:s:n" + "1" * 19: "sentence id", "Iliad 4b": "half verse", "Iliad 4b:2": "cannot read", "Iliad 4:y": "cannot read", "Iliad 1:2:3": "cannot read", " ": "empty reference", "Iliad 7:1;;3": "empty item", "Iliad 7:1!5-2": "backwards"}
    got = {r.i: r for r in _parse(spark, list(bad)).collect()}
    assert len(got) == len(bad)
    for i, (text, why) in enumerate(bad.items()):
        assert why in (got[i].error or "") and got[i].c1 is None, (text, got[i])


def test_display(spark):
    names = spark.createDataFrame([("ODY", "The Odyssey", "Od.", False), ("HYM", "The Hymn", "Hymn", True)], "code string, name string, short string, single boolean")
    texts = ["Odyssey", "Odyssey 3-4", "Odyssey 3:2-5", "Odyssey 3:2-4:1", "Hymn 5-6", "Hymn", "Odyssey 3:2!1"]
    got = [r.display for r in P.displayed(_parse(spark, texts), names).orderBy("i").collect()]
    assert got == ["The Odyssey", "Od. 3–4", "Od. 3:2–5", "Od. 3:2–4:1", "Hymn 5–6", "The Hymn", "Od. 3:2"]


def test_resolution_of_books_ids_and_endless_ranges(spark):
    d = spark.createDataFrame([(1, "ODY", "a b\nc"), (2, "ODY", "d"), (4, "ODY", "e f"), (3, "ILI", "g")], "doc_id long, source string, text string")
    tok = C.identified(C.tokens(d))
    books = spark.createDataFrame([("ODY", False), ("ILI", False)], "code string, single boolean")
    texts = ["ODY", "ODY 1-2", "ODY 1-999999999", "ODY 1:1-2", "ODY 3", "doc:l00000000300001", "doc:l00000000300002", "book:ILI", "lemma:a", "lemma:q", "ODY 1:1-4:1", "doc:n0000000010000100002"]
    refs = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    aliases = books.select("code", F.col("code").alias("alias"))
    got = {texts[r.i]: (r.status, r.n_tokens) for r in P.resolve_refs(refs, "i", "t", books, aliases, P.index(d), C.lemmas(tok)).collect()}
    assert got == {"ODY": ("found", 6), "ODY 1-2": ("found", 4), "ODY 1-999999999": ("absent", None), "ODY 1:1-2": ("found", 3), "ODY 3": ("absent", None), "doc:l00000000300001": ("found", 1), "doc:l00000000300002": ("absent", None), "book:ILI": ("found", 1), "lemma:a": ("found", 1), "lemma:q": ("absent", None), "ODY 1:1-4:1": ("found", 6), "doc:n0000000010000100002": ("found", 1)}
    rows = P.interlinear(P.parse_refs(refs, "i", "t", books, aliases), "i", tok).groupBy("i").count().collect()
    assert {texts[r.i]: r["count"] for r in rows}["ODY"] == 6


def test_aliases(spark):
    aliases = spark.createDataFrame([(c, a) for c, a, _ in BOOKS], "code string, alias string")
    names = spark.createDataFrame([("ody",), ("2elegies",), ("2 Elegies.",), ("Oed",), ("OED",), ("Aeneid",)], "name string")
    got = {r.name: (r.status, r.codes) for r in P.lookup(names, "name", aliases).collect()}
    assert got == {"ody": ("ok", "ODY"), "2elegies": ("ok", "ELE"), "2 Elegies.": ("ok", "ELE"), "Oed": ("ambiguous", "OEC|OED"), "OED": ("ok", "OED"), "Aeneid": ("unknown", "")}
    found = P.alias_collisions(aliases, spark.createDataFrame([], "alias string")).collect()
    assert [tuple(r) for r in found] == [("oed", "OEC|OED")]
    assert P.alias_collisions(aliases, spark.createDataFrame([("Oed",)], "alias string")).count() == 0


def test_chains_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", None)], "src string, dst string")
    assert sorted(r.root for r in G.cycles(edges).collect()) == ["a", "d"]
    assert G.cycles(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")).count() == 0
    starts = spark.createDataFrame([("a",), ("c",), ("e",)], "start string")
    got = sorted(map(tuple, G.chains(starts, edges).collect()))
    assert got == [("a", 0, "a"), ("a", 1, "b"), ("c", 0, "c"), ("c", 1, "a"), ("c", 2, "b"), ("e", 0, "e")]


def test_cycles_up_to_a_length_and_of_any_length(spark):
    """Rings of 200, 201, 300 and 1 nodes with ways into them; the number of rounds goes by the ways and rings, not by the nodes."""
    rings = [(base, n) for base, n in ((0, 200), (1000, 201), (2000, 300), (5000, 1))]
    edges = [(base + i, base + (i + 1) % n) for base, n in rings for i in range(n)] + [(3000, 0), (3001, 1000)] + [(6000 + i, 5000) for i in range(500)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert sorted(r.root for r in G.cycles(df).collect()) == [0, 1000, 2000, 5000]
    assert sorted(r.root for r in G.cycles(df, longest=200).collect()) == [0, 5000]
    assert len(G._doubled(df)) <= 3 and len(G._doubled(spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long"))) == 7


def test_long_chains_stop_at_the_cap(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)], "src int, dst int")
    got = G.chains(spark.createDataFrame([(0,), (60,)], "start int"), edges).collect()
    assert sorted((r.start, r.step, r.id) for r in got) == [(0, k, k) for k in range(51)] + [(60, k, 60 + k) for k in range(11)]


def test_chain_ends_equal_stepped_chains(spark):
    drawn = random.Random(6)
    edges = [(i, drawn.choice([None, *range(60)])) for i in range(60)] + [(k, k + 1) for k in range(100, 190)] + [(300, 301), (301, 302), (302, 300), (310, 300), (311, 310), (320, 320), (321, 320)]
    step = {a: b for a, b in edges if b is not None}
    want = {}
    for a, _ in edges:
        path = [a]
        while (to := step.get(path[-1])) is not None and to not in path:
            path.append(to)
        want[a] = (path[-1], len(path) - 1, to is not None)
    df = spark.createDataFrame(edges, "src int, dst int")
    assert {r.start: (r.end, r.length, r.cyclic) for r in G.chain_ends(df).collect()} == want
    for start in (0, 7, 100, 311, 321, 999):
        got = sorted(map(tuple, G.chain_from(df, start, 200).collect()))
        starts = spark.createDataFrame([(start,)], "start int")
        assert got == sorted((r.step, r.id) for r in G.chains(starts, df, 200).collect())
    assert G.chain_from(df, 100).count() == 51 and G.chain_ends(df.where("false")).count() == 0


def test_strict_trees(spark):
    deep = "".join(f'<wg id="g{k}">' for k in range(156)) + '<w id="w1"/>' + "</wg>" * 156
    good = '<book><sentence><wg id="a" role="cl"><w id="x"/><wg id="b" Role="s"><wg id="c"><w id="y"/></wg><w id="z"/></wg></wg></sentence></book>'
    bad = {10: "<wg id='a'><w id='x'/><wg id='b'></wg></wg>", 11: "<wg><w id='x'/><w id='x'/></wg>", 12: "<wg><p/></wg>", 13: "<wg><w/></wg><wg><w/></wg>", 14: "<wg><w/>", 15: "<sentence/>", 16: None, 17: "<sentence><wg><w/></wg><w/></sentence>", 18: "<wg><w><w/></w></wg>"}
    why = {10: "empty group b", 11: "repeated id x", 12: "unexpected tag p", 13: "not well formed", 14: "not well formed", 15: "no root", 16: "not well formed", 17: "more than one root", 18: "w inside a word"}
    docs = spark.createDataFrame([(1, good), (2, deep), *bad.items()], "doc long, text string")
    forest = tree_forest(docs, "doc", "text").cache()
    rows = {r.node: r for r in forest.where("doc = 1").collect()}
    assert {k: (r.parent, r.depth, r.child_ord, r.group_ord, r.word_ord, r.leftmost, r.role) for k, r in rows.items()} == {
        "a": (None, 0, 1, 1, None, "x", "cl"), "x": ("a", 1, 1, None, 1, None, None), "b": ("a", 1, 2, 2, None, "y", "s"),
        "c": ("b", 2, 1, 3, None, "y", None), "y": ("c", 3, 1, None, 2, None, None), "z": ("b", 2, 2, None, 3, None, None),
    }
    clo = {tuple(r) for r in leaf_closure(forest, "doc").collect()}
    inside = {(1, g.node, w.node) for g in rows.values() for w in rows.values() if g.kind == "group" and w.kind == "word" and g.enter < w.enter < g.leave}
    assert {c[:3] for c in clo if c[0] == 1} == inside and len([c for c in clo if c[0] == 2]) == 156
    plain = G.leaf_closure(forest.where("kind <> 'error'").withColumnsRenamed({"node": "id"}).withColumn("id", F.concat("doc", F.lit("/"), "id")).withColumn("parent", F.concat("doc", F.lit("/"), "parent")), F.col("kind") == "word")
    assert {(f"{d}/{a}", f"{d}/{w}", n) for d, a, w, n in clo} == {(r.anc, r.leaf, r.dist) for r in plain.collect()}
    assert "Exchange" not in leaf_closure(forest, "doc")._jdf.queryExecution().executedPlan().toString()
    errors = {r.doc: r.error for r in tree_errors(forest, "doc").collect()}
    assert set(errors) == set(bad) and all(why[d] in errors[d] for d in bad)


def test_tags_and_their_parents(spark):
    pages = spark.createDataFrame([(1, "</p><a><b><br></b><c></c></a></a></x><d><e>"), (2, None), (3, "text")], "page_id long, html string")
    got = sorted((r.n, r.tag, r.depth, r.parent) for r in G.tag_tree(pages).collect())
    assert got == [(1, "a", 1, None), (2, "b", 2, 1), (4, "c", 2, 1), (9, "d", 1, None), (10, "e", 2, 9)]
    drawn = random.Random(8)

    def nest(depth):
        return "".join(f"<{t}>{nest(depth + 1)}</{t}>" for t in drawn.choices(["div", "p", "ul", "li"], k=drawn.randrange(4 - depth))) if depth < 4 else ""

    whole = spark.createDataFrame([(k, f"<html>{nest(0)}</html>") for k in range(40)], "page_id long, html string")
    # preorder numbers of the walk against numbers among all tags: both in order of opening
    ours = sorted((r.page_id, r.n, r.tag, r.depth - 1, r.parent) for r in G.tag_tree(whole).collect())
    place, numbered = {}, []
    for page, n, tag, depth, parent in ours:
        place[page, n] = sum(1 for p, _ in place if p == page)
        numbered.append((page, place[page, n], None if parent is None else place[page, parent], tag, depth))
    assert sorted(numbered, key=str) == sorted(((r.page_id, r.node, r.parent, r.tag, r.depth) for r in dom_forest(whole).collect()), key=str)


def test_closure_refuses_a_cycle(spark):
    with pytest.raises(G.CycleError):
        G.closure(spark.createDataFrame([(0, None), (1, 3), (2, 1), (3, 2), (4, 0)], "id int, parent int"))


def test_long_numbers_keep_ids_apart(spark):
    places = [(1, 100_000, 1), (1, 10_000, 1), (10**9, 1, 1), (1, 1, 100_000), (123456789, 100_001, 1), (1234567891, 1, 1)]
    df = spark.createDataFrame(places, "d long, l long, w long").withColumn("id", T.token_id(F.col("d"), F.col("l"), F.col("w")))
    back = df.select("id", *T.token_parts(F.col("id")), T.kind_of(F.col("id"))).collect()
    assert [tuple(r)[1:4] for r in back] == places and len({r.id for r in back}) == len(places) and {r[4] for r in back} == {"token"}


def test_deep_closure_and_preorder(spark):
    n = 150
    nodes = spark.createDataFrame([(i, i - 1 if i else None, i % 2 + 1) for i in range(n)], "id int, parent int, child_ord int")
    clo = G.closure(nodes)
    assert clo.count() == n * (n - 1) // 2 and clo.where("node = 149 AND anc = 0").first().dist == 149
    out = G.preorder(nodes, clo, width=2).orderBy("path").collect()
    assert [r.id for r in out] == list(range(n)) and out[-1].depth == 149


def test_frames(spark):
    df = spark.createDataFrame([(1, "A0:x;-1 A1:y bad :z A2: "), (2, ""), (3, None)], "k int, f string")
    got = sorted(map(tuple, G.frame_edges(df, "k", "f", "-1").collect()), key=lambda r: r[4])
    assert got == [(1, "x", "A0", False, 1), (1, None, "A0", True, 2), (1, "y", "A1", False, 3)]
    lists = G.list_edges(spark.createDataFrame([(1, " a  b "), (2, " "), (3, None)], "k int, f string"), "k", "f")
    assert sorted(map(tuple, lists.collect())) == [(1, "a", 1), (1, "b", 2)]


def test_each_rule_fires_alone_on_its_plant(spark):
    d = spark.createDataFrame([(1, "s", "One two. Three\nfour five.", "en"), (2, "s", "six", "en")], "doc_id long, source string, text string, lang string")
    tok = C.identified(C.tokens(d))
    assert R.id_format(tok, "token", T.ID_GRAMMAR[0][1]).count() == R.id_place(tok).count() == R.word_numbers(tok).count() == R.key_mismatch(tok, "token", "surface", "key").count() == 0
    moved = tok.withColumn("word", F.when(F.col("surface") == "two", 9).otherwise(F.col("word")))
    assert [r.id for r in R.word_numbers(moved).collect()] == ["doc:l00000000100001"] and R.id_place(moved).count() == 1
    edges = spark.createDataFrame([(1, None, True, "data"), (2, "x", True, "data"), (3, "y", False, "guess"), (4, "z", False, "computed")], "src int, dst string, implicit boolean, tier string")
    found = {f.__name__: [r.id for r in f(edges, "e").collect()] for f in (R.implicit_target, R.tier_unknown, R.computed_in_canonical)}
    assert found == {"implicit_target": ["2"], "tier_unknown": ["3"], "computed_in_canonical": ["4"]}
    report = R.report([R.implicit_target(edges, "e"), R.tier_unknown(edges, "e")]).collect()
    assert sorted(tuple(r) for r in report) == [("e", "implicit-target", 1, "2"), ("e", "tier-unknown", 1, "3")]


def test_fingerprints_see_any_change_and_no_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    same = spark.createDataFrame([(2, None), (1, "x")], "k int, v string")
    other = spark.createDataFrame([(1, "x"), (2, "")], "k int, v string")
    digest = lambda df: tuple(A.fingerprint(df, ["k", "v"]).first())
    assert digest(a) == digest(same) != digest(other)


def test_ordered_digests_see_order_and_not_partitions(spark):
    rows = [(k, f"v{k % 7}", None if k % 5 else 1.5) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, v string, x double")
    root = lambda d, **kw: tuple(A.ordered_digest(d, ["k"], **kw).first())
    want = root(df, fan=16)
    for parts in (1, 7, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        assert root(df.repartition(parts), fan=16) == want
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    swapped = df.withColumn("k", F.when(F.col("k") == 10, 11).when(F.col("k") == 11, 10).otherwise(F.col("k")))
    assert root(swapped, fan=16) != want and root(df.where("k <> 2999"), fan=16) != want and root(df, fan=8)[1] != want[1]
    one = lambda *r: root(spark.createDataFrame([r], "k int, v string, w string"))
    assert len({one(1, None, ""), one(1, "\\N", ""), one(1, "~", ""), one(1, "", None), one(1, "1:a", ""), one(1, "1:", "a"), one(1, "a\x1fb", "c"), one(1, "a", "b\x1fc")}) == 8
    assert A.ordered_digest(df.where("false"), ["k"]).first().n == 0
    assert A.schema_digest(df) != A.schema_digest(df.withColumn("x", F.col("x").cast("float"))) != A.schema_digest(df.select("v", "k", "x"))


def test_agreement(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, "y", None), (3, "z", "q")], "k int, f string, g string")
    b = spark.createDataFrame([(1, "x", "p"), (2, "Y", None), (4, "z", "q")], "k int, f string, g string")
    assert sorted(map(tuple, A.coverage(a, b, ["k"]).collect())) == [("extra", 4), ("missing", 3)]
    assert sorted(map(tuple, A.field_mismatches(a, b, ["k"], ["f", "g"]).collect())) == [("f", 1), ("g", 0)]


def test_scoring(spark):
    gold = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "q string, id int")
    cited = spark.createDataFrame([("a", 1), ("a", 1), ("a", 9)], "q string, id int")
    got = {r.q: r for r in A.citation_scores(cited, gold, spark.createDataFrame([(1,), (2,), (3,)], "id int"), "q", "id").collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].n_fabricated) == (0.5, 0.5, 1) and (got["b"].precision, got["b"].recall) == (0.0, 0.0)
    df = spark.createDataFrame([("1,307 and 1 307",), ("Four of twenty",)], "t string")
    assert [r.p for r in df.select(T.plain_numbers(F.col("t")).alias("p")).collect()] == ["1307 and 1307", "4 of 20"]


SCHEMA = StructType([StructField("id", IntegerType()), StructField("name", StringType())])


@pytest.mark.parametrize(("text", "why"), [("id\tx\n1\ta\n", "missing"), ("id\tname\n1\ta\tb\n", "ragged"), ("id\tname\n1\n", "ragged"), ("id\tname\n1\ta\n1\tb\n", "repeated")])
def test_strict_scan_refuses(spark, tmp_path, text, why):
    (tmp_path / "t.tsv").write_text(text)
    with pytest.raises(io.SourceError, match=why):
        io.read_tsv(spark, str(tmp_path / "t.tsv"), SCHEMA, ["id"])


def test_strict_scan(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('id\tname\tsecret\tmore\n1\t"a"\tx\t\n2\t\tx\ty\n')
    df, ignored, counts = io.read_tsv(spark, str(tmp_path / "t.tsv"), SCHEMA, ["id"], ("secret",), {"nameless": F.col("name").isNull()})
    (tmp_path / "t.tsv").unlink()  # nothing is read again
    assert sorted(map(tuple, df.collect())) == [(1, '"a"'), (2, None)] and ignored == ["more"] and counts == {"rows": 2, "nameless": 1}


def test_files_are_hashed_in_blocks_by_relative_path(spark, tmp_path):
    for folder, text in (("a", b"one"), ("b", b"two"), ("b/c", b"x" * 3_000_000), ("d", b"")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / "same.bin").write_bytes(text)
    want = {f"{f}/same.bin": hashlib.sha256((tmp_path / f / "same.bin").read_bytes()).hexdigest() for f in ("a", "b", "b/c", "d")}
    got = {r.file: (r.bytes, r.sha256) for r in io.hashed_files(spark, str(tmp_path), block=1000).collect()}
    assert {k: v[1] for k, v in got.items()} == want and got["b/c/same.bin"][0] == 3_000_000
    lock = spark.createDataFrame([*want.items(), ("a/none.bin", "0"), ("same.bin", want["a/same.bin"])], "file string, sha256 string")
    (tmp_path / "b" / "same.bin").write_bytes(b"Two")
    status = {r.file: r.status for r in io.verify_files(spark, f"file://{tmp_path}", lock).collect()}
    assert status == {"a/same.bin": "ok", "b/same.bin": "changed", "b/c/same.bin": "ok", "d/same.bin": "ok", "a/none.bin": "missing", "same.bin": "missing"}


def test_envelope(spark):
    df = spark.createDataFrame([("book:a", "x", 1), ("book:b", None, 2), ("book:c", "lemma:q", 3)], "id string, t string, n int")
    one = io.envelope(df, ["n"], 2, "b7").first()
    assert (one.row_count, one.truncated, one.citable, one.columns, one.build_id) == (2, True, ["id"], ["id", "t", "n"], "b7")
    assert [json.loads(r) for r in one.rows] == [{"id": "book:a", "t": "x", "n": 1}, {"id": "book:b", "t": None, "n": 2}]
    three = io.envelope(df.where("n = 3"), ["n"], 2, "b7").first()
    assert (three.truncated, three.citable, three.row_count) == (False, ["id", "t"], 1) and io.envelope(df, ["n"], 3, "b").first().truncated is False
    with pytest.raises(io.SourceError):
        io.envelope(df, ["n"], 0, "b")


def test_publish_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    io.publish(spark.range(3), path)
    with pytest.raises(Exception, match="boom"):
        io.publish(spark.range(3).select(F.raise_error(F.lit("boom")).alias("x")), path)
    assert spark.read.parquet(path).count() == 3
    io.publish(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["out"]
    (tmp_path / "other").mkdir()
    with pytest.raises(io.SourceError):
        io.publish(spark.range(1), str(tmp_path / "other"))


def test_ordered_parquet_keeps_attribution(spark, tmp_path):
    io.write_ordered(spark.range(100).repartition(7), str(tmp_path / "o"), ["id"], "CC0")
    back = spark.read.parquet(str(tmp_path / "o"))
    assert back.schema["id"].metadata == {"attribution": "CC0"} and back.count() == 100


def test_conform(spark):
    df = spark.createDataFrame([("1", "a")], "id string, name string")
    assert io.conform(df.select("name", "id"), SCHEMA).dtypes == [("id", "int"), ("name", "string")]
    with pytest.raises(io.SourceError):
        io.conform(df.drop("name"), SCHEMA)


def test_dom_forest(spark):
    pages = spark.createDataFrame([(1, "<html><body><p>hi<br>there<p>x</body></b></html>"), (2, None)], "page_id long, html string")
    got = [tuple(r)[1:] for r in dom_forest(pages).orderBy("node").collect()]
    assert got == [(0, None, "html", 0, 1, 0), (1, 0, "body", 1, 1, 0), (2, 1, "p", 2, 1, 7), (3, 2, "br", 3, 1, 0), (4, 2, "p", 3, 2, 1)]


def test_offsets_match_a_plain_count(spark):
    rows = [(d, f"s{d % 3}", "w " * (d % 5), "en") for d in range(9000, 9050)] + [(1, "s0", "a b", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, lang string")
    want, at = {}, 0
    for source, d, n in sorted((r[1], r[0], len(r[2].split())) for r in rows):
        if n:
            want[d] = (len(want) + 1, at, len(want))  # one line each
        at += n
    assert {r.doc_id: (r.doc_no, r.offset, r.line_offset) for r in C.documents_in_order(docs).collect()} == want
