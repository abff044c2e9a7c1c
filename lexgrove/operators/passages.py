"""References to passages: aliases, parsing, rendering and resolution of whole columns of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.functions import text as T
from lexgrove.operators import corpus as C
from lexgrove.operators.graph import cut


def norm_alias(name: Column) -> Column:
    """Aliases ignore case, spaces and full stops."""
    return F.lower(F.regexp_replace(name, r"[\s.]+", ""))


def lookup(names: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """names with status (ok, ambiguous, unknown) and codes: an exact code wins, else all entries that claim the alias.

    aliases: (code, alias), a row for each name of an entry. Candidates are all listed, none is picked.
    """
    exact = aliases.select(F.col("code").alias("_exact")).distinct()
    loose = aliases.select("code", norm_alias(F.col("alias")).alias("_alias")).unionByName(aliases.select("code", norm_alias(F.col("code")).alias("_alias"))).distinct().groupBy("_alias").agg(F.array_sort(F.collect_set("code")).alias("_codes"))
    asked = names.join(exact, F.col(name) == F.col("_exact"), "left").join(loose, norm_alias(F.col(name)) == F.col("_alias"), "left")
    codes = F.when(F.col("_exact").isNotNull(), F.array("_exact")).otherwise(F.coalesce("_codes", F.expr("cast(array() as array<string>)")))
    out = asked.withColumn("_c", codes)
    status = F.when(F.size("_c") == 1, "ok").when(F.size("_c") > 1, "ambiguous").otherwise("unknown")
    return out.select(*names.columns, status.alias("status"), F.array_join("_c", "|").alias("codes"))


def alias_collisions(aliases: DataFrame, allowed: DataFrame) -> DataFrame:
    """(alias, codes): aliases that several entries claim and that aren't listed as ambiguous."""
    by = aliases.select("code", norm_alias(F.col("alias")).alias("alias")).groupBy("alias").agg(F.array_sort(F.collect_set("code")).alias("c")).where(F.size("c") > 1)
    return by.join(allowed.select(norm_alias(F.col("alias")).alias("alias")), "alias", "left_anti").select("alias", F.array_join("c", "|").alias("codes"))


#: What an item of a reference may look like, numbers written 0: where in its numbers stand the
#: first and last chapter, verse and word. Of items with bare numbers the context tells what they count.
SHAPES = {
    "0:0": (1, 2, 1, 2, None, None), "0:0-0": (1, 2, 1, 3, None, None), "0:0-0:0": (1, 2, 3, 4, None, None),
    "0:0!0": (1, 2, 1, 2, 3, 3), "0:0!0-0": (1, 2, 1, 2, 3, 4),
}
BARE = {"0": (1, 1), "0-0": (1, 2)}
SPAN = ("c1", "v1", "c2", "v2", "w1", "w2")


def _lexed(item: Column) -> tuple[Column, Column, Column]:
    """An item's numbers, its shape without half-verse letters, and whether it has such letters."""
    drawn = F.regexp_replace(item, "[0-9]+", "0")
    plain = F.regexp_replace(drawn, "(?<=0)[abc](?![:.])", "")
    return F.regexp_extract_all(item, F.lit("[0-9]+"), F.lit(0)).cast("array<bigint>"), F.translate(plain, ".", ":"), drawn != plain


def _place(shape: Column, numbers: Column, k: int) -> Column:
    """Part k of the span of an item with a chapter and verse."""
    at = F.create_map(*(F.lit(x) for name, parts in SHAPES.items() if parts[k] for x in (name, parts[k])))
    return F.try_element_at(numbers, F.try_element_at(at, shape))


def parse_refs(refs: DataFrame, ident: str, text: str, books: DataFrame, aliases: DataFrame) -> DataFrame:
    """(ident, n, book, c1, v1, c2, v2, w1, w2, partial, error): the spans of each reference, in order, or one row with an error.

    A reference is an id of a token, a line or a book, or a book's name alone, or the name, a
    space and items parted by , and ;. An item is numbers parted by : or . (chapter from verse),
    - (first from last) and ! (verse from word), with a, b or c behind a verse for a half of it,
    which is widened and marked partial. A number by itself counts chapters; it counts verses
    behind a , that follows a chapter, and in books of one chapter. books: (code, single);
    aliases: (code, alias). An error in one item refuses the whole reference; nothing is raised.
    """
    s = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    d = refs.select(F.col(ident).alias("_id"), s.alias("s")).withColumn("kind", T.kind_of(F.col("s")))
    doc, line, word = T.token_parts(F.col("s"))
    l_doc, l_line = T.line_parts(F.col("s"))
    named = F.regexp_extract("s", r"^(.+?) ([0-9].*)$", 1)
    book_text = F.when(F.col("kind") == "book", F.substring_index("s", ":", -1)).when(F.col("kind").isNull() & (F.col("s") != ""), F.coalesce(T.clean(named), F.col("s")))
    loc = F.when(F.col("kind").isNull() & (named != ""), F.regexp_replace(F.expr("substring(s, length(_named) + 2)"), "[\u2010-\u2014\u2212]", "-"))
    d = d.withColumn("_named", named).withColumns({"book_text": book_text, "loc": F.regexp_replace(loc, " ", ""), "by_id": F.col("kind").isin("token", "line"), "id_c": F.coalesce(doc, l_doc), "id_v": F.coalesce(line, l_line), "id_w": word})
    d = d.withColumn("by_id", F.coalesce("by_id", F.lit(False)))
    found = lookup(d.where("book_text IS NOT NULL").select("book_text").distinct(), "book_text", aliases)
    d = d.join(found, "book_text", "left").join(books.select(F.col("code").alias("codes"), F.col("single").alias("_single")), "codes", "left").withColumn("single", F.coalesce("_single", F.lit(False)))
    early = (
        F.when(F.coalesce(F.col("s"), F.lit("")) == "", "empty reference")
        .when(F.col("kind").isNotNull() & ~F.col("kind").isin("token", "line", "book"), F.concat(F.lit("a "), F.col("kind"), F.lit(" id is no passage")))
        .when(~F.col("by_id") & (F.col("status") == "ambiguous"), "ambiguous book")
        .when(~F.col("by_id") & (F.coalesce("status", F.lit("unknown")) == "unknown"), "unknown book")
    )
    d = d.withColumn("early", early)
    items = F.when(F.col("early").isNotNull() | F.col("loc").isNull(), F.array(F.lit(""))).otherwise(F.split("loc", "(?=[,;])"))
    rows = d.select("*", F.posexplode(items).alias("n", "item")).withColumns({"after_comma": F.col("item").startswith(","), "piece": F.regexp_replace("item", "^[,;]", "")})
    numbers, shape, half = _lexed(F.col("piece"))
    rows = rows.withColumns({"numbers": numbers, "shape": shape, "half": half})
    whole, bare = F.col("shape").isin(*SHAPES), F.col("shape").isin(*BARE)
    low = F.when(bare, F.get("numbers", F.lit(0)))
    high = F.when(bare, F.get("numbers", F.size("numbers") - 1))
    rows = rows.withColumns({"whole": whole, "bare": bare, "low": low, "high": high, **{f"i_{c}": F.when(whole, _place(F.col("shape"), F.col("numbers"), k)) for k, c in enumerate(SPAN)}})
    # the chapter that an item leaves to a bare number behind a comma
    leaves = F.when(F.col("whole"), F.col("i_c2")).when(F.col("bare") & F.col("single"), F.lit(1).cast("long")).when(F.col("bare") & ~F.col("after_comma"), F.col("high"))
    before = Window.partitionBy("_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("chapter", F.when(F.col("single"), F.lit(1).cast("long")).otherwise(F.last(leaves, ignorenulls=True).over(before)))
    verses = F.col("bare") & (F.col("single") | (F.col("after_comma") & F.col("chapter").isNotNull()))
    counted = lambda c, number: F.when(verses, F.col("chapter")).when(F.col("bare"), number) if c else F.when(verses, number)
    rows = rows.withColumns({
        "c1": F.coalesce("id_c", "i_c1", counted(True, F.col("low"))), "v1": F.coalesce("id_v", "i_v1", counted(False, F.col("low"))),
        "c2": F.coalesce("id_c", "i_c2", counted(True, F.col("high"))), "v2": F.coalesce("id_v", "i_v2", counted(False, F.col("high"))),
        "w1": F.coalesce("id_w", "i_w1"), "w2": F.coalesce("id_w", "i_w2"),
    })
    zero = F.lit(0).cast("long")
    edge = lambda *parts: F.struct(*(F.coalesce(F.col(p), zero).alias(p[0]) for p in parts))
    located = F.col("loc").isNotNull()
    late = (
        F.when(F.col("piece").rlike(r"[0-9]ff?\.?$"), "open-ended range")
        .when(located & (F.col("piece") == ""), "empty item")
        .when(located & ~F.col("whole") & ~F.col("bare"), "cannot read")
        .when(F.col("bare") & F.col("half") & F.col("v1").isNull(), "half verse marks no chapter")
        .when(edge("c2", "v2", "w2") < edge("c1", "v1", "w1"), "backwards range")
        .when(located & F.array_contains("numbers", zero), "count from 1")
    )
    rows = rows.withColumn("own_error", F.coalesce("early", late))
    rows = rows.withColumn("error", F.min(F.when(F.col("own_error").isNotNull(), F.struct("n", "own_error"))).over(Window.partitionBy("_id"))["own_error"])
    good = F.col("error").isNull()
    kept = rows.where(good | (F.col("n") == 0))
    return kept.select(F.col("_id").alias(ident), (F.col("n") + 1).cast("long").alias("n"), F.when(good & ~F.col("by_id"), F.col("codes")).alias("book"), *(F.when(good, F.col(c)).alias(c) for c in SPAN), (F.col("half") & good).alias("partial"), "error")


def _written(book: Column, whole: Column, dash: str, chapterless: Column, words: bool) -> Column:
    """A span as text: `whole` if it is all of a book, else the book and its ends, equal parts written once."""
    c1, v1, c2, v2, w1, w2 = (F.col(c).cast("string") for c in SPAN)
    one = F.when(F.col("c1") == F.col("c2"), "").otherwise(F.concat(F.lit(dash), c2))
    start = F.concat(F.when(chapterless, "").otherwise(F.concat(c1, F.lit(":"))), v1)
    end = F.when((F.col("c1") == F.col("c2")) & (F.col("v1") == F.col("v2")), "").when(F.col("c1") == F.col("c2"), F.concat(F.lit(dash), v2)).otherwise(F.concat(F.lit(dash), c2, F.lit(":"), v2))
    place = F.when(F.col("v1").isNull(), F.concat(c1, one)).otherwise(F.concat(start, end))
    if words:
        place = F.concat(place, F.when(F.col("w1").isNull(), "").otherwise(F.concat(F.lit("!"), w1, F.when(F.col("w1") == F.col("w2"), "").otherwise(F.concat(F.lit("-"), w2)))))
    return F.when(F.col("c1").isNull(), whole).otherwise(F.concat(book, F.lit(" "), place))


def canonical() -> Column:
    """A span as text by its book's code, never shortened; null for spans of ids, which name no book."""
    return _written(F.col("book"), F.col("book"), "-", F.lit(False), True)


def displayed(spans: DataFrame, names: DataFrame) -> DataFrame:
    """spans with `display`: a book's name if all of it is meant, else its short name, an en dash between ends, no chapter in books of one; words aren't shown.

    names: (code, name, short, single).
    """
    j = spans.join(names.select(F.col("code").alias("book"), "name", "short", "single"), "book", "left")
    alone = F.col("single") & (F.col("c1") == 1) & (F.col("c2") == 1)
    return j.withColumn("display", _written(F.col("short"), F.col("name"), "–", F.coalesce(alone, F.lit(False)), False)).drop("name", "short", "single")


def _opened(spans: DataFrame, chapters: DataFrame) -> DataFrame:
    """A row for each chapter (doc_id) that spans of chapters or verses touch; ranges find theirs among the book's own chapters."""
    placed = spans.where("error IS NULL AND c1 IS NOT NULL")
    one = placed.where("c1 = c2").withColumn("_doc", F.col("c1"))
    of = chapters.select(F.col("source").alias("book"), F.col("doc_id").alias("_doc"))
    many = placed.where("c1 < c2").join(of, "book").where(F.col("_doc").between(F.col("c1"), F.col("c2")))
    return one.unionByName(many)


@dataclass(frozen=True)
class Index:
    """What references are looked up in, none of it by token.

    lines: source, doc_id, line, n_tokens, first_token, last_token, first_ord, last_ord, line_ord; chapters: what
    documents_in_order gives; books: what books_of gives. Ordinals and line_ord are cumulated counts, so the size of a span
    is the difference of the rows of its ends.
    """

    lines: DataFrame
    chapters: DataFrame
    books: DataFrame


def index(docs: DataFrame, chapters: DataFrame | None = None) -> Index:
    """The index of documents (doc_id, source, text) that no store holds; chapters: what documents_in_order gives, if it is there already."""
    chapters = cut(C.documents_in_order(docs)) if chapters is None else chapters
    spans = C.line_spans(docs).select("source", "doc_id", "line", "n", "before", "n_tokens")
    lines = spans.join(chapters.select("source", "doc_id", "offset", "line_offset"), ["source", "doc_id"])
    before, mint = F.col("offset") + F.col("before"), lambda word: T.token_id(F.col("doc_id"), F.col("line"), word)
    lines = lines.select("source", "doc_id", "line", "n_tokens", mint(F.lit(1)).alias("first_token"), mint(F.col("n_tokens")).alias("last_token"), (before + 1).alias("first_ord"), (before + F.col("n_tokens")).alias("last_ord"), (F.col("line_offset") + F.col("n")).alias("line_ord"))
    return Index(lines, chapters, C.books_of(chapters))


def resolve(spans: DataFrame, ident: str, at: Index) -> DataFrame:
    """(ident, status, n_tokens, n_lines, first_token, last_token, first_ord, last_ord) for references parsed to spans.

    A chapter is a document, a verse a line with tokens. A range needs both its ends, a chapter
    range every chapter, a word range both words; gaps in between are tolerated. Status is found,
    absent or malformed. Each span looks up its two ends, whatever it covers: chapters are
    complete if the numbers of the first and last are as far apart as the chapters asked for.
    """
    good = spans.where("error IS NULL").select(ident, "n_span", "book", *SPAN)
    columns = ["ok", "size", "lines", "first", "last", "low", "high"]

    def ends(part: DataFrame, table: DataFrame, keys: dict[str, tuple[str, str]], values: dict[str, Column]) -> DataFrame:
        """part with the rows of its first and last end, as one_ and two_ columns."""
        out = part
        for k, name in enumerate(("one", "two")):
            there = table.select(F.col("source").alias(f"{name}_source"), *(F.col(c).alias(f"{name}_{c}") for c in keys), *(v.alias(f"{name}_{c}") for c, v in values.items()))
            on = F.col("book").isNull() | (F.col("book") == F.col(f"{name}_source"))
            for c, pair in keys.items():
                on = on & (F.col(pair[k]) == F.col(f"{name}_{c}"))
            out = out.join(there, on)
        return out.where("one_source = two_source")

    last = F.col("offset") + F.col("n_tokens")
    chapter = {"no": F.col("doc_no"), "low": F.col("offset") + 1, "high": last, "before": F.col("line_offset"), "upto": F.col("line_offset") + F.col("n_lines"), "first": F.col("first_token"), "last": F.col("last_token")}
    by_chapter = ends(good.where("c1 IS NOT NULL AND v1 IS NULL"), at.chapters, {"doc_id": ("c1", "c2")}, chapter)
    by_chapter = by_chapter.select(ident, "n_span", (F.expr("two_no - one_no = c2 - c1")).alias("ok"), F.expr("two_high - one_low + 1").alias("size"), F.expr("two_upto - one_before").alias("lines"), F.col("one_first").alias("first"), F.col("two_last").alias("last"), F.col("one_low").alias("low"), F.col("two_high").alias("high"))
    line = {"no": F.col("line_ord"), "low": F.col("first_ord"), "high": F.col("last_ord"), "size": F.col("n_tokens")}  # ids follow from the places
    by_line = ends(good.where("v1 IS NOT NULL AND w1 IS NULL"), at.lines, {"doc_id": ("c1", "c2"), "line": ("v1", "v2")}, line)
    by_line = by_line.select(ident, "n_span", F.lit(True).alias("ok"), F.expr("two_high - one_low + 1").alias("size"), F.expr("two_no - one_no + 1").alias("lines"), T.token_id(F.col("c1"), F.col("v1"), F.lit(1)).alias("first"), T.token_id(F.col("c2"), F.col("v2"), F.col("two_size")).alias("last"), F.col("one_low").alias("low"), F.col("two_high").alias("high"))
    # words are numbered from 1 in their line, so its size tells which there are
    worded = good.where("w1 IS NOT NULL").join(at.lines, (F.col("c1") == F.col("doc_id")) & (F.col("v1") == F.col("line")) & (F.col("book").isNull() | (F.col("book") == F.col("source"))))
    by_word = worded.select(ident, "n_span", (F.col("w2") <= F.col("n_tokens")).alias("ok"), F.expr("w2 - w1 + 1").alias("size"), F.lit(1).cast("long").alias("lines"), *(T.token_id(F.col("c1"), F.col("v1"), F.col(w)).alias(a) for w, a in (("w1", "first"), ("w2", "last"))), F.expr("first_ord + w1 - 1").alias("low"), F.expr("first_ord + w2 - 1").alias("high"))
    book = at.books.select(F.col("source").alias("book"), F.lit(True).alias("ok"), F.col("n_tokens").alias("size"), F.col("n_lines").alias("lines"), F.col("first_token").alias("first"), F.col("last_token").alias("last"), F.col("first_ord").alias("low"), F.col("last_ord").alias("high"))
    whole = good.where("c1 IS NULL").join(book, "book").select(ident, "n_span", *columns)
    each = by_chapter.unionByName(by_line).unionByName(by_word).unionByName(whole)
    found = spans.select(ident, "n_span", "error").join(each, [ident, "n_span"], "left")
    held = lambda c: F.when(F.col("ok"), F.col(c))
    all_ok = F.bool_and(F.coalesce("ok", F.lit(False)))
    return found.groupBy(ident).agg(F.when(F.max("error").isNotNull(), "malformed").when(all_ok, "found").otherwise("absent").alias("status"), F.sum(held("size")).alias("n_tokens"), F.sum(held("lines")).alias("n_lines"), F.min_by("first", held("low")).alias("first_token"), F.max_by("last", held("high")).alias("last_token"), F.min(held("low")).alias("first_ord"), F.max(held("high")).alias("last_ord"))


def resolve_refs(refs: DataFrame, ident: str, text: str, books: DataFrame, aliases: DataFrame, at: Index, lemmas: DataFrame) -> DataFrame:
    """What resolve gives, from the texts of references; ids of lemmas are found if they occur, with their tokens counted and no passage. lemmas: (lemma, n_tokens)."""
    s = F.trim(F.col(text))
    is_lemma = F.coalesce(T.kind_of(s) == "lemma", F.lit(False))
    passages = resolve(parse_refs(refs.where(~is_lemma), ident, text, books, aliases).withColumn("n_span", F.col("n")), ident, at)
    none = F.lit(None)
    asked = refs.where(is_lemma).select(ident, F.substring(s, 7, 1 << 30).alias("lemma")).join(lemmas.select("lemma", "n_tokens"), "lemma", "left")
    return passages.unionByName(asked.select(ident, F.when(F.col("n_tokens").isNull(), "absent").otherwise("found").alias("status"), "n_tokens", *(none.cast("string" if c.endswith("token") else "long").alias(c) for c in ("n_lines", "first_token", "last_token", "first_ord", "last_ord"))))


def intervals(spans: DataFrame, ident: str, chapters: DataFrame) -> DataFrame:
    """(ident, doc_id, source, low, high): the places (line, word) that a reference's spans name in each document; those that overlap are merged."""
    top = F.lit((1 << 63) - 1)
    of = chapters.select("source", "doc_id")
    opened = _opened(spans, of).join(of, (F.col("_doc") == F.col("doc_id")) & (F.col("book").isNull() | (F.col("book") == F.col("source"))))
    edge = lambda v, w, default: F.struct(F.coalesce(v, default).alias("line"), F.coalesce(w, default).alias("word"))
    first, last = F.col("_doc") == F.col("c1"), F.col("_doc") == F.col("c2")
    zero = F.lit(0).cast("long")
    placed = opened.select(ident, "source", "doc_id", edge(F.when(first, F.col("v1")), F.when(first, F.col("w1")), zero).alias("low"), edge(F.when(last, F.col("v2")), F.when(last, F.col("w2")), top).alias("high"))
    whole = spans.where("error IS NULL AND c1 IS NULL").select(ident, F.col("book").alias("source")).join(of, "source").select(ident, "source", "doc_id", F.struct(zero.alias("line"), zero.alias("word")).alias("low"), F.struct(top.alias("line"), top.alias("word")).alias("high"))
    w = Window.partitionBy(ident, "source", "doc_id").orderBy("low", "high")
    reached = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = placed.unionByName(whole).withColumn("new", F.when(reached.isNull() | (reached < F.col("low")), 1).otherwise(0))
    parted = marked.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parted.groupBy(ident, "source", "doc_id", "part").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("part")


def interlinear(spans: DataFrame, ident: str, tok: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """(ident, tok columns): the tokens of the books, lines or words that each span names, each once for a reference.

    Spans are merged before they meet tokens, by document, so token rows are never compared with one another.
    """
    merged = intervals(spans, ident, tok.select("source", "doc_id").distinct() if chapters is None else chapters)
    asked = merged.select(ident, F.col("source").alias("_source"), F.col("doc_id").alias("_of"), "low", "high")
    place = F.struct("line", "word")
    return tok.join(asked, (F.col("doc_id") == F.col("_of")) & (F.col("source") == F.col("_source")) & (place >= F.col("low")) & (place <= F.col("high"))).select(ident, *tok.columns)


MANY = 64  # intervals that go along with a text at a time


def interlinear_texts(spans: DataFrame, ident: str, docs: DataFrame, chapters: DataFrame) -> DataFrame:
    """(ident, id, doc_id, source, line, word, surface, after, lemma): what interlinear gives, from the texts: a document's intervals go to its text, and only tokens inside of one are given."""
    merged = intervals(spans, ident, chapters)
    part = F.floor(F.row_number().over(Window.partitionBy("source", "doc_id").orderBy(ident, "low")) / MANY)
    asked = merged.withColumn("part", part).groupBy("source", "doc_id", "part").agg(F.collect_list(F.struct(F.col(ident).alias("of"), "low", "high")).alias("asked")).drop("part")
    tok = C.identified(C.tokens_in_order(docs.select("doc_id", "source", "text").join(asked, ["source", "doc_id"]), "asked"))
    place = F.struct("line", "word")
    hit = F.filter("asked", lambda a: (place >= a["low"]) & (place <= a["high"]))
    return tok.withColumn("a", F.explode_outer(F.transform(hit, lambda a: a["of"]))).where("a IS NOT NULL").select(F.col("a").alias(ident), "id", "doc_id", "source", "line", "word", "surface", "after", "lemma")


def cells(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, cells): the tokens of each line as one array of surface, punctuation and lemma, in order."""
    cell = F.struct("word", F.concat("surface", "after").alias("form"), "lemma")
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
