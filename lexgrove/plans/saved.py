"""Saved queries with typed parameters: text values are checked and bound, then a function builds the DataFrame."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.functions import text as T
from lexgrove.operators import corpus as C
from lexgrove.operators import graph as G
from lexgrove.operators import passages as P
from lexgrove.operators.stored import Store


class ParamError(ValueError):
    """A parameter is unknown, missing or can't be read as its type."""


@dataclass(frozen=True)
class Param:
    """kind: lemma, text, int, token (an id or `book doc:line!word`) or passage (bound to its first and last ordinal)."""

    name: str
    kind: str = "text"
    required: bool = True
    default: str | None = None


class Corpus:
    """Documents and what is derived from them, each lazily and once."""

    def __init__(self, docs: DataFrame, store: Store | None = None, **relations: DataFrame) -> None:
        """store: where the tokens and places of these documents are kept, if they are. relations, as far as queries need them: refers_to and has_subject (src, dst, ord), frame_arg (src, dst, arg_role, implicit, ord), groups (id, parent, role), inside (anc, leaf), features (id, parent, role, pos, gcase)."""
        self.docs, self.store, self.relations = docs, store, relations

    def relation(self, name: str) -> DataFrame:
        if name not in self.relations:
            raise ParamError(f"this corpus has no {name}")
        return self.relations[name]

    @cached_property
    def tokens(self) -> DataFrame:
        if self.store is not None:
            return self.store.table("token")
        return C.with_ordinals(C.with_sentences(C.identified(C.tokens(self.docs))), self.docs)

    @cached_property
    def places(self) -> P.Index:
        return P.index(self.docs) if self.store is None else P.Index(*(self.store.table(t) for t in ("line", "chapter", "book")))

    @cached_property
    def books(self) -> tuple[DataFrame, DataFrame]:
        codes = self.docs.select(F.col("source").alias("code")).distinct()
        return codes.withColumn("single", F.lit(False)), codes.select("code", F.col("code").alias("alias"))


@dataclass(frozen=True)
class Saved:
    name: str
    doc: str
    params: tuple[Param, ...]
    build: Callable[..., DataFrame]


SAVED: dict[str, Saved] = {}


def saved(name: str, *params: Param):
    def add(f):
        SAVED[name] = Saved(name, (f.__doc__ or "").strip(), params, f)
        return f

    return add


def _bounds(corpus: Corpus, text: str) -> tuple[int, int]:
    """The ordinals of the first and last token of a passage; a gap between its spans is inside. One row comes back."""
    ref = corpus.docs.sparkSession.createDataFrame([(0, text)], "i int, t string")
    spans = P.parse_refs(ref, "i", "t", *corpus.books).withColumn("n_span", F.col("n"))
    if error := spans.agg(F.max("error")).first()[0]:
        raise ParamError(f"{text!r}: {error}")
    row = P.resolve(spans, "i", corpus.places).first()
    if row is None or row["status"] != "found":
        raise ParamError(f"{text!r} is not in this corpus")
    return row["first_ord"], row["last_ord"]


def bind(corpus: Corpus, query: Saved, raw: dict[str, str]) -> dict:
    """Values by parameter name; optional ones without a value are None."""
    names = {p.name for p in query.params}
    if unknown := sorted(set(raw) - names):
        raise ParamError(f"{query.name} has no parameter {', '.join(unknown)}; it has {', '.join(sorted(names)) or 'none'}")
    out = {}
    for p in query.params:
        value = raw.get(p.name, p.default)
        if value is None:
            if p.required:
                raise ParamError(f"{query.name} needs {p.name}")
            out[p.name] = None
        elif p.kind == "lemma":
            out[p.name] = unicodedata.normalize("NFC", value.removeprefix("lemma:"))
        elif p.kind == "int":
            if not re.fullmatch(r"[+-]?\d+", value):
                raise ParamError(f"{p.name} must be a whole number, not {value!r}")
            out[p.name] = int(value)
        elif p.kind == "token":
            if re.fullmatch(r"doc:n\d{19}", value):
                out[p.name] = value
            elif m := re.fullmatch(r"(.+) (\d+):(\d+)!(\d+)", value):
                _bounds(corpus, value)  # refuses other books, and what isn't there
                out[p.name] = f"doc:n{int(m[2]):09}{int(m[3]):05}{int(m[4]):05}"
            else:
                raise ParamError(f"{value!r} is no token id or reference to one word")
        elif p.kind == "passage":
            out[p.name] = _bounds(corpus, value)
        else:
            out[p.name] = value
    return out


def run(corpus: Corpus, name: str, raw: dict[str, str], limit: int | None = None) -> DataFrame:
    if name not in SAVED:
        raise ParamError(f"no saved query {name}; there are {', '.join(sorted(SAVED))}")
    out = SAVED[name].build(corpus, **bind(corpus, SAVED[name], raw))
    return out if limit is None else out.limit(limit)


def _within(tok: DataFrame, scope: tuple[int, int] | None) -> DataFrame:
    return tok if scope is None else tok.where(F.col("ord").between(*scope))


@saved("lemma_occurrences", Param("lemma", "lemma"), Param("scope", "passage", required=False))
def lemma_occurrences(corpus: Corpus, lemma: str, scope: tuple[int, int] | None) -> DataFrame:
    """Where a lemma stands, in text order."""
    return _within(corpus.tokens.where(F.col("lemma") == lemma), scope).select("id", "source", "doc_id", "line", "surface", "ord").orderBy("ord")


@saved("lemma_by_book", Param("lemma", "lemma"))
def lemma_by_book(corpus: Corpus, lemma: str) -> DataFrame:
    """How often each book has a lemma."""
    tok = corpus.tokens if corpus.store is not None else C.identified(C.tokens(corpus.docs))
    return tok.where(F.col("lemma") == lemma).groupBy("source").agg(F.count("*").alias("n")).orderBy("source")


@saved("split_lines", Param("scope", "passage", required=False))
def split_lines(corpus: Corpus, scope: tuple[int, int] | None) -> DataFrame:
    """Lines that more than one sentence shares."""
    by = _within(corpus.tokens, scope).groupBy("doc_id", "line").agg(F.count_distinct("sent").alias("n_sentences"))
    return by.where("n_sentences > 1").orderBy("doc_id", "line")


@saved("shared_trigrams", Param("a", "passage"), Param("b", "passage"))
def shared_trigrams(corpus: Corpus, a: tuple[int, int], b: tuple[int, int]) -> DataFrame:
    """Trigrams inside sentences that two passages share."""
    side = lambda scope, n: C.trigrams(_within(corpus.tokens, scope)).groupBy("l1", "l2", "l3").agg(F.count("*").alias(n))
    return side(a, "n_a").join(side(b, "n_b"), ["l1", "l2", "l3"]).orderBy("l1", "l2", "l3")


@saved("token", Param("token", "token"), Param("width", "int", required=False, default="3"))
def token(corpus: Corpus, token: str, width: int) -> DataFrame:
    """A token and its neighbours in the document."""
    at = corpus.tokens.where(F.col("id") == token).select(F.col("ord").alias("at"), F.col("doc_id").alias("d"))
    return corpus.tokens.join(F.broadcast(at), (F.col("doc_id") == F.col("d")) & F.col("ord").between(F.col("at") - width, F.col("at") + width)).select("id", "surface", "ord").orderBy("ord")


def _words(corpus: Corpus, prefix: str) -> DataFrame:
    return corpus.tokens.select(*(F.col(c).alias(f"{prefix}_{c}") for c in ("id", "surface", "lemma", "ord")))


def _placed(df: DataFrame, scope: tuple[int, int] | None, column: str) -> DataFrame:
    return df if scope is None else df.where(F.col(column).between(*scope))


@saved("referent_chain", Param("token", "token"))
def referent_chain(corpus: Corpus, token: str) -> DataFrame:
    """From a word to its first referent, and on, until there is none or one comes again."""
    start = corpus.docs.sparkSession.createDataFrame([(token,)], "start string")
    steps = G.chains(start, corpus.relation("refers_to").where("ord = 1"))
    return steps.join(corpus.tokens, "id").select("step", "id", "surface", "lemma").orderBy("step")


@saved("subject_lemma_tree", Param("lemma", "lemma"), Param("scope", "passage", required=False))
def subject_lemma_tree(corpus: Corpus, lemma: str, scope: tuple[int, int] | None) -> DataFrame:
    """Verbs beside a subject, a word or group of role s, that holds the lemma in the nominative."""
    word = corpus.relation("features")
    inside = corpus.relation("groups").join(corpus.relation("inside"), F.col("id") == F.col("anc")).select(F.col("parent").alias("clause"), "role", F.col("leaf").alias("id"))
    alone = word.select(F.col("parent").alias("clause"), "role", "id")
    either = inside.unionByName(alone).join(word.select("id", "pos", "gcase"), "id")
    subjects = either.where("role = 's' AND gcase = 'nominative'").select("clause", F.col("id").alias("subject_id")).join(_words(corpus, "subject"), "subject_id").where(F.col("subject_lemma") == lemma)
    verbs = either.where("role = 'v' AND pos = 'verb'").select("clause", F.col("id").alias("verb_id")).join(_words(corpus, "verb"), "verb_id")
    return _placed(subjects.join(verbs, "clause"), scope, "verb_ord").orderBy("verb_ord", "subject_ord").select("verb_id", "verb_surface", "verb_lemma", "subject_id", "subject_surface")


@saved("subject_lemma_subjref", Param("lemma", "lemma"), Param("scope", "passage", required=False))
def subject_lemma_subjref(corpus: Corpus, lemma: str, scope: tuple[int, int] | None) -> DataFrame:
    """Verbs whose annotated subject is a word of the lemma."""
    edges = corpus.relation("has_subject").select(F.col("src").alias("verb_id"), F.col("dst").alias("subject_id"), F.col("ord").alias("edge_ord"))
    rows = edges.join(_words(corpus, "subject"), "subject_id").where(F.col("subject_lemma") == lemma).join(_words(corpus, "verb"), "verb_id")
    return _placed(rows, scope, "verb_ord").orderBy("verb_ord", "edge_ord").select("verb_id", "verb_surface", "verb_lemma", "subject_id", "subject_surface")


@saved("frame_args", Param("verb_lemma", "lemma"), Param("role", required=False, default="A0"), Param("scope", "passage", required=False))
def frame_args(corpus: Corpus, verb_lemma: str, role: str, scope: tuple[int, int] | None) -> DataFrame:
    """What stands in a role of a verb's frames; implicit ones without a word."""
    edges = corpus.relation("frame_arg").where(F.col("arg_role") == role).select(F.col("src").alias("verb_id"), F.col("dst").alias("argument_id"), "arg_role", "implicit", F.col("ord").alias("edge_ord"))
    rows = edges.join(_words(corpus, "verb").where(F.col("verb_lemma") == verb_lemma), "verb_id").join(_words(corpus, "argument"), "argument_id", "left")
    return _placed(rows, scope, "verb_ord").orderBy("verb_ord", "edge_ord").select("verb_id", "verb_surface", "arg_role", "argument_id", "argument_surface", "argument_lemma", "implicit")


def parse_sql(text: str) -> tuple[Saved, str]:
    """A saved query written as SQL: a header of comments, then one statement with :parameters.

    Header lines: `-- name: n`, `-- doc: what it gives`, and for each parameter `-- param: name kind [optional | = default]`.
    A parameter of kind passage becomes :name_first and :name_last, its ordinals.
    """
    name, doc, params, body = None, "", [], []
    for line in text.strip().splitlines():
        if m := re.fullmatch(r"--\s*(name|doc|param):\s*(.+?)\s*", line):
            if m[1] == "name":
                name = m[2]
            elif m[1] == "doc":
                doc = m[2]
            else:
                p = re.fullmatch(r"(\w+)\s+(lemma|text|int|token|passage)(?:\s+(optional)|\s*=\s*(.+))?", m[2])
                if p is None:
                    raise ParamError(f"cannot read parameter {m[2]!r}")
                params.append(Param(p[1], p[2], required=not (p[3] or p[4]), default=p[4]))
        else:
            body.append(line)
    if name is None:
        raise ParamError("a saved query has a name")
    return Saved(name, doc, tuple(params), lambda corpus, **kw: None), "\n".join(body)


def run_sql(corpus: Corpus, text: str, raw: dict[str, str]) -> DataFrame:
    """Runs a saved query written as SQL over the corpus's tables as views token, line, chapter, book and what relations it has; search_key and nfc are there.

    Values are bound as named parameters, never put into the text.
    """
    spark = corpus.docs.sparkSession
    query, body = parse_sql(text)
    values, bound = {}, bind(corpus, query, raw)
    for p in query.params:
        v = bound[p.name]
        if p.kind == "passage":
            values[f"{p.name}_first"], values[f"{p.name}_last"] = v if v is not None else (0, (1 << 63) - 1)
        else:
            values[p.name] = v
    T.register_sql(spark)
    views = {"token": corpus.tokens, "line": corpus.places.lines, "chapter": corpus.places.chapters, "book": corpus.places.books, **corpus.relations}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(body, args=values)
