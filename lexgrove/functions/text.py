"""Text functions on columns: search keys, ids, clean-up. All but nfc stay in the JVM."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Marks that a search key leaves out. Apostrophes of elided forms, then punctuation.
ELISION = "’ʼ᾽᾿'"
PUNCTUATION = ",.·;·;"
#: Phrases by which a text declines.
DECLINES = (
    "not in", "can't", "cannot", "can not", "does not contain", "doesn't contain", "not available", "unable", "won't",
    "will not", "no data", "not include", "doesn't include", "does not include",
)
#: Number words, by their value.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


def _composed() -> tuple[str, str]:
    """Letters that decompose to a base letter and marks, and their bases."""
    letters, bases = [], []
    for cp in range(0xC0, 0x2000):
        parts = [c for c in unicodedata.normalize("NFD", chr(cp)) if not unicodedata.combining(c)]
        if len(parts) == 1 and parts[0] != chr(cp):
            letters.append(chr(cp))
            bases.append(parts[0])
    return "".join(letters), "".join(bases)


_LETTERS, _BASES = _composed()


def search_key(text: Column) -> Column:
    """Key that ignores accents, case, elision marks and punctuation; final sigma counts as sigma.

    Marks go before case is folded, else a combining iota subscript would become a letter. Text of ASCII alone, which
    has as many bytes as letters, has no accents to look for.
    """
    bare = F.translate(F.lower(text), "".join(c for c in ELISION + PUNCTUATION if c.isascii()), "")
    plain = F.regexp_replace(F.translate(text, _LETTERS, _BASES), r"\p{M}", "")
    return F.when(F.octet_length(text) == F.length(text), bare).otherwise(F.translate(F.lower(plain), "ς" + ELISION + PUNCTUATION, "σ"))


def _uncomposed() -> str:
    """A character class of what may stand in a text that isn't composed: marks, vowels and finals of Hangul, and letters that compose to others by themselves."""
    alone = [cp for cp in (*range(0xA0, 0xD800), *range(0xF900, 0x30000)) if unicodedata.normalize("NFC", chr(cp)) != chr(cp)]
    ranges: list[list[int]] = []
    for cp in alone:
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return r"[\p{M}\x{1160}-\x{11FF}" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


_UNCOMPOSED = _uncomposed()


def may_lack_nfc(text: Column) -> Column:
    """False only for texts that are their own canonical composition; decided in the JVM."""
    return text.rlike(_UNCOMPOSED)


def _nfc(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else unicodedata.normalize("NFC", v) for v in values.to_pylist()], pa.string())


def nfc(text: Column) -> Column:
    """Canonical composition, the identity form of strings. Spark has no such function, so this is an Arrow UDF."""
    return F.arrow_udf(_nfc, StringType())(text)


def clean(text: Column) -> Column:
    """Empty means absent."""
    return F.nullif(text, F.lit(""))


def padded(number: Column, width: int) -> Column:
    """The number with zeros before it up to the width; longer numbers stay whole."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), "0")


def _minted(start: str, fields: tuple[tuple[Column, int], ...]) -> Column:
    """An id of fixed-width fields whose order is surface order; if a number is too long for its field all are parted by full stops."""
    parts = [padded(x, n) for x, n in fields]
    fits, plain = F.lit(True), F.lit(True)
    for x, n in fields:
        fits, plain = fits & (x < 10**n), plain & x.between(0, 10**n - 1)
    short = [F.lpad(x.cast("string"), n, "0") for x, n in fields]
    return F.when(plain, F.concat(F.lit(start), *short)).otherwise(F.concat(F.lit(start), F.when(fits, F.concat(*parts)).otherwise(F.concat_ws(".", *parts))))


def token_id(doc: Column, line: Column, word: Column) -> Column:
    return _minted("doc:n", ((doc, 9), (line, 5), (word, 5)))


def line_id(doc: Column, line: Column) -> Column:
    return _minted("doc:l", ((doc, 9), (line, 5)))


#: The id grammar, first match wins.
ID_GRAMMAR = (
    ("token", r"^doc:n(?:\d{19}|\d{9,}\.\d{5,}\.\d{5,})$"), ("line", r"^doc:l(?:\d{14}|\d{9,}\.\d{5,})$"), ("sentence", r"^doc:s:n\d{19}$"),
    ("group", r"^doc:g:n\d{19}\.\d+$"), ("book", r"^book:\S+$"), ("lemma", r"^lemma:\S.*$"),
)
CITABLE = ("token", "line", "book", "lemma")


def kind_of(ident: Column) -> Column:
    """The kind of an id by its grammar, null if it has none."""
    kind = None
    for name, pattern in ID_GRAMMAR:
        hit = ident.startswith(re.match(r"\^([a-z:]+)", pattern)[1]) & ident.rlike(pattern)  # what can't match is told by its first letters
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return kind


def _parts(ident: Column, start: str, widths: tuple[int, ...]) -> list[Column]:
    fixed, parted = ("^" + start + sep.join(rf"(\d{{{n}{more}}})" for n in widths) + "$" for sep, more in (("", ""), (r"\.", ",")))
    return [F.coalesce(*(clean(F.regexp_extract(ident, p, k)) for p in (fixed, parted))).cast("long") for k in range(1, len(widths) + 1)]


def token_parts(ident: Column) -> list[Column]:
    """Document, line and word of a token id; null for other ids."""
    return _parts(ident, "doc:n", (9, 5, 5))


def line_parts(ident: Column) -> list[Column]:
    """Document and line of a line id; null for other ids."""
    return _parts(ident, "doc:l", (9, 5))


def labels(separator: str, *parts: Column) -> Column:
    """Parts that are null vanish."""
    return F.concat_ws(separator, *parts)


def one_line(text: Column, width: int) -> Column:
    """White space collapsed; what is longer than width ends in an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)


def extract_ids(text: Column, pattern: str) -> Column:
    """Distinct ids in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


def plain_numbers(text: Column) -> Column:
    """Thousands separators dropped and number words up to twenty as digits."""
    three = "[0-9]{3}(?![0-9A-Za-z_])"
    out = F.regexp_replace(text, f"([0-9])[, \u00a0\u202f](?={three})", "$1")
    for n, word in enumerate(NUMBER_WORDS):
        out = F.regexp_replace(out, rf"(?i)\b{word}\b", str(n))
    return out


def declines(text: Column, topics: tuple[str, ...]) -> Column:
    """Whether the text has a phrase that declines and one of the topic words."""
    low = F.lower(text)
    has = lambda words: F.greatest(*(low.contains(w.lower()) for w in words)) if len(words) > 1 else low.contains(words[0].lower())
    return has(DECLINES) & has(topics)


def register_sql(spark: SparkSession) -> None:
    """search_key(text) and nfc(text) for SQL text: the key as an SQL function of built-in ones, which the optimizer opens up, composition as an Arrow function."""
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    plain = f"regexp_replace(translate(s, {quoted(_LETTERS)}, {quoted(_BASES)}), '\\\\p{{M}}', '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION search_key(s STRING) RETURNS STRING RETURN translate(lower({plain}), {quoted('ς' + ELISION + PUNCTUATION)}, 'σ')")
    spark.udf.register("nfc", F.arrow_udf(_nfc, StringType()))
