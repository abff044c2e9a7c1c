"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

A document is the sequence of its lines that aren't blank (spaces only). Doubling ranks all
positions by their first 1, 2, 4, ... lines: a round pairs each position's rank with the rank `h`
lines further on and ranks the pairs. Positions whose rank nobody shares are settled and leave,
so a round touches repeated text only, and rounds go on until every rank is unique or ends with
its document. Positions of one rank are an interval of the suffix array.

The intervals of every longest common prefix lie between those of two powers of two. Going down
the powers, an interval of depth d is split by the rank h lines behind its d lines: parts
of two or more are intervals of depth d + h, and each part's first position stays in the interval
for the others. In the end the members of an interval share exactly its depth. A position's longest
repeat is its deepest interval in which an earlier position is the first; repeats that reach
further than the one before are the maximal runs. Later copies are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lexgrove.llm.common import attach, cut, written

MIN_LINES = 3
MIN_LINE_CHARS = 40
_DOC = ("_doc", "_th")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("_doc"), F.xxhash64(text).alias("_th"), F.split(text, "\n").alias("_lines"))


def _positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each non-blank line: document, seq among those lines, line number, 128-bit line id."""
    numbered = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("line"), x.alias("s"))), lambda x: F.trim(x["s"]) != "")
    rows = _keyed(docs, id_col, text_col).select(*_DOC, F.posexplode(numbered).alias("seq", "l"))
    return rows.select(*_DOC, "seq", F.col("l.line").alias("line"), F.xxhash64("l.s").alias("h1"), F.xxhash64("l.s", F.lit(7)).alias("h2"), F.length("l.s").alias("chars"))


_PLACE = (*_DOC, "seq")


def _ranks(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int, int]:
    """The keys that occur again, with `rank` in their order, rows and first place; with the rows of all of them and of the most frequent.

    Counts are combined before the shuffle, only keys are sorted.
    """
    repeated = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.min(F.struct(*_PLACE)).alias("first")).where("n_rows > 1")
    return _sized(repeated.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()))


def _sized(counted: DataFrame) -> tuple[DataFrame, int, int]:
    """The frame cut, with the sum and the largest of its n_rows, which are seen as it is written."""
    seen = Observation()
    own = cut(counted.observe(seen, F.sum("n_rows").alias("total"), F.max("n_rows").alias("most")))
    return own, seen.get["total"] or 0, seen.get["most"] or 0


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key occurs again, with `rank` in the order of the keys, and whether the row is a later one of its rank; rows of a key with many are joined where they are."""
    ranks, total, most = _ranks(rows, keys)
    joined = attach(rows, ranks, keys, total, most=most).drop(*keys)
    return joined.withColumn("later", ~_is("first")).drop("first")


def _is(first: str) -> Column:
    """The row is the one that `first` names."""
    return F.col("_doc").eqNullSafe(F.col(f"{first}._doc")) & (F.col("_th") == F.col(f"{first}._th")) & (F.col("seq") == F.col(f"{first}.seq"))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The repeated lines, ranked; rows that repeat id and text are one document from here on."""
    ranked = _ranked(cut(_positions(docs, id_col, text_col)), ["h1", "h2"])
    once = ranked.groupBy(*_PLACE).agg(F.first(F.struct("line", "chars", "rank", "later")).alias("r"))
    return cut(once.select(*_PLACE, "r.*"))


def _at(offset: int) -> Column:
    """The rank that many lines further on in the same document; null if that line is not repeated."""
    w = Window.partitionBy(*_DOC).orderBy("seq").rangeBetween(offset, offset)
    return F.max("rank").over(w)


def _doubled(lines: DataFrame, tables: list[Callable[[], None]] | None = None) -> dict[int, DataFrame]:
    """Length of a run -> the positions whose run of that length is repeated, ranked, and whether twice that length is a later one; up to the longest there is.

    A round writes the ranks of the pairs, and a table of the positions with their pair's rank and the one that follows it; what
    deletes the tables is added to `tables`.
    """
    tables, levels, h = [] if tables is None else tables, {}, 1
    at = cut(lines.select(*_PLACE, "rank", "later").withColumn("next", _at(h)))
    while True:
        paired = at.withColumnsRenamed({"rank": "this", "later": "was"})
        some = paired.where("next IS NOT NULL")
        ranks, total, most = _ranks(some, ["this", "next"])
        if not total:
            return levels | {h: at.select(*_PLACE, "rank", "later", F.lit(False).alias("deeper"))}
        joined = attach(some, ranks, ["this", "next"], total, most=most, how="left")
        joined = joined.select(*_PLACE, "this", "was", "rank", F.when(F.col("rank").isNotNull(), ~_is("first")).alias("later"))
        ends = paired.where("next IS NULL").select(*_PLACE, "this", "was", F.lit(None).cast("long").alias("rank"), F.lit(None).cast("boolean").alias("later"))
        both, drop = written(joined.unionByName(ends).withColumn("next", _at(2 * h)))
        tables.append(drop)
        levels[h] = both.select(*_PLACE, F.col("this").alias("rank"), F.col("was").alias("later"), F.coalesce("later", F.lit(False)).alias("deeper"))
        h *= 2
        at = both.where("rank IS NOT NULL").select(*_PLACE, "rank", "later", "next")


def _there(rows: DataFrame, *more: Column) -> DataFrame:
    """The rows' places under names of their own, to join with; merged, as there are too many joins to broadcast a side of each."""
    return rows.select(F.col("_doc").alias("l_doc"), F.col("_th").alias("l_th"), F.col("seq").alias("l_seq"), *more).hint("merge")


def _meets(ahead: Column) -> Column:
    return F.col("_doc").eqNullSafe(F.col("l_doc")) & (F.col("_th") == F.col("l_th")) & (ahead == F.col("l_seq"))


def _members(levels: dict[int, DataFrame], h: int) -> DataFrame:
    """(node, depth, place) of the intervals of h lines: positions that share no 2 h lines with an earlier one."""
    return levels[h].where("NOT deeper").select(F.struct(F.lit(h).alias("of"), F.col("rank").alias("id")).alias("node"), F.lit(h).alias("depth"), *_PLACE)


def _split(members: DataFrame, ranks: DataFrame, h: int, tables: list[Callable[[], None]]) -> DataFrame:
    """Intervals split by the rank that stands behind their depth: those of h lines more, and the old ones with the first of each part."""
    looked = members.join(_there(ranks, F.col("rank").alias("part")), _meets(F.col("seq") + F.col("depth")), "left")
    looked, drop = written(looked.select("node", "depth", *_PLACE, "part"))
    tables.append(drop)
    some = looked.where("part IS NOT NULL")
    parts = some.groupBy("node", "depth", "part").agg(F.count("*").alias("n_rows"), F.min(F.struct(*_PLACE)).alias("first"))
    parts, total, most = _sized(parts.withColumn("id", F.monotonically_increasing_id()))
    several = parts.where("n_rows > 1")
    deeper = attach(some, several.select("node", "part", "id", "n_rows"), ["node", "part"], total, most=most)
    deeper = deeper.select(F.struct(F.lit(-h).alias("of"), "id").alias("node"), (F.col("depth") + h).alias("depth"), *_PLACE)
    return deeper.unionByName(parts.select("node", "depth", "first.*")).unionByName(looked.where("part IS NULL").drop("part"))


def _runs(lines: DataFrame) -> DataFrame:
    """(_doc, _th, seq, s_doc, s_th, s_seq, n): maximal repeats, each beside the first position that shares so many lines.

    What a round leaves for the next one is a table: a checkpoint keeps the size that Spark
    guessed for it, a join's guess is the product of its sides, and so each round would
    double the digits of that number, to megabytes in the driver.
    """
    tables: list[Callable[[], None]] = []
    levels = _doubled(lines, tables)
    members = _members(levels, max(levels))
    for h in sorted(levels, reverse=True)[1:]:
        members = _split(members, levels[h], h, tables).unionByName(_members(levels, h))
    members = cut(members)
    firsts, total, most = _sized(members.groupBy("node").agg(F.count("*").alias("n_rows"), F.min(F.struct(*_PLACE)).alias("first")).where("n_rows > 1"))
    repeats = attach(members, firsts, ["node"], total, most=most).where(~_is("first"))
    longest = repeats.groupBy(*_PLACE).agg(F.max_by(F.struct("depth", "first"), "depth").alias("m"))
    end = F.col("seq") + F.col("m.depth")
    before = Window.partitionBy(*_DOC).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    heads = longest.withColumn("reached", F.max(end).over(before)).where(F.col("reached").isNull() | (F.col("reached") < end))
    runs = cut(heads.select(*_PLACE, F.col("m.first._doc").alias("s_doc"), F.col("m.first._th").alias("s_th"), F.col("m.first.seq").alias("s_seq"), F.col("m.depth").alias("n")))
    for drop in tables:
        drop()
    return runs


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """(id, first_line, last_line, n_lines, source_doc, source_line): maximal runs of lines, each beside the earliest copy of so many lines.

    Line numbers count all lines from 0; n_lines counts those that aren't blank.
    """
    lines = _lines(docs, id_col, text_col)
    runs = _runs(lines).where(F.col("n") >= min_lines)
    last, source = F.col("seq") + F.col("n") - 1, F.col("s_doc").eqNullSafe(F.col("l_doc")) & (F.col("s_th") == F.col("l_th")) & (F.col("s_seq") == F.col("l_seq"))
    for on, name in ((_meets(F.col("seq")), "first_line"), (_meets(last), "last_line"), (source, "source_line")):
        runs = runs.join(_there(lines, F.col("line").cast("long").alias(name)), on).drop("l_doc", "l_th", "l_seq")
    return runs.select(F.col("_doc").alias(id_col), "first_line", "last_line", F.col("n").cast("long").alias("n_lines"), F.col("s_doc").alias("source_doc"), "source_line")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_line_chars: int = MIN_LINE_CHARS) -> DataFrame:
    """(_doc, _th, line): the lines that belong to a later copy of a repeated run.

    A run counts if it has min_lines lines, or is one line of min_line_chars characters. The
    first copy, by document id and then line, stays. Blank lines belong to no run.
    """
    if min_lines < 2:
        raise ValueError("min_lines is 2 or more; single lines are governed by min_line_chars")
    lines = _lines(docs, id_col, text_col)
    single = lines.where(F.col("later") & (F.col("chars") >= min_line_chars)).select(*_DOC, "line")
    runs = _runs(lines).where(F.col("n") >= min_lines)
    covered = runs.select(*_DOC, F.explode(F.sequence("seq", F.col("seq") + F.col("n") - 1)).alias("seq")).distinct()
    return single.union(lines.join(_there(covered), _meets(F.col("seq")), "left_semi").select(*_DOC, "line"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_line_chars: int = MIN_LINE_CHARS) -> DataFrame:
    """The documents, text without later copies of repeated line runs, plus line counts.

    Returns all columns of docs with the text replaced, and n_lines, n_removed (non-blank lines).
    Null text stays null with zero lines; empty text stays empty; blank lines stay. Rows that
    repeat both id and text are one document: what goes from one goes from the other, and they
    are no copies of each other. Null ids sort first. No documents give no rows. Columns of
    docs named n_lines or n_removed are replaced; other extra columns pass through.
    """
    gone = repeated_lines(docs, id_col, text_col, min_lines, min_line_chars).groupBy(*_DOC).agg(F.collect_set("line").alias("_gone")).hint("merge")
    text = F.col(f"`{text_col}`")
    lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("g._gone"))
    d, g = docs.drop("n_lines", "n_removed").withColumn("_line_dedup_th", F.xxhash64(F.coalesce(text, F.lit("")))), gone.alias("g")
    out = d.join(g, d[f"`{id_col}`"].eqNullSafe(F.col("g._doc")) & (d["_line_dedup_th"] == F.col("g._th")), "left")
    shorter = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    n_lines = F.coalesce(F.size(F.filter(lines, lambda x: F.trim(x) != "")), F.lit(0))
    return out.select(
        *(F.when(F.col("g._gone").isNull(), text).otherwise(shorter).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")),
        F.when(text.isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("g._gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
