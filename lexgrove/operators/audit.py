"""Fingerprints, agreement of two sources, manifests, scoring."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType, TimestampNTZType, TimestampType

from lexgrove.functions import text as T
from lexgrove.operators.graph import cut


FAN = 1024  # digests that make one of the next level


def _written(value: Column, kind: DataType) -> Column:
    """A value as text that is the same in every engine; null if it is null."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(F.abs(value) < 1e12, F.floor(value.cast("double") * 1e6 + 0.5).cast("string")).otherwise(value.cast("string"))  # millionths
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")).cast("string")
    if isinstance(kind, ArrayType):
        return F.concat(F.size(value).cast("string"), F.lit("["), F.array_join(F.transform(value, lambda x: _marked(x, kind.elementType)), ""), F.lit("]"))
    if isinstance(kind, (StructType, MapType)):
        return F.to_json(value)
    return value.cast("string")


def _marked(value: Column, kind: DataType) -> Column:
    """Length, colon and text, or a tilde for null: no two different rows of values give one string."""
    text = _written(value, kind)
    return F.when(value.isNull(), "~").otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def canonical(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as text, its columns (all if none are named) by name order. Doubles count to a millionth, times to a microsecond."""
    return F.concat(*(_marked(F.col(f"`{c}`"), df.schema[c].dataType) for c in sorted(columns or df.columns)))


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(n, digest): rows and the sum of 60-bit row digests.

    The sum doesn't depend on the order of rows, so it needs no sort and combines map-side.
    """
    low = F.conv(F.substring(F.md5(canonical(df, columns)), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(low), F.lit(0)).cast("string").alias("digest"))


def schema_digest(df: DataFrame) -> str:
    """16 hex digits of the columns' names, types and nullability, in their order."""
    return hashlib.sha256("\n".join(f"{f.name} {f.dataType.simpleString()} {f.nullable}" for f in df.schema).encode()).hexdigest()[:16]


def ordered_digest(df: DataFrame, key: list[str], columns: list[str] | None = None, fan: int = FAN) -> DataFrame:
    """(n, root): the root of a tree of SHA-256 over the rows' digests in key order.

    Rows are sorted in ranges; their number in the whole order, not the range, decides which `fan`
    of them make a node, and so on upwards, so the root is the same however partitions
    are cut. Rows of one key are ordered by their digests. No rows: the digest of nothing.
    """
    spark = df.sparkSession
    rows = df.select(*(F.col(f"`{k}`") for k in key), F.unhex(F.sha2(canonical(df, columns), 256)).alias("_digest"))
    # a range is sorted where it is, so its rows need no second exchange to be numbered; only the digest and its place go on, 32 bytes and a number
    dealt = cut(rows.repartitionByRange(*key, "_digest").sortWithinPartitions(*key, "_digest").select("_digest", F.monotonically_increasing_id().alias("_at")))
    dealt = dealt.select("_digest", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("k"))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    base = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for each range
    level = dealt.join(F.broadcast(base), "_part").select((F.col("base") + F.col("k")).alias("ord"), F.col("_digest").alias("digest"))
    total = n = dealt.count()
    while True:
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "digest"))), lambda x: F.lower(F.hex(x["digest"]))), "")
        level = cut(level.groupBy(F.floor(F.col("ord") / fan).alias("ord")).agg(F.unhex(F.sha2(joined, 256)).alias("digest")))
        n = -(-n // fan)
        if n <= 1:
            break
    root = level.agg(F.coalesce(F.lower(F.hex(F.max("digest"))), F.sha2(F.lit(""), 256)).alias("root"))
    return root.select(F.lit(total).cast("long").alias("n"), "root") if total else spark.range(1).select(F.lit(0).cast("long").alias("n"), F.sha2(F.lit(""), 256).alias("root"))


def build_id(digests: DataFrame, text: str = "digest", order: str = "tbl") -> DataFrame:
    """16 hex digits over all table digests in the order of their names; a row for each table goes in."""
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: F.concat(x[order], F.lit(" "), x[text])), "\n")
    return digests.agg(F.substring(F.sha2(rows, 256), 1, 16).alias("build_id"))


def coverage(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(side, keys): keys that only one of the two has; 'missing' from b, or 'extra' in it. One join finds both."""
    side = lambda df, mark: df.select(*keys, F.lit(True).alias(mark))
    j = side(a, "_a").join(side(b, "_b"), keys, "full").where("_a IS NULL OR _b IS NULL")
    return j.select(F.when(F.col("_b").isNull(), "missing").otherwise("extra").alias("side"), *keys)


def field_mismatches(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(field, n): rows of both whose values differ, null-safe, all fields in one pass."""
    other = b.select(*keys, *(F.col(f).alias(f"_{f}") for f in fields))
    counted = a.select(*keys, *fields).join(other, keys).agg(*(F.count_if(~F.col(f).eqNullSafe(F.col(f"_{f}"))).alias(f) for f in fields))
    return counted.unpivot([], fields, "field", "n")


def listed_mismatches(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """field_mismatches of rows that hold many values: a field is a text of values parted by single spaces, and the k-th of one is held against the k-th of the other, if both have it.

    Keys are joined once for each such row, so a value travels as its letters and one space.
    """
    other = b.select(*keys, *(F.col(f).alias(f"_{f}") for f in fields))
    parts = lambda c: F.split(c, " ")
    unlike = lambda f: F.size(F.filter(F.zip_with(parts(F.col(f)), parts(F.col(f"_{f}")), lambda x, y: x != y), lambda d: d))
    n = lambda f: F.coalesce(F.sum(F.when(F.col(f) == F.col(f"_{f}"), 0).otherwise(unlike(f))), F.lit(0)).cast("long").alias(f)
    return a.select(*keys, *fields).join(other, keys).agg(*map(n, fields)).unpivot([], fields, "field", "n")


def manifest_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, before, after) where two manifests differ; a side without the key is null."""
    x, y = a.select(*keys, F.col(value).alias("before")), b.select(*keys, F.col(value).alias("after"))
    return x.join(y, keys, "full").where(~F.col("before").eqNullSafe(F.col("after")))


def citation_scores(cited: DataFrame, gold: DataFrame, universe: DataFrame, group: str, ident: str) -> DataFrame:
    """(group, n_cited, n_hit, n_gold, n_fabricated, precision, recall) of distinct citations; precision is 0 if nothing is cited."""
    c = cited.select(group, ident).distinct()
    marked = c.join(gold.select(group, ident).distinct().withColumn("_gold", F.lit(1)), [group, ident], "left").join(universe.select(ident).distinct().withColumn("_known", F.lit(1)), ident, "left")
    by = marked.groupBy(group).agg(F.count("*").alias("n_cited"), F.count("_gold").alias("n_hit"), F.count_if(F.col("_known").isNull()).alias("n_fabricated"))
    out = gold.select(group, ident).distinct().groupBy(group).agg(F.count("*").alias("n_gold")).join(by, group, "left").na.fill(0, ["n_cited", "n_hit", "n_fabricated"])
    ratio = lambda x, y: F.round(F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0), 6)
    return out.withColumns({"precision": ratio("n_hit", "n_cited"), "recall": ratio("n_hit", "n_gold")})


def golden_check(result: DataFrame, gold: DataFrame, group: str, ident: str) -> DataFrame:
    """(group, n_rows, n_gold, n_missing): rows a result has, and golden ids it lacks."""
    g, r = gold.select(group, ident).distinct(), result.select(group, ident).distinct()
    rows = result.groupBy(group).agg(F.count("*").alias("n_rows"))
    lack = g.join(r, [group, ident], "left_anti").groupBy(group).agg(F.count("*").alias("n_missing"))
    return g.groupBy(group).agg(F.count("*").alias("n_gold")).join(rows, group, "left").join(lack, group, "left").na.fill(0, ["n_rows", "n_missing"])


def golden_values(result: DataFrame, gold: DataFrame, group: str, value: str) -> DataFrame:
    """(group, wanted, found, status): a golden value for each query against what it gives now: ok, drifted or missing."""
    have = result.select(group, F.col(value).alias("found"))
    j = gold.select(group, F.col(value).alias("wanted")).join(have, group, "left")
    return j.select(group, "wanted", "found", F.when(F.col("found").isNull() & F.col("wanted").isNotNull(), "missing").when(F.col("wanted").eqNullSafe(F.col("found")), "ok").otherwise("drifted").alias("status"))


def citable_columns(df: DataFrame) -> DataFrame:
    """(column, citable): string columns with at least one value and only citable ids, in one pass."""
    names = [c for c, t in df.dtypes if t == "string"]
    ok = lambda c: F.coalesce(F.bool_and(F.when(F.col(c).isNotNull(), F.coalesce(T.kind_of(F.col(c)).isin(*T.CITABLE), F.lit(False)))), F.lit(False))
    return df.agg(*(ok(c).alias(c) for c in names)).unpivot([], names, "column", "citable")


def anomalies(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(anomaly, n): how many rows each named condition holds for, in one pass."""
    return df.agg(*(F.count_if(c).alias(k) for k, c in checks.items())).unpivot([], list(checks), "anomaly", "n")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def catalogue(df: DataFrame, table: str, references: dict[str, tuple[str, str]]) -> DataFrame:
    """(tbl, column, type, refers_to, label, n_values, n_nulls) for each column. references: `table.column` -> (`table.key`, label)."""
    counted = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns), F.count("*").alias("_rows"))
    known = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), *(F.lit(x).cast("string").alias(a) for x, a in zip(references.get(f"{table}.{f.name}", (None, None)), ("refers_to", "label"), strict=True)), F.col(f"`{f.name}`").alias("n_values"), (F.col("_rows") - F.col(f"`{f.name}`")).alias("n_nulls")) for f in df.schema]
    return counted.select(F.lit(table).alias("tbl"), F.inline(F.array(*known)))
