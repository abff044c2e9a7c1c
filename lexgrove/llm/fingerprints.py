"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits.

All of a sketch is array expressions within a row: a word shingle's hash is taken
once, its top bits name its bin, and sorting the hashes brings each bin's minimum to the front
of its bin. One ceiling value a bin is sorted along, so that the first of each bin gives exactly
`BINS` values and a bin that has only its ceiling is seen to be empty. An empty bin then copies
the bin that its own sequence of random probes meets first (optimal densification): a table of
drawn probes, then all bins in an order drawn by a hash of both bins, so that probing ends only
where it meets a filled bin.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.llm.common import cut

BIN_BITS = 7
BINS = 1 << BIN_BITS
BITS = 8  # low-order bits kept of each bin
WIDTH = 5
PROBES = 24
ROWS_PER_RANGE = 100_000  # ids, of 24 bytes each, that are put in order together


def _probes() -> list[list[int]]:
    """Probe k of bin i, from a fixed seed; no bin probes itself."""
    draw = random.Random(42)
    return [[(i + draw.randrange(1, BINS)) % BINS for i in range(BINS)] for _ in range(PROBES)]


def _array(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})")


def with_signature(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df with `name`: BINS low-order bytes of the text's sketch; null if the text has no word.

    Words are what stands between ASCII white space, in lower case; a text of fewer than WIDTH
    words is one shingle.
    """
    kept = [F.col(f"`{c}`") for c in df.columns]
    hashes = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    words = df.select(*kept, hashes.alias("_words"))
    n = F.size("_words")

    def shingle(x: Column, i: Column) -> Column:
        return F.xxhash64(x, *(F.get(F.col("_words"), i + k) for k in range(1, WIDTH)))

    many = F.transform(F.slice("_words", 1, F.greatest(n - (WIDTH - 1), F.lit(0))), shingle)
    ceiling = F.lit((1 << (64 - BIN_BITS)) - 1)
    ceilings = _array([((i - BINS // 2 + 1) << (64 - BIN_BITS)) - 1 for i in range(BINS)])
    ordered = words.select(*kept, n.alias("_n"), F.sort_array(F.concat(F.when(n >= WIDTH, many).otherwise(F.array(F.xxhash64("_words"))), ceilings)).alias("_sorted"))
    bin_of = lambda x: F.shiftright(x, 64 - BIN_BITS)
    firsts = ordered.select(*kept, "_n", F.filter("_sorted", lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col("_sorted"), i - 1)))).alias("_firsts"))
    filled = firsts.select(*kept, "_n", F.transform("_firsts", lambda x: F.when(x.bitwiseAND(ceiling) != ceiling, x)).alias("_bins"))

    def dense(x: Column, i: Column) -> Column:
        tries = [F.get(F.col("_bins"), F.get(_array(p), i)) for p in _probes()]
        order = F.transform("_bins", lambda v, j: F.struct(F.xxhash64(i, j).alias("h"), v.alias("v")))
        return F.coalesce(x, *tries, F.array_min(F.filter(order, lambda p: p["v"].isNotNull()))["v"])

    low = filled.select(*kept, "_n", F.transform("_bins", dense).alias("_dense"))
    packed = F.transform("_dense", lambda x, i: F.xxhash64(x, i).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
    return low.select(*kept, F.when(F.col("_n") > 0, packed).alias(name))


def packed(signature: Column) -> Column:
    """The signature as lower-case hex, two digits a bin; zeros if the text has no word."""
    digits = F.expr(f"array({', '.join(repr(f'{b:02x}') for b in range(1 << BITS))})")
    return F.coalesce(F.array_join(F.transform(signature, lambda b: F.get(digits, b)), ""), F.lit("00" * BINS))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two signatures, 0 to 1.

    The share of equal bins less what low-order bits of unequal minima have in common by chance.
    Two texts without words are alike, one without and one with words are not.
    """
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (equal - chance) / (1 - chance)))


def _with_next(rows: DataFrame, key: list[Column]) -> DataFrame:
    """Distinct rows (id, th) with next_id, next_th: those of the row after it in the order of the key; after the last comes the first.

    Rows are dealt out in ranges of the key. A range's last row gets the first of the next range,
    which a window over one row for each range gives.
    """
    parts = max(1, -(-rows.count() // ROWS_PER_RANGE))
    dealt = cut(rows.repartitionByRange(parts, *key).withColumn("_part", F.spark_partition_id()))
    w, at = Window.partitionBy("_part").orderBy(*key), F.struct("id", "th")
    placed = dealt.select("*", F.lead(at).over(w).alias("_next"), F.row_number().over(w).alias("_n"))
    ranges = Window.orderBy("_part")
    heads = placed.where("_n = 1").select("_part", at.alias("_head"))
    heads = heads.select("_part", F.coalesce(F.lead("_head").over(ranges), F.first("_head").over(ranges)).alias("_following"))  # a row for each range
    last = placed.where("_next IS NULL").join(heads, "_part").withColumn("_next", F.col("_following"))
    return placed.where("_next IS NOT NULL").unionByName(last.drop("_following")).select(*rows.columns, F.col("_next.id").alias("next_id"), F.col("_next.th").alias("next_th"))


def fingerprints_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id) for each row of docs.

    The edited text has its last third replaced by as many characters from the start of the next
    document by descending id. Ids are integers, of any size. Null text is empty; a single
    document is its own next; rows that repeat an id are ordered by a hash of their text, and
    one that repeats id and text has its twin as next, but for the last of them; null ids come
    last; other columns play no part; no documents give no rows.

    Rows are known by id and text hash. Only ids are put in order; a text is shuffled once, and
    the third of it that another row needs once more.
    """
    id_ = F.col(f"`{id_col}`").cast("long")
    own = docs.select(id_.alias("own_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"))
    own = own.select("own_id", F.coalesce("own_id", F.lit(0)).alias("id"), F.xxhash64("body", F.col("own_id").isNull()).alias("th"), "body")
    ids = own.groupBy("id", "th").agg(F.first("own_id").alias("own_id"), F.max(F.floor(F.length("body") / 3)).cast("int").alias("third"), F.count("*").alias("copies"))
    order = _with_next(ids, [F.col("own_id").desc_nulls_last(), F.col("th")]).drop("own_id")
    texts = with_signature(own, F.col("body"), "sig").groupBy("id", "th").agg(F.first("own_id").alias("own_id"), F.first("body").alias("body"), F.first("sig").alias("sig"))
    asked = order.select(F.col("next_id").alias("id"), F.col("next_th").alias("th"), F.col("id").alias("for_id"), F.col("th").alias("for_th"), "third", "copies")
    # both joins need every column of texts, so they share its one shuffle
    given = texts.join(asked, ["id", "th"]).select(F.col("for_id").alias("id"), F.col("for_th").alias("th"), F.substring(F.col("body"), F.lit(1), F.col("third")).alias("tail"), F.col("sig").alias("next_sig"), F.col("own_id").alias("next_doc"), "third", "copies")
    both = texts.join(given, ["id", "th"])
    # of equal rows all but one have a twin as next
    twin = F.when(F.col("copies") > 1, F.struct((F.col("copies") - 1).alias("times"), F.substring(F.col("body"), F.lit(1), F.col("third")).alias("tail"), F.col("sig").alias("next_sig"), F.col("own_id").alias("next_doc")))
    kinds = F.filter(F.array(F.struct(F.lit(1).cast("long").alias("times"), "tail", "next_sig", "next_doc"), twin), lambda x: x.isNotNull())
    rows = both.select("own_id", "body", "sig", "third", F.explode(kinds).alias("k"))
    n = F.length("body")
    edited = F.concat(F.substring(F.col("body"), F.lit(1), n - F.col("third")), F.col("k.tail"))
    out = with_signature(rows.select("own_id", n.cast("long").alias("n_chars"), "sig", F.col("k.next_sig").alias("next_sig"), F.col("k.next_doc").alias("next_doc"), F.col("k.times").alias("times"), edited.alias("edited")), F.col("edited"), "edited_sig")
    out = out.select(F.col("own_id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("sig")).alias("fingerprint"), packed(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"), F.col("next_doc").alias(f"next_{id_col}"), "times")
    return out.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).drop("times")
