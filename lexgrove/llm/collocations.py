"""Phrase collocation mining: best-first branch-and-bound growth over prefix counts.

Texts are cut into words once and kept as arrays of 64-bit word hashes, in which 0 parts the
pieces. A phrase's score can't pass 1000 n / f(first word), as the cut behind its first word has
a / r <= 1; so first words are expanded in waves from the highest bound down (rare words first), and
a wave's phrases grow word by word from the prefixes that are frequent enough. Of the phrases
found, those with the highest bound (their last cut's score) are settled first: all their parts are
counted exactly, and so is what stands before them. The `top`-th surviving score so far prunes
phrases and first words whose bound is lower; ties aren't pruned. When nothing is left whose bound
reaches it, the answer is settled.

A phrase lies inside a longer candidate of the same count exactly if it lies inside one that is
one word longer, so a survivor needs its one-word extensions only: to the right they are its own
children, to the left they are counted when it is settled.

Tasks know the frontier by a bit filter of fixed size: a phrase that passes by chance is counted
in vain and dropped by the exact join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.llm.common import cut, fitted, written

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
WAVE = 8  # first words of one wave differ by this factor in count at most
SETTLED = 4  # times `top` phrases of a language that are settled at once
FILTER_BITS = 26
SLICE = 1 << 20  # words that are looked at together
ROWS = 100_000  # phrases of one partition

_MARK = b"."
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz.........")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pieces(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z alone), with a full stop, which no word has, wherever pieces part."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).replace(_MARK, b" . ").split()


def _encode(batches: Iterator[pa.RecordBatch], tail: bytes) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: a text's word hashes, and how often a batch has a word (n is not null)."""
    names = ["lang", "ids", "word", "n"]
    for b in batches:
        known, counts = {_MARK: 0}, {}
        for part in (b.slice(i, 1024) for i in range(0, b.num_rows, 1024)):  # bounds the words that are objects at once
            langs, texts = part["lang"].to_pylist(), [pieces(t) for t in part["text"].to_pylist()]
            known |= {w: xxhash.xxh64_intdigest(w + tail, 42) | 1 for w in set().union(*texts).difference(known)}  # Spark's xxhash64
            rows = []
            for lang, ws in zip(langs, texts, strict=True):
                counts.setdefault(lang, Counter()).update(ws)
                rows.append(np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary()), *(pa.nulls(len(rows), t) for t in (pa.binary(), pa.int64()))], names=names)
        for lang, of in counts.items():
            of.pop(_MARK, None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(of), pa.string()), pa.nulls(len(of), pa.binary()), pa.array(list(of), pa.binary()), pa.array(list(of.values()), pa.int64())], names=names)


def _few(df: DataFrame) -> DataFrame:
    """The frame cut, in as many partitions as its rows need."""
    return fitted(df, ROWS)


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang, 7))


def _grow(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases and of the same phrases with a word more."""
    x = (h ^ words) * _MIX
    return x ^ (x >> np.uint64(31))


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(59 - len(bits).bit_length())
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _filter(phrases: DataFrame) -> Broadcast:
    """A filter with the bits of the phrases (lang, p) set: some 64 bits a phrase, but 2^FILTER_BITS in all at most. The driver gets its words of 64 bits, each once."""
    log2 = min(FILTER_BITS, max(12, phrases.count().bit_length() + 6))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seeds = {x: _seed(x) for x in b["lang"].unique().to_pylist()}
            h = np.array([seeds[x] for x in b["lang"].to_pylist()], np.uint64)
            size, flat = b["p"].value_lengths().to_numpy(), b["p"].flatten().to_numpy().view(np.uint64)
            start = np.cumsum(size) - size
            for j in range(size.max(initial=0)):
                own = np.flatnonzero(size > j)
                h[own] = _grow(h[own], flat[start[own] + j])
            at = h >> np.uint64(64 - log2)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["at", "bits"])

    words = phrases.select("lang", "p").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    own = np.zeros(1 << log2 - 6, np.uint64)
    own[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return phrases.sparkSession.sparkContext.broadcast(own)


def _streams(b: pa.RecordBatch, step: int) -> Iterator[tuple[str, np.ndarray]]:
    """(lang, word hashes) of some `step` words of a batch, texts parted by 0."""
    texts: dict[str, list[np.ndarray]] = {}
    sizes: Counter = Counter()
    for lang, ids in zip(b["lang"].to_pylist(), b["ids"], strict=True):
        own = np.frombuffer(ids.as_buffer(), np.uint64)
        texts.setdefault(lang, []).extend((own, np.zeros(1, np.uint64)))
        sizes[lang] += len(own)
        if sizes[lang] >= step:
            yield lang, np.concatenate(texts.pop(lang))
            sizes[lang] = 0
    for lang, own in texts.items():
        yield lang, np.concatenate(own)


def _counted(ids: np.ndarray, at: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases of k words among those that begin at `at`, and how often each occurs; h only makes sorting quick."""
    words = np.stack([ids[at + j] for j in range(k)], axis=1)
    _, first, same, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    if (words != words[first][same]).any():  # two phrases of one hash
        own, n = np.unique(words, axis=0, return_counts=True)
        return own, n
    return words[first], n


def _rows(lang: str, words: np.ndarray, n: np.ndarray, kind: int) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, words.shape[1], dtype=np.int32)), pa.array(words.ravel().view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), lists, pa.array(n.astype(np.int64)), pa.array(np.full(len(n), kind, np.int32))], names=["lang", "p", "n", "kind"])


def _occurrences(texts: DataFrame, wanted: Callable[[list[np.ndarray]], Iterator[tuple[int, int, np.ndarray]]], longest: int) -> DataFrame:
    """(lang, p, kind, n): counts of the phrases that `wanted` names by kind, length and a mask over places."""

    step = SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, ids in _streams(b, step):
                padded = np.append(ids, np.zeros(2 * longest, np.uint64))
                for start in range(0, len(ids), step):
                    own = padded[start : start + step + 2 * longest]
                    m = len(own) - longest  # places; those of the next slice only serve to look on
                    h, whole = [np.full(m, _seed(lang))], [np.ones(m, bool)]
                    for j in range(longest):
                        h.append(_grow(h[-1], own[j : j + m]))
                        whole.append(whole[-1] & (own[j : j + m] != 0))
                    for kind, k, mask in wanted(h):
                        at = np.flatnonzero((mask & whole[k])[:step])
                        if len(at):
                            yield _rows(lang, *_counted(own, at, h[k][at], k), kind)

    return texts.select("lang", "ids").mapInArrow(run, "lang string, p array<long>, n long, kind int").groupBy("lang", "p", "kind").agg(F.sum("n").alias("n"))


def _level(texts: DataFrame, k: int, nodes: DataFrame, prefixes: Broadcast, words: Broadcast, least: int) -> DataFrame:
    """(lang, p, a): phrases of k words that begin with a prefix of the frontier and end with a frequent word."""

    def wanted(h: list[np.ndarray]):
        last = np.append(_has(words.value, h[1])[k - 1 :], np.zeros(k - 1, bool))
        yield 0, k, _has(prefixes.value, h[k - 1]) & last

    found = _occurrences(texts, wanted, k).where(F.col("n") >= least).select("lang", "p", F.col("n").alias("a"), F.slice("p", 1, k - 1).alias("prefix"))
    return found.join(nodes.select("lang", F.col("p").alias("prefix")), ["lang", "prefix"], "left_semi").drop("prefix")


def _asked(texts: DataFrame, parts: Broadcast, followed: Broadcast, words: Broadcast, longest: int) -> DataFrame:
    """(lang, p, kind, n): kind 0 the phrases of `parts`; kind 1 those of `followed` with a frequent word before them."""

    def wanted(h: list[np.ndarray]):
        first = _has(words.value, h[1])
        for k in range(2, longest):
            yield 0, k, _has(parts.value, h[k])
        for k in range(2, longest):
            yield 1, k + 1, first & np.append(_has(followed.value, h[k])[1:], False)

    return _occurrences(texts, wanted, longest)


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)), in 38 digits."""
    big = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * big(a).cast("decimal(16,0)") * big(n).cast("decimal(18,0)"), big(left) * big(right))


def _settled(pick: DataFrame, texts: DataFrame, words: DataFrame, frequent: Broadcast, found: DataFrame, longest: int) -> DataFrame:
    """(lang, p, a, n_lang, l, r, score, survives) for picked phrases (lang, p, a, n_lang, right); right: the count of the most frequent child."""
    k = F.size("p")
    cuts = pick.select("lang", "p", "a", "n_lang", F.explode(F.sequence(F.lit(1), k - 1)).alias("at"))
    cuts = cuts.select("*", F.slice("p", 1, F.col("at")).alias("one"), F.slice("p", F.col("at") + 1, k).alias("two"))
    parts = cuts.select("lang", F.col("two").alias("p")).where(F.size("p") > 1).distinct()
    open_ = pick.where((k < longest) & ((F.col("right") != F.col("a")) | F.col("right").isNull())).select("lang", "p")
    filters = _filter(parts), _filter(open_)
    seen = _few(_asked(texts, *filters, frequent, longest))
    for x in filters:
        x.destroy()
    single = words.select("lang", F.array("h").alias("p"), F.col("f").alias("c"))
    counts = single.unionByName(seen.where("kind = 0").select("lang", "p", F.col("n").alias("c")))
    prefixes = single.unionByName(found.select("lang", "p", F.col("a").alias("c")))
    l_, r_ = prefixes.select("lang", F.col("p").alias("one"), F.col("c").alias("l")), counts.select("lang", F.col("p").alias("two"), F.col("c").alias("r"))
    scored = cuts.join(l_, ["lang", "one"]).join(r_, ["lang", "two"]).withColumn("score", _score(F.col("a"), F.col("n_lang"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "p").agg(F.min(F.struct("score", "at", "l", "r")).alias("low"))
    left = seen.where("kind = 1").groupBy("lang", F.slice("p", 2, longest).alias("p")).agg(F.max("n").alias("left"))
    out = pick.join(lowest, ["lang", "p"]).join(left, ["lang", "p"], "left")
    inside = F.coalesce(F.col("right") == F.col("a"), F.lit(False)) | F.coalesce(F.col("left") == F.col("a"), F.lit(False))
    return _few(out.select("lang", "p", "a", "n_lang", "low.l", "low.r", "low.score", (~inside).alias("survives")))


def _threshold(done: DataFrame, top: int) -> DataFrame:
    """(lang, tau): the top-th surviving score of each language that has so many."""
    w = Window.partitionBy("lang").orderBy(F.col("score").desc(), "p")
    return _few(done.where("survives").select("lang", "score", F.row_number().over(w).alias("k")).where(F.col("k") == top).select("lang", F.col("score").alias("tau")))


def _text(rows: DataFrame, said: DataFrame) -> DataFrame:
    """rows (lang, p, ...) with `phrase`; said: (lang, h, word), a word once or more."""
    each = _few(rows.select("lang", "p", F.posexplode("p").alias("i", "h")))
    words = said.join(each.select("lang", "h").distinct(), ["lang", "h"]).groupBy("lang", "h").agg(F.first("word").alias("word"))
    named = each.join(words, ["lang", "h"]).groupBy("lang", "p").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("ws"))
    return rows.join(named.select("lang", "p", F.array_join(F.transform("ws", lambda x: x["word"].cast("string")), " ").alias("phrase")), ["lang", "p"])


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = MIN_COUNT, longest: int = MAX_WORDS, top: int = TOP, wave: int = WAVE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to `longest` words by score, a (both descending) and phrase.

    Words are `[^ \\t]+` in pieces parted by `.,;:!?` and line ends, A-Z lower-cased. n counts a
    language's words, a the phrase's occurrences (`least` at least, overlaps included), l and r those
    of its parts at the cut of the lowest score floor(1000 a n / (l r)), the first such cut. Phrases
    inside a longer one of the same count are left out. Null language is `und`, null text empty;
    repeated rows count as often as they occur; other columns play no part; no documents, or
    none frequent enough, give no rows.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more and occur once or more")
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    for tail in (b"\0" * k for k in range(8)):
        both, forget = written(rows.mapInArrow(lambda it, t=tail: _encode(it, t), "lang string, ids binary, word binary, n long"))
        texts, said = both.where("ids IS NOT NULL").select("lang", "ids"), both.where("n IS NOT NULL")
        said = said.select("lang", F.xxhash64(F.concat("word", F.lit(tail))).bitwiseOR(F.lit(1)).alias("h"), "word", "n")
        unit = cut(said.groupBy("lang", "h").agg(F.sum("n").alias("f"), F.min(F.xxhash64(F.lit(7), "word")).alias("low"), F.max(F.xxhash64(F.lit(7), "word")).alias("high")))
        if unit.where("low <> high").isEmpty():
            break
        forget()
    else:
        raise RuntimeError("different words of one hash, whatever is put behind them")
    sizes = _few(unit.groupBy("lang").agg(F.sum("f").alias("n_lang")))
    words = _few(unit.where(F.col("f") >= least).join(sizes, "lang").select("lang", "h", "f", "n_lang"))
    frequent = _filter(words.select("lang", F.array("h").alias("p")))
    bound = F.expr("(cast(1000 as decimal(4,0)) * cast(n_lang as decimal(18,0))) div cast(f as decimal(18,0))")
    most = words.agg(F.max("f")).first()[0] or 0
    done = found = tau = None
    for i in range(1 + (int(math.log(most / least, wave)) + 1 if most else -1)):
        first = words.where((F.col("f") >= least * wave**i) & (F.col("f") < least * wave ** (i + 1)))
        if tau is not None:
            first = first.join(tau, "lang", "left").where(bound >= F.coalesce("tau", F.lit(0)))
        nodes = _few(first.select("lang", F.array("h").alias("p")))
        if nodes.isEmpty():
            continue
        levels = []
        for k in range(2, longest + 1):
            prefixes = _filter(nodes)
            nodes = _few(_level(texts, k, nodes, prefixes, frequent, least))
            prefixes.destroy()
            if nodes.isEmpty():
                break
            levels.append(nodes)
        if not levels:
            continue
        new = levels[0]
        for x in levels[1:]:
            new = new.unionByName(x)
        found = new if found is None else found.unionByName(new)
        children = new.where(F.size("p") > 2).groupBy("lang", F.slice("p", 1, F.size("p") - 1).alias("p")).agg(F.max("a").alias("right"))
        prefix = words.select("lang", F.array("h").alias("one"), F.col("f").alias("l")).unionByName(new.select("lang", F.col("p").alias("one"), F.col("a").alias("l")))
        ends = words.select("lang", F.col("h").alias("end"), F.col("f").alias("r"), "n_lang")
        open_ = new.join(children, ["lang", "p"], "left").where("right IS NULL OR right < a")
        open_ = open_.withColumns({"one": F.slice("p", 1, F.size("p") - 1), "end": F.element_at("p", -1)}).join(prefix, ["lang", "one"]).join(ends, ["lang", "end"])
        pending = _few(open_.select("lang", "p", "a", "right", "n_lang", _score(F.col("a"), F.col("n_lang"), F.col("l"), F.col("r")).alias("bound")))
        while True:
            if tau is not None:
                pending = pending.join(tau, "lang", "left").where(F.col("bound") >= F.coalesce("tau", F.lit(0))).drop("tau")
            order = Window.partitionBy("lang").orderBy(F.col("bound").desc(), "p")
            pick = _few(pending.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SETTLED * top).drop("k"))
            if pick.isEmpty():
                break
            now = _settled(pick.drop("bound"), texts, words, frequent, found, longest)
            done = now if done is None else done.unionByName(now)
            tau = _threshold(done, top)
            pending = _few(pending.join(pick.select("lang", "p"), ["lang", "p"], "left_anti"))
    frequent.destroy()
    if done is None:
        forget()
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    kept = done.where("survives").join(tau, "lang", "left").where(F.col("score") >= F.coalesce("tau", F.lit(0)))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = _text(_few(kept), said.select("lang", "h", "word")).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    out = cut(ranked.select("lang", "rank", "phrase", "a", "l", "r", F.col("n_lang").alias("n"), "score"))
    forget()
    return out
