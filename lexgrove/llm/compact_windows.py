"""Substring dedup by compact windows.

A text's tokens are its five-word shingles. For each of HASHES hash functions the Cartesian tree
over the tokens' hashes gives the compact windows (l, c, r): every passage that starts in [l, c]
and ends in [c, r] has its minimum at c, so a window stands for all of them, and two passages of
at least MIN_WORDS words that are alike share the minimum of most functions. Windows with one
signature meet in one group. A group may be large and most of its members foreign to each other,
as when a common sentence stands in many texts, so members aren't paired with one leader. Hashes
of runs of growing length before and after c make the group two trees of ever closer relatives,
one by what follows c first and one by what comes before it; each member is paired with the first
document of the closest relatives it has in each. So a passage in thousands of documents gives
thousands of pairs and not their square, and one shared by two documents behind a common sentence
is not hidden by the others that have the sentence.
Rows of one text are one node from the start, so a group of copies has one set of windows; each
copy is a member beside the smallest id of its text.
An interval join chains the pairs of two documents that lie on one diagonal; chains that enough
shared signatures support are verified on the tokens, and the stretches of similarity 0.8 or
more stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import attach, components, cut, written

WIDTH = 5
MIN_WORDS = 50
HASHES = 4
SUPPORT = 2
SIMILARITY = 0.8
SLACK = 16  # tokens by which a diagonal may drift between neighbours of a chain
CACHE = 400_000
SAMPLE = 32  # one document in so many is looked at to find crowded keys
CROWD = 64  # windows of the sample from which on a key is dealt out by document
MOST_CROWDED = 20_000  # keys that are dealt out, the most crowded first: each of the others has less than 1 in 20,000 of all windows
SALTS = 32
LEVELS = 8  # runs on each side of c by which neighbours are found
STEP = 5  # tokens by which each is longer than the one before
PIECE = 1 << 22  # tokens of a text that are looked at together
_POS = 24
_ODD = 0x9E3779B1 | 1
_INVERSE = pow(_ODD, -1, 1 << _POS)
_BASE = 0x9DDFEA08EB382D69
_UNBASE = pow(_BASE, -1, 1 << 64)
_words: dict[str, int] = {}


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def tokens(text: str) -> np.ndarray:
    """A 64-bit hash of each WIDTH-word shingle, in order; words are in lower case, between white space."""
    words = text.lower().split()
    n = len(words) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if len(_words) > CACHE:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    ids = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    out = ids[:n].copy()
    for k in range(1, WIDTH):
        out = out * np.uint64(0x9DDFEA08EB382D69) + ids[k : k + n]
    return _mix(out, 1)


def _contexts(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two numbers for each token, a byte for each of LEVELS runs that end there and that start there, the shortest first, and where each piece starts in them.

    Sorted by such a number, places that share a longer run come closer. Beyond a piece's edges
    there are zeros. A run's hash is a difference of sums of tokens times rising powers.
    """
    gap = np.zeros(LEVELS * STEP, np.uint64)
    values = np.concatenate([x for p in pieces for x in (gap, p)] + [gap])
    starts = np.cumsum([len(gap) + len(p) for p in pieces]) - [len(p) for p in pieces]
    up, down = (np.cumprod(np.full(len(values), x, np.uint64)) for x in (_BASE, _UNBASE))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up)))
    before, after = np.zeros(len(values), np.uint64), np.zeros(len(values), np.uint64)
    for k in range(1, LEVELS + 1):
        size, shift = k * STEP + 1, np.uint64(8 * (LEVELS - k))
        run = ((sums[size:] - sums[:-size]) * down[: len(values) - size + 1] >> np.uint64(56)) << shift
        before[size - 1 :] |= run
        after[: len(values) - size + 1] |= run
    return before.view(np.int64), after.view(np.int64), starts


def _levels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many runs two contexts share."""
    x = (a ^ b).view(np.uint64)
    return sum((x < np.uint64(1 << 8 * k)).astype(np.int8) for k in range(1, LEVELS)) + (x == 0).astype(np.int8)


def windows(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the compact windows of at least `least` tokens of the segments [start, end) of values, level by level of their Cartesian trees.

    Ties go to a scattered place, so runs of equal tokens make no deep trees.
    """
    mask = np.uint64((1 << _POS) - 1)
    place = np.arange(len(values), dtype=np.uint64) * np.uint64(_ODD) & mask
    packed = (values & ~mask) | place
    out = []
    keep = ends - starts >= least
    starts, ends = starts[keep], ends[keep]
    while len(starts):
        order = np.argsort(starts)
        starts, ends = starts[order], ends[order]
        edges = np.empty(2 * len(starts), np.int64)
        edges[0::2], edges[1::2] = starts, ends
        if edges[-1] == len(packed):
            edges = edges[:-1]
        low = np.minimum.reduceat(packed, edges)[0::2]
        c = (((low & mask) * np.uint64(_INVERSE)) & mask).astype(np.int64)
        out.append((starts, c, ends - 1))
        s, e = np.concatenate((starts, c + 1)), np.concatenate((c, ends))
        keep = e - s >= least
        starts, ends = s[keep], e[keep]
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_ROW = ["key", "salt", "doc", "variant", "c", "before", "after"]
_WINDOW = "key long, salt byte, doc long, variant short, c int, before long, after long"


def _windows(batches: Iterator[pa.RecordBatch], least: int, crowded: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(doc, variant, text) -> _WINDOW of all windows; the key holds the function and the token at c, the salt is -1 but for crowded keys.

    A text of over PIECE tokens is looked at in pieces that overlap by a passage of `least`
    tokens, so no such passage is cut.
    """
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            pieces = [(i, base, own[base : base + PIECE + least - 1]) for i, own in enumerate(map(tokens, b.column(2).to_pylist())) for base in range(0, max(len(own) - least + 1, 0), PIECE)]
            lengths = np.fromiter((len(p) for _, _, p in pieces), np.int64, len(pieces))
            group = np.cumsum(lengths) >> (_POS - 1)  # places have _POS bits
            for g in np.unique(group):
                own = [p for p, h in zip(pieces, group, strict=True) if h == g]
                values = np.concatenate([p for _, _, p in own])
                ends = np.cumsum([len(p) for _, _, p in own])
                starts = ends - [len(p) for _, _, p in own]
                rows, bases = np.array([i for i, _, _ in own]), np.array([base for _, base, _ in own])
                before, after, base_ = _contexts([p for _, _, p in own])
                for k in range(HASHES):
                    _, c, _ = windows(_mix(values, k + 2), starts, ends, least)
                    d = np.searchsorted(ends, c, side="right")
                    key = (_mix(values[c], 100) & ~np.uint64(7)) | np.uint64(k)
                    doc, variant = (b.column(x).to_numpy()[rows[d]] for x in (0, 1))
                    salt = np.full(len(key), -1, np.int8)
                    if crowded is not None and len(crowded):
                        found = crowded[np.minimum(np.searchsorted(crowded, key.view(np.int64)), len(crowded) - 1)] == key.view(np.int64)
                        salt[found] = _mix(doc[found].astype(np.int64).view(np.uint64), 7) % np.uint64(SALTS)
                    place = c - starts[d]
                    around = base_[d] + place
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), salt, doc, variant, (place + bases[d]).astype(np.int32), before[around], after[around])], names=_ROW)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, salt, doc) -> those whose key another document has too; salted ones, which are many, all stay."""
    held = None  # the last group, while only one document of it has been seen
    last = None  # key and salt of a group that goes on and stays
    for b in batches:
        rows = [b[x].to_numpy() for x in _ROW]
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        key, salt, doc = rows[:3]
        new = np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        many = (np.bincount(group, doc != doc[first][group]) > 0) | (salt[first] >= 0)
        many[0] |= (key[0], salt[0]) == last
        end = len(key) if many[-1] else int(first[-1])
        held = None if many[-1] else [x[end:] for x in rows]
        last = (key[-1], salt[-1]) if many[-1] else None
        pick = np.flatnonzero(many[group[:end]])
        yield pa.RecordBatch.from_arrays([pa.array(x[pick]) for x in rows], names=_ROW)


def _crowded(own: DataFrame, least: int) -> np.ndarray:
    """Keys that a sample of the documents shows to be crowded, sorted. They only decide how rows are dealt out, not which take part."""
    some = own.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0).mapInArrow(lambda it: _windows(it, least), _WINDOW)
    many = some.groupBy("key").count().where(F.col("count") >= CROWD).orderBy(F.col("count").desc(), "key").limit(MOST_CROWDED)
    return np.array(sorted(r["key"] for r in many.collect()), np.int64)


def _contested(own: DataFrame, least: int) -> DataFrame:
    """_WINDOW of the windows whose key several documents have."""
    shared = own.sparkSession.sparkContext.broadcast(_crowded(own, least))  # at most MOST_CROWDED numbers
    found = own.mapInArrow(lambda it: _windows(it, least, shared.value), _WINDOW)
    return found.repartition("key", "salt").sortWithinPartitions("key", "salt", "doc").mapInArrow(_shared, _WINDOW)


_EDGE = ["key", "doc", "variant", "c", "before", "after"]
_RELATED = "kind byte, part int, n int, key long, doc long, variant short, c int, before long, after long, lead_doc long, lead_variant short, lead_c int, levels byte"


def _related(batches: Iterator[pa.RecordBatch], order: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and the contexts in that order -> kind 0: a row with the first document of its closest relatives that is another.

    Relatives share the key and a number of runs of the first context, then of the second. What
    links relatives over the edge of two partitions comes as kind 1, the first row of a
    partition, and kind 2, its last row after the first documents of that row's relatives.
    """
    part, held = TaskContext.get().partitionId(), None
    types = {f.split()[0]: {"byte": pa.int8(), "short": pa.int16(), "int": pa.int32(), "long": pa.int64()}[f.split()[1]] for f in _RELATED.split(", ")}

    def out(kind: int, rows: list[np.ndarray], lead: list[np.ndarray] | None = None, levels: np.ndarray | None = None) -> pa.RecordBatch:
        n = len(rows[0])
        none = np.zeros(n, np.int8)
        cols = [np.full(n, kind), np.full(n, part), np.arange(n), *rows, *(lead or [none] * 3), none if levels is None else levels]
        return pa.RecordBatch.from_arrays([pa.array(v.astype(t.to_pandas_dtype())) for v, t in zip(cols, types.values(), strict=True)], names=list(types))

    for b in batches:
        if not b.num_rows:
            continue
        rows = [b[c].to_numpy() for c in _EDGE]
        if held is None:
            yield out(1, [v[:1] for v in rows])
        else:
            rows = [np.append(p, q) for p, q in zip(held, rows, strict=True)]
        key, doc, variant, c = rows[:4]
        one, two = (rows[_EDGE.index(x)] for x in order)
        first = _levels(one[1:], one[:-1])
        shared = np.append(-1, np.where(key[1:] != key[:-1], -1, first + np.where(first == LEVELS, _levels(two[1:], two[:-1]), 0)))
        by = np.lexsort((c, variant, doc))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        whom, path = np.full(len(key), -1), [len(key) - 1]
        for level in range(2 * LEVELS, -1, -1):
            new = shared < level
            new[0] = True
            lead = by[np.minimum.reduceat(rank, np.flatnonzero(new))][np.cumsum(new) - 1]
            whom = np.where((whom < 0) & (doc[lead] != doc), lead, whom)
            if lead[-1] != path[0]:
                path.insert(0, int(lead[-1]))
        have = np.flatnonzero(whom >= 0)
        x, y = [v[have] for v in rows], [v[whom[have]] for v in rows]
        levels = _levels(x[4], y[4]) + _levels(x[5], y[5])
        near = levels > 0
        yield out(0, [v[near] for v in x], [v[near] for v in y[1:4]], levels[near])
        held = [v[path] for v in rows]
    if held is not None:
        yield out(2, held)


def _relatives(rows: DataFrame, order: tuple[str, str]) -> DataFrame:
    """_RELATED pairs by contexts in that order; ranges of the order are dealt out, so a crowded key spans tasks."""
    by = ("key", *order, "doc", "variant", "c")
    step = lambda it: _related(it, order)
    found = rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(step, _RELATED)
    edges = found.where("kind > 0").repartition(1).sortWithinPartitions("part", "kind", "n").mapInArrow(step, _RELATED)  # some 20 rows a partition
    return found.where("kind = 0").unionByName(edges.where("kind = 0"))


def _pairs(own: DataFrame, least: int) -> DataFrame:
    """(doc, variant, c, lead_doc, lead_variant, lead_c, hash, levels): windows of one key that are related by what stands before or after c."""
    rows = cut(_contested(own, least).select(*_EDGE))
    both = _relatives(rows, ("before", "after")).unionByName(_relatives(rows, ("after", "before")))
    return both.select("doc", "variant", "c", "lead_doc", "lead_variant", "lead_c", F.expr("cast(key & 7 as tinyint)").alias("hash"), "levels")


_CHAIN = ("doc", "variant", "lead_doc", "lead_variant", "c0", "c1", "lead0", "lead1")


def _chained(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by both documents and c -> _CHAIN of chains that SUPPORT signatures back: shared minima of functions, and a context shared for two runs.

    A pair joins a chain of its documents if it is at most two passages further on and its
    diagonal is within SLACK of the chain's last; a chain closes once the scan is past it.
    """
    out: list[tuple] = []
    pair, chains = None, []

    def close(chain: list) -> None:
        if len(chain[5]) >= SUPPORT:
            out.append((*pair, *chain[:4]))

    for b in batches:
        for doc, variant, c, lead, lead_variant, lead_c, k, levels in zip(*(b[x].to_pylist() for x in ("doc", "variant", "c", "lead_doc", "lead_variant", "lead_c", "hash", "levels")), strict=True):
            if pair != (doc, variant, lead, lead_variant):
                for x in chains:
                    close(x)
                pair, chains = (doc, variant, lead, lead_variant), []
            for x in [x for x in chains if c - x[1] > 2 * least]:
                chains.remove(x)
                close(x)
            diagonal = c - lead_c
            for x in chains:
                if abs(diagonal - x[4]) <= SLACK:
                    x[1], x[2], x[3], x[4] = c, min(x[2], lead_c), max(x[3], lead_c), diagonal
                    break
            else:
                x = [c, c, lead_c, lead_c, diagonal, set()]
                chains.append(x)
            x[5].update((k, -1) if levels > 1 else (k,))
        yield _chains(out)
        out = []
    for x in chains:
        close(x)
    yield _chains(out)


def _chains(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=list(_CHAIN))


_STRETCH = ["lead_doc", "lead_variant", "lead_from", "lead_to"]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (doc, variant, no text first): a document's text and the stretches asked of it -> the same with the stretch's first place and tokens in 32 bits."""
    doc, own = None, np.empty(0, np.uint32)
    for b in batches:
        first, out, pick = [], [], []
        for i, (d, v, text, a, z) in enumerate(zip(*(b[x].to_pylist() for x in ("doc", "variant", "text", "from", "to")), strict=True)):
            if text is not None:
                if doc != (d, v):
                    doc, own = (d, v), (text,)
                continue
            if doc != (d, v):
                continue
            if isinstance(own, tuple):
                own = (tokens(own[0]) >> np.uint64(32)).astype(np.uint32)
            pick.append(i)
            first.append(max(a, 0))
            out.append(own[max(a, 0) : z + 1].tobytes())
        kept = b.select(["doc", "n_rows", *_STRETCH]).take(pa.array(pick, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(first, pa.int64()), pa.array(out, pa.binary())], names=["doc", "n_rows", *_STRETCH, "first", "tokens"])


def _best(common: np.ndarray, miss: float, least: int) -> tuple[int, int, float]:
    """(start, end, sum) of the stretch of `least` values or more with the largest sum, where a common token counts 1 and any other -miss."""
    sums = np.concatenate(([0.0], np.cumsum(np.where(common, 1.0, -miss))))
    low = np.minimum.accumulate(sums[: len(sums) - least])
    gain = sums[least:] - low
    end = int(gain.argmax())
    return int(np.flatnonzero(sums[: end + 1] == low[end])[-1]), end + least, float(gain[end])


def alike(a: np.ndarray, b: np.ndarray, least: int, similarity: float = SIMILARITY) -> Iterator[tuple[int, int, int, int, float]]:
    """(a from, a to, b from, b to, similarity), inclusive, of the stretches of a that b has by that Jaccard similarity.

    Stretches of a rich in common tokens are taken greedily, with a low price for others. One
    that proves too unlike is searched again at twice the price, which cuts it at its gaps; at
    the highest price only runs of common tokens are left.
    """
    if len(a) >= least and np.array_equal(a, b):
        yield 0, len(a) - 1, 0, len(b) - 1, 1.0
        return
    ours, theirs = a.tolist(), b.tolist()
    has = set(theirs).__contains__
    common = np.fromiter(map(has, ours), bool, len(ours))
    sums = np.append(0, np.cumsum(common))
    todo = [(0, len(a), similarity / (1 - similarity) / 2)]
    while todo:
        left, right, miss = todo.pop()
        if right - left < least or sums[right] - sums[left] < similarity * least:
            continue
        start, end, gain = _best(common[left:right], miss, least)
        start, end = left + start, left + end
        if gain <= 0:
            continue
        mine = set(ours[start:end])
        b0, b1, _ = _best(np.fromiter(map(mine.__contains__, theirs), bool, len(theirs)), miss, min(len(b), int(least * similarity)))
        found = set(theirs[b0:b1])
        both = len(mine & found)
        share = both / (len(mine) + len(found) - both)
        if share >= similarity:
            yield start, end - 1, b0, b1 - 1, share
        elif miss <= 2 * least:
            todo.append((start, end, 2 * miss))
        todo += [(left, start, miss), (end, right, miss)]  # what stands beside the stretch


def _verified(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    names = ["doc", "start_word", "end_word", "source_doc", "source_start", "source_end", "similarity"]
    for b in batches:
        out = []
        for doc, lead, a0, b0, x, y in zip(*(b[c].to_pylist() for c in ("doc", "lead_doc", "a0", "b0", "a", "b")), strict=True):
            for s, e, ls, le, share in alike(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least):
                out.append((doc, a0 + s, a0 + e + WIDTH - 1, lead, b0 + ls, b0 + le + WIDTH - 1, share))
        cols = list(zip(*out, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:6]), pa.array(cols[6], pa.float64())], names=names)


_PASSAGE = "doc long, start_word long, end_word long, source_doc long, source_start long, source_end long, similarity double"


def _last_words(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """(h1, h2, source_doc, n_rows, text) -> the number of the text's last word instead of the text, of texts of min_words words or more."""
    for b in batches:
        last = np.array([len(t.lower().split()) - 1 for t in b["text"].to_pylist()], np.int64)
        kept = b.select(["h1", "h2", "source_doc", "n_rows"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(last)], names=[*kept.schema.names, "last"]).filter(pa.array(last >= min_words - 1))


def _copies(named: DataFrame, texts: DataFrame, min_words: int) -> DataFrame:
    """_PASSAGE of each id that is not the first of its text: the whole text, beside that of the first."""
    again = texts.where("low < high").select("h1", "h2", F.col("doc").alias("source_doc"), "n_rows", "text").mapInArrow(lambda it: _last_words(it, min_words), "h1 long, h2 long, source_doc long, n_rows long, last long")
    again = cut(again)
    total = again.agg(F.sum("n_rows")).first()[0] or 0
    rows = attach(named.select("doc", "h1", "h2"), again, ["h1", "h2"], total).where("doc <> source_doc")
    start = F.lit(0).cast("long")
    return rows.select("doc", start.alias("start_word"), F.col("last").alias("end_word"), "source_doc", start.alias("source_start"), F.col("last").alias("source_end"), F.lit(1.0).alias("similarity")).distinct()


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, start_word, end_word, source_doc, source_start, source_end, similarity, class_id): passages that another document has too.

    Words are counted from 0, ends are inclusive. A passage is paired with the documents that are
    closest to it among all that share one of its minima, source_doc being the smaller id;
    class_id is the smallest id that pairs lead to, so all documents of one passage have one
    class. Documents of one text are represented by the smallest id: each other one has a row
    beside it for the whole text, and what the text shares with other texts stands in the rows
    of the smallest. Ids are integers; rows without id can't be named and are left out, as are null and
    empty texts and those of fewer than min_words words. Rows that repeat an id are one
    document, with the places of each of its texts. Repeats inside one document don't count. No
    documents give no rows.
    """
    least = min_words - WIDTH + 1
    text = F.col(f"`{text_col}`")
    named = docs.where(F.col(f"`{id_col}`").isNotNull() & text.isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(7)).alias("h2"), text.alias("text"))
    once = named.groupBy("h1", "h2").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n_rows"), F.first("text").alias("text"))
    kept, drop = written(once.select(F.col("low").alias("doc"), "low", "high", "h1", "h2", "n_rows", "text"))
    own = kept.select("doc", F.expr("cast(h1 & 32767 as smallint)").alias("variant"), "text")
    pairs = _pairs(own, least)
    order = ("doc", "variant", "lead_doc", "lead_variant")
    chains = pairs.repartition(*order).sortWithinPartitions(*order, "c", "lead_c", "hash").mapInArrow(lambda it: _chained(it, least), ", ".join(f"{c} long" for c in _CHAIN))
    chains = cut(chains.distinct())
    n = chains.count()
    lead = [F.col("lead_doc"), F.col("lead_variant").cast("short").alias("lead_variant"), (F.col("lead0") - 2 * least).alias("lead_from"), (F.col("lead1") + 2 * least).alias("lead_to")]
    mine = chains.select("doc", F.col("variant").cast("short").alias("variant"), F.lit(None).cast("string").alias("text"), (F.col("c0") - 2 * least).alias("from"), (F.col("c1") + 2 * least).alias("to"), F.lit(0).cast("long").alias("n_rows"), *lead)
    theirs = chains.select(*lead).groupBy(*_STRETCH).agg(F.count("*").alias("n_rows")).select(F.col("lead_doc").alias("doc"), F.col("lead_variant").alias("variant"), F.lit(None).cast("string").alias("text"), F.col("lead_from").alias("from"), F.col("lead_to").alias("to"), "n_rows", *_STRETCH)
    texts = own.select("doc", "variant", "text", *(F.lit(None).cast(t).alias(c) for c, t in mine.dtypes[3:]))
    beside = texts.union(mine).union(theirs).repartition("doc", "variant").sortWithinPartitions("doc", "variant", F.col("text").desc_nulls_last())
    slices = cut(beside.mapInArrow(_sliced, "doc long, n_rows long, lead_doc long, lead_variant short, lead_from long, lead_to long, first long, tokens binary"))
    by = slices.where("n_rows > 0").select("n_rows", *_STRETCH, F.col("first").alias("b0"), F.col("tokens").alias("b"))
    sides = attach(slices.where("n_rows = 0").select("doc", *_STRETCH, F.col("first").alias("a0"), F.col("tokens").alias("a")), by, _STRETCH, n)
    passages = cut(sides.mapInArrow(lambda it: _verified(it, least), _PASSAGE).distinct().unionByName(_copies(named, kept, min_words)))
    drop()
    classes = components(passages.select(F.col("doc").alias("a"), F.col("source_doc").alias("b")))
    return passages.join(classes.withColumnRenamed("id", "doc").withColumnRenamed("root", "class_id"), "doc").withColumnRenamed("doc", id_col)
