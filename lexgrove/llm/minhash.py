"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges.

A document's set of word shingles is hashed once; the top bits of a hash name its bin, each bin
keeps its least hash, and an empty bin copies the filled one that its own sequence of probes meets
first. `BANDS` bands of `ROWS` bins each name a bucket. Equal sets are one node from the start.

A bucket's nodes are linked to its least one: a star, so a bucket of n nodes gives n - 1 candidates.
Candidates whose signatures are far apart go; of the others each node's nearest centre comes
first and is confirmed on the full sets. What this leaves open, other centres and two nodes alike
each other but not a centre, is settled where nodes meet: to buckets whose nodes aren't all in one
component yet their full sets travel, every pair of components still apart whose signatures are
near is looked at there, nearest first, and a bucket gives the confirmed links that join two
components, fewer than it has nodes. Nothing is capped, and no pair that isn't a link is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import TASK_LINKS, attach, components_by_parts, cut, fitted
from lexgrove.llm.shingles import shingle_hashes

WIDTH = 2
PERCENT = 80  # of the union that the intersection has at least
BIN_BITS = 8
BINS = 1 << BIN_BITS
BANDS, ROWS = 42, 6  # two sets 0.8 alike share no bucket with probability 3e-6
NIBBLES = BINS // 16  # words of 64 bits that hold 4 bits of each bin
MARGIN = 0.1  # by which a signature may fall short of the similarity, 3.8 standard deviations
HOMES = 4096  # nodes of a bucket that one task holds
HELD = 1 << 22  # shingles of a bucket's sets that one task holds, about
ASKED = 1  # pairs for each node that are looked at before components are compared again; GROWTH times as many each further time
GROWTH = 8
PAIRS = 1 << 18  # signatures compared at once
WHOLE = 1024  # shingles of a set of which 16 bits each are compared first
CROWDED = 64  # nodes of a bucket from which that is done
SETS = 1 << 14  # sets, with what is known of each, in one partition
HOT = 500  # pairs of one text that one task confirms
FEW = 100_000  # so many rows of some numbers are broadcast

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _probes() -> np.ndarray:
    """Row i: all bins in the order in which an empty bin i tries them."""
    rng = np.random.default_rng(42)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def signature(hashes: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """The low 32 bits of each bin's least hash, of sorted distinct ones; empty bins copy the first filled one of their probes. Equal minima stay equal, others agree once in 2^32."""
    bins = (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    own, first = np.unique(bins, return_index=True)
    filled, out = np.zeros(BINS, bool), np.zeros(BINS, np.uint32)
    filled[own], out[own] = True, hashes[first].astype(np.uint32)
    empty = np.flatnonzero(~filled)
    if len(empty):
        tries = probes[empty]
        out[empty] = out[tries[np.arange(len(empty)), filled[tries].argmax(axis=1)]]
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """(sets, BANDS) bucket keys."""
    own = signatures[:, : BANDS * ROWS].reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(_mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), own.shape[:2]).copy()
    for j in range(ROWS):
        key = _mixed(key ^ own[:, :, j])
    return key


def packed(signatures: np.ndarray) -> np.ndarray:
    """(sets, NIBBLES) words with four bits of each bin."""
    low = (_mixed(signatures) >> np.uint64(60)).reshape(-1, NIBBLES, 16)
    return (low << np.arange(0, 64, 4, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def equal_bins(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bins of packed signatures agree, along the last axis."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return BINS - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)


def least_equal(percent: float) -> int:
    """Bins that agree at least, by expectation for a similarity of `MARGIN` less; chance has one in 16 of the others."""
    j = max(0.0, percent / 100 - MARGIN)
    return int(BINS * (j + (1 - j) / 16))


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    """(rid, th, text) -> (rid, th, n, digest, sig): the set's size, a hash of it, its signature's bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _probes()
        for b in batches:
            n, digests, sigs = [], [], []
            for t in b["text"]:
                h = shingle_hashes(t.as_py(), width)
                n.append(len(h))
                digests.append(xxhash.xxh3_64_intdigest(np.ascontiguousarray(h).tobytes(), 42))
                sigs.append(signature(np.ascontiguousarray(h[:, 0]), probes).tobytes() if len(h) else b"")
            yield pa.RecordBatch.from_arrays([b["rid"], b["th"], pa.array(n, pa.int64()), pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(sigs, pa.binary())], names=["rid", "th", "n", "digest", "sig"])

    kind = docs.schema["rid"].dataType.simpleString()
    return docs.select("rid", "th", "text").mapInArrow(run, f"rid {kind}, th long, n long, digest long, sig binary")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def _nibbles(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _bucketed(sets: DataFrame) -> DataFrame:
    """(digest, sig) -> (key, node): each node in its BANDS buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 1024) for i in range(0, b.num_rows, 1024)):
                keys = bands(_signatures(part["sig"]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part["digest"].to_numpy(), BANDS))], names=["key", "node"])

    return sets.select("digest", "sig").mapInArrow(run, "key long, node long")


def _packed(sets: DataFrame) -> DataFrame:
    """(digest, sig, n) -> (node, bits, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = packed(_signatures(b["sig"])) if b.num_rows else np.empty((0, NIBBLES), np.uint64)
            yield pa.RecordBatch.from_arrays([b["digest"], pa.array([x.tobytes() for x in bits], pa.binary()), b["n"]], names=["node", "bits", "n"])

    return sets.select("digest", "sig", "n").mapInArrow(run, "node long, bits binary, n long")


def _nearest_centres(pairs: DataFrame, bits: DataFrame, total: int, least: int) -> DataFrame:
    """(a, b): each b's nearest centre a, of those whose signatures agree in `least` bins. A centre may be in many pairs, b is in at most BANDS."""
    both = pairs.join(bits.select(F.col("node").alias("b"), F.col("bits").alias("bits_b")), "b")
    ends = pairs.groupBy("a").agg(F.count("*").alias("n_rows")).join(bits.select(F.col("node").alias("a"), F.col("bits").alias("bits_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                equal = equal_bins(_nibbles(b["bits_a"]), _nibbles(b["bits_b"]))
                yield pa.RecordBatch.from_arrays([b["a"], b["b"], pa.array(equal)], names=["a", "b", "equal"]).filter(pa.array(equal >= least))

    near = attach(both, ends, ["a"], total).select("a", "b", "bits_a", "bits_b").mapInArrow(run, "a long, b long, equal long")
    return near.groupBy("b").agg(F.max(F.struct("equal", "a")).alias("m")).select("m.a", "b")


def full_set(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the set."""
    return np.sort(shingle_hashes(text, width)[:, 0])


def alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two full sets are linked."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _confirm(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    last: dict[int, np.ndarray] = {}

    def of(node: int, text: pa.Scalar) -> np.ndarray:
        if node not in last:
            if len(last) > 1:
                del last[next(iter(last))]
            last[node] = full_set(text.as_py(), width)
        return last[node]

    for b in batches:
        keep = []
        for x, y, s, t in zip(b["a"].to_pylist(), b["b"].to_pylist(), b["text_a"], b["text_b"], strict=True):
            keep.append(alike(of(x, s), of(y, t), percent))
        yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _texts_of(named: DataFrame, docs: DataFrame) -> DataFrame:
    """docs joined with the rows (own, own_th, ...) that name some of them; while these are few, no text is shuffled."""
    by = F.broadcast(named) if named.count() <= FEW else named
    return docs.join(by, F.col("rid").eqNullSafe(F.col("own")) & (F.col("th") == F.col("own_th")))


def _confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, total: int, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets are alike. Only texts of pairs are shuffled while their rows are few; one in many pairs is dealt out by a salt."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").agg(F.count("*").alias("deg"))
    most = max(HOT, total // 1000)  # at most 2,000 nodes are in more pairs
    parts = F.when(F.col("deg") > most, F.ceil(F.col("deg") / HOT).cast("int")).otherwise(1)
    needed = fitted(sets.select("digest", "rid", "th").join(ends, "digest").select("rid", "th", "digest", parts.alias("parts")), TASK_LINKS)
    hot = F.broadcast(needed.where("parts > 1").select("digest", "parts"))
    named = needed.select(F.col("rid").alias("own"), F.col("th").alias("own_th"), "digest", "parts")
    texts = _texts_of(named, docs).select("digest", F.coalesce("text", F.lit("")).alias("text"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")).dropDuplicates(["digest", "salt"])

    def with_text(df: DataFrame, end: str, other: str) -> DataFrame:
        salted = df.join(hot.withColumnRenamed("digest", end), end, "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        return salted.join(texts.select(F.col("digest").alias(end), "salt", F.col("text").alias(f"text_{end}")), [end, "salt"]).drop("salt")

    return with_text(with_text(pairs, "b", "a"), "a", "b").select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _confirm(it, width, percent), "a long, b long")


def _whole(few: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets, 0 of those that don't travel whole, and a row of 16-bit hashes for each, padded with 1 << 16."""
    n = np.array([len(x) // 2 for x in few], np.int64)
    rows = np.full((len(few), n.max(initial=0)), 1 << 16, np.int32)
    rows[np.arange(rows.shape[1]) < n[:, None]] = np.frombuffer(b"".join(few), np.uint16)
    return n, rows


def _may_link(x: np.ndarray, y: np.ndarray, ask: tuple[np.ndarray, np.ndarray], home: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """Which pairs can be linked, x sorted: not those whose sets both travel whole and share too little even if equal hashes are equal shingles."""
    keep, has = np.ones(len(x), bool), np.zeros((1 << 16) + 1, bool)
    first = np.flatnonzero(np.diff(x, prepend=-1)).tolist()
    for i, j in zip(first, [*first[1:], len(x)] if first else [], strict=True):
        if n := ask[0][x[i]]:
            own, others = ask[1][x[i], :n], y[i:j]
            has[own] = True
            both = np.minimum(has[home[1][others]].sum(axis=1), n)
            keep[i:j] = (home[0][others] == 0) | (100 * both >= percent * (n + home[0][others] - both))
            has[own] = False
    return keep


def _top(up: dict[int, int], x: int) -> int:
    while (y := up.get(x, x)) != x:
        up[x] = x = up.get(y, y)
    return x


def _tops(up: dict[int, int], roots: np.ndarray) -> np.ndarray:
    own, at = np.unique(roots, return_inverse=True)
    return np.array([_top(up, x) for x in own.tolist()], np.int64)[at]


def _joins(ask: dict[str, np.ndarray], home: dict[str, np.ndarray], up: dict[int, int], least: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b): links between asking nodes and homes of larger ids that join components still apart; up keeps which are joined.

    All pairs whose signatures agree in `least` bins are looked at, nearest first, but for those
    whose ends are joined by then.
    """
    step = max(1, PAIRS // max(1, len(home["node"])))
    few = lambda rows: _whole(np.array([x.astype(np.uint16).tobytes() if len(x) <= WHOLE else b"" for x in rows["set"]], object))
    homes = few(home) if len(home["node"]) >= CROWDED else None
    for i in range(0, len(ask["node"]), step):
        own, found = {c: x[i : i + step] for c, x in ask.items()}, []
        x, y = np.nonzero((_tops(up, own["root"])[:, None] != _tops(up, home["root"])[None, :]) & (own["node"][:, None] < home["node"][None, :]))
        n = equal_bins(own["bits"][x], home["bits"][y])
        near = np.flatnonzero(n >= least)
        near = near[np.argsort(-n[near], kind="stable")]
        asks, at, size = few(own) if homes is not None and len(near) else None, 0, ASKED * len(own["node"])
        while at < len(near):
            p, q = x[near[at : at + size]], y[near[at : at + size]]
            apart = _tops(up, own["root"])[p] != _tops(up, home["root"])[q]
            p, q = p[apart], q[apart]
            if asks is not None:
                by = np.argsort(p, kind="stable")
                may = by[_may_link(p[by], q[by], asks, homes, percent)]
                may.sort()
                p, q = p[may], q[may]
            for j, k in zip(p.tolist(), q.tolist(), strict=True):
                r, t = _top(up, int(own["root"][j])), _top(up, int(home["root"][k]))
                if r != t and alike(own["set"][j], home["set"][k], percent):
                    up[max(r, t)] = min(r, t)
                    found.append((own["node"][j], home["node"][k]))
            at, size = at + size, size * GROWTH
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _settled(batches: Iterator[pa.RecordBatch], least: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, replica, node, root, bits, set) sorted by key and replica: a bucket's homes come first and stay, replicas stream past; homes without replicas meet each other."""
    empty = {"node": np.empty(0, np.int64), "root": np.empty(0, np.int64), "bits": np.empty((0, NIBBLES), np.uint64), "set": np.empty(0, object)}
    bucket, home, streamed, up = None, empty, False, {}
    for b in batches:
        if not b.num_rows:
            continue
        key, replica = b["key"].to_numpy(), b["replica"].to_numpy(zero_copy_only=False)
        own = np.empty(b.num_rows, object)
        own[:] = [np.frombuffer(x, np.uint64) for x in b["set"].to_pylist()]
        rows = {"node": b["node"].to_numpy(), "root": b["root"].to_numpy(), "bits": _nibbles(b["bits"]), "set": own}
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))).tolist()
        for i, j in zip(first, [*first[1:], len(key)], strict=True):
            if key[i] != bucket:
                if not streamed:
                    yield from _joins(home, home, up, least, percent)
                bucket, home, streamed, up = key[i], empty, False, {}
            mid = i + int((~replica[i:j]).sum())
            home = {c: np.concatenate((home[c], x[i:mid])) for c, x in rows.items()}
            if mid < j:
                streamed = True
                yield from _joins({c: x[mid:j] for c, x in rows.items()}, home, up, least, percent)
    if not streamed:
        yield from _joins(home, home, up, least, percent)


def _full_sets(nodes: DataFrame, sets: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, set): the sorted hashes of each node's set, from the text of one row that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                yield pa.RecordBatch.from_arrays([part["digest"], pa.array([full_set(t.as_py(), width).tobytes() for t in part["text"]], pa.binary())], names=["node", "set"])

    needed = fitted(sets.select("digest", F.col("rid").alias("own"), F.col("th").alias("own_th")).join(nodes.select(F.col("node").alias("digest")), "digest"), TASK_LINKS)
    texts = _texts_of(needed, docs).select("digest", "text").dropDuplicates(["digest"])
    return texts.mapInArrow(run, "node long, set binary")


def joining_links(members: DataFrame, bits: DataFrame, roots: DataFrame, sets: DataFrame, docs: DataFrame, total: int, width: int, percent: int) -> DataFrame:
    """(a, b): links that join components of the nodes of a bucket, so many that none is left to join there.

    members (key, node), bits (node, bits, n), roots (id, root), sets (digest, rid, th): a node's set is that of the named row of docs (rid, th, text).
    """
    least = least_equal(percent)
    named = members.join(roots.select(F.col("id").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    state = cut(named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n_rows")).where("low < high").select("key", "n_rows"))
    rows = fitted(attach(named, state, ["key"], total).join(bits, "node"), TASK_LINKS)
    parts = F.greatest(F.ceil(F.count("*") / HOMES), F.ceil(F.sum("n") / HELD)).cast("int")
    sized = rows.groupBy("key").agg(parts.alias("parts"), F.count("*").alias("n_rows"))
    dealt = attach(rows, sized, ["key"], total).join(_full_sets(rows.select("node").distinct(), sets, docs, width), "node")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    place = lambda part, replica: F.struct(part.cast("int").alias("part"), F.lit(replica).alias("replica"))
    many = F.concat(F.array(place(own, False)), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: place(i, True)))
    spread = dealt.select("key", "node", "root", "bits", "set", F.explode(F.when(F.col("parts") > 1, many).otherwise(F.array(place(F.lit(0), False)))).alias("at"))
    met = spread.select(F.xxhash64("key", "at.part").alias("key"), "at.replica", "node", "root", "bits", "set").repartition("key").sortWithinPartitions("key", "replica")
    return met.mapInArrow(lambda it: _settled(it, least, percent), "a long, b long")


def shared_buckets(sets: DataFrame) -> DataFrame:
    """(key, node, centre): the nodes of buckets that have several."""
    buckets = _bucketed(sets)
    several = cut(buckets.groupBy("key").agg(F.count("*").alias("n_rows"), F.min("node").alias("centre")).where("n_rows > 1"))
    return cut(attach(buckets, several, ["key"], BANDS * sets.count()))


def _linked(sets: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, root) for the sets that have a link."""
    bits = fitted(_packed(sets), SETS)
    members = shared_buckets(sets)
    total = members.count()
    pairs = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    tested = fitted(_nearest_centres(pairs, bits, total, least_equal(percent)), TASK_LINKS)
    links = fitted(_confirmed(tested, sets, docs, tested.count(), width, percent), TASK_LINKS)
    roots = fitted(components_by_parts(links), TASK_LINKS)
    more = fitted(joining_links(members.select("key", "node"), bits, roots, sets, docs, total, width, percent), TASK_LINKS)
    return roots if more.isEmpty() else components_by_parts(links.union(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept): the size of each document's set, the smallest id reachable over links, and whether that is the document itself.

    A document's set: the distinct shingles of `width` words (what stands between ASCII white space,
    A-Z lower-cased); of fewer words, all of them as one; of none, nothing. Two documents are
    linked if 100 * intersection >= percent * union of their full sets, an empty set with nothing.
    Equal sets are linked whatever their signatures. Null text is empty; a null id never names a
    component unless all of it are null; repeated rows are linked, as their sets are equal, unless
    these are empty; other columns play no part; no documents give no rows. A pair of exactly 0.8
    is seen with probability 1 - 1e-4, one more alike with more.
    """
    text = F.col(f"`{text_col}`")
    own = docs.select(F.col(f"`{id_col}`").alias("rid"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text"))
    marked = cut(_sketched(own, width))
    sets = marked.where("n > 0").groupBy("digest").agg(F.min("rid").alias("least"), F.count("*").alias("n_rows"), F.min(F.struct("rid", "th")).alias("row"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    sets = cut(sets.select("digest", "least", "n_rows", "row.*", "sig", "n"))
    found = cut(_linked(sets, own, width, percent))
    linked = cut(sets.join(found, sets.digest == found.id).select("digest", "least", "n_rows", "root"))
    groups = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = attach(linked, groups, ["root"], linked.count(), "members").select("digest", "n_rows", "component_id")
    alone = sets.join(found, sets.digest == found.id, "left_anti").select("digest", "n_rows", F.col("least").alias("component_id"))
    rows = marked.select("digest", "rid", "n")
    some = attach(rows.where("n > 0"), named.unionByName(alone), ["digest"], marked.count()).select("rid", "n", "component_id")
    out = some.unionByName(rows.where("n = 0").select("rid", "n", F.col("rid").alias("component_id")))
    return out.select(F.col("rid").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("rid").eqNullSafe(F.col("component_id")).alias("kept"))
