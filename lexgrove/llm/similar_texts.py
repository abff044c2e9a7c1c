"""Near-dedup of texts at a Jaccard similarity: SimHash anchor covering for candidates, exact shingle sets for the answer.

A text's 128 SimHash bits come from its set of word shingles. `segments` samples of 21 of these
bits are taken; a sample's anchors are a covering code of radius 1 (a perfect Hamming code on 15
bits, all values on the rest). A fingerprint lives at its own anchor and is replicated to every
anchor within radius plus a threshold of one bit, so any two that differ in at most one bit of a
sample meet. Two sets 0.8 alike differ in about 15 % of the bits and meet in some sample with
probability 0.96. Where they meet, the first 64 bits are compared, and an anchor reports a spanning
forest of the pairs within `limit` bits, nearest first. Reported pairs are verified by their exact
shingle sets: the nearest few of each fingerprint, then all whose ends verified pairs haven't
joined. Connected components of verified pairs are groups.
SimHash leaves pairs out: those that meet in no sample, and those that a forest stands for by nearer
pairs which aren't links. So the groups are closed over buckets of MinHash bands, where two sets 0.8
alike meet but for 1 in 10,000: in each bucket that has several groups all pairs between them are
looked at on the full sets, as in `minhash.joining_links`, and links join their groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.llm import minhash
from lexgrove.llm.common import TASK_LINKS, attach, components_by_parts, cut, fitted
from lexgrove.llm.shingles import shingle_hashes
from lexgrove.llm.simhash import HOMES, Forest, _errors, _home, _syndrome

SHINGLE = 5
SIMILARITY = 0.8
SEGMENTS = 18
BITS, CODE = 21, 4  # bits of a sample; its Hamming code has 2^CODE - 1 bits
LIMIT = 16  # of 64 bits; sets 0.8 alike differ in 9.7 on average
PAIRS = 1 << 20  # pairs compared at once
FEW = 100_000  # so many rows of three numbers are broadcast
FIRST = 3  # candidates of a fingerprint that are verified first
HOT = 500  # pairs of one text that one task verifies


def sketch(text: str | None, width: int = SHINGLE) -> tuple[int, int, int]:
    """(digest of the shingle set, first and last 64 majority bits), signed; bits are 0 if there is no word."""
    return _sketch(shingle_hashes(text, width))


def _sketch(h: np.ndarray) -> tuple[int, int, int]:
    n, step = len(h), 1 << 15
    ones = sum((np.unpackbits(np.ascontiguousarray(h[i : i + step]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, n, step)), np.zeros(128, np.int64))
    own = np.packbits(ones * 2 > n, bitorder="little").view(np.int64)
    return int(np.uint64(xxhash.xxh64_intdigest(np.ascontiguousarray(h[:, 0]).tobytes(), 42)).view(np.int64)), int(own[0]), int(own[1])


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    """(rid, th, text) -> (rid, th, digest, lo, hi, n, sig): also the set's size and its MinHash signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = minhash._probes()
        for b in batches:
            own, n, sigs = [], [], []
            for t in b["text"]:
                h = shingle_hashes(t.as_py(), width)
                own.append(_sketch(h))
                n.append(len(h))
                sigs.append(minhash.signature(np.ascontiguousarray(h[:, 0]), probes).tobytes() if len(h) else b"")
            own = np.array(own, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b["rid"], b["th"], *(pa.array(own[:, i]) for i in range(3)), pa.array(n, pa.int64()), pa.array(sigs, pa.binary())], names=["rid", "th", "digest", "lo", "hi", "n", "sig"])

    kind = docs.schema["rid"].dataType.simpleString()
    return docs.select("rid", "th", "text").mapInArrow(run, f"rid {kind}, th long, digest long, lo long, hi long, n long, sig binary")


def _samples(segments: int) -> list[np.ndarray]:
    """The bits of each sample: six disjoint ones of every seeded permutation of the 128."""
    rng, out = np.random.default_rng(42), []
    while len(out) < segments:
        order = rng.permutation(128)
        out += [order[i * BITS : (i + 1) * BITS] for i in range(128 // BITS)]
    return out[:segments]


def _placed(batches: Iterator[pa.RecordBatch], segments: int, replicas: bool) -> Iterator[pa.RecordBatch]:
    """(key, lo): key is the sample and anchor, shifted by one, plus 1 for a replica."""
    errors, samples = _errors(BITS, CODE, 2), _samples(segments)
    for b in batches:
        lo, hi = (b[c].to_numpy().view(np.uint64) for c in ("lo", "hi"))
        for k, bits in enumerate(samples):
            x = np.zeros(len(lo), np.uint64)
            for i, bit in enumerate(bits.tolist()):
                x |= (((lo if bit < 64 else hi) >> np.uint64(bit % 64)) & np.uint64(1)) << np.uint64(i)
            keys, who = [_home(x, CODE) << np.uint64(1)], [lo]
            if replicas:
                s = _syndrome(x, CODE)
                for code, masks in errors.items():
                    own = np.flatnonzero(s == code)
                    keys.append(((x[own][:, None] ^ masks[None, :]).ravel() << np.uint64(1)) | np.uint64(1))
                    who.append(np.repeat(lo[own], len(masks)))
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(keys) | np.uint64(k << BITS + 1)).view(np.int64)), pa.array(np.concatenate(who).view(np.int64))], names=["key", "lo"])


def _joined(p: np.ndarray, q: np.ndarray, d: np.ndarray, forest: Forest) -> list[tuple[int, int]]:
    """The pairs of a spanning forest of (p, q), nearest first, that the forest doesn't have yet."""
    found: list[tuple[int, int]] = []
    while len(p):
        ids, at = np.unique(np.concatenate((p, q)), return_inverse=True)
        root = np.unique(np.array([forest.root(i) for i in ids.tolist()], np.uint64), return_inverse=True)[1]
        apart = root[at[: len(p)]] != root[at[len(p) :]]
        p, q, d = p[apart], q[apart], d[apart]
        order = np.argsort(d, kind="stable")
        nearest = order[np.unique(p[order], return_index=True)[1]]
        found += [(x, y) for x, y in zip(p[nearest].tolist(), q[nearest].tolist(), strict=True) if forest.join(x, y)]
    return found


def _near(p: np.ndarray, q: np.ndarray, limit: int, forest: Forest, anchor: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Those of the replicas p and homes q that are near and not joined yet; with anchors, each pair counts at its own."""
    d = np.bitwise_count(p ^ q)
    ok = (d <= limit) & (d > 0)
    if anchor is None:
        return _joined(p[ok], q[ok], d[ok], forest)
    mix = anchor[ok].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # a node of the forest is a fingerprint at an anchor
    own = dict(zip((x := p[ok] ^ mix).tolist(), mix.tolist(), strict=True))
    return [(a ^ own[a], b ^ own[a]) for a, b in _joined(x, q[ok] ^ mix, d[ok], forest)]


def _candidates(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: an anchor's homes come first and stay, replicas stream past. Gives (replica, home)."""
    anchor, homes, forest = -1, np.empty(0, np.uint64), Forest()
    for b in batches:
        key, lo = b["key"].to_numpy(), b["lo"].to_numpy().view(np.uint64)
        if not len(key):
            continue
        own, replica = key >> 1, (key & 1) == 1
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        last = np.append(first[1:], len(key))
        n_homes = np.add.reduceat(~replica, first, dtype=np.int64)
        n_reps = last - first - n_homes
        found: list[tuple[int, int]] = []
        wide = n_homes * n_reps > PAIRS // 16
        wide[[0, -1]] = True  # these may go on from the batch before, or in the next one
        for g in np.flatnonzero(wide).tolist():
            mid = first[g] + n_homes[g]
            if own[first[g]] != anchor:
                anchor, homes, forest = own[first[g]], np.empty(0, np.uint64), Forest()
            homes = np.concatenate((homes, lo[first[g] : mid]))
            step = max(1, PAIRS // max(1, len(homes)))
            for i in range(mid, last[g], step) if len(homes) else ():
                r = lo[i : min(i + step, last[g])]
                found += _near(np.repeat(r, len(homes)), np.tile(homes, len(r)), limit, forest)
        n = np.where(wide, 0, n_homes)
        rep = np.flatnonzero(replica & (np.repeat(n, last - first) > 0))  # replicas of small groups that have homes
        of = np.searchsorted(first, rep, side="right") - 1
        size, at = np.cumsum(n[of]), 0
        while at < len(rep):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PAIRS, side="right")))
            many = n[of[at:to]]
            ends = np.cumsum(many)
            home = np.repeat(first[of[at:to]] - (ends - many), many) + np.arange(ends[-1])
            found += _near(np.repeat(lo[rep[at:to]], many), lo[home], limit, Forest(), np.repeat(own[rep[at:to]], many))
            at = to
        pairs = np.array(found, np.uint64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], names=["a", "b"])


def candidates(fingerprints: DataFrame, limit: int = LIMIT, segments: int = SEGMENTS, homes: int = HOMES) -> DataFrame:
    """(a, b) from (lo, hi) with distinct lo: b lives at an anchor where a is a replica, and they differ in at most `limit` bits of lo.

    Of many such pairs an anchor reports a spanning forest, so a fingerprint has no more than anchors. Anchors with more than `homes` homes are
    salted: their homes are dealt out and their replicas go to each salt.
    """
    f = fingerprints.select("lo", "hi")
    anchors = f.mapInArrow(lambda it: _placed(it, segments, False), "key long, lo long")
    crowded = cut(anchors.groupBy("key").count().where(F.col("count") > homes).select((F.shiftright("key", 1)).alias("anchor"), F.ceil(F.col("count") / homes).cast("int").alias("parts")))
    placed, n = f.mapInArrow(lambda it: _placed(it, segments, True), "key long, lo long"), crowded.count()
    if n:
        spread = placed.withColumn("anchor", F.shiftright("key", 1)).join(F.broadcast(crowded) if n <= FEW else crowded, "anchor", "left")
        salts = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("key") % 2 == 0, F.array(F.pmod(F.xxhash64("lo"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        placed = spread.select("key", "lo", F.explode(salts).alias("salt")).select((F.col("key") + F.shiftleft(F.col("salt").cast("long"), 32)).alias("key"), "lo")
    dealt = placed.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    return dealt.mapInArrow(lambda it: _candidates(it, limit), "a long, b long").distinct()


def _alike(batches: Iterator[pa.RecordBatch], width: int, similarity: float) -> Iterator[pa.RecordBatch]:
    last: dict[int, np.ndarray] = {}

    def of(node: int, text: str) -> np.ndarray:
        if node not in last:
            if len(last) > 1:
                del last[next(iter(last))]
            last[node] = shingle_hashes(text, width)[:, 0]
        return last[node]

    for b in batches:
        keep = []
        for x, y, s, t in zip(b["a"].to_pylist(), b["b"].to_pylist(), b["text_a"], b["text_b"], strict=True):
            p, q = of(y, t.as_py()), of(x, s.as_py())
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(both >= similarity * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are alike; nodes: (node, rid, th) names the row of docs with its text.

    Only texts of a pair are shuffled while their nodes are few; those in many pairs are salted.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))
    needed = cut(nodes.select("node", F.col("rid").alias("own"), F.col("th").alias("own_th")).join(ends, "node"))
    n, total = needed.count(), pairs.count()
    by = F.broadcast(needed) if n <= FEW else needed
    most = max(HOT, total // 1000)  # at most 2,000 nodes are in more pairs
    hot = F.broadcast(needed.where(F.col("deg") > most).select("node", F.ceil(F.col("deg") / HOT).cast("int").alias("parts")))
    parts = F.when(F.col("deg") > most, F.ceil(F.col("deg") / HOT).cast("int")).otherwise(F.lit(1))
    texts = docs.join(by, F.col("rid").eqNullSafe(F.col("own")) & (F.col("th") == F.col("own_th"))).select("node", F.coalesce("text", F.lit("")).alias("text"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    dealt = texts.dropDuplicates(["node", "salt"])  # its shuffle is the one of both joins

    def with_text(df: DataFrame, end: str, other: str) -> DataFrame:
        salted = df.join(hot, F.col(end) == F.col("node"), "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("node", "parts")
        return salted.join(dealt.select(F.col("node").alias(end), "salt", F.col("text").alias(f"text_{end}")), [end, "salt"]).drop("salt")

    return with_text(with_text(pairs, "a", "b"), "b", "a").select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _alike(it, width, similarity), "a long, b long")


def _found(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(id, root) by verified pairs: of each fingerprint the nearest few first, then all others whose ends are still apart."""
    order = Window.partitionBy("a").orderBy(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))), F.xxhash64("a", "b"))  # as many rows as anchors
    ranked = cut(pairs.withColumn("rank", F.row_number().over(order)))
    found = cut(components_by_parts(verified(ranked.where(F.col("rank") <= FIRST).select("a", "b"), nodes, docs, width, similarity)))
    rest = cut(ranked.where(F.col("rank") > FIRST).select("a", "b").join(found.select(F.col("id").alias("a"), F.col("root").alias("root_a")), "a", "left"))
    n = rest.count()
    by = rest.groupBy("b").agg(F.count("*").alias("n_rows")).join(found.select(F.col("id").alias("b"), F.col("root").alias("root_b")), "b", "left")
    apart = cut(attach(rest, by, ["b"], n).where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b"))
    if not apart.count():
        return found
    more = verified(apart, nodes, docs, width, similarity)
    return components_by_parts(more.union(found.select(F.col("id").alias("a"), F.col("root").alias("b"))))


def _closed(found: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """found (id, root) with the groups joined that links between nodes of one MinHash bucket join."""
    own = nodes.where("n > 0").select(F.col("node").alias("digest"), "rid", "th", "n", "sig")
    members = minhash.shared_buckets(own).select("key", "node")
    more = minhash.joining_links(members, fitted(minhash._packed(own), minhash.SETS), found, own, docs, members.count(), width, 100 * similarity)
    more = fitted(more, TASK_LINKS)
    return found if more.isEmpty() else components_by_parts(more.union(found.select(F.col("id").alias("a"), F.col("root").alias("b"))))


def _groups(docs: DataFrame, width: int, similarity: float, segments: int, homes: int) -> DataFrame:
    """(rid, th, text) -> (rid, th, component_id)."""
    marked = cut(_sketched(docs, width))
    sets = marked.groupBy("digest").agg(F.min("rid").alias("least"), F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.count("*").alias("n_rows"), F.min(F.struct("rid", "th")).alias("row"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    sets = cut(sets.select("digest", "least", "lo", "hi", "n_rows", "row.*", "n", "sig"))
    prints = sets.groupBy("lo").agg(F.min(F.struct("digest", "hi")).alias("one")).select("lo", "one.hi", F.col("one.digest").alias("of"))
    # a set of the same first bits as another is a node of its own and a candidate of that one
    nodes = cut(sets.join(prints.select("lo", "of"), "lo").withColumn("node", F.when(F.col("digest") == F.col("of"), F.col("lo")).otherwise(F.col("digest"))))
    same = nodes.where("node <> lo").select(F.col("node").alias("a"), F.col("lo").alias("b"))
    # nothing keeps the anchors' shuffle once the pairs are written
    found = _found(cut(candidates(prints, segments=segments, homes=homes).union(same)), nodes, docs, width, similarity)
    found = _closed(cut(found), nodes, docs, width, similarity)
    linked = cut(nodes.join(found, nodes.node == found.id).select("digest", "least", "n_rows", "root"))
    groups = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = attach(linked, groups, ["root"], linked.count(), "members").select("digest", "n_rows", "component_id")
    alone = nodes.join(found, nodes.node == found.id, "left_anti").select("digest", "n_rows", F.col("least").alias("component_id"))
    return attach(marked.select("digest", "rid", "th"), named.unionByName(alone), ["digest"], marked.count()).select("rid", "th", "component_id")


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("rid"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, similarity: float = SIMILARITY, segments: int = SEGMENTS, homes: int = HOMES) -> DataFrame:
    """(id, component_id): the smallest id reachable over verified links, for each row of docs.

    A link: the Jaccard similarity of the sets of `width`-word shingles is `similarity` or more (words
    lower-cased in A-Z and cut at ASCII white space; fewer words are one shingle). Texts without
    words have the empty set and are alike; null text is empty. Equal sets are always in one
    group. Null ids never name a group unless all are null; repeated rows are in one group; other columns
    play no part. No documents give no rows.
    """
    return _groups(_own(docs, id_col, text_col), width, similarity, segments, homes).select(F.col("rid").alias(id_col), "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, similarity: float = SIMILARITY, segments: int = SEGMENTS, homes: int = HOMES) -> DataFrame:
    """docs with one document of each group of `similar_groups`: of the rows with its smallest id, the one of the least text hash.

    All columns pass through. Repeated rows count as one document and one of them stays.
    """
    near = _groups(_own(docs, id_col, text_col), width, similarity, segments, homes)
    stay = near.where(F.col("rid").eqNullSafe(F.col("component_id"))).groupBy("rid").agg(F.min("th").alias("_stay_th")).withColumnRenamed("rid", "_stay_id")
    d = docs.withColumn("_near_th", F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    kept = d.join(stay, d[f"`{id_col}`"].eqNullSafe(stay["_stay_id"]) & (d["_near_th"] == stay["_stay_th"]), "left_semi")
    return kept.dropDuplicates([id_col, "_near_th"]).drop("_near_th")
