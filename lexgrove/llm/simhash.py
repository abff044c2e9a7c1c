"""SimHash near-dedup by anchor-point covering.

Two 64-bit fingerprints that differ in at most `distance` bits differ in at most
distance // segments bits of one of `segments` disjoint segments. A segment's anchors are a
covering code of radius 1: a perfect Hamming code on its first 2^m - 1 bits, all values on the
rest. Each fingerprint lives at its own anchor, within the covering radius, and is replicated to
every anchor within radius plus threshold; so of two linked fingerprints one's home gets the
other's replica. Only distinct fingerprints take part. An anchor's homes are salted into groups
of bounded size, replicas stream past them, and a task reports a spanning forest of the links
it finds, which reaches all that the links reach without listing all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import attach, components, cut

SHINGLE = 4
DISTANCE = 4
SEGMENTS = 3
HOMES = 4096  # homes of one anchor that one task holds at once


def fingerprint_text(text: str | None, width: int = SHINGLE) -> int:
    """The 64 majority bits of the XXH64 (seed 42) of all word shingles of the text; 0 if there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(whole, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    n = len(starts)
    h = np.fromiter((digest(whole[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, n)
    ones = sum(np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, n, 1 << 16))
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(docs: DataFrame, text_col: str = "text", width: int = SHINGLE, name: str = "fingerprint") -> DataFrame:
    """docs without its text, with the fingerprint as a long. Null text is empty; an own column of that name is replaced."""
    kept = [c for c in docs.columns if c not in (text_col, name)]
    d = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias("_simhash_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [_signed(fingerprint_text(t, width)) for t in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(own, pa.int64())], names=[*kept, name])

    return d.mapInArrow(run, d.drop("_simhash_text").withColumn(name, F.lit(0).cast("long")).schema)


def _segments(segments: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, m) of each segment; m: its Hamming code has 2^m - 1 bits."""
    cuts = [round(i * 64 / segments) for i in range(segments + 1)]
    return [(a, b - a, (b - a + 1).bit_length() - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _syndrome(x: np.ndarray, m: int) -> np.ndarray:
    """Of the low 2^m - 1 bits; 0 for a code word, else the 1-based bit to turn."""
    out = np.zeros(len(x), np.uint64)
    for bit in range((1 << m) - 1):
        out ^= ((x >> np.uint64(bit)) & np.uint64(1)) * np.uint64(bit + 1)
    return out


def _home(x: np.ndarray, m: int) -> np.ndarray:
    s = _syndrome(x, m)
    return np.where(s > 0, x ^ (np.uint64(1) << np.maximum(s, 1) - np.uint64(1)), x)


def _errors(bits: int, m: int, most: int) -> dict[int, np.ndarray]:
    """Syndrome -> all masks of at most `most` bits that have it: x ^ mask is an anchor if the syndromes agree."""
    masks = np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.uint64)
    s = _syndrome(masks & np.uint64((1 << ((1 << m) - 1)) - 1), m)
    return {k: masks[s == k] for k in range(1 << m)}


def _at_anchors(batches: Iterator[pa.RecordBatch], segments: int, distance: int) -> Iterator[pa.RecordBatch]:
    """(anchor, replica, fp): a fingerprint at its homes and at all anchors within radius 1 plus threshold."""
    plan = [(a, n, m, _errors(n, m, 1 + distance // segments)) for a, n, m in _segments(segments)]
    for b in batches:
        fp = b["fp"].to_numpy().view(np.uint64)
        for k, (first, n, m, errors) in enumerate(plan):
            x, tag = (fp >> np.uint64(first)) & np.uint64((1 << n) - 1), np.int64(k << 40)
            home = _home(x, m)
            s, anchors, who = _syndrome(x, m), [home], [fp]
            for code, masks in errors.items():
                own = np.flatnonzero(s == code)
                anchors.append((x[own][:, None] ^ masks[None, :]).ravel())
                who.append(np.repeat(fp[own], len(masks)))
            size = sum(map(len, who))
            kind = np.ones(size, np.int8)
            kind[: len(fp)] = 0
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors).view(np.int64) + tag), pa.array(kind), pa.array(np.concatenate(who).view(np.int64))], names=["anchor", "replica", "fp"])


class Forest:
    """Joins sets of integers; tells which links joined two."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        up, r = self.up, a
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(a, a)) != r:
            up[a], a = r, p
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, salt, replica): the homes of a group come first and stay, replicas stream past."""
    group, homes = (None, None), np.empty(0, np.uint64)
    forest: Forest = Forest()
    for b in batches:
        anchor, salt, replica, fp = (b[c].to_numpy() for c in ("anchor", "salt", "replica", "fp"))
        fp = fp.view(np.uint64)
        edges = np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1
        found: list[tuple[int, int]] = []
        for i, j in zip([0, *edges], [*edges, len(fp)], strict=True):
            if i == j:
                continue
            if (key := (anchor[i], salt[i])) != group:
                group, homes, forest = key, np.empty(0, np.uint64), Forest()
            mid = i + int(np.searchsorted(replica[i:j], 1))
            if mid > i:
                homes = np.concatenate((homes, fp[i:mid]))
            if not len(homes) or mid == j:
                continue
            for at in range(mid, j, 256):
                near = np.bitwise_count(fp[at : min(at + 256, j), None] ^ homes[None, :]) <= distance
                for x, y in zip(*np.nonzero(near), strict=True):
                    p, q = int(fp[at + x]), int(homes[y])
                    if p != q and forest.join(p, q):
                        found.append((p, q))
        yield pa.RecordBatch.from_arrays([pa.array([_signed(p) for p, _ in found], pa.int64()), pa.array([_signed(q) for _, q in found], pa.int64())], names=["a", "b"])


def links(fingerprints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, homes: int = HOMES) -> DataFrame:
    """(a, b) from a column `fp` of distinct fingerprints: links that join all that differ in at most `distance` bits.

    Not every pair of a large group is listed, but two fingerprints within the distance are
    always joined by the links returned.
    """
    placed = fingerprints.select("fp").mapInArrow(lambda it: _at_anchors(it, segments, distance), "anchor long, replica byte, fp long")
    crowded = placed.where("replica = 0").groupBy("anchor").count().where(F.col("count") > homes).select("anchor", F.ceil(F.col("count") / homes).cast("int").alias("parts"))
    spread = placed.join(cut(crowded), "anchor", "left")
    salts = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("replica") == 0, F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = spread.select("anchor", F.explode(salts).alias("salt"), "replica", "fp").repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "replica")
    return dealt.mapInArrow(lambda it: _links(it, distance), "a long, b long")


def _near(docs: DataFrame, kept: list[str], id_col: str, width: int, distance: int, segments: int) -> DataFrame:
    marked = cut(with_fingerprint(docs.select(*kept, "_simhash_text"), "_simhash_text", width))
    least = marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(F.col(f"`{id_col}`")).alias("least"), F.count("*").alias("n_rows"))
    least = cut(least)
    found = components(links(least, distance, segments))
    joined = cut(least.join(found, least.fp == found.id))
    groups = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    linked = attach(joined.drop("id"), groups, ["root"], joined.count(), "members").drop("root", "least")
    alone = least.join(found, least.fp == found.id, "left_anti").withColumnRenamed("least", "component_id")
    named = linked.unionByName(alone).withColumnRenamed("fp", "fingerprint")
    return attach(marked, named, ["fingerprint"], marked.count()).select(*marked.columns, "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(id, fingerprint long, component_id): component_id is the smallest id reachable over links of at most `distance` bits.

    A row for each row of docs. Null and empty texts have fingerprint 0 and link like any other;
    repeated rows are in one component; null ids never name a component unless all are null;
    other columns of docs play no part. No documents give no rows.
    """
    own = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_simhash_text"))
    return _near(own, [f"`{id_col}`"], id_col, width, distance, segments)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """docs with one document of each component: of the rows with its smallest id, the one of the least text hash.

    All columns pass through. Repeated rows count as one document and one of them stays.
    """
    th = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    own = docs.select(F.col(f"`{id_col}`").alias("_near_id"), F.col(f"`{text_col}`").alias("_simhash_text"), th.alias("_near_th"))
    near = _near(own, ["_near_id", "_near_th"], "_near_id", width, distance, segments)
    stay = near.where(F.col("_near_id").eqNullSafe(F.col("component_id"))).groupBy("_near_id").agg(F.min("_near_th").alias("_stay_th"))
    d = docs.withColumn("_near_th", th)
    kept = d.join(stay, d[f"`{id_col}`"].eqNullSafe(stay["_near_id"]) & (d["_near_th"] == stay["_stay_th"]), "left_semi")
    return kept.dropDuplicates([id_col, "_near_th"]).drop("_near_th")
