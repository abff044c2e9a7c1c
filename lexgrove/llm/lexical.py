"""Ranked lexical search by norm buckets, as LEMP does for inner products.

A document's impact vector holds what each of its terms adds to a score, before the term's weight; an
item's vector holds its terms' weights times how often it has them. The score is their inner
product. Documents are put in order of the length of their vectors and cut into buckets. By
Cauchy-Schwarz no document of a bucket scores more than the item's length times the longest
vector of the bucket, so buckets that can't reach the item's `top`-th score so far are passed
over. Inside a bucket, the item's largest coordinates are the focus: as few of them as leave a rest so short that
a document without any of them can't qualify. Documents with a focus term are bounded by
their exact sum over the focus plus the rests' lengths, and those that survive are scored
exactly in integers. A first search among the longest vectors gives every task a threshold to
begin with.

Items are indexed in shards of bounded size; each shard is a pass over the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.llm.common import cut

TOP = 20
SHARD_CHARS = 2_000_000  # characters of items whose index one task holds
BUCKET = 4096  # documents
SEEDS = 8192  # of the longest vectors, for the first thresholds
SLACK = 1 + 1e-9  # of bounds in doubles

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII; A-Z alone is lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Item:
    """An item's terms, largest weight times count first; rest[j] is the length of its vector from the j-th on."""

    terms: np.ndarray
    weights: np.ndarray
    rest: np.ndarray


def _vectors(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """(rid, n, t, tf) for documents with a term: how many terms, and those of the vocabulary with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value.get
        for b in batches:
            keep, n, ids, counts = [], [], [], []
            for i, text in enumerate(b["text"]):
                ws = terms(text.as_py())
                if ws:
                    t, tf = np.unique(np.array([k for w in ws if (k := known(w)) is not None], np.int32), return_counts=True)
                    keep.append(i)
                    n.append(len(ws))
                    ids.append(t)
                    counts.append(tf)
            size = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate(x).astype(kind) if x else np.empty(0, kind))) for x, kind in ((ids, np.int32), (counts, np.int64))]
            yield pa.RecordBatch.from_arrays([b["rid"].take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists], names=["rid", "n", "t", "tf"])

    return docs.select("rid", "text").mapInArrow(run, "rid long, n long, t array<int>, tf array<long>")


class Searched:
    """The best documents so far of each item, and the score that a further one has to reach."""

    def __init__(self, items: list[Item], least: np.ndarray, top: int) -> None:
        self.items, self.top = items, top
        self.length = np.array([x.rest[0] for x in items])
        self.least = least.copy()
        self.best: dict[int, tuple[np.ndarray, ...]] = {}

    def bucket(self, rid: np.ndarray, known: np.ndarray, owner: np.ndarray, t: np.ndarray, impact: np.ndarray) -> None:
        """One bucket: ids (known: not null), and for each entry its document's place, term and impact."""
        n = len(rid)
        square = np.bincount(owner, impact.astype(float) ** 2, n)
        longest = math.sqrt(square.max(initial=0))
        order = np.argsort(t, kind="stable")
        t, owner, impact = t[order], owner[order], impact[order]
        for i in np.flatnonzero(self.length * longest * SLACK >= self.least).tolist():
            item = self.items[i]
            start, end = np.searchsorted(t, item.terms), np.searchsorted(t, item.terms, side="right")
            focus = max(1, int((item.rest * longest * SLACK >= self.least[i]).sum()))  # rests fall; one past the last term is 0
            focus = min(focus, len(item.terms))
            entries = np.concatenate([np.arange(a, b) for a, b in zip(start[:focus], end[:focus], strict=True)])
            if not len(entries):
                continue
            who, own = owner[entries], impact[entries]
            weight = np.repeat(item.weights[:focus], (end - start)[:focus])
            sums, used = np.bincount(who, weight * own.astype(float), n), np.bincount(who, own.astype(float) ** 2, n)
            bound = (sums + item.rest[focus] * np.sqrt(np.maximum(square - used, 0))) * SLACK
            alive = (used > 0) & (bound >= self.least[i])
            if not alive.any():
                continue
            score = np.zeros(n, np.int64)
            for a, b, w in zip(start.tolist(), end.tolist(), item.weights.tolist(), strict=True):
                mine = alive[owner[a:b]]
                score[owner[a:b][mine]] += w * impact[a:b][mine]  # a document has a term once
            self._offer(i, rid, known, score, np.flatnonzero(alive & (score >= self.least[i])))

    def _offer(self, i: int, rid: np.ndarray, known: np.ndarray, score: np.ndarray, at: np.ndarray) -> None:
        old = self.best.get(i, (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)))
        ids, has, scores = (np.concatenate(x) for x in zip(old, (rid[at], known[at], score[at]), strict=True))
        order = np.lexsort((ids, has, -scores))[: self.top]
        self.best[i] = ids[order], has[order], scores[order]
        if len(order) == self.top:
            self.least[i] = max(self.least[i], scores[order[-1]])

    def rows(self) -> Iterator[pa.RecordBatch]:
        for i, (ids, has, scores) in self.best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i, np.int32)), pa.array(ids, mask=~has), pa.array(scores)], names=["item", "rid", "score"])


def _search(vectors: DataFrame, items: Broadcast, least: Broadcast, top: int) -> DataFrame:
    """(item, rid, score): each task's best documents of each item; rows (rid, m, t, tf) come longest vector first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Searched(items.value, least.value, top)
        for b in batches:
            for part in (b.slice(i, BUCKET) for i in range(0, b.num_rows, BUCKET)):
                size = part["t"].value_lengths().to_numpy()
                owner = np.repeat(np.arange(len(size)), size)
                tf, m = part["tf"].flatten().to_numpy(), part["m"].to_numpy()
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[owner])
                known = part["rid"].is_valid().to_numpy(zero_copy_only=False)
                found.bucket(part["rid"].fill_null(0).to_numpy(), known, owner, part["t"].flatten().to_numpy(), impact)
        yield from found.rows()

    return vectors.select("rid", "m", "t", "tf").mapInArrow(run, "item int, rid long, score long")


def _first(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("rid"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _shard(docs: DataFrame, texts: list[str], top: int) -> DataFrame | None:
    """(item, rid, score, rank): item is a place in texts."""
    sc = docs.sparkSession.sparkContext
    own = [Counter(terms(x)) for x in texts]
    vocabulary = {w: k for k, w in enumerate(sorted({w for c in own for w in c}))}
    vectors = cut(_vectors(docs, sc.broadcast(vocabulary)))
    n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    df = dict(vectors.select(F.explode("t").alias("t")).groupBy("t").count().collect())  # no more rows than the shard has terms
    items = []
    for c in own:
        t = np.array([vocabulary[w] for w in c if df.get(vocabulary[w])], np.int32)
        times = np.array([k for w, k in c.items() if df.get(vocabulary[w])], np.int64)
        weights = times * np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[k] + 1))) for k in t.tolist()], np.int64)
        order = np.argsort(-weights, kind="stable")
        order = order[weights[order] > 0]
        rest = np.sqrt(np.append(np.cumsum(weights[order][::-1].astype(float) ** 2)[::-1], 0.0))
        items.append(Item(t[order], weights[order], rest))
    if not any(len(x.terms) for x in items):
        return None
    m = F.expr(f"75L + (25L * n * {n_docs}L) div {n_terms}L")
    norm = F.expr("aggregate(tf, 0D, (s, x) -> s + pow((1000000000L * x) div (1000L * x + 12L * m), 2))")
    some = cut(vectors.where(F.size("t") > 0).select("rid", m.alias("m"), "t", "tf").withColumn("norm", norm))
    held, none = sc.broadcast(items), np.array([1 if len(x.terms) else 2**62 for x in items], np.int64)
    seeds = some.orderBy(F.col("norm").desc(), "rid").limit(SEEDS)
    least = none.copy()
    for item, score in _first(_search(seeds, held, sc.broadcast(none), top), top).where(F.col("rank") == top).select("item", "score").collect():  # a row for each item of the shard
        least[item] = score
    key = (F.col("norm").desc(), F.xxhash64("rid", "m"))  # equal vectors are dealt out, too
    ordered = some.repartitionByRange(*key).sortWithinPartitions(*key)
    return _first(_search(ordered, held, sc.broadcast(least), top), top)


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(item, rank, id, score): the `top` documents of each item by score, equal scores by ascending id; only scores above 0.

    The score is that of `terms`: w = floor(1000 ln((2 N + 2) / (2 df + 1))) for each term of the item, repeats
    included, times (10^9 tf) div (1000 tf + 12 m), with m = 75 + (25 n N) div L; N documents with
    a term, L terms of all, n of the document, all over the whole collection. Ids are integers;
    a null id comes first among equal scores; each row of docs is a document, repeated ones too.
    Item rows that repeat id and text are one item; items without terms and null texts give no
    rows; other columns play no part; no documents or no items give no rows.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("rid"), F.col(f"`{text_col}`").alias("text"))
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")).where("text IS NOT NULL").distinct()
    kind = asked.schema["item_id"].dataType.simpleString()
    asked = cut(asked.withColumn("n_chars", F.length("text")))
    chars = asked.agg(F.sum("n_chars")).first()[0] or 0
    shards = 1 if chars <= shard_chars else -(-2 * chars // shard_chars)  # dealt out by hash, so each is far below the bound
    out = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, rid long, score long")
    for k in range(shards if chars else 0):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).select("item_id", "text").collect()  # bounded by shard_chars
        found = _shard(own, [r["text"] for r in rows], top)
        if found is not None:
            names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {kind}")
            out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "rid", "score"))
    return out.select(F.col("item_id").alias(item_col), "rank", F.col("rid").alias(id_col), "score")
