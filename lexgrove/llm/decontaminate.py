"""Benchmark decontamination: BM25 inverted index of test items, queried by every passage with block-max WAND.

Items are the documents of the index and a passage's distinct words the query. Impacts are
divided by the item's score for itself, so one threshold serves all items. Posting lists are cut
into blocks at the same item numbers, and each block of a list knows its largest impact. A batch
of passages sums these maxima for all blocks by arrays; a block that can't reach the threshold is
skipped as a whole. In the others WAND walks the lists: the pivot is the first item at which
the list maxima of the block add up to the threshold, and only pivots are scored. Every item at
or above the threshold is then verified by the overlap of its question and answer with the
passage. The index holds a bounded number of item words; more items are indexed in shards, one
pass over the documents each.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.65  # of the item's score for itself
OVERLAP = 0.8  # of the question's words, in runs that the passage has
ANSWER_OVERLAP = 0.5  # of the answer's distinct words
RUN = 3  # words of such a run
CELLS = 4_000_000  # passages times blocks and common terms that are bounded together
ANSWER_WORDS = 8
BLOCK = 4
COMMON = 8  # blocks from which on a term is summed by a matrix product
INDEX_WORDS = 400_000  # item words in one shard of the index, and so in a broadcast
K1, B = 1.2, 0.75


def words_of(texts: pa.Array) -> pa.ListArray:
    """Lower-case runs of letters and digits of each text."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}\p{N}]+", " ")
    return pc.split_pattern(pc.utf8_trim(plain, " "), " ")


def shingles(words: list[str], width: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


class Index:
    """Posting lists by block and term number: items ascending, impacts, and the block's largest impact of each list."""

    def __init__(self, items: list[tuple[int, list[str]]], df: dict[str, int], n_items: int, mean_words: float, threshold: float) -> None:
        # items that share common words, as those of one language do, get neighbouring numbers: bounds of blocks are closer
        self.items = sorted(((i, w) for i, w in items if w), key=lambda x: (sorted(set(x[1]), key=lambda t: (-df[t], t))[:3], x[0]))
        self.threshold = threshold - 1e-9
        raw: dict[str, list[tuple[int, float]]] = {}
        for k, (_, words) in enumerate(self.items):
            own = {t: np.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean_words)) for t, f in Counter(words).items()}
            total = sum(own.values())
            for t, x in own.items():
                raw.setdefault(t, []).append((k, float(x / total)))
        self.terms = sorted(raw)
        self.longest = max((len(w) for _, w in self.items), default=0)
        self.n_blocks = -(-len(self.items) // BLOCK)
        self.blocks: list[dict[int, tuple[list[int], list[float], float]]] = [{} for _ in range(self.n_blocks)]
        at, block, most = [0], [], []
        for t, term in enumerate(self.terms):
            for k, x in raw[term]:
                own, impacts, top = self.blocks[k // BLOCK].get(t, ([], [], 0.0))
                self.blocks[k // BLOCK][t] = ([*own, k], [*impacts, x], max(top, x))
            for n in sorted({k // BLOCK for k, _ in raw[term]}):
                block.append(n)
                most.append(self.blocks[n][t][2])
            at.append(len(block))
        self.at, self.block, self.most = np.array(at), np.array(block, np.int64), np.array(most)
        common = np.flatnonzero(np.diff(self.at) >= COMMON)
        self.common = np.full(len(self.terms) + 1, -1)
        self.common[common] = np.arange(len(common))
        self.table = np.zeros((len(common), self.n_blocks), np.float32)
        for row, t in enumerate(common):
            self.table[row, self.block[self.at[t] : self.at[t + 1]]] = self.most[self.at[t] : self.at[t + 1]]
        self.parts = []
        for _, w in self.items:
            cut = max(len(w) - ANSWER_WORDS, (len(w) + 1) // 2)
            self.parts.append((w[:cut], set(w[cut:])))

    def bounds(self, cells: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """(n, blocks): the most that any item of a block can score for each of n passages, from (passage, term) pairs."""
        often = self.common[terms] >= 0
        has = np.zeros((n, len(self.table)), np.float32)
        has[cells[often], self.common[terms[often]]] = 1
        out = (has @ self.table).astype(np.float64)
        rare = np.unique(cells[~often] * (len(self.terms) + 1) + terms[~often])
        cell, term = rare // (len(self.terms) + 1), rare % (len(self.terms) + 1)
        sizes = self.at[term + 1] - self.at[term]
        each = np.repeat(self.at[term] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        out.ravel()[:] += np.bincount(np.repeat(cell, sizes) * self.n_blocks + self.block[each], self.most[each], out.size)
        return out

    def wand(self, query: set[int], block: int) -> list[tuple[int, float]]:
        """All (item, score) of a block at or above the threshold for a set of term numbers."""
        lists = self.blocks[block]
        cursors = [[own[0], 0, own, impacts, most] for t in query if t in lists for own, impacts, most in (lists[t],)]
        out = []
        while cursors:
            cursors.sort(key=itemgetter(0))
            bound, pivot = 0.0, -1
            for n, c in enumerate(cursors):
                bound += c[4]
                if bound >= self.threshold:
                    pivot = n
                    break
            if pivot < 0:
                break
            item, score, alive = cursors[pivot][0], 0.0, []
            for c in cursors:
                if c[0] <= item:
                    at = bisect_left(c[2], item, c[1])
                    if at < len(c[2]) and c[2][at] == item:
                        score += c[3][at]
                        at += 1
                    if at == len(c[2]):
                        continue
                    c[0], c[1] = c[2][at], at
                alive.append(c)
            if score >= self.threshold:
                out.append((item, score))
            cursors = alive
        return out

    def verify(self, item: int, passage: list[str]) -> tuple[float, float]:
        """Shares of the question's words that stand in runs of RUN words which the passage has, and of the answer's distinct words that it has."""
        question, answer = self.parts[item]
        width = min(RUN, len(question))
        have = shingles(passage, width)
        covered = {k for i in range(len(question) - width + 1) if tuple(question[i : i + width]) in have for k in range(i, i + width)}
        return len(covered) / len(question), len(answer & set(passage)) / len(answer) if answer else 1.0

    def search(self, offsets: np.ndarray, ids: np.ndarray, words: pa.Array) -> Iterator[tuple[int, int, int, float, float, float]]:
        """(document, first word, item, score, question, answer) for passages of all documents; ids: the words' term numbers, -1 for others.

        As many passages are bounded together as CELLS allows, however long the documents are.
        """
        half = max(64, self.longest)  # a passage has two halves and starts at each half: every item fits in one
        lengths = np.diff(offsets)
        cells = -(-lengths // half)
        first = np.concatenate(([0], np.cumsum(cells)))
        known = np.flatnonzero(ids >= 0)
        doc = np.searchsorted(offsets, known, side="right") - 1
        part = (known - offsets[doc]) // half
        cell = first[doc] + part  # ascending
        step = max(1, CELLS // (self.n_blocks + len(self.table) + 1))
        for low in range(0, int(first[-1]), step):
            high = min(low + step, int(first[-1]))
            a, z = np.searchsorted(cell, (low, high + 1))  # a passage also has the words of the next half of its document
            own, terms, p = cell[a:z], ids[known[a:z]], part[a:z]
            inside, also = own < high, (p > 0) & (own > low)
            bounds = self.bounds(np.concatenate((own[inside], own[also] - 1)) - low, np.concatenate((terms[inside], terms[also])), high - low)
            yield from self._walk(low, bounds, first, offsets, half, ids, words)

    def _walk(self, low: int, bounds: np.ndarray, first: np.ndarray, offsets: np.ndarray, half: int, ids: np.ndarray, words: pa.Array) -> Iterator[tuple[int, int, int, float, float, float]]:
        last, query, a, b, d = -1, set(), 0, 0, 0
        for c, block in zip(*np.nonzero(bounds >= self.threshold - 1e-5), strict=True):
            if c != last:
                last, d = c, int(np.searchsorted(first, low + c, side="right")) - 1
                a = int(offsets[d] + (low + c - first[d]) * half)
                b = min(a + 2 * half, int(offsets[d + 1]))
                query = set(ids[a:b].tolist())
            for item, score in self.wand(query, block):
                yield d, a - int(offsets[d]), item, score, *self.verify(item, words[a:b].to_pylist())


def _shards(items: DataFrame, id_col: str, text_col: str, threshold: float) -> Iterator[Index]:
    """Indexes of at most INDEX_WORDS words each, or of one item; statistics are those of all items."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["item"], words_of(b["text"])], names=["item", "words"])

    tokens = items.select(F.col(f"`{id_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL AND item IS NOT NULL").distinct().mapInArrow(split, "item long, words array<string>")
    n_items, n_words = tokens.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    if not n_words:
        return
    shards = -(-n_words // INDEX_WORDS)
    df = tokens.select("item", F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for k in range(shards):
        own = tokens.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == k)
        here = own.select(F.explode("words").alias("term")).distinct()
        yield Index(sorted((r["item"], [w for w in r["words"] if w]) for r in own.collect()), {r["term"]: r["df"] for r in df.join(here, "term", "left_semi").collect()}, n_items, n_words / n_items, threshold)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, answer_overlap: float = ANSWER_OVERLAP) -> DataFrame:
    """(id, item_id, start_word, score, question_overlap, answer_overlap): the best verified passage of each document for each item it holds.

    The answer is an item's last ANSWER_WORDS words, at most half of it, the question the rest.
    A passage is verified if `overlap` of the question's words stand in runs of three words (or
    all, if there are fewer) that the passage has, and it has `answer_overlap` of the answer's
    words: a replaced word costs itself and what it leaves alone. Null or empty texts, and
    items without words, match nothing; repeated rows count once; ties between passages go to
    the first. No documents or no items give no rows. Rows with a null id can't be named and are left out.
    """
    own = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    kind = dict(own.dtypes)["doc"]
    schema = f"doc {kind}, item_id long, start_word long, score double, question_overlap double, answer_overlap double"
    out = None
    for index in _shards(items, item_id_col, item_text_col, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            terms = pa.array(index.terms, pa.string())
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    b = whole.slice(at, 500)
                    words = words_of(b.column(1))
                    offsets = words.offsets.to_numpy().astype(np.int64)
                    flat = words.values
                    ids = pc.fill_null(pc.index_in(flat, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                    hits = [h for h in index.search(offsets, ids, flat) if h[4] >= overlap and h[5] >= answer_overlap]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([h[0] for h in hits], pa.int64())), pa.array([index.items[h[2]][0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64()), *(pa.array([float(h[k]) for h in hits], pa.float64()) for k in (3, 4, 5))], names=["doc", "item_id", "start_word", "score", "question_overlap", "answer_overlap"])

        found = own.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    rank = F.struct("question_overlap", "answer_overlap", "score", (-F.col("start_word")).alias("s"))
    best = out.groupBy("doc", "item_id").agg(F.max(rank).alias("best"))
    return best.select(F.col("doc").alias(id_col), "item_id", (-F.col("best.s")).alias("start_word"), "best.score", "best.question_overlap", "best.answer_overlap")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the documents that hold an item; all columns and all other rows stay.

    Documents are known by a digest of their text, so rows without id or with a repeated one are
    judged like any other.
    """
    digest = F.md5(F.col(f"`{text_col}`").cast("binary"))
    found = contaminated(docs.select(digest.alias("_leak"), F.col(f"`{text_col}`").alias("text")), items, "_leak").select("_leak").distinct()
    some = docs.where(F.col(f"`{text_col}`").isNotNull()).withColumn("_digest", digest).join(found, F.col("_digest") == F.col("_leak"), "left_anti").drop("_digest")
    return some.unionByName(docs.where(F.col(f"`{text_col}`").isNull()))  # these hold nothing and need no shuffle
