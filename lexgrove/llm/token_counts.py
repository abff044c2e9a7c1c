"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a batch are one ragged array of symbols. A round finds each sequence's
lowest-rank pair, merges all its occurrences from the left at once, and drops the sequences
that have no pair left; the symbols that survive are counted. A merge's result only takes part
in merges of higher rank, so all occurrences of the lowest pair go before any other pair, as
when they are merged one by one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 512
CACHE = 500_000  # pieces whose counts a worker keeps
#: Fixed value: how a byte-level tokenizer cuts text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: printable ones stand for themselves."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


class Merges:
    """Vocabulary, merges and special strings of a tokenizer file, and counts by piece."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.start = np.array([vocab[c] for c in _byte_letters()], np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(PATTERN)
        self.first: dict[str, int] = {}
        self.after_space: dict[str, int] = {}

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that each non-empty pre-token is merged to."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        counts, none = sizes.copy(), np.int64(len(self.result))
        symbols = self.start[np.frombuffer(b"".join(tokens), np.uint8)]
        own = np.repeat(np.arange(len(tokens)), sizes)
        while len(symbols) > 1:
            key = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.append(np.where((self.keys[at] == key) & (own[:-1] == own[1:]), self.ranks[at], none), none)
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(own)))
            low = np.repeat(least, lengths)
            hit = (rank == low) & (low < none)
            # of a run of overlapping hits every second one is taken, from the left
            run = np.flatnonzero(hit & ~np.append(False, hit[:-1]))
            since = np.arange(len(hit)) - np.repeat(np.append(0, run), np.diff(np.append(np.append(0, run), len(hit))))
            hit &= since % 2 == 0
            symbols = np.where(hit, self.result[np.minimum(rank, none - 1)], symbols)
            gone = np.append(False, hit[:-1])
            counts -= np.bincount(own[gone], minlength=len(tokens))
            stay = ~gone & np.repeat(least < none, lengths)
            symbols, own = symbols[stay], own[stay]
        return counts

    def _learn(self, pieces: list[str], space: str, known: dict[str, int]) -> None:
        cut = [self.split.findall(space + p) for p in pieces]
        distinct = {t: None for c in cut for t in c}
        found = dict(zip(distinct, self.count([t.encode("utf-8", "surrogatepass") for t in distinct]).tolist(), strict=True)) if distinct else {}
        known.update((p, sum(map(found.__getitem__, c))) for p, c in zip(pieces, cut, strict=True))

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. What stands between single spaces is cut independently, and is counted once."""
        total, spans = [0] * len(texts), []
        for i, t in enumerate(texts):
            parts = self.special.split(t) if self.special else [t]
            total[i] += len(parts) - 1
            spans += [(i, p.split(" ")) for p in parts if p]
        if len(self.first) + len(self.after_space) > CACHE:
            self.first.clear()
            self.after_space.clear()
        odd = lambda w: not w or w[0].isspace() or w[-1].isspace()  # noqa: E731  white space next to the space: no independent pieces
        large: dict[str, int] = {}
        for known, space, words in ((self.first, "", {w[0] for _, w in spans}), (self.after_space, " ", {x for _, w in spans for x in w[1:]})):
            fresh = words.difference(known)
            known.update((w, -1) for w in fresh if odd(w))
            self._learn([w for w in fresh if not odd(w)], space, known)
        for i, words in spans:
            counts = [self.first[words[0]], *map(self.after_space.__getitem__, words[1:])]
            if min(counts) < 0:
                whole = self.split.findall(" ".join(words))
                if fresh := list({t for t in whole if t not in large}):
                    large.update(zip(fresh, self.count([t.encode("utf-8", "surrogatepass") for t in fresh]).tolist(), strict=True))
                total[i] += sum(map(large.__getitem__, whole))
            else:
                total[i] += sum(counts)
        return total


_merges: dict[str, Merges] = {}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of docs.

    Counts are those of the library for that file, without special tokens at the ends; special
    strings in a text count as one token. Null text is empty and has 0 tokens; repeated rows and
    null ids are rows like others; other columns play no part. path is read on every executor.
    """
    path = path or tokenizer_path()
    own = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _merges:
            _merges[path] = Merges(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = [t or "" for t in b.column(1).to_pylist()]
                sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                n = _merges[path].count_texts(texts)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc", "n_bytes", "n_tokens", "over_limit"])

    out = own.mapInArrow(run, f"doc {dict(own.dtypes)['doc']}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("doc", id_col)
