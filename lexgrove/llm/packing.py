"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

Documents are dealt to partitions by a hash and cut there into groups of bounded token count.
A group is packed by itself: whole documents, largest first, each into the first sequence with
room; the tree over the sequences' free room finds it in logarithmic time. A document longer
than a sequence gives full sequences and a rest. The emptiest sequences then are cut up to fill
the others' gaps, and what is left over goes into sequences whose lengths are powers of two,
which need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
GROUP_TOKENS = 2_000_000
END_ID = 1
CACHE = 1_400_000  # words whose ids a worker keeps
_MARK = "|"
_ODD = re.compile("[\x1c-\x1f]")  # white space to Python, not to the tokenizer
_words: dict[str, dict[str, bytes]] = {}
_tokenizers: dict = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def _id_type(path: str) -> str:
    """Two bytes hold an id if the vocabulary is small enough."""
    return "<u2" if _tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def _encode_words(words: list[str], path: str) -> list[bytes]:
    """Ids of runs without white space; many go to the library as one text, parted by a mark that none of them has."""
    tok, kind = _tokenizer(path), _id_type(path)
    (mark,) = tok.encode(_MARK, add_special_tokens=False).ids
    size, out = np.dtype(kind).itemsize, []
    lists = [words[i : i + 256] for i in range(0, len(words), 256)]
    for part, e in zip(lists, tok.encode_batch_fast([f" {_MARK} ".join(x) for x in lists], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, kind)
        ends = np.flatnonzero(ids == mark)
        if len(ends) != len(part) - 1:
            raise ValueError("the mark is no token of its own")
        whole, ends = ids.tobytes(), ends * size
        out += [whole[a:b] for a, b in zip([0, *(ends + size).tolist()], [*ends.tolist(), len(whole)], strict=True)]
    return out


def encode(texts: list[str], path: str) -> list[bytes]:
    """Token ids, little-endian, of each text, as the library gives them without special tokens.

    The tokenizer takes lower case and treats what stands between white space, and letters and
    the comma or full stop after them, independently. So each distinct run is tokenized once, and
    its ids are kept by the worker. Runs with the parting mark or of many characters are not kept.
    """
    tok, kind, known = _tokenizer(path), _id_type(path), _words.setdefault(path, {})
    if len(known) > CACHE:
        known.clear()
    get = known.get
    found: list[list[bytes | None] | None] = []
    fresh: dict[str, list[tuple[int, int]]] = {}
    for i, t in enumerate(texts):
        if _ODD.search(t):
            found.append(None)
            continue
        found.append(own := list(map(get, words := t.split())))
        if None in own:
            for k, x in enumerate(own):
                if x is None:
                    fresh.setdefault(words[k], []).append((i, k))
    bases: dict[str, bytes] = {}
    plain: dict[str, tuple[str, str]] = {}
    once: dict[str, bytes] = {}
    for w in fresh:
        if len(w) > 40 or _MARK in w:
            once[w] = np.array(tok.encode(w, add_special_tokens=False).ids, kind).tobytes()
            continue
        low = w if "Σ" in w else w.lower()
        tail = low[-1] if low[-1] in ",." and low[:-1].isalpha() else ""
        plain[w] = (base := low[:-1] if tail else low), tail
        bases[base] = b""
    bases = {w: known.get(w) or b"" for w in bases}
    todo = [w for w, ids in bases.items() if not ids]
    bases.update(zip(todo, _encode_words(todo, path), strict=True))
    tails = {t: np.array(tok.encode(t, add_special_tokens=False).ids, kind).tobytes() for t in ("", ",", ".")}
    known.update((w, bases[base] + tails[tail]) for w, (base, tail) in plain.items())
    for w, places in fresh.items():
        ids = known.get(w) or once.get(w, b"")
        for i, k in places:
            found[i][k] = ids
    return [np.array(tok.encode(t, add_special_tokens=False).ids, kind).tobytes() if own is None else b"".join(own) for t, own in zip(texts, found, strict=True)]


class Tournament:
    """Free room of `size` bins; finds the first with enough."""

    def __init__(self, size: int, room: int) -> None:
        self.leaves = 1 << max(0, size - 1).bit_length()
        self.best = [room] * (2 * self.leaves)

    def place(self, n: int) -> int:
        """Takes n from the first bin with that much room and returns the bin."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < n:
                at += 1
        bin_, best[at] = at - self.leaves, best[at] - n
        while at > 1:
            at //= 2
            a, b = best[2 * at], best[2 * at + 1]
            best[at] = a if a >= b else b
        return bin_


def pack(sizes: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document number, start, length) for documents of these sizes, each at least 1.

    All sequences have `length` tokens, but for the last of a group, whose lengths are powers of two.
    """
    full = [[(d, k, length)] for d, n in enumerate(sizes) for k in range(0, n - n % length, length)]
    rest = sorted(((n % length, d) for d, n in enumerate(sizes) if n % length), key=lambda x: (-x[0], x[1]))
    tree = Tournament(len(rest), length)
    bins: list[list[tuple[int, int, int]]] = []
    for n, d in rest:
        if (k := tree.place(n)) == len(bins):
            bins.append([])
        bins[k].append((d, sizes[d] - n, n))
    used = [sum(p[2] for p in b) for b in bins]
    open_ = sorted((k for k in range(len(bins)) if used[k] < length), key=lambda k: (-used[k], k))
    full += [bins[k] for k in range(len(bins)) if used[k] == length]
    i, j = 0, len(open_) - 1
    while i < j:  # the emptiest open sequence fills the fullest
        to, of = open_[i], open_[j]
        d, start, n = bins[of].pop()
        take = min(n, length - used[to])
        bins[to].append((d, start, take))
        used[to], used[of] = used[to] + take, used[of] - take
        if take < n:
            bins[of].append((d, start + take, n - take))
        if used[to] == length:
            full.append(bins[to])
            i += 1
        if not used[of]:
            j -= 1
    for k in open_[i : j + 1]:
        left, pieces = used[k], bins[k][::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            row, room = [], size
            while room:
                d, start, n = pieces.pop()
                take = min(n, room)
                row.append((d, start, take))
                room -= take
                if take < n:
                    pieces.append((d, start + take, n - take))
            full.append(row)
            left -= size
    return full


def spread(deal: np.ndarray) -> np.ndarray:
    """Where rows are dealt to: equal ones of a batch to places of their own. Equal rows can take each other's place, so their order doesn't matter."""
    order = np.argsort(deal, kind="stable")
    first = np.flatnonzero(np.append(True, deal[order][1:] != deal[order][:-1])) if len(deal) else order
    nth = np.empty(len(deal), np.int64)
    nth[order] = np.arange(len(deal)) - np.repeat(first, np.diff(np.append(first, len(deal))))
    return (deal.view(np.uint64) + nth.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _tokens(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    end = np.array([END_ID], _id_type(path)).tobytes()
    for whole in batches:
        whole = whole.set_column(2, "deal", pa.array(spread(whole.column(2).to_numpy())))
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            ids = [x + end for x in encode([t or "" for t in b.column(1).to_pylist()], path)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ids, pa.binary())], names=["doc", "deal", "ids"])


def _packed(batches: Iterator[pa.RecordBatch], length: int, group_tokens: int, path: str) -> Iterator[pa.RecordBatch]:
    ids_type = _id_type(path)
    done, docs, ids, size, kind = TaskContext.get().partitionId() << 33, [], [], 0, None

    def flush() -> pa.RecordBatch:
        nonlocal done, docs, ids, size
        out: list[tuple] = []
        for row in pack(list(map(len, ids)), length):
            offset = 0
            for d, start, n in row:
                out.append((docs[d], start, n, zlib.crc32(ids[d][start : start + n].astype("<u4")), len(ids[d]), done, offset))
                offset += n
            done += 1
        docs, ids, size = [], [], 0
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    for b in batches:
        kind = b.column(0).type
        for doc, x in zip(b["doc"].to_pylist(), b["ids"].to_pylist(), strict=True):
            docs.append(doc)
            ids.append(np.frombuffer(x, ids_type))
            size += len(ids[-1])
            if size >= group_tokens:
                yield flush()
    if docs:
        yield flush()


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents, each token in one piece.

    A document is its text's ids and END_ID; null text is empty, so it still has one token. A
    task holds one group: group_tokens and at most one document more. Repeated rows and null ids
    are documents like others, and a row that repeats very often is dealt out to many tasks; other columns play no part. No documents give no rows.
    """
    path = path or tokenizer_path()
    deal = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    own = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"), deal.alias("deal"))
    kind = dict(own.dtypes)["doc"]
    tokens = own.mapInArrow(lambda it: _tokens(it, path), f"doc {kind}, deal long, ids binary")
    dealt = tokens.repartition("deal").sortWithinPartitions("deal")
    out = dealt.mapInArrow(lambda it: _packed(it, length, group_tokens, path), f"doc {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("doc", id_col)
