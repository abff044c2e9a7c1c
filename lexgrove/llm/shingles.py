"""Sets of word shingles as hashes."""

from __future__ import annotations

import numpy as np
import xxhash


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """(n, 2) XXH3 halves of the distinct word shingles, by the first half; a shorter text is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return np.empty((0, 2), np.uint64)
    whole, digest = b" ".join(words), xxhash.xxh3_128_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[width - 1 :] - 1).tolist() if len(words) > width else [len(whole)]
    h = np.frombuffer(b"".join([digest(whole[a:b], 42) for a, b in zip(starts, stops, strict=True)]), np.uint64).reshape(-1, 2)
    return h[np.unique(h[:, 0], return_index=True)[1]]
