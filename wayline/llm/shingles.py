"""Word shingles of one text and their XXH64 hashes (small helpers that run inside tasks)."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash

SEED = 42


def shingle_digests(words: list[bytes], width: int) -> np.ndarray:
    """Big-endian XXH64 digests, one row of 8 bytes for every shingle in order, repeats included.

    Fewer words than ``width`` make one shingle; no word makes none.
    """
    if not words:
        return np.empty((0, 8), np.uint8)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_digest
    if len(words) < width:
        made = digest(joined, SEED)
    else:
        made = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[width - 1 :])])
    return np.frombuffer(made, np.uint8).reshape(-1, 8)
