"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from gridloom.llm.base import LOWER, ByteHash, Piece, mix, word_spans

_C = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(piece: Piece, size: int) -> list[np.ndarray]:
    """For each row, the hashes of its distinct shingles of `size` words, ascending. A-Z count
    as a-z; a row with fewer words has its whole sequence as one shingle, one without none."""
    s, e, first = word_spans(piece)
    out = [np.zeros(0, np.uint64)] * len(piece)
    if not len(s):
        return out
    words = ByteHash(LOWER[piece.data]).of(s, e)
    n = len(words)
    h = words.copy()
    for k in range(1, size):
        h[: n - k] = mix(h[: n - k] * _C + words[k:])
    for r in range(len(piece)):
        a, b = int(first[r]), int(first[r + 1])
        if b - a >= size:
            x = np.sort(h[a : b - size + 1])
            out[r] = x[np.append(True, x[1:] != x[:-1])]
        elif b > a:
            short = words[a : a + 1]
            for k in range(a + 1, b):
                short = mix(short * _C + words[k : k + 1])
            out[r] = mix(short + np.uint64(b - a))
    return out


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    return int(mix(hashes).sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mix(hashes * _C)).astype(np.int64)) if len(hashes) else 0
