"""Nearby codewords of the binary Golay code of length 23.

The code is perfect: each 23-bit vector is within 3 bits of exactly one of the
4,096 codewords. list_keys() gives, for each vector, the 12-bit indices of all
codewords within 4 bits: one, if the nearest is within 2 bits, else six. Any
two vectors that differ in at most 2 bits have one of these in common.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, INFO = 23, 12
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101


def _syndrome(v: int) -> int:
    for bit in range(LENGTH - 1, LENGTH - INFO - 1, -1):
        if v >> bit & 1:
            v ^= GENERATOR << (bit - (LENGTH - INFO))
    return v


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of the upper 12 bits; error masks per syndrome, -1 where none."""
    upper = np.array([_syndrome(x << (LENGTH - INFO)) for x in range(1 << INFO)], np.int64)
    masks = np.full((1 << (LENGTH - INFO), 6), -1, np.int64)
    held = np.zeros(len(masks), np.int64)
    unit = [_syndrome(1 << b) for b in range(LENGTH)]
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            s = 0
            for b in bits:
                s ^= unit[b]
            if weight == 4 and held[s] == 1 and bin(int(masks[s, 0])).count("1") != 3:
                continue
            masks[s, held[s]] = sum(1 << b for b in bits)
            held[s] += 1
    return upper, masks


def list_keys(vectors: np.ndarray) -> np.ndarray:
    """Shape (n, 6): indices of the codewords within 4 bits, -1 for none."""
    upper, masks = _tables()
    v = vectors.astype(np.int64)
    low = (1 << (LENGTH - INFO)) - 1
    errors = masks[upper[v >> (LENGTH - INFO)] ^ (v & low)]
    return np.where(errors >= 0, (v[:, None] ^ errors) >> (LENGTH - INFO), -1)
