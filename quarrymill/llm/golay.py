"""The binary Golay code [23, 12, 7]: for any 23-bit word the indices of all codewords within four bits of it.

The code is perfect, so a word is either within two bits of one codeword (that one is the only one within four bits),
or exactly three bits from one and four bits from five others. Two words that differ in at most two bits always share
one of these codewords: the word between them lies within three bits of a codeword, and each end within four.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
WORD_BITS, INDEX_BITS = 23, 12


def syndromes(words: np.ndarray) -> np.ndarray:
    """The remainder of each word by the generator: 11 bits, zero for codewords."""
    rest = words.astype(np.int64)
    for bit in range(WORD_BITS - 1, WORD_BITS - INDEX_BITS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@lru_cache(maxsize=1)
def error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes the errors of up to four bits that make it: six columns, and how many hold."""
    errors = np.array([sum(1 << i for i in c) for n in range(5) for c in combinations(range(WORD_BITS), n)])
    weight = np.array([n for n in range(5) for _ in combinations(range(WORD_BITS), n)])
    found = syndromes(errors)
    order = np.lexsort((weight, found))
    found, errors, weight = found[order], errors[order], weight[order]
    first = np.searchsorted(found, np.arange(2048))
    count = np.where(weight[first] <= 2, 1, 6)
    table = errors[np.minimum(first[:, None] + np.arange(6), len(errors) - 1)]
    return table, count


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(indices, count)``: for each word the 12-bit indices of the codewords near it, ``count`` of six columns hold."""
    table, count = error_patterns()
    s = syndromes(words)
    return (words.astype(np.int64)[:, None] ^ table[s]) >> 11, count[s]
