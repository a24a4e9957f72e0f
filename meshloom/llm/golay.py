"""The binary Golay code (23, 12): nearest codewords and keys that near words share."""

from __future__ import annotations

import numpy as np

#: The code's generator polynomial, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH, PARITY = 23, 11


def _syndrome(word: int) -> int:
    """The remainder of the word by the generator."""
    for bit in range(LENGTH - 1, PARITY - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - PARITY)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits of a word, and the error (3 bits at most) of each syndrome."""
    single = np.array([_syndrome(1 << i) for i in range(LENGTH)])

    def of(bits: range) -> np.ndarray:
        out = np.zeros(1 << len(bits), np.int64)
        for i, b in enumerate(bits):
            out[1 << i : 2 << i] = out[: 1 << i] ^ single[b]
        return out

    error = np.zeros(1 << PARITY, np.int64)
    bit = 1 << np.arange(LENGTH)
    i, j, k = np.meshgrid(np.arange(LENGTH), np.arange(LENGTH), np.arange(LENGTH), indexing="ij")
    pick = (i <= j) & (j <= k)  # one, two or three different places, as x ^ x = 0 leaves the rest
    for a, b, c in zip(i[pick], j[pick], k[pick], strict=True):
        if a == b == c or a != b != c:
            error[single[a] ^ (single[b] if b != a else 0) ^ (single[c] if c != b else 0)] = bit[a] ^ (bit[b] if b != a else 0) ^ (bit[c] if c != b else 0)
        elif a != b:
            error[single[a] ^ single[b]] = bit[a] ^ bit[b]
    return of(range(12)), of(range(12, LENGTH)), error


LOW, HIGH, ERROR = _tables()


def nearest(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the one codeword within 3 bits of each 23-bit word."""
    syndrome = LOW[words & 0xFFF] ^ HIGH[words >> 12]
    return (words ^ ERROR[syndrome]) >> PARITY


def keys(words: np.ndarray) -> np.ndarray:
    """For each word the codeword indices of the word and of its 23 neighbours: one row, repeats included.

    Two words that differ in at most two bits have a neighbour, or themselves, in
    common, and so share a key. A row holds one or six different indices.
    """
    flips = np.concatenate([[0], 1 << np.arange(LENGTH)])
    return nearest(words[:, None] ^ flips[None, :])
