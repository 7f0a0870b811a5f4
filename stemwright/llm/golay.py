"""The perfect binary Golay code (23, 12, 7) as lookup tables for Spark expressions.

Every 23-bit word lies within three bits of exactly one codeword. The words within one bit of a given
word decode to one or six codewords; two words at most two bits apart have at least one of them in common.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH, CHECK = 23, 11
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
NO_PATTERN = -1


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each word by the generator polynomial."""
    rest = np.array(words, dtype=np.int64)
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        rest ^= (GENERATOR << (bit - CHECK)) * ((rest >> bit) & 1)
    return rest


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; by syndrome the (up to six) differences to the near codewords."""
    single = [1 << i for i in range(LENGTH)]
    double = [a | b for a in single for b in single if a < b]
    triple = [a | b for a in double for b in single if b > (1 << (a.bit_length() - 1))]
    errors = np.array([0, *single, *double, *triple])
    by_syndrome = np.zeros(1 << CHECK, dtype=np.int64)
    by_syndrome[syndrome(errors)] = errors
    steps = np.array([0, *single])
    step_syndromes = syndrome(steps)
    near = np.full((1 << CHECK, 6), NO_PATTERN, dtype=np.int64)
    for s in range(1 << CHECK):
        found = sorted(set((steps ^ by_syndrome[s ^ step_syndromes]).tolist()))
        near[s, : len(found)] = found
    return syndrome(np.arange(4096)), syndrome(np.arange(2048) << 12), near


def _literal(values: np.ndarray) -> Column:
    return F.split(F.lit(",".join(map(str, values.ravel().tolist()))), ",").cast("array<int>")


def near_index(word: Column, which: Column) -> Column:
    """12-bit index of the which-th (0 to 5) codeword near a 23-bit word, NULL where there are fewer."""
    low, high, near = tables()
    s = F.get(_literal(low), word.bitwiseAND(F.lit(4095))).bitwiseXOR(F.get(_literal(high), F.shiftright(word, 12)))
    pattern = F.get(_literal(near), s * 6 + which)
    return F.when(pattern != NO_PATTERN, F.shiftright(word.bitwiseXOR(pattern), CHECK))


def near_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in words, 12-bit index) of every codeword near each 23-bit word, one or six for each."""
    low, high, near = tables()
    patterns = near[low[words & 4095] ^ high[words >> 12]]
    at, which = np.nonzero(patterns != NO_PATTERN)
    return at, (words[at] ^ patterns[at, which]) >> CHECK
