"""Words of a text: the longest runs of letters and digits, in lower case."""

from __future__ import annotations

import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_code(word: str) -> int:
    """A 64-bit code of a word, the same in every worker."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class WordCodes(dict):
    """Remembers codes; forgets all when it has grown to limit."""

    limit = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        code = self[word] = word_code(word)
        return code


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finaliser of a published hash)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def run_codes(codes: np.ndarray, size: int) -> np.ndarray:
    """The 64-bit code of the run of size consecutive words at each place; empty if there are fewer words."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n])
    return acc


def shingles(codes: np.ndarray, size: int) -> np.ndarray:
    """The sorted set of the codes of all runs of size consecutive words."""
    return np.unique(run_codes(codes, size))
