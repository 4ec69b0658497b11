"""Words as the contracts define them (A-Z lower-cased, split at ASCII white space), and 64-bit shingles."""

from __future__ import annotations

import numpy as np
import xxhash

MASK = (1 << 64) - 1


def words(text: str | None) -> list[bytes]:
    """bytes.lower() changes A-Z alone, and bytes.split() splits at 0x20 and 0x09-0x0D alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash; forgets all when full, so that memory stays bounded."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Distinct shingles as sorted 64-bit hashes; fewer words than size make one shingle, no words none."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = max(1, len(w) - size + 1)
    h = np.full(n, min(size, len(w)), np.uint64)
    for i in range(min(size, len(w))):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n])
    return np.unique(h)
