"""Static binary-fuse filters over 64-bit digests: 8-bit fingerprints, three overlapping segments, numpy only."""

from __future__ import annotations

import numpy as np


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys.view(np.uint64) + np.uint64(seed)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


class BinaryFuse8:
    """Answers no for a key that it does not hold with probability 255/256, and never for one that it holds."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        """Three slots a key, in three neighbouring segments."""
        first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        base = first * np.uint64(segment)
        return np.stack([base + (h & mask), base + np.uint64(segment) + ((h >> np.uint64(18)) & mask), base + np.uint64(2 * segment) + ((h >> np.uint64(36)) & mask)]).astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> "BinaryFuse8":
        keys = np.unique(np.asarray(keys, dtype=np.int64))
        n = len(keys)
        segment = 4 if n < 2 else 1 << max(2, min(18, int(np.floor(np.log(n) / np.log(3.33) + 2.25))))
        room = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) * n
        segments = max(1, int(np.ceil(room / segment)) - 2)
        for attempt in range(200):
            seed = (0x9E3779B97F4A7C15 * (attempt + 1)) & (2**64 - 1)
            h = _mix(keys, seed)
            places = cls._places(h, segment, segments)
            order = cls._peel(places, segment * (segments + 2))
            if order is not None:
                break
            if attempt % 10 == 9:
                segments += max(1, segments // 20)
        else:
            raise RuntimeError("no seed gives a filter")
        prints = np.zeros(segment * (segments + 2), np.uint8)
        own = cls._print(h)
        for which, slot in reversed(order):
            p = places[:, which]
            prints[slot] = own[which] ^ prints[p[0]] ^ prints[p[1]] ^ prints[p[2]]
        return cls(seed, segment, segments, prints)

    @staticmethod
    def _peel(places: np.ndarray, size: int):
        """Rounds of (keys, the slot that only each of them still touches), or None if some keys stay tied up."""
        count = np.bincount(places.ravel(), minlength=size)
        tied = np.zeros(size, np.int64)  # xor of the keys that touch a slot
        index = np.arange(places.shape[1])
        for row in places:
            np.bitwise_xor.at(tied, row, index)
        left, rounds = places.shape[1], []
        free = np.flatnonzero(count == 1)
        while len(free):
            which, first = np.unique(tied[free], return_index=True)
            slot = free[first]
            rounds.append((which, slot))
            left -= len(which)
            touched = places[:, which].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(tied, touched, np.tile(which, 3))
            touched = np.unique(touched)
            free = touched[count[touched] == 1]
        return rounds if not left else None

    def holds(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(np.asarray(keys, dtype=np.int64), self.seed)
        p = self._places(h, self.segment, self.segments)
        return (self.prints[p[0]] ^ self.prints[p[1]] ^ self.prints[p[2]]) == self._print(h)

    def dump(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], np.uint64).tobytes() + self.prints.tobytes()

    @classmethod
    def load(cls, data: bytes) -> "BinaryFuse8":
        seed, segment, segments = np.frombuffer(data[:24], np.uint64).tolist()
        return cls(seed, segment, segments, np.frombuffer(data[24:], np.uint8))
