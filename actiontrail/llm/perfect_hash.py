"""A minimal perfect hash over 64-bit keys: n distinct keys get the numbers 0 to n - 1, in a few bits a key.

Level by level every key left picks a bit by a seeded hash; keys alone at their bit stay there, the others go on to the next
level. A key's number is the count of set bits before its own. Keys that were not built in get a wrong number or -1, so a
caller keeps the keys in the order of their numbers and compares.
"""

from __future__ import annotations

import struct

import numpy as np

from actiontrail.llm.text_bytes import mixed, running

ROOM = 2.0  # bits for each key of a level
LEVELS = 200


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & 0xFFFFFFFFFFFFFFFF)
    return (mixed(keys ^ seed) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, words: np.ndarray, sizes: list[int]):
        self.words, self.sizes = words, sizes
        self.before = running(np.bitwise_count(words).astype(np.int64))
        self.count = int(self.before[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, words, sizes = keys.astype(np.uint64), [], []
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys of a perfect hash have to be distinct")
            size = -(-max(64, int(ROOM * len(left))) // 64) * 64
            at = _places(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(np.concatenate(words) if words else np.zeros(0, "<u8"), sizes)

    def index(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = _places(keys[todo], level, size) + base
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            own = self.words[word] >> bit & np.uint64(1) > 0
            hit, low = word[own], (np.uint64(1) << bit[own]) - np.uint64(1)
            out[todo[own]] = self.before[hit] + np.bitwise_count(self.words[hit] & low)
            todo, base = todo[~own], base + size
        return out

    def to_bytes(self) -> bytes:
        return struct.pack(f"<I{len(self.sizes)}Q", len(self.sizes), *self.sizes) + self.words.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        (levels,) = struct.unpack_from("<I", data)
        sizes = list(struct.unpack_from(f"<{levels}Q", data, 4))
        return cls(np.frombuffer(data, "<u8", offset=4 + 8 * levels), sizes)
