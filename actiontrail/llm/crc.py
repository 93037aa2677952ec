"""CRC-32C (Castagnoli) and its masked form, computed with numpy tables a block of bytes at a time."""

from __future__ import annotations

import functools

import numpy as np

POLYNOMIAL = 0x82F63B78
BLOCK = 256
MASK = 0xA282EAD8


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)
    # place[p][b]: what byte b adds to the register when p more bytes follow it in its block.
    place = np.empty((BLOCK, 256), np.uint32)
    place[0] = one
    for p in range(1, BLOCK):
        place[p] = one[place[p - 1] & 0xFF] ^ (place[p - 1] >> 8)
    # skip[k][b]: byte k of a register after a whole block of zero bytes.
    skip = np.empty((4, 256), np.uint32)
    for k in range(4):
        state = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(BLOCK):
            state = one[state & 0xFF] ^ (state >> 8)
        skip[k] = state
    return one, place[::-1].copy(), skip


def crc32c(data: bytes | memoryview) -> int:
    place = _tables()[1]
    raw = np.frombuffer(data, np.uint8)
    full = len(raw) // BLOCK * BLOCK
    state = 0xFFFFFFFF
    if full:
        at = np.arange(BLOCK)
        for begin in range(0, full, BLOCK * 4096):
            rows = raw[begin:min(full, begin + BLOCK * 4096)].reshape(-1, BLOCK)
            s0, s1, s2, s3 = _skips()
            for own in np.bitwise_xor.reduce(place[at, rows], axis=1).tolist():
                state = own ^ s0[state & 255] ^ s1[state >> 8 & 255] ^ s2[state >> 16 & 255] ^ s3[state >> 24]
    step = _steps()
    for byte in bytes(raw[full:]):
        state = step[(state ^ byte) & 0xFF] ^ (state >> 8)
    return state ^ 0xFFFFFFFF


@functools.lru_cache(maxsize=1)
def _skips() -> list[list[int]]:
    return [row.tolist() for row in _tables()[2]]


@functools.lru_cache(maxsize=1)
def _steps() -> list[int]:
    return _tables()[0].tolist()


def masked(crc: int) -> int:
    """Rotated and shifted, so that a checksum of data that holds checksums stays useful."""
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def unmasked(value: int) -> int:
    rot = (value - MASK) & 0xFFFFFFFF
    return ((rot >> 17) | (rot << 15)) & 0xFFFFFFFF
