"""UTF-8 texts of an Arrow batch as one numpy byte array, with rolling-hash sums over it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PART_BYTES = 2 << 20

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 .. n - 1, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, x in enumerate((BASE, INVERSE)):
            row = np.full(max(n, 1 << 16), x, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def running(values: np.ndarray) -> np.ndarray:
    """Sums before each place: n + 1 numbers."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE**place before each place, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], the same wherever the bytes stand."""
    inverse = powers(len(sums))[1]
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * MIX1)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row begins (n + 1 offsets); null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def parts(batches: Iterator[pa.RecordBatch], column: int, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in slices whose texts have about `limit` bytes (lists: elements); a longer one stands alone."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        if batch.num_rows:
            own = batch.column(column)
            measure = pa.compute.list_value_length if pa.types.is_list(own.type) else pa.compute.binary_length
            sizes = np.asarray(measure(own).fill_null(0))
        begin, total = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if row > begin and total + size > limit:
                yield batch.slice(begin, row - begin)
                begin, total = row, 0
            total += size
        if begin < batch.num_rows:
            yield batch.slice(begin)
