"""Bloom filters of 64-bit numbers, put together on the executors: of bounded size, so that more numbers let more others through and lose none."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import per_task

#: Bits that a filter has for each number, and in all at least and at most; parts in which it travels.
BITS, LEAST_BITS, MOST_BITS, CHUNKS = 16, 1 << 16, 1 << 27, 64
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _places(x: np.ndarray, n_bits: int) -> list[np.ndarray]:
    h = x.astype(np.int64).view(np.uint64)
    out = []
    for factor in _FACTORS:
        h = (h ^ (h >> np.uint64(31))) * factor
        out.append(((h ^ (h >> np.uint64(29))) % np.uint64(n_bits)).astype(np.int64))
    return out


def bloom_filter(numbers: DataFrame) -> np.ndarray:
    """The filter, as packed bits, of a table of one column of distinct longs without nulls."""
    n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS * numbers.count()).bit_length()))

    def mark(batches):
        bits = np.zeros(n_bits, bool)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(), n_bits):
                bits[at] = True
        parts = np.packbits(bits).reshape(CHUNKS, -1)
        used = np.flatnonzero(parts.any(axis=1))
        yield {"chunk": used, "bits": [parts[k].tobytes() for k in used]}

    def both(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out[k] = out.get(k, 0) | np.frombuffer(bits, np.uint8)
        yield {"chunk": list(out), "bits": [v.tobytes() for v in out.values()]}

    marks = per_task(numbers, mark, "chunk long, bits binary").repartition(CHUNKS, "chunk")
    out = np.zeros((CHUNKS, n_bits // 8 // CHUNKS), np.uint8)
    for r in per_task(marks, both, "chunk long, bits binary").collect():
        out[r.chunk] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def passes(numbers: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which numbers may be in the filter: all that are, and a few others."""
    out = np.ones(len(numbers), bool)
    for at in _places(numbers, len(bits) * 8):
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out
