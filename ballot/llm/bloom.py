"""Bloom filters over 64-bit hashes: bits in NumPy arrays, built by tasks and merged by segment.

What reaches the driver is the filter, whose size is fixed beforehand; the hashes never do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PROBES = 4
SEGMENT = 1 << 14  # bytes
MOST_BITS = 1 << 30  # of a filter that goes to all tasks: 128 MB


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions of each 64-bit hash, by double hashing; bits is a power of two."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(j) * step) & np.uint64(bits - 1) for j in range(PROBES)])


def has(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def put(filter_: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(filter_, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def bits_for(keys: int, each: int = 16, least: int = 1 << 16, most: int = MOST_BITS) -> int:
    """A power of two of at least `each` bits a key, within the bounds."""
    return min(most, max(least, 1 << (each * max(1, keys) - 1).bit_length()))


def merged(hashes: DataFrame, bits: int) -> bytes:
    """The filter of a frame's one column of 64-bit hashes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            if b.num_rows:
                put(own, probes(b.column(0).to_numpy().view(np.uint64), bits))
        for i in range(0, bits // 8, SEGMENT):
            part = own[i : i + SEGMENT]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // SEGMENT], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["segment", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for segment, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(packed), np.uint8)
                held[segment] = held[segment] | part if segment in held else part
        for segment, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["segment", "bits"])

    schema = "segment int, bits binary"
    out = np.zeros(bits // 8, np.uint8)
    for r in hashes.mapInArrow(build, schema).repartition("segment").mapInArrow(merge, schema).collect():  # bits / 8 bytes at most
        part = np.frombuffer(zlib.decompress(r.bits), np.uint8)
        out[r.segment * SEGMENT : r.segment * SEGMENT + len(part)] = part
    return out.tobytes()
