"""Counter-based random numbers, alike in Spark, NumPy and SQL: slices of an MD5 of seed and place.

A place is a text such as "7:rp:tree:level:dim". A task that runs again draws the same numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = 4294967296.0


def _slices(place: str) -> tuple[int, int, int]:
    h = hashlib.md5(place.encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16)


def uniform(place: str) -> float:
    """In [0, 1)."""
    return _slices(place)[2] / WIDE


def normal(place: str) -> float:
    """Standard normal, rounded to six places so that engines agree."""
    a, b, _ = _slices(place)
    return round(float(np.sqrt(-2 * np.log((a + 1) / (WIDE + 1))) * np.cos(2 * np.pi * b / WIDE)), 6)


def integer(place: str, below: int) -> int:
    return _slices(place)[2] % below


def sample(place: str, size: int, below: int) -> list[int]:
    """`size` different numbers under `below`, uniformly: those of the least hashes, in hash order."""
    return sorted(range(below), key=lambda i: (hashlib.md5(f"{place}:{i}".encode()).hexdigest(), i))[:size]


def hash_order(*parts: Column | str) -> Column:
    """The hex digest to rank rows by when sampling them."""
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts]))
