"""The model: trees as arrays of bounded size, and routing of vectors to leaves.

A forest of n_trees trees of a depth has n_trees * (2^depth - 1) inner nodes in heap order, children of
i at 2i+1 (left) and 2i+2. The arrays are all a task needs to route; their size depends on the parameters,
never on the data. Build and queries route with the same code, over projections rounded to nine places, so
that a training point on a split value goes the same way always.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballot.functions import randomness as R
from ballot.sources.vectors import matrix, of_dimension

PLACES = 9
TERMINAL = -1


def resolve_density(density: float | str | None, dim: int) -> float:
    """"auto": 1 / sqrt(dim); None: 1; otherwise in (0, 1]."""
    if density == "auto":
        return 1.0 / math.sqrt(dim)
    if density is None:
        return 1.0
    if isinstance(density, str) or not 0 < density <= 1:
        raise ValueError(f"density is a share above 0 and up to 1, 'auto' or None, not {density!r}")
    return float(density)


def projected_dims(density: float, dim: int) -> int:
    """Whole part of density * dim in single precision."""
    return int(np.float32(density) * np.float32(dim))


@dataclass
class Forest:
    kind: str  # "RP", "PCA" or "RF"
    n_trees: int
    depth: int
    dim: int
    density: float
    b: int
    seed: int
    splits: np.ndarray = field(default=None)  # [tree, node]
    split_dims: np.ndarray = field(default=None)  # RF: [tree, node], TERMINAL where none
    dims: np.ndarray = field(default=None)  # PCA: [tree, node, m]
    weights: np.ndarray = field(default=None)  # RP: [tree, level, dim]; PCA: [tree, node, m]
    cut_value: np.ndarray = field(default=None)  # RP, PCA, while building: last value and id that go left
    cut_id: np.ndarray = field(default=None)

    def __post_init__(self):
        n = self.n_inner
        if self.splits is None:
            self.splits = np.zeros((self.n_trees, n))
        if self.kind == "RF" and self.split_dims is None:
            self.split_dims = np.full((self.n_trees, n), TERMINAL, np.int64)
        if self.kind != "RF" and self.cut_value is None:
            self.cut_value, self.cut_id = np.zeros((self.n_trees, n)), np.zeros((self.n_trees, n), np.int64)

    @property
    def n_inner(self) -> int:
        return (1 << self.depth) - 1

    def values(self, x: np.ndarray, node: np.ndarray, level: int) -> np.ndarray:
        """The number each row is compared by at its node of each tree."""
        if self.kind == "RP":
            return np.round(x @ self.weights[:, level].T, PLACES)
        tree = np.arange(self.n_trees)
        row = np.arange(len(x))
        if self.kind == "RF":
            return x[row[:, None], np.maximum(self.split_dims[tree, node], 0)]
        out = np.empty(node.shape)
        for t in tree:
            d = self.dims[t, node[:, t]]
            out[:, t] = (x[row[:, None], d] * self.weights[t, node[:, t]]).sum(axis=1)
        return np.round(out, PLACES)

    def nodes_at(self, x: np.ndarray, level: int, ids: np.ndarray | None = None) -> np.ndarray:
        """[row, tree]: the node reached after `level` steps. With ids: where a training row of that id was put."""
        node = np.zeros((len(x), self.n_trees), np.int64)
        tree = np.arange(self.n_trees)
        for at in range(level):
            v = self.values(x, node, at)
            left = v <= self.splits[tree, node]
            if self.kind == "RF":
                left |= self.split_dims[tree, node] == TERMINAL
            elif ids is not None:
                cut = self.cut_value[tree, node]
                left = (v < cut) | (v == cut) & (ids[:, None] <= self.cut_id[tree, node])
            node = 2 * node + 2 - left
        return node

    def leaves(self, x: np.ndarray, ids: np.ndarray | None = None) -> np.ndarray:
        return self.nodes_at(x, self.depth, ids) - self.n_inner

    def nodes_table(self) -> list[tuple]:
        """(tree, node, level, split_dim, split_point) rows."""
        out = []
        for t in range(self.n_trees):
            for n in range(self.n_inner):
                d = None if self.kind != "RF" or self.split_dims[t, n] == TERMINAL else int(self.split_dims[t, n])
                none = self.kind == "RF" and d is None
                out.append((t, n, (n + 1).bit_length() - 1, d, None if none else float(self.splits[t, n])))
        return out


def leaves_of(df: DataFrame, id_column: str, forest: Forest, training: bool = False, with_vec: bool = False) -> DataFrame:
    """(id_column, leaves[, vec]): the leaf each row reaches, by tree; `training`: ties on a split go by id, as in building."""
    shared = df.sparkSession.sparkContext.broadcast(forest)
    src = df.select(F.col(id_column).cast("long").alias(id_column), of_dimension(forest.dim, "rows to be routed"))
    schema = T.StructType([T.StructField(id_column, T.LongType()), T.StructField("leaves", T.ArrayType(T.IntegerType())), *([T.StructField("vec", df.schema["vec"].dataType)] if with_vec else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            ids = b.column(0).to_numpy()
            leaves = f.leaves(matrix(b.column(1), f.dim), ids if training else None).astype(np.int32)
            offsets = np.arange(0, leaves.size + 1, f.n_trees, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, leaves.ravel()), *([b.column(1)] if with_vec else [])], names=schema.names)

    return src.mapInArrow(run, schema)


def routed(df: DataFrame, id_column: str, forest: Forest, training: bool = False) -> DataFrame:
    """(id_column, tree, leaf): a row for each tree."""
    return leaves_of(df, id_column, forest, training).select(id_column, F.posexplode("leaves").alias("tree", "leaf"))


def check_shape(kind: str, n_trees: int, depth: int, n_train: int) -> None:
    if n_trees < 1:
        raise ValueError(f"a forest needs a tree or more, not {n_trees}")
    if kind == "RF":
        if not 0 <= depth <= 24:
            raise ValueError(f"RF trees have depths from 0 to 24, not {depth}")
    elif depth < 1 or depth > int(math.log2(n_train)):
        raise ValueError(f"{n_train} rows that place splits carry depths from 1 to {int(math.log2(max(1, n_train)))}, not {depth}")


def rp_weights(n_trees: int, depth: int, dim: int, density: float, seed: int) -> np.ndarray:
    """[tree, level, dim]: standard normal with probability `density`, else 0; all normal at density 1."""
    out = np.zeros((n_trees, depth, dim))
    for t in range(n_trees):
        for level in range(depth):
            for d in range(dim):
                place = f"{seed}:rp:{t}:{level}:{d}"
                if density >= 1 or R.uniform(place) < density:
                    out[t, level, d] = R.normal(place)
    return out
