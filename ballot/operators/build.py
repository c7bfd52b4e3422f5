"""Growing of forests: a task a tree, from one sample of training rows of bounded size.

Splits need no more rows than give their medians and gains: about `fit_rows` training rows, chosen by a hash of
their ids (all rows, where there are no more), are sent to every task once, and every task grows whole
trees. Nothing is shuffled, and there is one job a forest. The sample only places the splits: all training
rows are routed and counted afterwards (`forest.routed`, `votes.leaf_counts`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballot.functions import randomness as R
from ballot.operators.forest import PLACES, TERMINAL, Forest, projected_dims, rp_weights
from ballot.sources.vectors import matrix

SUBSAMPLE = 100  # rows that score a node's split (RF)
TOLERANCE = 0.001
FIT_ROWS = 50_000  # training rows, about, that splits are placed by
FIT_BYTES = 64 << 20  # of them sent to the tasks


@dataclass
class Sample:
    """Training rows in the order of their ids; labels only for RF."""

    ids: np.ndarray
    x: np.ndarray
    labels: list[np.ndarray] | None = None


def fit_share(id_column: str, rows: int, wanted: int, seed: int) -> F.Column:
    """A condition that about `wanted` of `rows` meet, alike in every run; all, where there are no more."""
    if rows <= wanted:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.col(id_column), F.lit(seed)), F.lit(1 << 40)) < int(wanted / rows * (1 << 40))


def wanted_rows(fit_rows: int, dim: int) -> int:
    return max(1, min(fit_rows, FIT_BYTES // (8 * dim)))


def fit_sample(train: DataFrame, forest: Forest, n_train: int, knn: DataFrame | None = None, fit_rows: int = FIT_ROWS) -> Sample:
    """The rows that splits are placed by: `fit_rows` and FIT_BYTES at most, up to hashing."""
    wanted = wanted_rows(fit_rows, forest.dim)
    some = train.select(F.col("train_id").cast("long").alias("train_id"), "vec").filter(fit_share("train_id", n_train, wanted, forest.seed))
    if knn is not None:
        some = some.join(knn.select("train_id", F.array_distinct("labels").alias("labels")), "train_id", "left")
    got = some.toArrow().combine_chunks()
    ids = got.column("train_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    x = matrix(pa.concat_arrays(got.column("vec").chunks), forest.dim)[order] if len(ids) else np.zeros((0, forest.dim))
    labels = None
    if knn is not None:
        own = got.column("labels").to_pylist()
        labels = [np.asarray([v for v in own[i] or () if v is not None and v >= 0], np.int64) for i in order]
    return Sample(ids[order], x, labels)


def per_tree(spark, forest: Forest, sample: Sample, work: Callable[[int, Forest, Sample], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `work` yields for each tree, a task a tree."""
    shared = spark.sparkContext.broadcast((forest, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, s = shared.value
        for b in batches:
            for t in b.column(0).to_pylist():
                yield from work(t, f, s)

    return spark.range(0, forest.n_trees, 1, forest.n_trees).mapInArrow(run, schema)


NODE = "tree int, node int, split double, cut_value double, cut_id long, dim long, weights array<double>"


def node_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
    names = [c.split()[0] for c in NODE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def median_split(value: np.ndarray, ids: np.ndarray) -> tuple[float, float, int, np.ndarray]:
    """(split, cut_value, cut_id, goes left) of a node's rows.

    The left half has the extra row. The split is the middle value, or the mean of the two middle ones; the
    cut is the left half's last row, so that equal values are told apart by id.
    """
    order = np.lexsort((ids, value))
    half = -(-len(order) // 2)
    last = order[half - 1]
    split = value[last] if len(order) % 2 else (value[last] + value[order[half]]) / 2
    left = np.zeros(len(order), bool)
    left[order[:half]] = True
    return float(split), float(value[last]), int(ids[last]), left


def grow(train: DataFrame, forest: Forest, n_train: int, knn: DataFrame | None = None, fit_rows: int = FIT_ROWS) -> Forest:
    """Fills in the forest's arrays."""
    m = projected_dims(forest.density, forest.dim)
    if forest.kind == "RP":
        forest.weights = rp_weights(forest.n_trees, forest.depth, forest.dim, forest.density, forest.seed)
        work = rp_tree
    elif forest.kind == "PCA":
        if m < 1:
            raise ValueError("density leaves no dimension to project on")
        draw_directions(forest, m)
        work = pca_tree
    else:
        if not m:
            return forest
        work = rf_tree
    sample = fit_sample(train, forest, n_train, knn if forest.kind == "RF" else None, fit_rows)
    for r in per_tree(train.sparkSession, forest, sample, work, NODE).collect():  # one record a node
        forest.splits[r.tree, r.node] = r.split
        if forest.kind == "RF":
            forest.split_dims[r.tree, r.node] = r["dim"]
        else:
            forest.cut_value[r.tree, r.node], forest.cut_id[r.tree, r.node] = r.cut_value, r.cut_id
        if forest.kind == "PCA":
            forest.weights[r.tree, r.node] = r.weights
    return forest


def median_tree(t: int, f: Forest, s: Sample, direction: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Nodes of a tree whose splits are medians; direction(node, rows): a node's values, after its weights are set."""
    rows = [np.arange(len(s.ids))]
    out = []
    for node in range(f.n_inner):
        own, rows[node] = rows[node], None
        if not len(own):
            rows += [own, own]
            continue
        value = direction(node, own)
        split, cut_value, cut_id, left = median_split(value, s.ids[own])
        weights = f.weights[t, node].tolist() if f.kind == "PCA" else None
        out.append((t, node, split, cut_value, cut_id, TERMINAL, weights))
        rows += [own[left], own[~left]]
    if out:
        yield node_batch(out)


def rp_tree(t: int, f: Forest, s: Sample) -> Iterator[pa.RecordBatch]:
    """Random projections, one a level; median splits."""
    values = np.round(s.x @ f.weights[t].T, PLACES)
    yield from median_tree(t, f, s, lambda node, own: values[own, (node + 1).bit_length() - 1])


def draw_directions(forest: Forest, m: int) -> None:
    shape = (forest.n_trees, forest.n_inner, m)
    forest.dims, forest.weights = np.zeros(shape, np.int64), np.zeros(shape)
    for t in range(forest.n_trees):
        for n in range(forest.n_inner):
            places = [f"{forest.seed}:pca:{t}:{n}:{j}" for j in range(m)]
            forest.dims[t, n] = [R.integer(p, forest.dim) for p in places]  # repeats are possible, and meant
            forest.weights[t, n] = [R.normal(p) for p in places]


def pca_tree(t: int, f: Forest, s: Sample) -> Iterator[pa.RecordBatch]:
    """For each node a sparse direction near its rows' first principal component; median splits."""

    def direction(node: int, own: np.ndarray) -> np.ndarray:
        y = s.x[own][:, f.dims[t, node]]
        if len(own) > 1:
            apart = y - y.mean(axis=0)
            f.weights[t, node] = principal(0.02 / (len(own) - 1) * (apart.T @ apart), f.weights[t, node])
        return np.round((y * f.weights[t, node]).sum(axis=1), PLACES)

    yield from median_tree(t, f, s, direction)


def principal(c: np.ndarray, v: np.ndarray, steps: int = 20, still: float = 0.01) -> np.ndarray:
    """Power steps v + Cv, each normalised, until the mean change is under `still`; rounded, so that engines agree."""
    v = v / np.linalg.norm(v)
    for _ in range(steps):
        new = v + c @ v
        new /= np.linalg.norm(new)
        moved = np.abs(new - v).mean()
        v = new
        if moved < still:
            break
    return np.round(v, 9)


def tried_dims(forest: Forest, tree: int, level: int) -> list[int]:
    """The dimensions that every node of a tree's level may split on, in the order they are tried."""
    return R.sample(f"{forest.seed}:rf:{tree}:{level}", projected_dims(forest.density, forest.dim), forest.dim)


def node_sample(ids: np.ndarray, seed: int, tree: int, node: int, size: int = SUBSAMPLE) -> np.ndarray:
    """Positions of up to `size` of a node's rows, those of the least hashes, in the order of ids."""
    if len(ids) <= size:
        return np.arange(len(ids))
    digest = np.array([hashlib.md5(f"{seed}:sub:{tree}:{node}:{i}".encode()).hexdigest() for i in ids.tolist()])
    return np.sort(np.lexsort((ids, digest))[:size])


def rf_tree(t: int, f: Forest, s: Sample) -> Iterator[pa.RecordBatch]:
    """Splits of greatest entropy gain over the labels; a node without one is terminal, and all below it."""
    level_dims = [tried_dims(f, t, level) for level in range(f.depth)]
    rows = [np.arange(len(s.ids))]
    out = []
    for node in range(f.n_inner):
        own, rows[node] = rows[node], None
        found = None
        if len(own) > 1:
            some = own[node_sample(s.ids[own], f.seed, t, node)]
            found = best_split(s.x[some], [s.labels[i] for i in some], level_dims[(node + 1).bit_length() - 1])
        if found is None:
            rows += [own[:0], own[:0]]
            continue
        out.append((t, node, found[1], 0.0, 0, found[0], None))
        left = s.x[own, found[0]] <= found[1]
        rows += [own[left], own[~left]]
    if out:
        yield node_batch(out)


def entropy_sums(row: np.ndarray, label: np.ndarray, n: int) -> np.ndarray:
    """Sum of v log2 v over the labels' counts v, after each of n rows; row and label list the rows' labels."""
    order = np.lexsort((row, label))
    own = label[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    v = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)])) + 1.0  # the label's count with this row
    grown = v * np.log2(v) - np.where(v > 1, (v - 1) * np.log2(np.maximum(v - 1, 1)), 0.0)
    return np.cumsum(np.bincount(row[order], grown, n))


def boundary_gains(key: np.ndarray, labels: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, gain, split) at each boundary between different neighbouring keys; rows sorted by key.

    The impurity of s rows is k log2 s - (1/s) sum v log2 v: k labels a row, v rows with a label.
    """
    n, k = len(key), sum(map(len, labels)) / max(1, len(labels))
    row = np.repeat(np.arange(n), [len(x) for x in labels])
    flat = np.concatenate([np.asarray(x, np.int64) for x in labels])
    ahead, behind = entropy_sums(row, flat, n), entropy_sums(n - 1 - row, flat, n)[::-1]
    i = np.flatnonzero(key[:-1] != key[1:])
    a, b = i + 1.0, n - i - 1.0
    left, right = k * np.log2(a) - ahead[i] / a, k * np.log2(b) - behind[i + 1] / b
    gain = k * np.log2(n) - ahead[-1] / n - (a / n * left + b / n * right)
    return i, gain, (key[i] + key[i + 1]) / 2


def gains(key: np.ndarray, labels: list) -> list[tuple[int, float, float]]:
    return list(zip(*(x.tolist() for x in boundary_gains(key, labels)), strict=True))


def best_split(x: np.ndarray, labels: list, dims: list[int], tolerance: float = TOLERANCE) -> tuple[int, float] | None:
    """The split kept after trying dims in order and positions upwards: one must beat the last by the tolerance."""
    best, pick = 0.0, None
    for d in dims:
        order = np.argsort(x[:, d], kind="stable")
        _, gain, split = boundary_gains(x[order, d], [labels[i] for i in order])
        for j in np.flatnonzero(gain > best + tolerance).tolist():
            if gain[j] > best + tolerance:
                best, pick = float(gain[j]), (int(d), float(split[j]))
    return pick
