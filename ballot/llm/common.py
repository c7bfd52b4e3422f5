"""Shared helpers: scratch tables on the cluster's shared folder, text batches, held-out folds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballot.sources.vectors import shared_folder

#: ASCII white space, [\x20\x09-\x0D]: what bytes.split() and bytes.strip() take without an argument.
SPACE = " \t\n\x0b\x0c\r"


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of what led to them.

    A table must outlive the lazy frames that read it; clear() removes all of them and is for callers
    that know those frames have been consumed, such as the pipeline between two of its stages.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/ballot-{uuid.uuid4().hex}"
        self.count = 0

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.count}"
        self.count += 1
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, share: int = 4 << 20) -> DataFrame:
    """A table too small to have a split for each core, dealt to all of them; others as they are.

    It is for files of one row group, which one task would read: under `share` bytes a core are shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < share * cores
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df


def held_out(id_column: str) -> F.Column:
    """One row in five, by the checksum of its id as text; such rows never train a model."""
    return F.coalesce(F.crc32(F.col(f"`{id_column}`").cast("string")) % 5 == 0, F.lit(False))


def share(column, rows: int, wanted: int, seed: int = 0) -> F.Column:
    """A condition that holds for about `wanted` of `rows`, chosen by a hash of the column and alike in every run."""
    if rows <= wanted:
        return F.lit(True)
    cut = int(wanted / rows * 2**31)
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(2**31)) < cut


def aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with columns called like an operator's own renamed, and what gives all of df's columns back under their names."""
    taken = {n.lower() for n in names}
    mark = "own"
    while any(c.lower().startswith(mark) for c in df.columns) or any(n.startswith(mark) for n in taken):
        mark += "_"
    new = [f"{mark}{i}" if c.lower() in taken else c for i, c in enumerate(df.columns)]
    renamed = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, new, strict=True)])
    old = df.columns
    return renamed, lambda out: out.select(*[F.col(f"`{n}`").alias(c) for c, n in zip(old, new, strict=True)])


HUB = 1000  # rows of one key beyond which a join spreads them


def hub_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, hub: int = HUB) -> DataFrame:
    """left joined to right, which has one row a key and in `n` the rows that left has of it; n is dropped.

    A key with more than `hub` rows, or more than a thousandth of all, is cut into parts by a hash of
    `spread_by`, and right's row is copied to each part: no task gets more, whatever the key's share. There
    are a thousand such keys at most, so that their table can be broadcast.
    """
    total, most = right.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    least = max(hub, total // 1000)
    if most <= least:
        return left.join(right.drop("n"), key)
    heavy = F.broadcast(right.filter(F.col("n") > least).select(F.col(key).alias("__key"), F.ceil(F.col("n") / least).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    cut = left.join(heavy, F.col(key) == F.col("__key"), "left").withColumn("__part", F.pmod(F.xxhash64(spread_by), parts).cast("int")).drop("__key", "__parts")
    copies = right.drop("n").join(heavy, F.col(key) == F.col("__key"), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__key", "__parts")
    return cut.join(copies, [key, "__part"]).drop("__part")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df less the columns that an operator is about to add; the operator's own win when names clash."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow, which can't take a frame with dots in its columns' names, for columns of any name."""
    names = df.columns
    if not any("." in c for c in names):
        return df.mapInArrow(run, schema)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(lambda batches: run(b.rename_columns(names) for b in batches), schema)


def map_text(df: DataFrame, column: str, added: list[tuple[str, T.DataType, pa.DataType]], make: Callable[[], Callable[[list], list[list]]], binary: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Appends columns computed from one text column, an Arrow batch at a time.

    make() runs once a task and returns a function from a batch's texts (str, or UTF-8 bytes if `binary`;
    None for null) to one list a new column. `keep`: the input columns to pass on (default all). Columns of
    the input with the names of new ones are replaced; texts go over only once.
    """
    names = [n for n, _, _ in added]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in {n.lower() for n in names}]
    inner = "__text"
    while inner in {c.lower() for c in kept}:
        inner += "_"
    src = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").cast("string").alias(inner))
    schema = T.StructType([*[f for f in src.schema.fields[:-1]], *[T.StructField(n, t) for n, t, _ in added]])
    arrow = [t for _, _, t in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for b in batches:
            f = f or make()
            for part in pieces(b):
                t = part.column(part.num_columns - 1)
                out = f((t.cast(pa.binary()) if binary else t).to_pylist())
                cols = [*part.columns[:-1], *[pa.array(x, type=k) for x, k in zip(out, arrow, strict=True)]]
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, *names])

    return map_arrow(src, run, schema)


def pieces(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose bytes stay near `most`, one row at least: bounds Python's copies of long texts."""
    rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
