"""Vector tables: checked on the way in, as (id BIGINT, vec ARRAY<FLOAT or DOUBLE>)."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_vectors(spark: SparkSession, path: str, id_column: str = "vec_id", vec_column: str = "embedding") -> DataFrame:
    """A Parquet table's ids and vectors; only the two columns are read."""
    return spark.read.parquet(path).select(F.col(id_column).cast("long").alias("id"), F.col(vec_column).alias("vec"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one only on a local master without it."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ballot-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def check_schema(df: DataFrame, name: str, id_column: str = "id") -> DataFrame:
    missing = {id_column, "vec"} - set(df.columns)
    if missing:
        raise ValueError(f"{name} lacks the columns {sorted(missing)}")
    kind = df.schema["vec"].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        raise ValueError(f"{name}.vec must be an array of floats or doubles, not {kind.simpleString()}")
    return df


def check_vectors(df: DataFrame, name: str, dim: int | None = None, id_column: str = "id") -> tuple[int, int]:
    """(rows, dimension), by one aggregation; raises for empty, ragged, null, NaN or unlike vectors."""
    check_schema(df, name, id_column)
    bad = F.col("vec").isNull() | F.exists("vec", lambda x: x.isNull() | F.isnan(x)) | F.col(id_column).isNull()
    r = df.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("bad")).first()
    if not r.n:
        raise ValueError(f"{name} is empty")
    if r.bad:
        raise ValueError(f"{name} has {r.bad} rows with null ids or vectors, or elements that are null or no number")
    if r.lo != r.hi or not r.lo:
        raise ValueError(f"{name} has vectors of {r.lo} to {r.hi} elements")
    if dim is not None and r.lo != dim:
        raise ValueError(f"{name} has dimension {r.lo}; the corpus has {dim}")
    return r.n, r.lo


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column as a double matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != dim * len(column) or column.null_count:
        raise ValueError(f"a vector has not {dim} elements")
    return flat.astype(np.float64).reshape(len(column), dim)


def of_dimension(dim: int, name: str = "queries", vec: str = "vec") -> F.Column:
    """The vector column; a row of another length fails its task with a message that says so."""
    size = F.size(vec)
    return F.when(size == dim, F.col(vec)).otherwise(F.raise_error(F.concat(F.lit(f"{name} need vectors of {dim} elements, not "), size.cast("string")))).alias(vec)
