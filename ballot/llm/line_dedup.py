"""Line dedup with two Bloom filters and exact confirmation.

Pass 1 sends the 64-bit hash of every line key to the task that its hash range belongs to, eight bytes a line.
That task holds two filters, for hashes seen once and for hashes seen twice, which get a further layer
whenever they are full, so that their bits a key stay the same on any corpus; what it sees again it names, once.
Pass 2 probes a filter of the hashes named and sends on only suspected repeats, whose exact keys are
counted with map-side sums. Pass 3 rewrites the texts.

The filter of pass 2 goes to all tasks and has 128 MB at most. Where the hashes named need more bits, the hash
space is cut and pass 2 goes over the documents once for each part. False suspects cost a shuffle, never a line: the
exact count decides.

Defined results: a null or empty text is one empty line; very long texts and lines are taken whole. A row is a
document, also where ids repeat; rows with a null doc_id hold lines but are never the ones that keep them, unless
no row with an id holds the line. Rows with equal ids that hold the line all keep it. An empty table gives an empty
result. Columns called n_lines and n_dropped are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballot.llm.bloom import MOST_BITS, bits_for, has, merged, probes, put
from ballot.llm.common import Scratch, aside, hub_join, map_arrow, pieces, without

RANGE_ROWS = 1 << 18  # documents, about, whose lines' hashes one task filters
PROBE_BITS = 16  # a hash named, in the filter of pass 2

def line_key(line: bytes, least: int) -> bytes | None:
    """The line stripped of ASCII white space with A-Z in lower case; None under `least` code points."""
    if len(line) < least:
        return None
    key = line.strip().lower()
    if len(key) < least or not key.isascii() and len(key.decode()) < least:
        return None
    return key


def text_keys(text: bytes | None, least: int) -> set[bytes]:
    return {k for k in (line_key(x, least) for x in (text or b"").split(b"\n")) if k is not None}


def hashed(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)


class Layered:
    """A Bloom filter that gets another layer, twice as large, when it has as many keys as its bits are meant for."""

    def __init__(self, keys: int = 1 << 16, each: int = 16):
        self.each, self.layers, self.room = each, [], keys

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), bool)
        for filter_, bits in self.layers:
            found |= has(filter_, probes(hashes, bits))
        return found

    def put(self, hashes: np.ndarray) -> None:
        while len(hashes):
            if not self.layers or not self.left:
                self.room *= 2
                self.left = self.room
                bits = bits_for(self.room, self.each, most=1 << 40)
                self.layers.append((np.zeros(bits // 8, np.uint8), bits))
            now, hashes = hashes[: self.left], hashes[self.left :]
            put(self.layers[-1][0], probes(now, self.layers[-1][1]))
            self.left -= len(now)


def seen_again(docs: DataFrame, text: str, least: int, ranges: int) -> DataFrame:
    """(h): hashes of the keys that two rows or more have, and of a few others."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b):
                h = hashed(k for t in part.column(0).cast(pa.binary()).to_pylist() for k in text_keys(t, least))
                if not len(h):
                    continue
                own, n = np.unique(h, return_counts=True)
                place = (own >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                ends = np.r_[cut[1:], len(own)]
                blobs = [own[i:j].tobytes() for i, j in zip(cut, ends, strict=True)]
                again = [own[i:j][n[i:j] > 1].tobytes() for i, j in zip(cut, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(place[cut].astype(np.int32)), pa.array(blobs, pa.binary()), pa.array(again, pa.binary())], names=["range", "hashes", "again"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Layered(), Layered()
        for b in batches:
            for blob, more in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                h, repeats = np.frombuffer(blob, np.uint64), np.frombuffer(more, np.uint64)
                seen = once.has(h)
                found = np.union1d(h[seen], repeats)
                found = found[~twice.has(found)]
                twice.put(found)
                once.put(h[~seen])
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    sent = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(send, "range int, hashes binary, again binary")
    return sent.repartition(ranges, "range").mapInArrow(merge, "h long")


def suspects(docs: DataFrame, id_column: str, text: str, least: int, bits: int, filter_: bytes, part: int = 0, parts: int = 1) -> DataFrame:
    """(key, id): the distinct keys of each row that the filter names, of one part of the hash space."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filter_)
    kind = docs.select(F.col(f"`{id_column}`")).schema[0].dataType

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            for piece in pieces(b):
                rows, keys = [], []
                for i, t in enumerate(piece.column(1).cast(pa.binary()).to_pylist()):
                    own = text_keys(t, least)
                    rows += [i] * len(own)
                    keys += own
                if keys:
                    h = hashed(keys)
                    hit = np.flatnonzero(has(seen, probes(h, bits)) & (h % np.uint64(parts) == part))
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in hit], pa.binary()).cast(pa.string()), piece.column(0).take(pa.array([rows[i] for i in hit], pa.int64()))], names=["key", "id"])

    src = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return src.mapInArrow(probe, T.StructType([T.StructField("key", T.StringType()), T.StructField("id", kind)]))


def line_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = 40, documents: int = 5, broadcast_bytes: int = 32 << 20, filter_bits: int = MOST_BITS, scratch: Scratch | None = None) -> DataFrame:
    """docs with repeated lines cut from `text`, plus n_lines (before) and n_dropped.

    A key of `least` code points or more in `documents` rows or more loses all its lines but those of the
    largest id. Repeated keys go to all tasks while their bytes stay under `broadcast_bytes`; beyond that
    each row's dropped keys are joined to it by id. filter_bits: the most that the filter of pass 2 has, a power of two.
    """
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark)
    ranges = max(spark.sparkContext.defaultParallelism, -(-docs.count() // RANGE_ROWS))
    again = scratch.table(seen_again(docs, text, least, ranges))
    n = again.count()
    parts = max(1, -(-n * PROBE_BITS // filter_bits))
    bits = bits_for(-(-n // parts), PROBE_BITS, most=filter_bits)
    place = lambda k: F.pmod(F.pmod("h", F.lit(parts)) + F.when(F.col("h") < 0, F.lit((1 << 64) % parts)).otherwise(0), F.lit(parts)) == k
    found = None
    for k in range(parts):
        own = again.filter(place(k)) if parts > 1 else again
        one = suspects(docs, id_column, text, least, bits, merged(own, bits), k, parts)
        found = one if found is None else found.unionAll(one)
    repeated = scratch.table(found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep")).filter(F.col("n") >= documents))
    size = repeated.agg(F.coalesce(F.sum(F.octet_length("key") + 120), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        drops = spark.sparkContext.broadcast({r.key.encode(): r.keep for r in repeated.collect()})
        return rewrite(docs, id_column, text, least, drops)
    lost = hub_join(found, repeated, "key", "id").filter(~F.col("id").eqNullSafe(F.col("keep"))).groupBy("id").agg(F.collect_set(F.unhex(F.md5("key"))).alias("lost"))
    renamed, restored = aside(docs, ["__id", "__lost"])
    own_id = next(c for c, old in zip(renamed.columns, docs.columns, strict=True) if old == id_column)
    joined = renamed.join(lost.select(F.col("id").alias("__id"), F.col("lost").alias("__lost")), F.col(f"`{own_id}`").eqNullSafe(F.col("__id")), "left").drop("__id")
    names = dict(zip(docs.columns, renamed.columns, strict=True))
    out = rewrite(joined, own_id, names[text], least, None)
    back = [F.col(f"`{n}`").alias(c) for c, n in names.items() if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*back, "n_lines", "n_dropped")


def rewrite(docs: DataFrame, id_column: str, text: str, least: int, drops) -> DataFrame:
    """Cuts the lines whose keys are in `drops` (key to the id that keeps it) or, with None, in the column __lost."""
    import hashlib

    out = [c for c in docs.columns if c != "__lost"]
    names = [c for c in out if c.lower() not in ("n_lines", "n_dropped")]
    base = without(docs, ["n_lines", "n_dropped"]).withColumn(text, F.col(f"`{text}`").cast("string"))
    schema = T.StructType([*[f for f in base.schema.fields if f.name != "__lost"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = drops.value if drops is not None else None
        absent = object()
        for b in batches:
            for part in pieces(b):
                ids = part.column(id_column).to_pylist()
                lost = part.column("__lost").to_pylist() if held is None else ids
                texts, total, gone = [], [], []
                for id_, own, t in zip(ids, lost, part.column(text).cast(pa.binary()).to_pylist(), strict=True):
                    lines = (t or b"").split(b"\n")
                    if held is None:
                        own = set(own or ())
                        kept = [x for x in lines if not own or (k := line_key(x, least)) is None or hashlib.md5(k).digest() not in own]
                    else:
                        kept = [x for x in lines if (k := line_key(x, least)) is None or held.get(k, absent) in (absent, id_)]
                    total.append(len(lines))
                    gone.append(len(lines) - len(kept))
                    texts.append(b"\n".join(kept))
                cols = [pa.array(texts, pa.binary()).cast(pa.string()) if c == text else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return map_arrow(base, run, schema)
