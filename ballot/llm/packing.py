"""Packing along a space-filling curve.

Each document is tokenised once; its token counts, hashed to a fixed number of buckets, are projected to
a few dimensions and give a Hilbert key. Documents are range-sorted by that key, in rows of one sequence's
length at most, so that ranges of as many rows are alike in size however long the documents are, and every
range is filled up in order: neighbours on the curve share sequences, each of which is cut when it is full. What
is left at the end of a range is cut into sequences of powers of two, so that nothing is padded.

Ids are from the tokenizer file given. Texts in plain Latin scripts take a faster library with the same
vocabulary and merges; other texts, and those that hold an added token's string such as <|endoftext|> (that
token's one id), take the file's own library.

Defined results: a null or empty text is the closing id alone; rows with equal or null ids are documents
of their own, told apart by a row number, and so are repeated rows; rows with equal keys stay in the order
they were read in; very long texts are cut into rows of a sequence's length; an empty table gives an empty
result. Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballot.llm.common import Scratch, map_text

LENGTH = 2048
CLOSING = 1
RANGE_BYTES = 8 << 20  # of ids that a task packs
BUCKETS, DIMS, BITS = 1024, 3, 10
OTHER = re.compile("[^\x00-ɏ]")


def id_type(path: str) -> str:
    """The narrowest type that holds the vocabulary's ids; it halves what is written and shuffled."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def encoder(path: str, ranks: str | None, kind: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids, without special tokens around it; those written in it have their ids."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    whole = lambda t: slow.encode(t, add_special_tokens=False).ids
    if ranks is None:
        return lambda t: np.array(whole(t), kind)
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    plain = fast.encode_ordinary
    code = "H" if kind == "<u2" else "I"
    strings = [x.content for x in slow.get_added_tokens_decoder().values()]

    def encode(t: str) -> np.ndarray:
        ids = whole(t) if OTHER.search(t) or any(x in t for x in strings) else plain(t)
        return np.frombuffer(array(code, ids), kind)

    return encode


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of integer points in [0, 2^bits), one row each."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations from the coarsest cell inwards
        for i in range(len(x)):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(turned, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[i]
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x = [v ^ flip for v in x]
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | ((v >> b) & 1)
    return key


def projection(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))


def curve_keys(ids: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    v = np.stack([np.log1p(np.bincount(x % BUCKETS, minlength=BUCKETS)) for x in ids])
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    # Rounded before cells are cut, so that equal documents meet whatever the batch they came in.
    cell = np.clip(np.round((v @ matrix + 4) / 8, 9) * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(cell.astype(np.int64), BITS)


def tokenised(docs: DataFrame, text: str, keep: list[str], paths: tuple[str, str | None], id_kind: str) -> DataFrame:
    """keep, curve (Hilbert key), doc_tokens and chunks: the ids (little-endian, of id_kind), LENGTH at a time."""

    def make():
        encode = _encoder(paths, id_kind)
        matrix = projection()
        closing = np.array([CLOSING], id_kind)

        def run(texts):
            ids = [np.concatenate([encode(t), closing]) if t else closing for t in texts]
            chunks = [[x[i : i + LENGTH].tobytes() for i in range(0, len(x), LENGTH)] for x in ids]
            return [curve_keys(ids, matrix) if ids else [], [len(x) for x in ids], chunks]

        return run

    return map_text(docs, text, [("curve", T.LongType(), pa.int64()), ("doc_tokens", T.LongType(), pa.int64()), ("chunks", T.ArrayType(T.BinaryType()), pa.list_(pa.binary()))], make, keep=keep)


_held: dict = {}


def _encoder(paths, kind):
    """One encoder a worker process and kind."""
    if paths not in _held:
        _held[paths] = encoder(*paths, kind)
    return _held[paths]


def parts_of(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def place(rows: Iterator[tuple[object, int, int, np.ndarray]], length: int) -> Iterator[tuple]:
    """(doc, start, piece ids, doc tokens, sequence, offset) along the order of (doc, start, doc tokens, ids) rows.

    What follows another piece of its document in the same sequence is one piece with it.
    """
    number, fill, held = 0, 0, []
    last = None
    for doc, start, n, ids in rows:
        if held and last == (doc, start, n) and start:
            own, at, ids_before, *rest = held[-1]
            take = min(len(ids), length - fill)
            held[-1] = (own, at, np.concatenate([ids_before, ids[:take]]), *rest)
            at, fill = take, fill + take
            if fill == length:
                yield from held
                number, fill, held = number + 1, 0, []
        else:
            at = 0
        last = (doc, start + len(ids), n)
        while at < len(ids):
            take = min(len(ids) - at, length - fill)
            held.append((doc, start + at, ids[at : at + take], n, number, fill))
            at, fill = at + take, fill + take
            if fill == length:
                yield from held
                number, fill, held = number + 1, 0, []
    sizes = parts_of(fill)
    fill = 0
    for doc, at, ids, n, *_ in held:
        while len(ids):
            take = min(len(ids), sizes[0] - fill)
            yield doc, at, ids[:take], n, number, fill
            at, ids, fill = at + take, ids[take:], fill + take
            if fill == sizes[0]:
                sizes, number, fill = sizes[1:], number + 1, 0


def pack(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, paths: tuple[str, str | None] | None = None, scratch: Scratch | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    scratch = scratch or Scratch(docs.sparkSession)
    kind = docs.select(F.col(f"`{id_column}`")).schema[0].dataType
    src = docs.select(F.col(f"`{id_column}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    # Written once: the range bounds are sampled from it, and the row number must stay what it was.
    paths = paths or default_paths()
    id_kind = id_type(paths[0])
    ids = scratch.table(tokenised(src, "text", ["doc"], paths, id_kind).withColumn("row", F.monotonically_increasing_id()).select("doc", "curve", "row", "doc_tokens", F.posexplode("chunks").alias("part", "ids")))
    # As many ranges as the ids' bytes ask for, however many there are; a range is one task's.
    total = ids.filter("part = 0").agg(F.sum("doc_tokens")).first()[0] or 0
    ranges = max(1, math.ceil(total * np.dtype(id_kind).itemsize / range_bytes))
    ordered = ids.repartitionByRange(ranges, "curve", "row", "part").sortWithinPartitions("curve", "row", "part").select("doc", "part", "doc_tokens", "ids")
    names = [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(id_column, kind), *[T.StructField(n, T.LongType()) for n in names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        types: list = []

        def rows():
            for b in batches:
                types[:] = [b.column(0).type]
                for doc, part, n, x in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    yield doc, part * LENGTH, n, np.frombuffer(x, id_kind)

        out: list[list] = [[] for _ in names]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(x, types[0] if i == 0 else pa.int64()) for i, x in enumerate(out)], names=names)
        for doc, at, ids, n, number, offset in place(rows(), length):
            for x, v in zip(out, (doc, at, len(ids), zlib.crc32(ids.astype("<u4")), n, first + number, offset), strict=True):
                x.append(v)
            if len(out[0]) >= 1 << 14:
                yield batch()
                out = [[] for _ in names]
        if out[0]:
            yield batch()

    return ordered.mapInArrow(run, schema)
