"""Benchmark decontamination by greedy string tiling.

Benchmark items become token ids; the Karp-Rabin hash of each run of `width` tokens is a seed. The
documents' rolling hashes are looked up in the seeds, a batch at a time; a document and an item that
share seeds over enough of the item's tokens are tiled: the longest match that overlaps no earlier tile
is marked again and again, trimmed to what is free, until none of `width` tokens is left. Items with a
tiled share of at least `threshold` are reported, so that passages whose sentences were reordered or
interrupted are found too.

The benchmark is a query set: it goes to all tasks in blocks of bounded size, one pass over the
documents for each block, and the documents are never shuffled.

Seed pairs of an item and a text are listed up to PAIRS of them. Beyond that, as where one word is repeated
without end, the longest matches are found by rolling hashes of growing and shrinking length instead: the same
tiles, in memory that grows with the text and not with the pairs.

Tokens are lower-case words; ASCII punctuation counts as space. Defined results: null and empty texts and items
match nothing; items of fewer than `width` tokens match texts that consist of just these tokens; very long texts
are searched whole; equal items are reported each, and so are repeated rows, whatever their ids; of matches of equal
length the first in the item, then in the text, is marked; an empty table on either side gives no matches. Input
columns may have any names: only the id and the text are read, or all are passed on as they were.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ballot.llm.common import map_arrow, pieces

WIDTH = 5
THRESHOLD = 0.8
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BLOCK = 16 << 20  # bytes of benchmark text in one pass
PAIRS = 1 << 18  # of places in an item and a text, up to which they are listed
PUNCTUATION = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(PUNCTUATION).split()


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` ids, modulo 2^64."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * BASE + ids[k : k + n].astype(np.uint64)
    return h


class Seeds:
    """Items as ids of the benchmark's own vocabulary (from 1; 0: any other word), and where each hash occurs."""

    def __init__(self, items: list[tuple[object, str | None]], width: int = WIDTH):
        self.width = width
        self.vocabulary: dict[bytes, int] = {}
        self.names, self.items = [], []
        for name, text in items:
            words = tokens(text)
            if len(words) >= width:
                self.names.append(name)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
        self.short = {}  # items of fewer tokens than a seed: matched by texts that are nothing else
        for name, text in items:
            words = tokens(text)
            if 0 < len(words) < width:
                self.short.setdefault(tuple(words), []).append(name)
        hashes = [rolling(x, width) for x in self.items]
        all_ = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(all_, kind="stable")
        self.item, self.place = item[order], place[order]
        self.hashes, self.first, number = np.unique(all_[order], return_index=True, return_inverse=True)
        self.count = np.diff(np.r_[self.first, len(all_)])
        back = np.empty(len(all_), np.int64)
        back[order] = number
        self.seed_of = np.split(back, np.cumsum([len(h) for h in hashes])[:-1]) if hashes else []  # by item, of each place

    def ids(self, text: str | None) -> list[int]:
        get = self.vocabulary.get
        return [get(w, 0) for w in tokens(text)]

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of runs whose hash is a seed, and that seed's number; runs with a foreign word are none."""
        n = len(ids) - self.width + 1
        if n <= 0 or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids > 0
        whole = np.flatnonzero(np.logical_and.reduce([known[k : k + n] for k in range(self.width)]))
        h = np.zeros(len(whole), np.uint64)
        for k in range(self.width):
            h = h * BASE + ids[whole + k].astype(np.uint64)
        seed = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[seed] == h
        return whole[hit], seed[hit]


def tile(item: np.ndarray, text: np.ndarray, at_item: np.ndarray, at_text: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Tiles (item position, text position, length) from seed pairs, longest first, none overlapping."""
    order = np.lexsort((at_item, at_text - at_item))
    i, j = at_item[order], at_text[order]
    same = np.ones(len(i), bool)
    for k in range(width):  # equal hashes of unequal runs drop out here
        same &= item[i + k] == text[j + k]
    i, j = i[same], j[same]
    if not len(i):
        return []
    new = np.flatnonzero(np.r_[True, (np.diff(i) != 1) | (np.diff(j) != 1)])
    runs = np.diff(np.r_[new, len(i)])
    heap = [(-(n + width - 1), a, b) for n, a, b in zip(runs.tolist(), i[new].tolist(), j[new].tolist(), strict=True)]
    heapq.heapify(heap)
    used_item, used_text = np.zeros(len(item), bool), np.zeros(len(text), bool)
    out = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = ~(used_item[a : a + n] | used_text[b : b + n])
        if free.all():
            out.append((a, b, n))
            used_item[a : a + n] = True
            used_text[b : b + n] = True
            continue
        # What is left of it competes again.
        edge = np.flatnonzero(np.diff(np.r_[0, free.astype(np.int8), 0]))
        for k, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if end - k >= width:
                heapq.heappush(heap, (k - end, a + k, b + k))
    return out


def tile_long(item: np.ndarray, text: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """The same tiles without listing the pairs of seeds: memory in proportion to item and text.

    The longest run that is free in both is found by halving its length, with rolling hashes of all free runs
    of a length; where it occurs, tiles of that length are marked, first in the item, first in the text.
    """
    used_item, used_text = np.zeros(len(item), bool), np.zeros(len(text), bool)
    out: list[tuple[int, int, int]] = []

    def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of free runs of n tokens that item and text share, with their hashes."""
        found = []
        for x, used in ((item, used_item), (text, used_text)):
            taken = np.r_[0, np.cumsum(used)]
            h = rolling_long(x, n)
            at = np.flatnonzero(taken[n:] == taken[: len(x) - n + 1])
            found.append((at, h[at]))
        (a, ha), (b, hb) = found
        keep = np.isin(hb, ha)
        b, hb = b[keep], hb[keep]
        keep = np.isin(ha, hb)
        return a[keep], ha[keep], b, hb

    longest = min(len(item), len(text))
    while longest >= width:
        lo, hi = width - 1, longest  # runs of lo tokens are shared, or lo is under the width; none of more than hi is
        while lo < hi:
            n = (lo + hi + 1) // 2
            lo, hi = (n, hi) if len(common(n)[0]) else (lo, n - 1)
        if lo < width:
            break
        n, longest = lo, lo
        a, ha, b, hb = common(n)
        order = np.argsort(hb, kind="stable")
        b, hb = b[order], hb[order]
        next_ = {}
        marked = False
        for place, h in zip(a.tolist(), ha.tolist(), strict=True):
            if used_item[place : place + n].any():
                continue
            k = next_.get(h, int(np.searchsorted(hb, np.uint64(h))))
            while k < len(hb) and int(hb[k]) == h:
                at = int(b[k])
                k += 1
                if not used_text[at : at + n].any() and np.array_equal(item[place : place + n], text[at : at + n]):
                    out.append((place, at, n))
                    used_item[place : place + n] = True
                    used_text[at : at + n] = True
                    marked = True
                    break
            next_[h] = k
        if not marked:  # hashes that agree by chance only
            longest = n - 1
    return out


def rolling_long(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n ids modulo 2^64, from sums of the ids' hashes times powers of the base."""
    if n > len(ids):
        return np.zeros(0, np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(ids)), dtype=np.uint64)]
    return (sums[n:] - sums[:-n]) * powers(INVERSE, len(ids) - n + 1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def covered(seeds: Seeds, ids: np.ndarray, threshold: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(item number, its covered tokens, tiles) of each item with a tiled share of `threshold` in one text."""
    at, seed = seeds.hits(ids)
    if not len(at):
        return
    yield from _covered(seeds, ids, at, seed, threshold)


def _covered(seeds: Seeds, ids: np.ndarray, at: np.ndarray, seed: np.ndarray, threshold: float, most: int = PAIRS):
    order = np.argsort(seed, kind="stable")
    at, seed = at[order], seed[order]
    begin = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]])
    own = seed[begin]
    times = np.diff(np.r_[begin, len(seed)])
    # The places of the text's seeds in the items, each once however often the text has it.
    n = seeds.count[own]
    slot = np.repeat(seeds.first[own] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    item, place = seeds.item[slot], seeds.place[slot]
    order = np.argsort(item, kind="stable")
    item, place = item[order], place[order]
    starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(item)], strict=True):
        words = seeds.items[item[a]]
        mark = np.zeros(len(words) + 1, np.int64)
        first = np.unique(place[a:b])
        np.add.at(mark, first, 1)
        np.add.at(mark, first + seeds.width, -1)
        if (np.cumsum(mark)[:-1] > 0).sum() < threshold * len(words):
            continue  # every tile is made of seeds, so they bound its share from above
        of = np.searchsorted(own, seeds.seed_of[item[a]][first])
        n = times[of]
        if n.sum() <= most:
            text_at = at[np.repeat(begin[of] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
            tiles = tile(words, ids, np.repeat(first, n), text_at, seeds.width)
        else:
            tiles = tile_long(words, ids, seeds.width)
        total = sum(x[2] for x in tiles)
        if total >= threshold * len(words):
            yield int(item[a]), total, tiles


def in_batch(seeds: Seeds, texts: list[str | None], threshold: float) -> Iterator[tuple[int, object, int, int, list[tuple[int, int, int]]]]:
    """(row, item, its tokens, covered tokens, tiles) over a batch of texts."""
    lists = [seeds.ids(t) for t in texts]
    # One array for the batch, with a foreign word between texts, so that no run spans two.
    flat = np.fromiter((x for y in lists for x in (*y, 0)), np.int64)
    begin = np.cumsum([0, *(len(y) + 1 for y in lists)])
    at, seed = seeds.hits(flat)
    rows = np.searchsorted(begin, at, side="right") - 1
    for r in np.unique(rows):
        lo, hi = np.searchsorted(rows, [r, r + 1])
        for number, *found in _covered(seeds, flat[begin[r] : begin[r + 1] - 1], at[lo:hi] - begin[r], seed[lo:hi], threshold):
            yield int(r), seeds.names[number], len(seeds.items[number]), *found
    if seeds.short:
        longest = max(map(len, seeds.short))
        for r, own in enumerate(lists):
            if 0 < len(own) <= longest:
                for name in seeds.short.get(tuple(tokens(texts[r])), ()):
                    yield r, name, len(own), len(own), [(0, 0, len(own))]


def find(docs: DataFrame, block: list[tuple[object, str | None]], item_type: T.DataType, id_column: str, text: str, width: int, threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Seeds(block, width))
    src = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", src.schema[0].dataType), T.StructField("item", item_type), *[T.StructField(n, T.LongType()) for n in ("item_tokens", "covered_tokens", "n_tiles", "longest_tile")], T.StructField("coverage", T.DoubleType())])

    item_kind = to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        for b in batches:
            for part in pieces(b):
                out = []
                for r, name, n, total, tiles in in_batch(seeds, part.column(1).to_pylist(), threshold):
                    out.append((r, name, n, total, len(tiles), max(x[2] for x in tiles), total / n))
                if out:
                    row, name, *rest = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(name, item_kind), *(pa.array(x, pa.int64()) for x in rest[:-1]), pa.array(rest[-1], pa.float64())], names=schema.names)

    return src.mapInArrow(run, schema)


def free_of(docs: DataFrame, block: list[tuple[object, str | None]], text: str, width: int, threshold: float) -> DataFrame:
    """docs less the rows that hold an item of the block; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(Seeds(block, width))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b):
                keep = np.ones(part.num_rows, bool)
                for r, *_ in in_batch(shared.value, part.column(place).to_pylist(), threshold):
                    keep[r] = False
                yield part.filter(pa.array(keep))

    return map_arrow(docs, run, docs.schema)


def blocks(benchmark: DataFrame, item_column: str, text: str, most: int = BLOCK) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark's items, `most` bytes or one item at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col(f"`{item_column}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).toLocalIterator():
        n = len((r.text or "").encode())
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((r.id, r.text))
        size += n
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id, item, item_tokens, covered_tokens, n_tiles, longest_tile, coverage): documents that hold items."""
    item_type = benchmark.select(F.col(f"`{item_column}`")).schema[0].dataType
    out = None
    for part in blocks(benchmark, item_column, item_text, block):
        one = find(docs, part, item_type, id_column, text, width, threshold)
        out = one if out is None else out.union(one)
    out = find(docs.limit(0), [], item_type, id_column, text, width, threshold) if out is None else out
    return out.withColumnsRenamed({"id": id_column, "item": item_column})


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_column: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """docs less the rows that hold a benchmark item, all columns as they were."""
    for part in blocks(benchmark, item_column, item_text, block):
        docs = free_of(docs, part, text, width, threshold)
    return docs
