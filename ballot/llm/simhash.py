"""SimHash near-duplicate classes over a Gray-order hierarchical index.

Every distinct fingerprint is dealt to one bucket for each of four 16-bit blocks: of two fingerprints
with three differing bits or fewer, one block at least is equal. Within a bucket the fingerprints are
sorted by Gray rank, which puts codes of like bits beside each other, and grouped bottom-up; an upper
node holds the bits that all codes below it share (mask and pattern). A fingerprint descends from its
bucket's root, adding up the differences at the bits each node adds to its parent's; a sum over the
limit prunes the whole group. A node whose codes differ in no more bits than the limit is taken whole.

A task returns only the spanning stars of the links it found, so a group of n copies gives n rows and
not n squared. Buckets with far more than their share of the fingerprints are cut into chunks, each
pair of which is one group of its own. Classes come from alternating large-star and small-star rounds.

The wider fingerprints of `keep_first` are searched by the same index, in other buckets.

Defined results: a null text has no words, like an empty one, and fingerprint zero; very long texts are taken
whole; rows with null doc_id take part, but never name a class unless no row in it has an id; rows that repeat
get a row each; an empty table gives an empty result. Exact copies share a fingerprint and are one point of
the search. Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballot.llm.bloom import bits_for, has, merged, probes
from ballot.llm.common import Scratch, aside, hub_join, map_arrow, map_text

SEED = 42
FAN = 8
BUCKET_ROWS = 1 << 20  # rows of buckets, about, that a task searches
LARGE_BUCKETS = 100_000  # whose sizes may be broadcast
#: A wide fingerprint's words, the bits in which linked ones differ at most, and the bands of least hashes they share one of.
WORDS, WIDE_MOST, BANDS, BAND_ROWS = 4, 48, 10, 3
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64-bit hash of each hash, one for each k."""
    out = h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for factor in MIX:
        out = (out ^ (out >> np.uint64(33))) * factor
    return out ^ (out >> np.uint64(33))


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of each run of `width` words, repeats included; of all words where there are fewer; none without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    buf = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(buf, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[: 1 - width].tolist()
    return np.array([digest(buf[a:b], SEED) for a, b in zip(begin, end[width - 1 :].tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """64 bits, each 1 if set in over half the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64 bits, each 1 if set in over half the XXH64 of the text's word shingles, repeats included."""
    h = shingle_hashes(text, width)  # of bytes: A-Z and ASCII white space only
    return majority(h) if len(h) else 0


def signature(text: bytes | None, width: int, bands: int, rows: int) -> tuple[list[int], list[int]]:
    """(WORDS words of a wide fingerprint, a key for each band of `rows` least hashes), as signed numbers."""
    h = shingle_hashes(text, width)
    if not len(h):
        return [0] * WORDS, [0] * bands
    own = np.unique(h)  # a line said twice makes short texts no more alike
    wide = [majority(mixed(own, k)) for k in range(WORDS)]
    factors = MULTIPLIERS[: bands * rows, None]
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 1 << 12):
        np.minimum(least, ((own[i : i + (1 << 12)] ^ (own[i : i + (1 << 12)] >> np.uint64(32)))[None, :] * factors).min(axis=1), out=least)
    keys = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        keys = mixed(keys ^ column, 1)
    return [signed(x) for x in wide], keys.view(np.int64).tolist()


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code [row, word] in the reflected Gray sequence, the first word the most significant."""
    out = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    for w in range(1, codes.shape[1]):  # odd above: the sequence below runs backwards
        out[:, w] ^= np.uint64(0) - (out[:, w - 1] & np.uint64(1))
    return out


def bits_of(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[:, 0]).astype(np.int64) if x.shape[1] == 1 else np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def index_levels(group: np.ndarray, codes: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Levels of nodes over codes sorted by (group, Gray rank), leaves first, up to one node a group."""
    n = len(codes)
    level = {"first": np.arange(n), "end": np.arange(1, n + 1), "group": group, "and": codes, "or": codes}
    out = []
    while True:
        level["mask"] = ~(level["and"] ^ level["or"])
        out.append(level)
        g = level["group"]
        new = np.r_[True, g[1:] != g[:-1]]
        if new.all():
            return out
        at = np.arange(len(g))
        start = np.flatnonzero(new | ((at - np.maximum.accumulate(np.where(new, at, 0))) % FAN == 0))
        level = {"first": level["first"][start], "end": level["end"][np.r_[start[1:], len(g)] - 1], "group": g[start], "and": np.bitwise_and.reduceat(level["and"], start, axis=0), "or": np.bitwise_or.reduceat(level["or"], start, axis=0), "child": start, "children": np.diff(np.r_[start, len(g)])}


def links(group: np.ndarray, codes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions that connect what differs in `most` bits or fewer; codes [row, word] sorted by (group, Gray rank)."""
    levels = index_levels(group, codes)
    for level in levels[1:]:  # tight nodes: everything below is linked
        tight = np.flatnonzero(bits_of(~level["mask"]) <= most)
        count = level["end"][tight] - level["first"][tight] - 1
        left = np.repeat(level["first"][tight] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        yield left, left + 1
    top = levels[-1]
    size = top["end"] - top["first"]
    root_of = np.repeat(np.arange(len(size)), size)
    # Where nothing can be pruned a query meets all of its group: as many queries at once as that allows.
    step = max(64, min(1 << 13, (1 << 21) // max(1, int(size.max(initial=1)))))
    for lo in range(0, len(codes), step):
        query = np.arange(lo, min(lo + step, len(codes)))
        node = root_of[query]
        query = query[top["end"][node] > query + 1]
        node = root_of[query]
        above = np.zeros((len(query), codes.shape[1]), np.uint64)
        acc = np.zeros(len(query), np.int64)
        for depth in range(len(levels) - 1, -1, -1):
            if not len(query):
                break
            level = levels[depth]
            if depth < len(levels) - 1:
                upper = levels[depth + 1]
                count = upper["children"][node]
                begin = upper["child"][node]
                above = np.repeat(upper["mask"][node], count, axis=0)
                query, acc = np.repeat(query, count), np.repeat(acc, count)
                node = np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            acc = acc + bits_of((codes[query] ^ level["and"][node]) & level["mask"][node] & ~above)
            keep = (acc <= most) & (level["end"][node] > query + 1)
            query, node, acc = query[keep], node[keep], acc[keep]
            whole = acc + bits_of(~level["mask"][node]) <= most
            if whole.any():
                yield query[whole], level["end"][node[whole]] - 1
            query, node, acc = query[~whole], node[~whole], acc[~whole]


def stars(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position reachable from each of n, by the pairs given."""
    label = np.arange(n)
    for a, b in pairs:
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            low = np.minimum(x, y)
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while not np.array_equal(up := label[label], label):
                label = up
    return label


def bucket_links(keyed: DataFrame, rows: int, codes: list[str], most: int) -> DataFrame:
    """(u, v): spanning stars of the links within each key's group of (key, node, *codes) rows."""
    width = len(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        key, node, *words = (np.concatenate(x) for x in zip(*got, strict=True))
        code = np.stack([w.view(np.uint64) for w in words], axis=1)
        # A key of one row has no links; a repeated row is one.
        order = np.lexsort((node, key))
        key, node, code = key[order], node[order], code[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node, code = key[fresh], node[fresh], code[fresh]
        begins = np.r_[True, key[1:] != key[:-1]]
        alone = begins & np.r_[begins[1:], True]
        key, node, code = key[~alone], node[~alone], code[~alone]
        if not len(key):
            return
        rank = gray_rank(code)
        order = np.lexsort((*[rank[:, w] for w in range(width - 1, -1, -1)], key))
        key, node, code = key[order], node[order], code[order]
        own, at = np.unique(node, return_inverse=True)
        label = stars(len(own), ((at[a], at[b]) for a, b in links(key, code, most)))
        moved = np.flatnonzero(label != np.arange(len(own)))
        for i in range(0, len(moved), 1 << 16):
            m = moved[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own[m]), pa.array(own[label[m]])], names=["u", "v"])

    parts = max(keyed.sparkSession.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))
    return keyed.select("key", "node", *codes).repartition(parts, "key").mapInArrow(run, "u long, v long").distinct()


def chunked(dealt: DataFrame, fair: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """(key, ...) of dealt (bucket, ...) and its rows: buckets of over `fair` rows are cut into chunks by node.

    Each pair of a bucket's chunks is a group of its own, so that no group has more than about 2 * fair rows,
    and every two rows of the bucket meet.
    """
    sizes = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    large = scratch.table(sizes.filter(F.col("n") > fair).select("bucket", F.ceil(F.col("n") / fair).alias("chunks"), "n"))
    n_large, extra = large.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n") * F.col("chunks")), F.lit(0))).first()
    rows = dealt.count() + int(extra)
    if not n_large:
        return dealt.withColumnRenamed("bucket", "key"), rows
    chunks = large.select("bucket", "chunks")
    parts = dealt.join(F.broadcast(chunks) if n_large <= LARGE_BUCKETS else chunks, "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    parts = parts.withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks"))).withColumn("o", other)
    return parts.withColumn("key", F.xxhash64("bucket", F.least("c", "o"), F.greatest("c", "o"))).drop("bucket", "chunks", "c", "o"), rows


def near_links(distinct: DataFrame, most: int, scratch: Scratch, blocks: int = 4) -> DataFrame:
    """(u, v), v not u: links that connect all fingerprints with `most` < `blocks` differing bits or fewer."""
    width = 64 // blocks
    block = [F.shiftrightunsigned(F.shiftleft("fp", 64 - width * (i + 1)), 64 - width) for i in range(blocks)]
    dealt = distinct.select(F.col("fp").alias("node"), F.explode(F.array(*[F.lit(i * 2**width).cast("long") + v for i, v in enumerate(block)])).alias("bucket")).withColumn("c0", F.col("node"))
    keyed, rows = chunked(dealt, max(512, 4 * distinct.count() // 2**width), scratch)
    return bucket_links(keyed, rows, ["c0"], most)


def classes(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): v is the smallest node reachable from u; only nodes that are not their own smallest.

    Large stars and small stars in turn until nothing changes: a number of rounds that grows with the
    logarithm of the classes. A node of very many links is spread over tasks.
    """
    now = scratch.table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v"))
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = scratch.table(hub_join(both, low, "u", "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = scratch.table(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        joined = hub_join(large, least, "u", "v")
        now = scratch.table(joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            return now
        mark = new


def simhash_classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", most: int = 3, width: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """(id_column, fingerprint, component_id): a row for each row of docs."""
    scratch = scratch or Scratch(docs.sparkSession)

    def make():
        return lambda texts: [[signed(fingerprint(t, width)) for t in texts]]

    src = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
    fps = scratch.table(map_text(src, "text", [("fp", T.LongType(), pa.int64())], make, binary=True, keep=["id"]))
    groups = scratch.table(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    near = classes(near_links(groups.select("fp"), most, scratch), scratch)
    low = groups.join(near, F.col("fp") == F.col("u"), "left").select("fp", "least", "n", F.coalesce("v", "fp").alias("root"))
    roots = scratch.table(low.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    named = scratch.table(hub_join(low, roots, "root", "fp").select("fp", "component_id", "n"))
    return hub_join(fps, named, "fp", "id").select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_links(distinct: DataFrame, most: int, scratch: Scratch, fair: int = 2048) -> DataFrame:
    """(u, v): links of wide fingerprints with `most` differing bits or fewer that share a key; distinct: (node, w0.., keys)."""
    words = [f"w{k}" for k in range(WORDS)]
    keyed, rows = chunked(distinct.select("node", *words, F.explode("keys").alias("bucket")), fair, scratch)
    return bucket_links(keyed, rows, words, most)


def keep_first(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 5, most: int = WIDE_MOST, bands: int = BANDS, rows: int = BAND_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """docs less all but one row of each class of texts alike in their `width`-word shingles.

    Texts are linked whose fingerprints of 256 bits differ in `most` or fewer. The default is meant for a
    Jaccard similarity of 0.8, at which 39 bits are expected: of such pairs of the test tables nearly all are
    linked, of pairs at 0.75 most, under 0.6 none. With so many bits no equal block can be relied on, so the
    buckets of the index are bands of least shingle hashes: a pair at 0.8 shares none of them once in 1,300.

    The row that stays is that of the smallest id, then of the least checksum of its text, and of equal rows
    the one whose other columns have the least checksum. Texts of rows that stay are not shuffled: a
    Bloom filter of what goes sends only those it names to an exact comparison.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    words = [f"w{k}" for k in range(WORDS)]
    own = F.col(f"`{text}`").cast("string")
    identity = [F.col(f"`{id_column}`"), F.xxhash64(F.lit(1), own), F.xxhash64(F.lit(2), own)]
    names = ["id", "h1", "h2"]

    def make():
        def run(texts):
            got = [signature(t, width, bands, rows) for t in texts]
            return [*[[g[0][k] for g in got] for k in range(WORDS)], [g[1] for g in got]]

        return run

    src = docs.select(*[c.alias(n) for c, n in zip(identity, names, strict=True)], own.alias("text"))
    signed_rows = map_text(src, "text", [*[(w, T.LongType(), pa.int64()) for w in words], ("keys", T.ArrayType(T.LongType()), pa.list_(pa.int64()))], make, binary=True, keep=names)
    marks = scratch.table(signed_rows.withColumn("fp", F.xxhash64(*words)))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), *names)).alias("first")
    groups = scratch.table(marks.groupBy("fp", *words).agg(first, F.count(F.lit(1)).alias("n"), F.min("keys").alias("keys")).withColumn("node", F.monotonically_increasing_id()))
    near = classes(wide_links(groups, most, scratch), scratch)
    low = groups.select("fp", *words, "node", "first", "n").join(near, F.col("node") == F.col("u"), "left").withColumn("root", F.coalesce("v", "node"))
    of_root = scratch.table(low.groupBy("root").agg(F.min("first").alias("stays"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("n")).filter("size > 1").drop("size"))
    shared = scratch.table(hub_join(low, of_root, "root", "node").select("fp", *[F.col(w).alias(f"{w}_") for w in words], "stays", "n"))
    # Rows of classes of two rows or more, one for each (id, text), with how many there are and whether they stay.
    same = F.lit(True)
    for w in words:
        same = same & (F.col(w) == F.col(f"{w}_"))
    rows_of = marks.groupBy("fp", *words, *names).agg(F.count(F.lit(1)).alias("copies"))
    one = shared.groupBy("fp").agg(F.sum("n").alias("n"), F.collect_list(F.struct("stays", *[f"{w}_" for w in words])).alias("x"))  # more than one only where checksums collide
    found = hub_join(rows_of, one, "fp", "h1").withColumn("x", F.explode("x")).select("*", "x.*").filter(same)
    stays = F.lit(True)
    for n in names:
        stays = stays & F.col(n).eqNullSafe(F.col(f"stays.{n}"))
    verdict = scratch.table(found.select(*names, "copies", stays.alias("stays")).filter("copies > 1 OR NOT stays"))
    return less(docs, identity, verdict.select(*names, "stays"), scratch)


def less(docs: DataFrame, identity: list[F.Column], verdict: DataFrame, scratch: Scratch) -> DataFrame:
    """docs less the rows whose identity is in verdict (*names, stays), but one row of each that stays."""
    names = verdict.columns[:-1]
    n = verdict.count()
    if not n:
        return docs
    bits = bits_for(n)
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    filter_ = docs.sparkSession.sparkContext.broadcast(merged(verdict.select(key), bits))
    renamed, _ = aside(docs, [*names, "__key"])
    plain, restored = renamed.columns, dict(zip(renamed.columns, docs.columns, strict=True))
    mark = [c.alias(name) for c, name in zip(identity, names, strict=True)]
    marked = docs.select(*[F.col(f"`{restored[c]}`").alias(c) for c in plain], *mark).withColumn("__key", key)

    def kept(hits: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.frombuffer(filter_.value, np.uint8)
            for b in batches:
                hit = has(seen, probes(b.column(b.num_columns - 1).to_numpy().view(np.uint64), bits)) if b.num_rows else np.zeros(0, bool)
                yield b.filter(pa.array(hit == hits))

        return run

    out = [F.col(f"`{c}`").alias(restored[c]) for c in plain]
    clear = map_arrow(marked, kept(False), marked.schema).select(*out)
    # Equal identities are summed to one row before the comparison, so that none of them makes a task large.
    suspects = map_arrow(marked, kept(True), marked.schema)
    row = F.struct(*[F.col(f"`{c}`") for c in plain])
    one = suspects.groupBy(*names).agg(F.min_by(row, F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in plain])).alias("row"), F.count(F.lit(1)).alias("copies"))
    match = F.lit(True)
    for name in names:
        match = match & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    told = one.alias("a").join(verdict.alias("b"), match, "left").filter("b.stays IS NULL OR b.stays").select("a.row")
    return clear.unionByName(told.select(*[F.col(f"row.`{c}`").alias(restored[c]) for c in plain]))
