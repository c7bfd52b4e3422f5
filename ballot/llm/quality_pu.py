"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the rest of the corpus is unlabelled; no negative label is
used. An additive model over binned statistics of the text is trained by minimising the non-negative
unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)). The class prior
is the ratio of the unlabelled to the positive share above the score where that ratio and its sampling error are
least. Two models, each trained on half of the sampled rows, give the scores: positives are scored by the half that
has not seen them, and the unlabelled share is that of all rows outside the held-out fold, counted by score in a pass
over the corpus.

The weights are trained on a bounded sample (`positives` and `unlabelled` rows, about, by a hash of the id); rows of
the held-out fold train nothing. Every row is scored.

Defined results: a null text is empty; empty texts get the score of their (zero) statistics; very long texts are
taken whole; equal texts get equal scores, whatever their ids, and so do repeated rows; a repeated id is a positive
if any of its labels is; rows are put in order by their statistics, so that ties and ids change nothing; an empty
table gives an empty result; without a positive label every score is 0.5. Input columns named like the results are
replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballot.llm.common import held_out, map_text, pieces, share

POSITIVES, UNLABELLED = 4000, 6000  # sampled rows, about
BINS, REACH = 400, 20.0  # of score histograms, and the log odds they reach either way
#: Finer at the ends, where each kind of junk has a few hundredths of the rows.
CUTS = [0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.25, 0.4, 0.6, 0.75, 0.85, 0.9, 0.93, 0.96, 0.98, 0.99, 0.995]
THRESHOLD = 0.3
SINGLE = b"#*$%&|<>!?.,;:-_=+/\\@\"'()[]{}~^`"


def _groups() -> np.ndarray:
    """256 byte values to counted groups: upper, lower, digits, white space, new lines, non-ASCII, signs one by one."""
    sets = [range(65, 91), range(97, 123), range(48, 58), [9, 10, 11, 12, 13, 32], [10], range(128, 256), *[[b] for b in SINGLE], SINGLE]
    out = np.zeros((256, len(sets)))
    for i, s in enumerate(sets):
        out[list(s), i] = 1
    return out


GROUPS = _groups()


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """A row of numbers for each text."""
    counts = np.zeros((len(texts), 256))
    rest = np.zeros((len(texts), 11))
    for i, t in enumerate(texts):
        if not t:
            continue
        counts[i] = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        words = t.split()
        n = len(words)
        if not n:
            continue
        size = np.fromiter(map(len, words), np.int64, n)
        tally = Counter(words)
        pairs = len(set(zip(words, words[1:])))  # noqa: B905
        lines = [x for x in t.split(b"\n") if x.strip()]
        rest[i] = (np.log1p(n), size.mean(), size.std(), size.max(), (size <= 2).mean(), len(tally) / n, max(tally.values()) / n, pairs / max(1, n - 1), np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), n / len(lines))
    shares = counts @ GROUPS / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.hstack([shares, rest])


@dataclass
class Model:
    edges: list[np.ndarray]
    weights: list[np.ndarray]
    bias: float
    prior: float = 0.5

    def log_odds(self, stats: np.ndarray) -> np.ndarray:
        z = np.full(len(stats), self.bias)
        for j, (e, w) in enumerate(zip(self.edges, self.weights, strict=True)):
            z += w[np.searchsorted(e, stats[:, j], side="right")]
        return z

    def score(self, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(stats)))


def binned(edges: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
    cols = [np.eye(len(e) + 1)[np.searchsorted(e, stats[:, j], side="right")] for j, e in enumerate(edges)]
    return np.hstack(cols)


def adam(grad, size: int, steps: int, rate: float = 0.1) -> np.ndarray:
    w, m, v = np.zeros((3, size), np.float32)
    for k in range(1, steps + 1):
        g = grad(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def histogram(z: np.ndarray) -> np.ndarray:
    """Rows by log odds, in BINS of equal width; the outermost take what is beyond."""
    place = np.clip(((z + REACH) * (BINS / (2 * REACH))).astype(np.int64), 0, BINS - 1)
    return np.bincount(place, minlength=BINS)


def class_prior(positive: np.ndarray, every: np.ndarray) -> float:
    """The ratio of the unlabelled to the positive share at or above a score, where its upper bound is least; of histograms."""
    n, m = positive.sum(), every.sum()
    a, b = (np.cumsum(h[::-1])[::-1] / max(1, h.sum()) for h in (positive, every))
    cut = np.flatnonzero(a >= 0.05)  # of positives too few are left beyond to say anything
    if not len(cut):
        return 0.5
    slack = np.sqrt(np.log(40) / (2 * m)) + np.sqrt(np.log(40) / (2 * n))
    best = cut[np.argmin((b[cut] + slack) / a[cut])]  # the error decides where to look, not what is seen there
    return float(np.clip(b[best] / a[best], 0.02, 0.98))


@dataclass
class Design:
    """Bins of the statistics, from sampled rows."""

    edges: list[np.ndarray]
    penalty: float

    @classmethod
    def of(cls, p: np.ndarray, u: np.ndarray) -> Design:
        both = np.vstack([p, u])
        cuts = [c for c in CUTS if min(c, 1 - c) * len(both) >= 12]
        return cls([np.unique(np.quantile(both[:, j], cuts)) for j in range(both.shape[1])], 1 / len(both))

    def rows(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([binned(self.edges, x), np.ones((len(x), 1))]).astype(np.float32)

    def model(self, w: np.ndarray, prior: float = 0.5) -> Model:
        weights, at = [], 0
        for e in self.edges:
            weights.append(w[at : at + len(e) + 1])
            at += len(e) + 1
        return Model(self.edges, weights, float(w[-1]), prior)


def halves(design: Design, p: np.ndarray, u: np.ndarray, steps: int = 100) -> list[tuple[Model, np.ndarray]]:
    """Models of positives against unlabelled rows, each from every second row, and how they score the other positives."""
    xp, xu = design.rows(p), design.rows(u)
    out = []
    for k in (0, 1):
        half_p, half_u = xp[k::2], xu[k::2]

        def grad(w, a=half_p, b=half_u):
            return -a.T @ sigmoid(-a @ w) / len(a) + b.T @ sigmoid(b @ w) / len(b) + 10 * design.penalty * w

        w = adam(grad, xp.shape[1], steps)
        out.append((design.model(w), histogram(xp[1 - k :: 2] @ w)))
    return out


def train(design: Design, p: np.ndarray, u: np.ndarray, prior: float, steps: int = 300) -> Model:
    """p, u: statistics of trusted positives and of unlabelled rows."""
    xp, xu = design.rows(p), design.rows(u)

    def risk(w):
        zp, zu = xp @ w, xu @ w
        plus = -prior * xp.T @ sigmoid(-zp) / len(xp)
        minus = xu.T @ sigmoid(zu) / len(xu) - prior * xp.T @ sigmoid(zp) / len(xp)
        worth = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # Below zero the second part is overfitted: step back from it.
        return (plus + minus if worth >= 0 else -minus) + design.penalty * w

    return design.model(adam(risk, xp.shape[1], steps), prior)


def counted(docs: DataFrame, models: list[Model], id_column: str, text: str) -> np.ndarray:
    """[model, bin]: all rows outside the held-out fold by each model's score; a task sends its sums only."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(shared.value), BINS), np.int64)
        for b in batches:
            for part in pieces(b):
                stats = statistics(part.column(0).cast(pa.binary()).to_pylist())
                for k, m in enumerate(shared.value):
                    sums[k] += histogram(m.log_odds(stats))
        place = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums.ravel()[place])], names=["place", "n"])

    rows = docs.filter(~held_out(id_column)).select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "place long, n long")
    out = np.zeros(len(models) * BINS, np.int64)
    for r in rows.groupBy("place").agg(F.sum("n").alias("n")).collect():  # a record a bin
        out[r.place] = r.n
    return out.reshape(len(models), BINS)


def quality_model(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """The classifier; none without a positive label. positives, unlabelled: sampled rows, about, that train its weights."""
    p, u = sampled(docs, labels, id_column, text, label, positives, unlabelled)
    if not len(p) or not len(u):
        return None
    design = Design.of(p, u)
    prior = 0.5
    if len(p) > 3 and len(u) > 3:
        own = halves(design, p, u)
        every = counted(docs, [m for m, _ in own], id_column, text)
        prior = float(np.mean([class_prior(h, every[k]) for k, (_, h) in enumerate(own)]))
    return train(design, p, u, prior)


def sampled(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, positives: int, unlabelled: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of positives and of unlabelled rows; sizes are bounded by the two parameters, up to hashing."""
    known = labels.select(F.col(f"`{id_column}`").alias("__id"), F.col(f"`{label}`").alias("__label")).filter("__id IS NOT NULL")
    good = known.filter("__label = 1").filter(~held_out("__id"))
    good = good.filter(share(F.col("__id"), good.count(), positives, 1)).select("__id").distinct()
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).filter("id IS NOT NULL").filter(~held_out("id"))
    some = share(F.col("id"), docs.count(), unlabelled, 2)
    # One pass: rows of either sample, marked; the positives' ids are a bounded set.
    marked = rows.join(F.broadcast(good), F.col("id") == F.col("__id"), "left").select("text", F.col("__id").isNotNull().alias("p"), some.alias("u")).filter("p OR u")

    def make():
        return lambda texts: [statistics(texts).tolist()]

    got = map_text(marked, "text", [("stats", T.ArrayType(T.DoubleType()), pa.list_(pa.float64()))], make, binary=True, keep=["p", "u"]).collect()
    got.sort(key=lambda r: (r.stats, r.p, r.u))
    wide = GROUPS.shape[1] + 11
    pick = lambda which: np.array([r.stats for r in got if r[which]]).reshape(-1, wide)
    return pick("p"), pick("u")


def quality_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """docs with held_out, score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(quality_model(docs, labels, id_column, text, label, positives, unlabelled))

    def make():
        def run(texts):
            m = model.value
            s = m.score(statistics(texts)) if m else np.full(len(texts), 0.5)
            return [s, (s >= threshold).astype(np.int32)]

        return run

    out = map_text(docs, text, [("score", T.DoubleType(), pa.float64()), ("predicted", T.IntegerType(), pa.int32())], make, binary=True)
    return out.withColumn("held_out", held_out(id_column))
