"""Toxicity by weak supervision.

Voters, each a word list or a pattern, fire or abstain on a text; some of the lists are mined from labelled
rows: words of which an excess in toxic rows is more than chance explains. All rows outside the held-out fold are
counted by which voters fired and by their label, if any: at most 3 * 2^VOTERS rows reach the driver,
whatever the corpus. A generative label model is fitted to the counts by expectation and maximisation. It has for
either class a firing rate for every voter and an interaction for the pairs of voters that fire together more
often than the class explains; a given label is one more voter, which abstains on rows without one and errs
at rates that are estimated like the others'. Which class a row has is known of no row: the voters'
agreement decides, and without labels it does so alone. The model's posterior labels a bounded sample of texts,
weighted back to the corpus, on which a sparse linear classifier over words and voters is trained.

Defined results: a null text is empty; no voter fires on it, and it gets the score of a text without
known words; very long texts are taken whole, as the set of their words; equal texts get equal scores, whatever
their ids; a repeated id has each of its texts labelled by its greatest label; ties between words go to the lesser
word; an empty table gives an empty result. Without a text on which a voter fires, words have no weight. Input
columns named like the results are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballot.llm.common import Scratch, held_out, map_text, share

FIRED, SILENT = 4000, 6000  # sampled texts, about
THRESHOLD = 0.5

# Word lists, one voter each; without words that are everyday ones in another of the languages.
LEXICONS = {
    "wits": "idiot idiots idiotic moron morons moronic stupid stupidity imbecile imbeciles dumb dumbass dimwit halfwit cretin brainless dunce",
    "worth": "worthless loser losers pathetic useless parasite parasites vermin leech crybaby",
    "filth": "trash scum filth filthy garbage dirtbag scumbag scumbags lowlife maggot maggots disgusting disgrace repulsive revolting sickening hideous",
    "ridicule": "clown clowns buffoon fool fools foolish laughable ridiculous creep creepy",
    "vulgar": "shit shitty bullshit fuck fucking fucker bitch bastard bastards asshole assholes crap piss dickhead prick wanker slut whore",
    "foreign": "dummkopf vollidiot arschloch scheisse scheiße abschaum wichser hurensohn schlampe trottel missgeburt connard connasse salaud salope merde crétin abruti ordure enculé minable estúpido estúpida imbécil pendejo cabrón mierda gilipollas basura asqueroso",
}
# Patterns, together one voter.
PATTERNS = r"\byou(?:'re| are|r)?\s+(?:a |an |such a |all |so |just a )?(?:idiot|moron|stupid|loser|trash|scum|pathetic|worthless|disgusting|clown|dumb|fool|ugly)|\b(?:shut up|go to hell|get lost|drop dead|kill yourself|screw you|hate you|piss off)\b"
MINED = 5  # voters over words mined from labelled rows, the most telling first; more would only multiply the patterns
VOTERS = [*LEXICONS, "pattern", *(f"mined{k}" for k in range(MINED))]
LABELLED = 20_000  # labelled rows, about, that words are mined from
PULL = 10
PAIRS, WORDS_KEPT = 6, 400  # correlated pairs of voters at most, and words that the classifier chooses from
LEET = str.maketrans("013457@$!", "oieastasi")
#: ASCII but letters, digits and these signs, which stand for letters at times, is space.
SPACES = bytes(b if b >= 128 or chr(b).isalnum() or chr(b) in "'@$!" else 32 for b in range(256))
MARKS = re.compile("[¡¿«»‐-‧„“”]")


def words(text: str | None) -> set[str]:
    low = (text or "").lower()
    if not low.isascii():
        low = MARKS.sub(" ", low)
    return {w.strip("'@$!") for w in set(low.encode().translate(SPACES).decode().split())} - {""}


class Voters:
    """mined: further words, the most telling first, dealt to the mined voters by rank."""

    def __init__(self, mined: list[str]):
        self.of_word: dict[str, int] = {}
        for k, name in enumerate(LEXICONS):
            for w in LEXICONS[name].split():
                self.of_word[w] = 1 << k
        for k, w in enumerate(mined):
            self.of_word.setdefault(w, 1 << len(LEXICONS) + 1 + k * MINED // len(mined))
        self.pattern = re.compile(PATTERNS)

    def mask(self, text: str | None, own: set[str]) -> int:
        out = 0
        for w in own & self.of_word.keys():
            out |= self.of_word[w]
        for w in own:
            if not w.isalpha():  # digits and signs for letters
                plain = w.translate(LEET)
                if plain.isalpha():
                    out |= self.of_word.get(plain, 0)
        if ("you" in own or own & {"up", "hell", "lost", "dead", "yourself", "off"}) and self.pattern.search((text or "").lower()):
            out |= 1 << len(LEXICONS)
        return out


def telling(sums: DataFrame, toxic: int, clean: int) -> list[str]:
    """Words of (word, t, n), the toxic and all rows with it, whose excess in toxic rows no chance among so many words explains.

    Each word is tested where it is; those that pass, words of a bounded sample, reach the driver.
    """
    mean = toxic / max(1, toxic + clean)
    chance = math.sqrt(2 * math.log(max(3, sums.count())))
    score = F.round((F.col("t") - F.col("n") * mean) / F.sqrt(F.col("n") * (mean * (1 - mean)) + 1e-9), 9)
    return [r.word for r in sums.filter("2 * t > n").withColumn("score", score).filter(F.col("score") > chance).orderBy(F.desc("score"), "word").collect()]


def bits(masks: np.ndarray) -> np.ndarray:
    return (masks[:, None] >> np.arange(len(VOTERS)) & 1).astype(float)


@dataclass
class LabelModel:
    """For either class the probability of every set of voters to fire: the flattest that has the class's rates and pairs."""

    prior: float
    pairs: list[tuple[int, int]]
    log_p: np.ndarray  # [class, pattern]
    says: np.ndarray  # by class, how often a given label is toxic

    def posterior(self, masks: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """Of patterns, and of the labels given beside them if any (-1: none)."""
        z = self.log_p[:, masks] + np.log([1 - self.prior, self.prior])[:, None]
        odds = z[1] - z[0]
        if known is not None:
            given = Labels(known)
            given.says = self.says
            odds = odds + given.log_odds()
        return 1 / (1 + np.exp(np.clip(-odds, -60, 60)))


def design(masks: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    b = bits(masks)
    return np.hstack([b, *[(b[:, i] * b[:, j])[:, None] for i, j in pairs]])


def flattest(features: np.ndarray, target: np.ndarray, sweeps: int = 30) -> np.ndarray:
    """Log probabilities of all patterns with the given feature means, by iterative proportional fitting."""
    p = np.full(len(features), 1 / len(features))
    on = features > 0
    for _ in range(sweeps):
        for k, t in enumerate(target):
            mean = p[on[:, k]].sum()
            p = p * np.where(on[:, k], t / mean, (1 - t) / (1 - mean))
    return np.log(np.maximum(p, 1e-300))


class Labels:
    """The voter of given labels: how often it says toxic in either class, the weight of ten rows on being right."""

    def __init__(self, known: np.ndarray):
        self.known, self.says = known, np.array([0.05, 0.9])

    def log_odds(self) -> np.ndarray:
        a, b = self.says
        return np.select([self.known == 1, self.known == 0], [np.log(b / a), np.log((1 - b) / (1 - a))], 0.0)

    def learn(self, counts: np.ndarray, post: np.ndarray) -> None:
        given = self.known >= 0
        for k, (w, prior) in enumerate(((counts * (1 - post), 0.05), (counts * post, 0.9))):
            self.says[k] = (w[self.known == 1].sum() + 10 * prior) / (w[given].sum() + 10)
        self.says = np.clip(self.says, 1e-4, 1 - 1e-4)


def fit(masks: np.ndarray, counts: np.ndarray, known: np.ndarray, prior: float = 0.05, rounds: int = 60, most_pairs: int = PAIRS) -> LabelModel:
    """The label model of the patterns seen, their counts and labels (-1: none), by expectation and maximisation."""
    m = len(VOTERS)
    every = np.arange(1 << m)
    b = bits(masks)
    rate = np.array([np.full(m, 1e-3), np.full(m, 0.2)])
    labels, pi = Labels(known), prior
    if set(known[known >= 0].tolist()) == {0, 1}:  # labelled rows give the first guess of the rates, and nothing more
        for k in (0, 1):
            w = counts * (known == k)
            rate[k] = np.clip((w @ b + (0.5 if k else 0.01)) / (w.sum() + 1), 1e-4, 0.99)
        rate[1] = np.clip(np.maximum(rate[1], 2 * rate[0]), 1e-3, 0.99)
    for _ in range(rounds):  # voters independent given the class
        ll = b @ np.log(rate).T + (1 - b) @ np.log(1 - rate).T + np.log([1 - pi, pi])
        post = 1 / (1 + np.exp(np.clip(ll[:, 0] - ll[:, 1] - labels.log_odds(), -60, 60)))
        labels.learn(counts, post)
        for k, w in enumerate((counts * (1 - post), counts * post)):
            # The toxic class keeps a rate over the other's, so that the classes cannot change places.
            rate[k] = (w @ b + (0.05 if k else 0.001)) / (w.sum() + 1)
        rate[1] = np.maximum(rate[1], 2 * rate[0])
        rate = np.clip(rate, 1e-7, 1 - 1e-7)
        pi = float(np.clip((counts * post).sum() / counts.sum(), 1e-4, 0.5))
    # Pairs that fire together beyond what the classes explain.
    expect = np.einsum("n,ki,kj->ij", [counts.sum()], rate * np.sqrt([1 - pi, pi])[:, None], rate * np.sqrt([1 - pi, pi])[:, None])
    seen = (b * counts[:, None]).T @ b
    excess = np.triu((seen - expect) / np.sqrt(expect + 1), 1)
    order = np.dstack(np.unravel_index(np.argsort(-excess, axis=None), excess.shape))[0]
    pairs = [(int(i), int(j)) for i, j in order[:most_pairs] if excess[i, j] > 4]
    xe, x = design(every, pairs), design(masks, pairs)
    for _ in range(rounds):
        given = [counts * (1 - post), counts * post]
        pi = float(np.clip(given[1].sum() / counts.sum(), 1e-4, 0.5))
        log_p = []
        for k, w in enumerate(given):
            rate = np.clip((w @ x[:, :m] + (0.05 if k else 0.001)) / (w.sum() + 1), 1e-7, 1 - 1e-7)
            alone = np.array([rate[i] * rate[j] for i, j in pairs])
            # Pairs are drawn to what independent voters would give, by the weight of PULL rows.
            # Clean texts are taken to meet voters by chance, each by itself: what fires together there is no class.
            both = (w @ x[:, m:] + PULL * alone) / (w.sum() + PULL) if k else alone
            most = np.array([min(rate[i], rate[j]) for i, j in pairs])
            log_p.append(flattest(xe, np.r_[rate, np.minimum(both, 0.999 * most)]))
        model = LabelModel(pi, pairs, np.array(log_p), labels.says)
        post = model.posterior(masks, known)
        labels.learn(counts, post)
    return model


@dataclass
class Classifier:
    words: dict[str, float]
    voters: np.ndarray
    bias: float

    def score(self, own: set[str], mask: int) -> float:
        z = self.bias + sum(self.words[w] for w in own & self.words.keys()) + sum(v for k, v in enumerate(self.voters) if mask >> k & 1)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(rows: list[tuple[list[str], int, float, float]], names: list[str], steps: int = 600, penalty: float = 4e-4) -> Classifier:
    """A sparse logistic model of (words, fired voters, posterior, weight) rows, by proximal gradient steps; names: words it may use."""
    if not rows:
        return Classifier({}, np.zeros(len(VOTERS)), -2.0)
    number = {w: i for i, w in enumerate(names)}
    width = len(names) + len(VOTERS)
    pairs = [(i, number[w]) for i, (own, *_) in enumerate(rows) for w in own if w in number]
    pairs += [(i, len(names) + k) for i, (_, mask, *_) in enumerate(rows) for k in range(len(VOTERS)) if mask >> k & 1]
    at = np.array(pairs, np.int64).reshape(-1, 2)
    y, weight = (np.array([r[k] for r in rows]) for k in (2, 3))
    weight = weight / max(weight.sum(), 1e-9)
    # Steps fit to each feature's curvature, which rare ones have little of.
    curve = np.maximum(np.bincount(at[:, 1], weight[at[:, 0]], width), 1e-4) / 4
    w, bias = np.zeros(width), float(np.log((weight @ y + 1e-6) / (weight @ (1 - y) + 1e-6)))
    for _ in range(steps):
        z = np.bincount(at[:, 0], w[at[:, 1]], len(rows)) + bias
        r = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        new = w - 0.3 * np.bincount(at[:, 1], r[at[:, 0]], width) / curve
        w = np.sign(new) * np.maximum(np.abs(new) - 0.3 * penalty / curve, 0)
        bias -= 2 * r.sum()
    return Classifier({n: float(v) for n, v in zip(names, w, strict=False) if v}, w[len(names) :], float(bias))


def votes(docs: DataFrame, mined: list[str], id_column: str, text: str, with_words: bool) -> DataFrame:
    def make():
        voters = Voters(mined)

        def run(texts):
            own = [words(t) for t in texts]
            masks = [voters.mask(t, o) for t, o in zip(texts, own, strict=True)]
            return [masks, [sorted(o) for o in own]] if with_words else [masks]

        return run

    return map_text(docs, text, [("mask", T.LongType(), pa.int64()), WORDS] if with_words else [("mask", T.LongType(), pa.int64())], make, keep=[id_column])


WORDS = ("words", T.ArrayType(T.StringType()), pa.list_(pa.string()))


def mine(rows: DataFrame, known: DataFrame, scratch: Scratch, sample: int = LABELLED) -> list[str]:
    """Words telling toxic rows apart, from about `sample` labelled rows; rows: (id, text), known: (__id, known)."""
    total = {r.known: r["count"] for r in known.groupBy("known").count().collect()}
    if set(total) != {0, 1}:
        return []
    some = known.filter(share(F.col("__id"), sum(total.values()), sample, 5))
    picked = rows.join(F.broadcast(some), F.col("id") == F.col("__id")).select("known", "text")
    split = map_text(picked, "text", [WORDS], lambda: lambda texts: [[sorted(words(t)) for t in texts]], keep=["known"])
    sums = scratch.table(split.select("known", F.explode("words").alias("word")).groupBy("word").agg(F.sum("known").alias("t"), F.count(F.lit(1)).alias("n")).filter("n >= 3"))
    return telling(sums, total[1], total[0])


def toxicity_model(docs: DataFrame, labels: DataFrame | None = None, id_column: str = "doc_id", text: str = "text", label: str = "toxic", scratch: Scratch | None = None, labelled: int = LABELLED, fired: int = FIRED, silent: int = SILENT) -> tuple[list[str], Classifier]:
    """The mined words and the classifier.

    labelled: labelled rows, about, that words are mined from; fired, silent: rows, about, on which a voter fires or
    none does, that the classifier is trained on. The label model counts all rows outside the held-out fold.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")).filter(~held_out("id"))
    mined: list[str] = []
    known = None
    if labels is not None:
        known = labels.select(F.col(f"`{id_column}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("known")).filter("known IN (0, 1)").filter(~held_out("__id")).groupBy("__id").agg(F.max("known").alias("known"))
        mined = mine(rows, known, scratch, labelled)

    def with_labels(marked: DataFrame, *columns) -> DataFrame:
        if known is None:
            return marked.select(*columns, "mask", F.lit(-1).alias("known"))
        return marked.join(known, F.col("id") == F.col("__id"), "left").select(*columns, "mask", F.coalesce("known", F.lit(-1)).alias("known"))

    found = with_labels(votes(rows, mined, "id", "text", False)).groupBy("mask", "known").count().collect()
    masks, given, counts = (np.array([r[c] for r in found], np.int64) for c in ("mask", "known", "count"))
    if not len(masks):
        return mined, Classifier({}, np.zeros(len(VOTERS)), -2.0)
    model = fit(masks, counts, given)
    n_fired, n_silent = int(counts[masks > 0].sum()), int(counts[masks == 0].sum())
    # The sample is chosen by id before texts are split; whether voters fire is known only afterwards.
    wide = share(F.col("id"), max(n_fired, 1), fired, 3)
    narrow = share(F.col("id"), max(n_silent, 1), silent, 4)
    some = votes(rows.select("id", "text", wide.alias("wide"), narrow.alias("narrow")).filter("wide OR narrow").select(F.struct("id", "wide", "narrow").alias("at"), "text"), mined, "at", "text", True)
    some = some.filter(F.when(F.col("mask") != 0, F.col("at.wide")).otherwise(F.col("at.narrow"))).select("at.id", "mask", "words")
    post = spark.createDataFrame([(int(m), int(k), float(p)) for m, k, p in zip(masks, given, model.posterior(masks, given), strict=True)], "m long, k int, post double")
    some = with_labels(some, "id", "words").join(F.broadcast(post), (F.col("mask") == F.col("m")) & (F.col("known") == F.col("k"))).select("id", "mask", "post", "words")
    some = scratch.table(some)  # a bounded sample, read three times
    names = apart(some)
    own = F.array_sort(F.array_intersect("words", F.lit(names).cast("array<string>")))
    # In an order that ids play no part in, so that ties and repeated ids cannot change the sums.
    got = sorted((r.mask, r.post, r.words) for r in some.select("mask", "post", own.alias("words")).collect())
    seen = sum(mask != 0 for mask, *_ in got)
    scale = n_fired / max(1, seen), n_silent / max(1, len(got) - seen)
    return mined, train([(own, mask, post, scale[0] if mask else scale[1]) for mask, post, own in got], names)


def apart(some: DataFrame, least: int = 8, most: int = WORDS_KEPT) -> list[str]:
    """Of the words in `least` sampled rows or more the `most` that tell posteriors apart best."""
    total = some.agg(F.avg("post")).first()[0] or 0.0
    sums = some.select("post", F.explode("words").alias("word")).groupBy("word").agg(F.sum("post").alias("t"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    far = F.round(F.abs(F.col("t") - F.col("n") * total) / F.sqrt(F.col("n") * (total * (1 - total)) + 1), 6)
    return sorted(r.word for r in sums.orderBy(far.desc(), "word").limit(most).collect())


def toxicity_scores(docs: DataFrame, labels: DataFrame | None = None, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, scratch: Scratch | None = None, **bounds) -> DataFrame:
    """docs with held_out, score and predicted; bounds: those of toxicity_model."""
    model = docs.sparkSession.sparkContext.broadcast(toxicity_model(docs, labels, id_column, text, scratch=scratch, **bounds))

    def make():
        mined, classifier = model.value
        voters = Voters(mined)

        def run(texts):
            scores = []
            for t in texts:
                own = words(t)
                scores.append(classifier.score(own, voters.mask(t, own)))
            return [scores, [int(s >= threshold) for s in scores]]

        return run

    out = map_text(docs, text, [("score", T.DoubleType(), pa.float64()), ("predicted", T.IntegerType(), pa.int32())], make)
    return out.withColumn("held_out", held_out(id_column))
