"""Quality rules learned as a decision list, in DataFrame functions only.

Statistics of whole texts are Column expressions over one row's arrays: no shuffle, no Python. A bounded
sample of labelled rows' statistics trains ordered rules by sequential covering: a rule grows by the
threshold condition of the best information gain, is pruned on rows it did not grow on, and stays if it
is precise there; what it covers leaves the sample. The list becomes one CASE WHEN expression.

Defined results: a null text is empty and has no words; a text without words is not kept; equal rows get
equal results, whatever their ids; very long texts are taken whole, as arrays of one row; ties between
conditions go to the feature named first, then the lower cut; an empty table gives an empty result; without
labels of both kinds no rule is learned and only the fixed rules reject. Input columns named like the results
are replaced; all others, whatever their names, stay.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballot.llm.common import SPACE, aside, held_out, share, without

WINDOW = 5
FIXED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "mean_chars", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "distinct_rate", "mark_rate"]
SAMPLE = 8000  # labelled rows at most, about, that the list is learned from


#: Names of columns on the way, which the input's columns make room for.
INNER = ["__t", "__trim", "__words", "__lines", "__upper", "__marks", "__windows", "__placed", "__twice", "__n_lines", "__distinct"]


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with FIXED and FEATURES columns; columns of df with those names are replaced, all others stay."""
    df, restored = aside(without(df, [*FIXED, *FEATURES]), INNER)
    text = text if text in df.columns else next(c for c, old in zip(df.columns, restored(df).columns, strict=True) if old == text)
    own = df.columns
    keep = [F.col(f"`{c}`") for c in own]
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    df = df.select(*keep, t.alias("__t"), F.trim(t, F.lit(SPACE)).alias("__trim"))
    words = F.when(F.col("__trim") == "", none).otherwise(F.split("__trim", r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    left = lambda pattern: F.char_length(F.regexp_replace("__t", pattern, "")).cast("long")
    df = df.select(*keep, words.alias("__words"), lines.alias("__lines"), left(r"[^#*$%&|<>]+").alias("n_symbols"), left(r"[^A-Z]+").alias("__upper"), left(r"[^!?#*$%&|<>]+").alias("__marks"))
    n = F.size("__words")
    at = lambda i, k: F.get(F.col("__words"), i + k)
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<long>"))
    df = df.select("*", hashes.alias("__windows"))
    # Only texts with a repeated window sort their windows.
    again = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select("*", F.when(again, placed).alias("__placed"))
    same = lambda s, j: F.coalesce(F.get("__placed", j)["h"] == s["h"], F.lit(False))
    twice = F.filter("__placed", lambda s, j: same(s, j - 1) | same(s, j + 1))
    df = df.select("*", F.array_sort(F.transform(twice, lambda s: s["i"])).alias("__twice"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("__twice", zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    df = df.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").alias("__n_lines"),
        F.size(F.array_distinct("__words")).alias("__distinct"),
        "__upper",
        "__marks",
    )
    rate = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    df = df.select(
        *keep,
        *FIXED,
        rate("word_chars", "n_words").alias("mean_chars"),
        rate("n_symbols", "word_chars").alias("symbol_rate"),
        rate("n_dup_lines", "__n_lines").alias("dup_line_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"),
        rate("__upper", "word_chars").alias("upper_rate"),
        rate("__distinct", "n_words").alias("distinct_rate"),
        rate("__marks", "word_chars").alias("mark_rate"),
    )
    back = [F.col(f"`{c}`").alias(old) for c, old in zip(own, restored(df).columns, strict=True)]
    return df.select(*back, *FIXED, *FEATURES)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.cut if self.above else row[self.feature] <= self.cut

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut


def covers(rule: list[Condition], row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def cuts(rows: list[dict], feature: str, most: int = 24) -> list[float]:
    """Midpoints between neighbouring quantiles."""
    values = sorted({r[feature] for r in rows})
    picked = values if len(values) <= most + 1 else [values[i * (len(values) - 1) // most] for i in range(most + 1)]
    return [(a + b) / 2 for a, b in zip(picked, picked[1:], strict=False)]


def count(rows: list[dict]) -> tuple[int, int]:
    bad = sum(r["bad"] for r in rows)
    return bad, len(rows) - bad


def grow(rows: list[dict], features: list[str], longest: int) -> list[Condition]:
    """Adds the condition of the best information gain until no good row is covered."""
    rule: list[Condition] = []
    while len(rule) < longest:
        p, n = count(rows)
        if not p or not n:
            break
        base, best, pick = math.log2(p / (p + n)), 1e-9, None
        for f in features:
            order = sorted(rows, key=lambda r: r[f])
            places = cuts(rows, f)
            k = below_p = below_n = 0
            for cut in places:
                while k < len(order) and order[k][f] <= cut:
                    below_p += order[k]["bad"]
                    below_n += 1 - order[k]["bad"]
                    k += 1
                for above, a, b in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
                    if a and (gain := a * (math.log2(a / (a + b)) - base)) > best:
                        best, pick = gain, Condition(f, above, cut)
        if pick is None:
            break
        rule.append(pick)
        rows = [r for r in rows if pick.holds(r)]
    return rule


def prune(rule: list[Condition], rows: list[dict]) -> list[Condition]:
    """The prefix of the rule with the best (p - n) / (p + n) on rows that did not grow it; the shorter of equals."""

    def worth(k: int) -> float:
        p, n = count([r for r in rows if covers(rule[:k], r)])
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda x: (worth(len(x)), -len(x)), default=[])


def learn(rows: list[dict], features: list[str] | None = None, precision: float = 0.95, longest: int = 4, most: int = 24) -> list[list[Condition]]:
    """Ordered rules that reject; each row has `features`, "bad" (0 or 1) and "fold" (0: prunes, else: grows)."""
    features = features or FEATURES
    out: list[list[Condition]] = []
    left = rows
    while len(out) < most and count(left)[0] > 2:
        growing, pruning = [r for r in left if r["fold"]], [r for r in left if not r["fold"]]
        whole = grow(growing, features, longest)
        shortest = len(prune(whole, pruning))
        for k in range(shortest, len(whole) + 1):  # conditions pruned too much come back
            rule = whole[:k]
            p, n = count([r for r in left if covers(rule, r)]) if rule else (0, 0)
            if p >= 3 and p >= precision * (p + n):
                break
        else:
            break
        out.append(rule)
        left = [r for r in left if not covers(rule, r)]
    return out


def verdict(rules: list[list[Condition]]) -> Column:
    """True where no rule rejects; the rules as ordered branches."""
    out = None
    for rule in rules:
        every = rule[0].column()
        for c in rule[1:]:
            every = every & c.column()
        out = F.when(every, False) if out is None else out.when(every, False)
    return F.lit(True) if out is None else out.otherwise(True)


def learned_rules(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, **settings) -> list[list[Condition]]:
    """Rules from about `sample` labelled rows at most outside the held-out fold, chosen by a hash of their ids.

    Rows are put in order by their statistics, and a checksum of a row's statistics says whether it grows or
    prunes rules, so that ids of any type, repeated ids and ties of all kinds give the same rules in every run.
    """
    known = labels.select(F.col(f"`{id_column}`").alias("__id"), F.col(f"`{label}`").alias("__label")).filter("__label IN (0, 1)").filter(~held_out("__id"))
    some = known.filter(share(F.col("__id"), known.count(), sample))
    rows = with_statistics(docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(some), F.col("id") == F.col("__id")).select("text", F.col("__label").alias("label")), "text")
    found = sorted((tuple(float(r[f]) for f in FEATURES), int(r.label)) for r in rows.select("label", *FEATURES).collect())
    return learn([dict(zip(FEATURES, x, strict=True)) | {"bad": 1 - y, "fold": zlib.crc32(repr((x, i)).encode()) % 3} for i, (x, y) in enumerate(found)], **settings)


def quality_rules(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", sample: int = SAMPLE, precision: float = 0.95, longest: int = 4, most: int = 24) -> DataFrame:
    """docs with the statistics, base_failed and kept.

    sample: labelled rows, about, that rules are learned from; precision: the share of bad rows that a rule
    must cover among them; longest: conditions a rule; most: rules.
    """
    rules = learned_rules(docs, labels, id_column, text, sample=sample, precision=precision, longest=longest, most=most)
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    out = with_statistics(without(docs, ["base_failed", "kept"]), text)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))
