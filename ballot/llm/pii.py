"""Personal data with deobfuscation that keeps offsets.

Base spans are found in the text as it stands. Then a cascade of transducers rewrites a copy: the first
writes homoglyphs and compatibility forms as ASCII and invisible characters as nothing; the second reads words of the
corpus's four languages for "at", "dot", the digits, "plus" and "double" and writes a mark for each; over the
marks, finite-state contexts (bracketed signs, addresses spoken part by part, runs of spelled digits) decide which
of them become signs or figures; the others stay the words they were. Every character of the copy carries the
source range it came from, so that identifiers found in the copy give spans of the source. Of these, only those
that a transducer had a hand in, and that overlap no base span or hold it whole and more, are added; base spans stay.

Defined results: a null text is empty; equal rows get equal results, whatever their ids; very long texts are
taken whole, in time and memory in proportion, with no bound on the parts of an address, their length or the
spaces around signs; spans of one kind never overlap, the leftmost being taken; an empty table gives an empty result.
Spans are in code points. Input columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ballot.llm.common import map_text
from ballot.llm.transducer import Copy, Edit, Transducer

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only start where its digits do; saying so keeps long runs of digits linear.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")

# Letters of other scripts that look like ASCII letters.
LIKE = dict(zip(
    "аеорсухіјѕԁАВЕКМНОРСТХІЈЅοαρνΑΒΕΖΗΙΚΜΝΟΡΤΥΧı․．。‐‑‒–−﹫＠＋",
    "aeopcyxijsdABEKMHOPCTXIJSoapvABEZHIKMNOPTYXi...-----@@+",
    strict=True,
))
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
FOREIGN = re.compile("[­ıͰ-֏​-―․⁠℀-⅏−①-⓿。﹐-﹯﻿！-～\U0001d400-\U0001d7ff]")

# Words in English, German, French and Spanish. "at" and "point" are everyday words of English prose.
DIGIT_WORDS = {
    "0": "zero oh null zéro cero",
    "1": "one eins un uno",
    "2": "two zwei zwo deux dos",
    "3": "three drei trois tres",
    "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco",
    "6": "six sechs seis",
    "7": "seven sieben sept siete",
    "8": "eight acht huit ocho",
    "9": "nine neun neuf nueve",
}
AT, AT_ONLY, DOT, POINT, PLUS, TWICE, THRICE = (chr(0xE040 + k) for k in range(7))
SIGN_WORDS = {
    AT: "at ät",
    AT_ONLY: "arobase arobas klammeraffe arroba",
    DOT: "dot punkt punto",
    POINT: "point",
    PLUS: "plus más",
    TWICE: "double doppelt doble",
    THRICE: "triple dreifach",
}
FIGURE = {chr(0xE030 + int(d)): d for d in DIGIT_WORDS}
_FIGURES = f"{min(FIGURE)}-{max(FIGURE)}"


def folded(c: str) -> str:
    """What the first transducer writes for a character: one ASCII character, nothing, or itself."""
    if c in INVISIBLE:
        return ""
    new = LIKE.get(c) or unicodedata.normalize("NFKC", c)
    return new if len(new) == 1 and new.isascii() else c


def ranges(*pairs: tuple[int, int]) -> Iterator[str]:
    for lo, hi in pairs:
        yield from map(chr, range(lo, hi + 1))


GLYPHS = Transducer((c, folded(c)) for c in [*LIKE, *INVISIBLE, *ranges((0x2100, 0x214F), (0x2460, 0x24FF), (0xFE50, 0xFE6F), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF))] if folded(c) != c)
WORDS = Transducer([(w, mark) for table in (SIGN_WORDS, {chr(0xE030 + int(d)): w for d, w in DIGIT_WORDS.items()}) for mark, words in table.items() for w in words.split()], words=True)

_SPOKEN = "|".join(w for words in DIGIT_WORDS.values() for w in words.split())
#: What a text must have for the marks to matter: signs beside brackets or spaces, or digit words one after another.
BRACKET = re.compile(r"[\[({<]")
SAID = frozenset(f"{SIGN_WORDS[DOT]} {SIGN_WORDS[AT_ONLY]}".split())
FIGURES_SAID = frozenset(_SPOKEN.split("|"))
SPELLED_HINT = re.compile(rf"\b(?:{_SPOKEN})[ ,-]+(?:(?:double|doppelt|doble|triple|dreifach)[ -]+)?(?:{_SPOKEN})\b", re.I)
BRACKETED_HINT = re.compile(r"[\[({<]\s*(?:[@.]|at\b|ät\b|dot\b|point\b|pun[kt])", re.I)
BRACKETED = re.compile(rf"[\[({{<]\s*(?:(?P<at>[{AT}{AT_ONLY}@])|[{DOT}{POINT}.])\s*[\])}}>]")
JOINT = re.compile(rf" (?:[{AT}{AT_ONLY}]|@) |@")
STEP = re.compile(rf" [{DOT}{POINT}] |\.| \. ")
LABEL = re.compile(r"[A-Za-z0-9-]+")
_ONE = f"(?:(?:[{TWICE}{THRICE}][ -]+)?[{_FIGURES}]|[0-9]+)"
SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:{PLUS}[ -]+)?{_ONE}(?:(?:[ ,-]+|[ -]*[{DOT}{POINT}][ -]*){_ONE}(?![A-Za-z0-9]))+")
SPELLED_PART = re.compile(f"[{PLUS}{TWICE}{THRICE}{DOT}{POINT}{_FIGURES}]|[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, each from its @: linear in the text."""
    out, free, at = [], 0, t.find("@")
    while at >= 0:
        begin = at
        while begin > free and t[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(t, at) if begin < at else None
        if m:
            out.append((begin, m.end()))
        free = m.end() if m else at + 1
        at = t.find("@", free)
    return out


def detect(t: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind; matches that fail their kind's test are dropped without another try inside them."""
    out = {k: [] for k in KINDS}
    if not SIGN.search(t):
        return out
    if "@" in t:
        out["email"] = emails(t)
    if "." in t:
        out["ip"] = [m.span() for m in IP.finditer(t) if all(small(p) for p in m[0].split("."))]
    for m in CARD.finditer(t):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in t:
        out["phone"] = [m.span() for m in PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def small(part: str) -> bool:
    """At most 255, whatever the leading zeros or the length."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def bracketed(t: str) -> list[Edit]:
    """Signs and words for them in brackets, with the spaces beside."""
    edits, free = [], 0
    for m in BRACKETED.finditer(t):
        a, b = m.span()
        while a > free and t[a - 1] in " \t\xa0":
            a -= 1
        while b < len(t) and t[b] in " \t\xa0":
            b += 1
        edits.append((a, b, "@" if m["at"] else "."))
        free = b
    return edits


def spoken(t: str) -> list[Edit]:
    """Addresses with words or spaced signs for "@" and ".": from each sign outwards, part by part.

    The English words "at" and "point" make no address by themselves ("look at this point in ..."): "at" asks for
    another word for a dot, and "point" for another word for "at" or for a sign. A spaced full stop after a whole name
    ends a sentence; it joins only names that are spaced from their first part on.
    """
    edits: list[Edit] = []
    free = 0
    for m in JOINT.finditer(t):
        a, at = m.start(), m[0].strip()
        steps: list[Edit] = []
        left = a
        while True:
            part = left
            while left > free and t[left - 1] in LOCAL:
                left -= 1
            if left == part:
                left = part + 3 if steps else part  # a step without a part before it is none
                if steps:
                    steps.pop()
                break
            if left - 3 >= free and t[left - 3] == t[left - 1] == " " and t[left - 2] in (DOT, POINT):
                steps.append((left - 3, left, "."))
                left -= 3
                continue
            break
        begin = left
        label = LABEL.match(t, m.end())
        if begin == a or not label:
            continue
        right: list[tuple[Edit | None, re.Match]] = []
        end, spaced = label.end(), False
        while step := STEP.match(t, end):
            after = LABEL.match(t, step.end())
            if not after or step[0] == " . " and (right and not spaced or right and not (t[after.start()].islower() or t[after.start()].isdigit())):
                break
            spaced |= step[0] == " . "
            right.append(((*step.span(), ".") if step[0] != "." else None, after))
            end = after.end()
        while right and not (right[-1][1][0].isalpha() and len(right[-1][1][0]) > 1):
            right.pop()
        if not right:
            continue
        own = [*reversed(steps), *([(*m.span(), "@")] if m[0] != "@" else []), *[x for x, _ in right if x]]
        words = {t[x + 1] for x, y, _ in own if y - x == 3}
        if at == AT and DOT not in words or POINT in words and at == AT:
            continue
        edits += own
        free = right[-1][1].end()
    return edits


def spelled(t: str) -> list[Edit]:
    """Runs with four digit words or more, or three dots or more: words to figures, separators to nothing, "plus" and "dot" to signs."""
    edits: list[Edit] = []
    for m in SPELLED.finditer(t):
        parts = list(SPELLED_PART.finditer(t, *m.span()))
        if sum(w[0] in FIGURE for w in parts) < 4 and sum(w[0] in (DOT, POINT) for w in parts) < 3:
            continue
        times, at = 1, m.start()
        for w in parts:
            if w[0] in (TWICE, THRICE):
                times, new = 2 if w[0] == TWICE else 3, ""
            else:
                new = "+" if w[0] == PLUS else "." if w[0] in (DOT, POINT) else FIGURE.get(w[0], w[0]) * times
                times = 1
            edits.append((at, w.end(), new))
            at = w.end()
    return edits


def in_context(tape: Copy, context: Callable[[str], list[Edit]]) -> Copy:
    """The tape with the marks that a context accepts written out; words whose marks it does not accept stay."""
    marked = Copy.of(tape.text).replaced(WORDS.edits(tape.text))
    return tape.replaced([(marked.begin[a], marked.end[b - 1], new) for a, b, new in context(marked.text)])


def said(text: str) -> tuple[int, bool]:
    """(words for signs, whether digit words follow one another): by whole words, which is faster than any pattern."""
    words = text.lower().replace(",", " ").replace("-", " ").split()
    signs = 0 if SAID.isdisjoint(words) else sum(w in SAID for w in words)
    return signs, not FIGURES_SAID.isdisjoint(words) and bool(SPELLED_HINT.search(text))


def deobfuscated(text: str) -> Copy:
    """The cascade; steps that have nothing to read in the text are left out."""
    tape = GLYPHS(Copy.of(text)) if FOREIGN.search(text) else Copy.of(text)
    if BRACKET.search(tape.text):
        tape = in_context(tape, bracketed)
    signs, figures = said(tape.text)
    if "@" in tape.text or signs:
        tape = in_context(tape, spoken)
    if figures or signs > 2:
        tape = in_context(tape, spelled)
    return tape


def disguised(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """Spans found in the rewritten copy only."""
    if not (FOREIGN.search(text) or BRACKETED_HINT.search(text) or "@" in text or any(said(text))):
        return []
    copy = deobfuscated(text)
    if not any(copy.made) and len(copy.text) == len(text):
        return []
    taken = sorted(s for found in base.values() for s in found)
    out = []
    for kind, found in detect(copy.text).items():
        for a, b in found:
            lo, hi = copy.begin[a], copy.end[b - 1]
            if not any(copy.made[a:b]) and hi - lo == b - a:
                continue
            i = bisect_left(taken, (lo, lo))
            over = [taken[i - 1]] if i and taken[i - 1][1] > lo else []
            while i < len(taken) and taken[i][0] < hi:
                over.append(taken[i])
                i += 1
            if all(lo <= x and y <= hi and (x, y) != (lo, hi) for x, y in over):
                out.append((kind, lo, hi))
    return out


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def pii_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and spans and n_pii, the added ones too."""

    def make():
        nothing = hashlib.sha256(b"").hexdigest()

        def run(texts):
            counts = {k: [0] * len(texts) for k in KINDS}
            digest, spans, total = [nothing] * len(texts), [""] * len(texts), [0] * len(texts)
            for i, t in enumerate(texts):
                if not t:
                    continue
                base = detect(t)
                own = [(k, *s) for k, found in base.items() for s in found]
                more = disguised(t, base)
                for k, *_ in own:
                    counts[k][i] += 1
                if own:
                    digest[i] = hashlib.sha256(joined(own).encode()).hexdigest()
                spans[i], total[i] = joined(own + more), len(own) + len(more)
            return [*counts.values(), digest, spans, total]

        return run

    return map_text(docs, text, [*[(f"n_{k}", T.LongType(), pa.int64()) for k in KINDS], ("base_sha256", T.StringType(), pa.string()), ("spans", T.StringType(), pa.string()), ("n_pii", T.LongType(), pa.int64())], make)
