"""Secret scan: all rules in one minimal automaton, one pass over the bytes of each text.

The combined automaton says after which byte the seed of which rule ends: what every match of it begins
with, up to the first byte of its last run. From there the rule's own backward automaton runs to where the
match begins, the leftmost place after the end of the rule's match before, and its forward one to where it
ends. All are transition arrays made by subset construction and minimisation; no other search is done, and no
byte outside of matches and their seeds is read twice. Base kinds then drop what is under their least length, without another try inside it.
Further kinds (tokens of well-known services, web tokens, private keys, passwords in addresses) add spans.

The combined automaton counts no runs but those of hexadecimal digits: counted or open runs of several rules
side by side would multiply its states (over 44,000 with them, about 1,200 without). Least lengths are in the
forward automata, or checked on the spans.

Defined results: a null text is empty; equal rows get equal results, whatever their ids; very long texts
are scanned whole, in time and memory in proportion; rules never match across line ends, and spans of one kind
never overlap, the leftmost and then longest being taken; an empty table gives an empty result. Input columns named
like the results are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ballot.llm.automaton import Automaton
from ballot.llm.common import map_text

VALUE = "[A-Za-z0-9+/_.=-]"
KEYWORD = "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"


@dataclass(frozen=True)
class Rule:
    """seed: what the combined automaton looks for; whole: all of a match, from where the seed begins.

    A match shorter than `least` is taken and dropped; `lead`: what of a match doesn't count towards its length.
    fold: ASCII letters in either case; before: what the backward automaton reads from the seed's end, if not the
    seed; run: of seeds that end at places in a row the last one counts.
    """

    seed: str
    whole: str
    least: int = 0
    lead: str = ""
    fold: bool = False
    before: str = ""
    run: bool = False


def run_of(lead: str, kind: str, least: int) -> Rule:
    return Rule(f"{lead}{kind}", f"{lead}{kind}{{{least},}}")


SCHEME = "[a-z][a-z0-9+]*"
BASE = {
    "assign": Rule(f"{KEYWORD}{VALUE}", f"{KEYWORD}{VALUE}+", 12, KEYWORD, True),
    "access": Rule("AKIA[A-Z0-9]", "AKIA[A-Z0-9]+", 18),
    "hex": Rule("[0-9a-f]{16}", "[0-9a-f]+", 16, before="[0-9a-f]+", run=True),
}
ADDED = {
    "github": run_of("gh[pousr]_", "[A-Za-z0-9]", 36),
    "slack": run_of("xox[abeoprs]-", "[A-Za-z0-9-]", 10),
    "google": run_of("AIza", "[A-Za-z0-9_-]", 35),
    "stripe": run_of("[rs]k_live_", "[A-Za-z0-9]", 16),
    "webtoken": Rule("eyJ[A-Za-z0-9_-]+\\.eyJ", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    "private_key": Rule("-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "address_password": Rule("://[A-Za-z0-9_.-]+:[A-Za-z0-9_.%!$*+-]+@", f"{SCHEME}://[A-Za-z0-9_.-]+:[A-Za-z0-9_.%!$*+-]{{6,}}@[A-Za-z0-9.-]+", before=f"{SCHEME}://[A-Za-z0-9_.-]+:[A-Za-z0-9_.%!$*+-]+@"),
}
RULES = BASE | ADDED
KINDS = list(RULES)


class Scanner:
    """The rules as automata."""

    def __init__(self, rules: dict[str, Rule] = RULES):
        self.rules = rules
        self.seeds = Automaton([(r.seed, r.fold) for r in rules.values()])
        self.runs = sum(1 << k for k, r in enumerate(rules.values()) if r.run)
        self.back = [Automaton([(r.before or r.seed, r.fold)], anchored=True, backward=True) for r in rules.values()]
        self.whole = [Automaton([(r.whole, r.fold)], anchored=True) for r in rules.values()]
        self.lead = [Automaton([(r.lead, r.fold)], anchored=True) if r.lead else None for r in rules.values()]

    def spans(self, texts: list[bytes]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) in bytes of each text, in no particular order."""
        out = []
        names = list(self.rules)
        for text, ends in zip(texts, self.seeds.ends_in(texts, runs=self.runs), strict=True):
            found: list[tuple[str, int, int]] = []
            free = [0] * len(names)
            for end, mask in ends:
                for k, kind in enumerate(names):
                    if not mask >> k & 1 or end <= free[k]:
                        continue
                    before = self.back[k].farthest(text, end - 1, free[k] - 1, -1)
                    size = self.whole[k].farthest(text, end - before, len(text), 1) if before > 0 else -1
                    if size < 0:
                        continue
                    start = end - before
                    free[k] = start + size
                    lead = self.lead[k].farthest(text, start, start + size, 1) if self.lead[k] else 0
                    if size - lead >= self.rules[kind].least:
                        found.append((kind, start, start + size))
            out.append(found)
        return out


def in_code_points(text: bytes, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    if text.isascii() or not found:
        return found
    places = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    before = np.r_[0, places]
    return [(k, int(before[a]), int(before[b])) for k, a, b in found]


def joined(found: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: (x[1], order[x[0]], x[2])))


def secret_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256, spans ("kind:start:end", code points, comma-joined) and n_secrets of all kinds."""
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner())

    def make():
        nothing = hashlib.sha256(b"").hexdigest()

        def run(texts):
            texts = [t or b"" for t in texts]
            counts = {k: [0] * len(texts) for k in BASE}
            digest, spans, total = [nothing] * len(texts), [""] * len(texts), [0] * len(texts)
            for i, found in enumerate(scanner.value.spans(texts)):
                if not found:
                    continue
                found = in_code_points(texts[i], found)
                base = [x for x in found if x[0] in BASE]
                for k, *_ in base:
                    counts[k][i] += 1
                digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i], total[i] = joined(found), len(found)
            return [*counts.values(), digest, spans, total]

        return run

    return map_text(docs, text, [*[(f"n_{k}", T.LongType(), pa.int64()) for k in BASE], ("base_sha256", T.StringType(), pa.string()), ("spans", T.StringType(), pa.string()), ("n_secrets", T.LongType(), pa.int64())], make, binary=True)
