"""Transducers over characters that carry the source range of everything they write.

A machine is a trie of what it reads, with what it writes at the states where that ends; it rewrites the
leftmost longest readings and copies all else. A `Copy` is a machine's tape: its text, and for each
character the range of the source it stands for, so that machines compose and spans of the last tape are
spans of the source.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

Edit = tuple[int, int, str]


@dataclass
class Copy:
    """A rewritten text; begin and end: the source range of each character; made: whether a transducer made it."""

    text: str
    begin: list[int]
    end: list[int]
    made: list[bool]

    @classmethod
    def of(cls, text: str) -> Copy:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text))

    def replaced(self, edits: list[Edit]) -> Copy:
        """With [a, b) replaced, for edits in order; new characters share the range of what they replace."""
        if not edits:
            return self
        out = Copy("", [], [], [])
        parts, at = [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            parts += [self.text[at:a], new]
            out.begin += self.begin[at:a]
            out.end += self.end[at:a]
            out.made += self.made[at:a]
            if new:
                out.begin += [self.begin[a]] * len(new)
                out.end += [self.end[b - 1]] * len(new)
                out.made += [True] * len(new)
            at = b
        out.text = "".join(parts)
        return out


class Transducer:
    """Rewrites readings (input, output); `words`: only whole words, letters in either case."""

    def __init__(self, readings: Iterable[tuple[str, str]], words: bool = False):
        self.arcs: list[dict[str, int]] = [{}]
        self.out: list[str | None] = [None]
        self.words = words
        for read, write in readings:
            state = 0
            for c in read:
                if c not in self.arcs[state]:
                    self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.out.append(None)
                state = self.arcs[state][c]
            self.out[state] = write
        first = "".join(re.escape(c) for c in sorted(self.arcs[0]))
        self.start = re.compile(rf"(?<![^\W_])[{first}]" if words else f"[{first}]", re.I if words else 0)

    def edits(self, text: str) -> list[Edit]:
        low = text.lower() if self.words else text
        if len(low) != len(text):  # a letter whose lower case has another length: none that is read
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        arcs, out, n = self.arcs, self.out, len(low)
        found, free = [], 0
        for m in self.start.finditer(low):
            a = m.start()
            if a < free:
                continue
            state, at, best = 0, a, None
            while at < n and (state := arcs[state].get(low[at], -1)) >= 0:
                at += 1
                if out[state] is not None and not (self.words and at < n and low[at].isalnum()):
                    best = at, out[state]
            if best:
                free = best[0]
                found.append((a, free, best[1]))
        return found

    def __call__(self, tape: Copy) -> Copy:
        return tape.replaced(self.edits(tape.text))
