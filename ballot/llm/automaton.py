"""Regexes over bytes to one minimal deterministic automaton, and its scan over many texts at once.

The dialect: literals, escapes (\\xHH, \\., \\n ...), classes, groups, |, ?, *, + and {m}, {m,}, {m,n}.
Rules are made into one nondeterministic automaton with a loop at its start, so that a match may begin
anywhere; subset construction over byte classes and partition refinement give a transition array whose
states say which rules end there. Anchored automata, without the loop, and backward ones, of the rules read
from their ends, find where a match that ends at a known place begins.
"""

from __future__ import annotations

import numpy as np

ALL = frozenset(range(256))
GUESSES = 4


class Parser:
    """A syntax tree: ("set", bytes), ("cat", [..]), ("alt", [..]), ("rep", tree, least, most or None)."""

    def __init__(self, pattern: str, fold: bool = False):
        self.p, self.i, self.fold = pattern, 0, fold

    def parse(self):
        tree = self.alternatives()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return tree

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def alternatives(self):
        found = [self.sequence()]
        while self.peek() == "|":
            self.take()
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self):
        found = []
        while self.peek() and self.peek() not in "|)":
            found.append(self.repeated())
        return ("cat", found)

    def repeated(self):
        tree = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.p.index("}", self.i)
                least, _, most = self.p[self.i : end].partition(",")
                bounds = int(least), (int(most) if most else None) if "," in self.p[self.i : end] else int(least)
                self.i = end + 1
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            tree = ("rep", tree, *bounds)
        return tree

    def atom(self):
        c = self.take()
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            tree = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"no closing bracket in {self.p!r}")
            return tree
        if c == "[":
            return ("set", self.members())
        if c == ".":
            return ("set", ALL - {10})
        return ("set", self.cased({self.escape() if c == "\\" else ord(c)}))

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "r": 13, "t": 9}.get(c, ord(c))

    def members(self) -> frozenset[int]:
        inverse = self.peek() == "^"
        self.i += inverse
        out: set[int] = set()
        while self.peek() != "]":
            lo = self.escape() if (c := self.take()) == "\\" else ord(c)
            hi = lo
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.take()
                hi = self.escape() if (c := self.take()) == "\\" else ord(c)
            out |= set(range(lo, hi + 1))
        self.take()
        return ALL - out if inverse else self.cased(out)

    def cased(self, found) -> frozenset[int]:
        if self.fold:
            found = {x for b in found for x in ({b, b ^ 32} if chr(b).isascii() and chr(b).isalpha() else {b})}
        return frozenset(found)


class Automaton:
    """delta[state * classes + class] is the next state times `classes`; ends[state] is a mask of rules."""

    def __init__(self, rules: list[tuple[str, bool]], anchored: bool = False, backward: bool = False):
        edges, jumps, final = [[]], [[]], {}

        def state() -> int:
            edges.append([])
            jumps.append([])
            return len(edges) - 1

        def build(tree, at: int) -> int:
            """The state after the tree, begun in `at`."""
            if tree[0] == "set":
                to = state()
                edges[at].append((tree[1], to))
                return to
            if tree[0] == "cat":
                for x in reversed(tree[1]) if backward else tree[1]:
                    at = build(x, at)
                return at
            if tree[0] == "alt":
                to = state()
                for x in tree[1]:
                    fork = state()
                    jumps[at].append(fork)
                    jumps[build(x, fork)].append(to)
                return to
            _, inner, least, most = tree
            for _ in range(least):
                at = build(inner, at)
            if most is None:
                loop, to = state(), state()
                jumps[at] += [loop, to]
                jumps[build(inner, loop)] += [loop, to]
                return to
            to = state()
            for _ in range(most - least):
                jumps[at].append(to)
                fork = state()
                jumps[at].append(fork)
                at = build(inner, fork)
            jumps[at].append(to)
            return to

        for k, (pattern, fold) in enumerate(rules):
            begin = state()
            jumps[0].append(begin)
            final[build(Parser(pattern, fold).parse(), begin)] = 1 << k

        sets = sorted({s for out in edges for s, _ in out}, key=sorted)
        signature = [tuple(b in s for s in sets) for b in range(256)]
        kinds = sorted(set(signature))
        self.classes = len(kinds)
        self.class_of = np.array([kinds.index(x) for x in signature], np.uint8)
        member = [signature.index(k) for k in kinds]  # one byte of each class

        def closure(found) -> frozenset[int]:
            stack, seen = list(found), set(found)
            while stack:
                for x in jumps[stack.pop()]:
                    if x not in seen:
                        seen.add(x)
                        stack.append(x)
            return frozenset(x for x in seen if edges[x] or x in final)

        start = closure([0])
        moves = {x: [frozenset(to for s, to in edges[x] if b in s) for b in member] for x in range(len(edges)) if edges[x]}
        closed: dict[frozenset[int], frozenset[int]] = {}
        numbers, queue, table = {start: 0}, [start], []
        while len(table) < len(queue):
            here = queue[len(table)]
            row = []
            for c in range(self.classes):
                raw = frozenset().union(*(moves[x][c] for x in here if x in moves))
                to = closed.get(raw)
                if to is None:
                    to = closed[raw] = closure(raw) if anchored else closure(raw) | start
                if to not in numbers:
                    numbers[to] = len(queue)
                    queue.append(to)
                row.append(numbers[to])
            table.append(row)
        delta = np.array(table)
        ends = np.array([sum({final[x] for x in s if x in final}) for s in queue], np.int64)
        self.subsets = len(queue)
        _, block = np.unique(ends, return_inverse=True)
        while True:  # refine until states of a block go to the same blocks
            _, new = np.unique(np.column_stack([block, block[delta]]), axis=0, return_inverse=True)
            if new.max() == block.max():
                break
            block = new
        _, one = np.unique(block, return_index=True)
        self.states = len(one)
        self.ends = ends[one]
        self.start = int(block[0]) * self.classes
        self.delta = np.ascontiguousarray(block[delta[one]] * self.classes, np.int32).ravel()
        self.resets = bool((self.delta.reshape(self.states, -1)[:, self.class_of[10]] == self.start).all())
        nothing = numbers.get(frozenset())
        self.dead = int(block[nothing]) * self.classes if nothing is not None else -1
        self._lists = None

    def farthest(self, text: bytes, begin: int, end: int, step: int) -> int:
        """From `begin` in steps of 1 or -1 up to `end`: the bytes taken at the last final state, -1 if there is none.

        For anchored automata; it stops as soon as no match can follow.
        """
        if self._lists is None:
            self._lists = self.delta.tolist(), self.class_of.tolist(), (np.repeat(self.ends, self.classes) > 0).tolist()
        delta, class_of, final = self._lists
        state, found, dead = self.start, -1, self.dead
        for at in range(begin, end, step):
            state = delta[state + class_of[text[at]]]
            if state == dead:
                break
            if final[state]:
                found = abs(at - begin) + 1
        return found

    def states_of(self, joined: bytes, lane: int) -> np.ndarray:
        """The state after each byte, [place in lane, lane]: one pass, in lanes side by side.

        Lanes start without knowing the state their text is in there. Those that should have started in another run
        again, twice side by side. What is then left, such as a run over many lanes that keeps its state, is looked up in
        a further pass from that state; beyond GUESSES such states, lanes are walked along byte by byte from their
        right start until they meet what was found before.
        """
        n = len(joined)
        lanes = -(-n // lane)
        codes = np.full(lanes * lane, self.class_of[10], np.uint8)
        np.take(self.class_of, np.frombuffer(joined, np.uint8), out=codes[:n])
        steps = np.ascontiguousarray(codes.reshape(lanes, lane).T)
        out = np.empty((lane, lanes), np.int32)
        begin = np.full(lanes, self.start, np.int32)
        todo = np.arange(lanes)
        for _ in range(3):
            state = begin[todo]
            whole = len(todo) == lanes
            part = steps if whole else np.ascontiguousarray(steps[:, todo])
            own = out if whole else np.empty((lane, len(todo)), np.int32)
            for p in range(lane):
                state = self.delta.take(state + part[p])
                own[p] = state
            if not whole:
                out[:, todo] = own
            right = np.r_[np.int32(self.start), out[-1, :-1]]
            todo = np.flatnonzero(right != begin)
            begin = right
            if not len(todo):
                return out
        if self._lists is None:
            self.farthest(b"", 0, 0, 1)
        delta = self._lists[0]
        wrong = np.zeros(lanes + 1, bool)
        wrong[todo] = True
        tried: dict[int, tuple[int, np.ndarray]] = {}  # start state: first lane, states of all lanes from there on
        for k in range(int(todo[0]), lanes):
            if not wrong[k]:
                continue
            state = int(out[-1, k - 1]) if k else self.start
            if state not in tried and len(tried) < GUESSES:
                # What begins in this state may end in it too: all later lanes from it, side by side.
                now = np.full(lanes - k, state, np.int32)
                own = np.empty((lane, lanes - k), np.int32)
                part = np.ascontiguousarray(steps[:, k:])
                for p in range(lane):
                    now = self.delta.take(now + part[p])
                    own[p] = now
                tried[state] = k, own
            if state in tried and tried[state][0] <= k:
                first, own = tried[state]
                wrong[k + 1] |= bool(own[-1, k - first] != out[-1, k])
                out[:, k] = own[:, k - first]
                continue
            new = []
            for c, before in zip(steps[:, k].tolist(), out[:, k].tolist(), strict=True):
                state = delta[state + c]
                if state == before:
                    break
                new.append(state)
            out[: len(new), k] = new
            wrong[k + 1] |= len(new) == lane  # its end has changed, so the next one's start has
        return out

    def ends_in(self, texts: list[bytes], lane: int = 1024, runs: int = 0) -> list[list[tuple[int, int]]]:
        """For each text, (end, mask) in order: places that matches of the mask's rules end at; of the rules in `runs` only the last of places in a row."""
        if not self.resets:
            raise ValueError("a rule matches across line ends")
        joined = b"\n".join(texts) + b"\n"
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        flag = np.repeat(self.ends, self.classes).astype(np.uint16 if len(self.ends) == 0 or int(self.ends.max()) < 1 << 16 else np.uint64)
        if not flag.any():
            return out
        marks = flag.take(self.states_of(joined, lane)).T.ravel()[: len(joined)]
        hit = np.flatnonzero(marks)
        if not len(hit):
            return out
        after = np.zeros(len(hit), marks.dtype)
        inside = hit + 1 < len(joined)
        after[inside] = marks[hit[inside] + 1]
        stop = marks[hit] & ~(after & marks.dtype.type(runs))
        last = np.flatnonzero(stop)
        stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        row = np.searchsorted(stops, hit[last], side="right")
        for r, place, mask in zip(row.tolist(), hit[last].tolist(), stop[last].tolist(), strict=True):
            out[r].append((place + 1 - (int(stops[r]) - len(texts[r]) - 1), mask))
        return out
