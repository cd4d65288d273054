"""Byte automata: patterns to one minimal deterministic automaton for many rules.

A pattern has literals, classes, groups, alternatives and the repetitions ? * + {m} {m,} {m,n}; it means
bytes, so a literal outside ASCII is its UTF-8 bytes, and classes name ASCII characters. Patterns become positions with
followers, the subset construction makes sets of positions deterministic over classes of bytes that no
pattern tells apart, and states that no continuation tells apart are merged.
"""

from __future__ import annotations

from dataclasses import dataclass


def _bytes_of(chars: str) -> int:
    return sum({1 << b for c in chars for b in c.encode()})


class _Reader:
    """A pattern as a tree: ("set", bytes), ("cat", trees), ("alt", trees), ("rep", tree, least, most)."""

    def __init__(self, pattern: str, fold: bool):
        self.p, self.i, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(f"pattern ends early: {self.p}")
        self.i += 1
        return c

    def escaped(self) -> str:
        c = self.take()
        if c == "x":
            return chr(int(self.take() + self.take(), 16))
        return {"n": "\n", "t": "\t", "r": "\r"}.get(c, c)

    def either(self, mask: int) -> int:
        """With `fold`, both cases of the letters."""
        if self.fold:
            for b in range(26):
                if mask >> (65 + b) & 1 or mask >> (97 + b) & 1:
                    mask |= 1 << (65 + b) | 1 << (97 + b)
        return mask

    def alternatives(self):
        found = [self.sequence()]
        while self.peek() == "|":
            self.take()
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self):
        found = []
        while self.peek() not in ("", "|", ")"):
            found.append(self.repeated())
        return ("cat", found)

    def repeated(self):
        one = self.single()
        while self.peek() in ("?", "*", "+", "{"):
            c = self.take()
            if c == "{":
                least, _, most = self.p[self.i : self.p.index("}", self.i)].partition(",")
                has_most = "," in self.p[self.i : self.p.index("}", self.i)]
                self.i = self.p.index("}", self.i) + 1
                one = ("rep", one, int(least), (int(most) if most else None) if has_most else int(least))
            else:
                one = ("rep", one, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        return one

    def single(self):
        c = self.take()
        if c == "(":
            inner = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"a group is open: {self.p}")
            return inner
        if c == "[":
            return ("set", self.either(self.members()))
        if c in ")]{}*+?|":
            raise ValueError(f"{c} out of place: {self.p}")
        if c == ".":
            return ("set", ((1 << 256) - 1) ^ (1 << 10))
        c = self.escaped() if c == "\\" else c
        found = [("set", self.either(1 << b)) for b in c.encode()]
        return found[0] if len(found) == 1 else ("cat", found)

    def members(self) -> int:
        negated = self.peek() == "^" and bool(self.take())
        mask, first = 0, True
        while first or self.peek() != "]":
            first = False
            low = self.take()
            low = self.escaped() if low == "\\" else low
            high = low
            if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] != "]":
                self.take()
                high = self.take()
                high = self.escaped() if high == "\\" else high
            if high > "\x7f" or low > high:
                raise ValueError(f"classes are of ASCII, in order: {self.p}")
            mask |= sum(1 << b for b in range(ord(low), ord(high) + 1))
        self.take()
        return ((1 << 256) - 1) ^ mask if negated else mask


def parse(pattern: str, fold: bool = False):
    r = _Reader(pattern, fold)
    tree = r.alternatives()
    if r.peek():
        raise ValueError(f"{r.peek()} out of place: {pattern}")
    return tree


class _Positions:
    """Every place of a set in the expanded patterns, and the places that may follow it, as sets of bits."""

    def __init__(self):
        self.sets: list[int] = []
        self.follow: list[int] = []

    def add(self, tree) -> tuple[bool, int, int]:
        """Whether the tree matches nothing at all, and its first and last places."""
        kind = tree[0]
        if kind == "set":
            self.sets.append(tree[1])
            self.follow.append(0)
            here = 1 << (len(self.sets) - 1)
            return False, here, here
        if kind == "alt":
            found = [self.add(t) for t in tree[1]]
            return any(f[0] for f in found), self.union(f[1] for f in found), self.union(f[2] for f in found)
        if kind == "cat":
            return self.chain([self.add(t) for t in tree[1]])
        _, one, least, most = tree
        found = [self.add(one) for _ in range(least)]
        if most is None:
            empty, first, last = self.add(one)
            self.link(last, first)
            found.append((True, first, last))
        else:
            # optional copies nest: each needs the one before
            rest = (True, 0, 0)
            for _ in range(most - least):
                e, f, last = self.chain([self.add(one), rest])
                rest = (True, f, last)
            found.append(rest)
        return self.chain(found)

    def chain(self, found) -> tuple[bool, int, int]:
        empty, first, last = True, 0, 0
        for e, f, at in found:
            self.link(last, f)
            first |= f if empty else 0
            last = (last if e else 0) | at
            empty = empty and e
        return empty, first, last

    def link(self, last: int, first: int) -> None:
        for i in bits(last):
            self.follow[i] |= first

    @staticmethod
    def union(masks) -> int:
        out = 0
        for m in masks:
            out |= m
        return out


def bits(mask: int):
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


@dataclass(frozen=True)
class Automaton:
    """`move[state * n_classes + of_byte[byte]]` is the next state; states from `first_accept` on accept the rules of `accepts`."""

    of_byte: object
    n_classes: int
    move: object
    start: int
    first_accept: int
    accepts: tuple[int, ...]  # by state: a bit for each rule
    dead: int  # the state without a way to accept, or -1

    def rules_at(self, state: int) -> int:
        return self.accepts[state]


def build(trees: list, search: bool = False) -> Automaton:
    """One automaton for many trees; with `search`, a match may begin anywhere, and a state accepts the rules of which a match ends there."""
    import numpy as np

    places = _Positions()
    begin, end = 0, []
    for t in trees:
        empty, first, last = places.add(t)
        if empty:
            raise ValueError("a rule must not match nothing")
        begin |= first
        end.append(last)
    # bytes that are in the same sets behave alike
    kinds: dict[int, int] = {}
    of_byte = np.zeros(256, np.uint8)
    for b in range(256):
        inside = sum(1 << i for i, s in enumerate(places.sets) if s >> b & 1)
        of_byte[b] = kinds.setdefault(inside, len(kinds))
    inside = list(kinds)
    follow = places.follow
    known: dict[int, int] = {0: 0}
    todo, rows = [0], []
    # a state is the set of places just read; the empty one begins
    root_next = begin
    while todo:
        state = todo.pop(0)
        after = root_next if search or state == 0 else 0
        for i in bits(state):
            after |= follow[i]
        row = []
        for k in inside:
            # without search, nothing read after the beginning is no beginning: -1 is dead
            to = after & k
            if not to and not search:
                row.append(-1)
                continue
            if to not in known:
                known[to] = len(known)
                todo.append(to)
            row.append(known[to])
        rows.append(row)
    if any(-1 in r for r in rows):
        dead = len(rows)
        rows = [[dead if x < 0 else x for x in r] for r in rows] + [[dead] * len(inside)]
        accepts = [sum(1 << r for r, e in enumerate(end) if s & e) for s in known] + [0]
    else:
        dead, accepts = -1, [sum(1 << r for r, e in enumerate(end) if s & e) for s in known]
    return minimal(of_byte, np.array(rows, np.int64), accepts, dead)


def minimal(of_byte, move, accepts: list[int], dead: int) -> Automaton:
    """States are split by what they accept, then by where they lead, until nothing splits; accepting ones are numbered last."""
    import numpy as np

    _, block = np.unique(np.array(accepts, dtype=object).astype(str), return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[move]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    n = int(block.max()) + 1
    member = np.zeros(n, np.int64)
    member[block[::-1]] = np.arange(len(block))[::-1]  # the first state of each block stands for it
    told = [accepts[m] for m in member]
    order = sorted(range(n), key=lambda b: (told[b] != 0, member[b]))
    rank = np.zeros(n, np.int64)
    rank[order] = np.arange(n)
    table = rank[block[move[member[order]]]]
    first = sum(1 for t in told if not t)
    return Automaton(of_byte, move.shape[1], table.astype(np.int32).ravel(), int(rank[block[0]]), first, tuple(told[b] for b in order), int(rank[block[dead]]) if dead >= 0 else -1)
