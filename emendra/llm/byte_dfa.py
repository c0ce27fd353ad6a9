"""Regular expressions over bytes, compiled to minimal deterministic automata.

Supports literals, classes with ranges and negation, ``.``, groups, ``(?i:...)``,
alternation, ``? * + {m} {m,} {m,n}`` and ``\\xHH \\d \\w \\s`` escapes. Several rules
make one automaton; a state knows the rules that accept in it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

_SETS = {"d": set(range(48, 58)), "w": set(range(48, 58)) | set(range(65, 91)) | set(range(97, 123)) | {95}, "s": {9, 10, 11, 12, 13, 32}}
_NAMED = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}


class _Parser:
    """Pattern to a tree of ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most)."""

    def __init__(self, pattern: str):
        self.p, self.at = pattern, 0

    def parse(self):
        tree = self.alternatives(False)
        if self.at < len(self.p):
            raise ValueError(f"Unexpected {self.p[self.at]!r} at {self.at} in {self.p!r}")
        return tree

    def peek(self) -> str:
        return self.p[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.p[self.at - 1]

    def alternatives(self, fold: bool):
        parts = [self.sequence(fold)]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence(fold))
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self, fold: bool):
        parts = []
        while self.peek() not in ("", "|", ")"):
            part = self.atom(fold)
            while self.peek() and self.peek() in "?*+{":
                part = ("rep", part, *self.times())
            parts.append(part)
        return ("cat", parts)

    def times(self) -> tuple[int, int | None]:
        c = self.take()
        if c != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        end = self.p.index("}", self.at)
        least, comma, most = self.p[self.at : end].partition(",")
        self.at = end + 1
        return int(least), (int(most) if most else None) if comma else int(least)

    def atom(self, fold: bool):
        c = self.take()
        if c == "(":
            if self.p.startswith("?i:", self.at):
                self.at, fold = self.at + 3, True
            elif self.p.startswith("?:", self.at):
                self.at += 2
            inner = self.alternatives(fold)
            if self.take() != ")":
                raise ValueError(f"Missing ) in {self.p!r}")
            return inner
        if c == "[":
            return ("set", self.fold(self.members(), fold))
        if c == ".":
            return ("set", frozenset(set(range(256)) - {10}))
        return ("set", self.fold(self.escape() if c == "\\" else {ord(c)}, fold))

    @staticmethod
    def fold(chars: set[int], fold: bool) -> frozenset:
        return frozenset(chars | {x ^ 32 for x in chars if fold and (65 <= x <= 90 or 97 <= x <= 122)})

    def escape(self) -> set[int]:
        c = self.take()
        if c == "x":
            self.at += 2
            return {int(self.p[self.at - 2 : self.at], 16)}
        if c.lower() in _SETS:
            return _SETS[c.lower()] if c.islower() else set(range(256)) - _SETS[c.lower()]
        return {_NAMED.get(c, ord(c))}

    def members(self) -> set[int]:
        negated = self.peek() == "^" and bool(self.take())
        found: set[int] = set()
        first = True
        while (c := self.take()) != "]" or first:
            first = False
            low = self.escape() if c == "\\" else {ord(c)}
            if self.peek() == "-" and self.p[self.at + 1 : self.at + 2] != "]":
                self.take()
                c = self.take()
                high = self.escape() if c == "\\" else {ord(c)}
                low = set(range(min(low), max(high) + 1))
            found |= low
        return set(range(256)) - found if negated else found


def _reversed(tree):
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", _reversed(tree[1]), *tree[2:])
    return (kind, [_reversed(x) for x in (tree[1][::-1] if kind == "cat" else tree[1])])


@dataclass
class _Nfa:
    moves: list[list[tuple[frozenset, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int) -> int:
        """Thompson's construction; returns the end state."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                own = self.state()
                self.free[start].append(own)
                self.free[self.add(part, own)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(most - least):
            self.free[start].append(end)
            start = self.add(part, start)
        self.free[start].append(end)
        return end


@dataclass
class Dfa:
    """`table[state + byte]` is the next state; states are multiples of 256, `start` the first.

    States from `first_final` on accept; `rules` gives the rules of each, as bits. State `dead` never accepts (-1: none).
    """

    table: list[int]
    start: int
    first_final: int
    rules: dict[int, int]
    dead: int

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match that starts at `at`; -1 if none."""
        state, end, table = self.start, -1, self.table
        for k in range(at, len(data)):
            state = table[state + data[k]]
            if state >= self.first_final:
                end = k + 1
            elif state == self.dead:
                break
        return end


def compile_dfa(patterns: list[str], anywhere: bool, backwards: bool = False) -> Dfa:
    """One minimal automaton for all patterns; `anywhere`: a match may begin at each byte."""
    nfa = _Nfa()
    root = nfa.state()
    finals: dict[int, int] = {}
    for rule, pattern in enumerate(patterns):
        tree = _Parser(pattern).parse()
        own = nfa.state()
        nfa.free[root].append(own)
        end = nfa.add(_reversed(tree) if backwards else tree, own)
        finals[end] = finals.get(end, 0) | 1 << rule

    def closed(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in nfa.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    # bytes that no set of the patterns tells apart share a column
    sets = list({chars for moves in nfa.moves for chars, _ in moves})
    columns: dict[tuple, int] = {}
    column = [columns.setdefault(tuple(c in x for x in sets), len(columns)) for c in range(256)]
    sample = [column.index(k) for k in range(len(columns))]

    # subset construction
    first = closed({root})
    number, rows, accepts, todo = {first: 0}, [], [], [first]
    for subset in todo:
        moves = [m for x in subset for m in nfa.moves[x]]
        row, known = [], {}
        for c in sample:
            key = frozenset(to for chars, to in moves if c in chars)
            if key not in known:
                following = closed(key | {root} if anywhere else key)
                if following not in number:
                    number[following] = len(number)
                    todo.append(following)
                known[key] = number[following]
            row.append(known[key])
        rows.append(row)
        mask = 0
        for x in subset:
            mask |= finals.get(x, 0)
        accepts.append(mask)
    # minimisation: refine the partition by accepted rules until successors agree
    group = accepts
    count = len(set(group))
    while True:
        keys: dict = {}
        refined = [keys.setdefault((group[s], *(group[t] for t in rows[s])), len(keys)) for s in range(len(rows))]
        group = refined
        if len(keys) == count:
            break
        count = len(keys)
    member = {g: s for s, g in reversed(list(enumerate(group)))}
    order = sorted(member, key=lambda g: (accepts[member[g]] > 0, member[g]))
    place = {g: k * 256 for k, g in enumerate(order)}
    table = [place[group[rows[member[g]][column[c]]]] for g in order for c in range(256)]
    rules = {place[g]: accepts[member[g]] for g in order if accepts[member[g]]}
    dead = next((place[g] for g in order if not accepts[member[g]] and all(group[t] == g for t in rows[member[g]])), -1)
    return Dfa(table, place[group[0]], min(rules, default=len(table)), rules, dead)
