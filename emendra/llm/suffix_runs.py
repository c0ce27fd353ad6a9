"""Front-coded sorted runs of suffixes, and a loser tree that merges them by their common prefixes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: (suffix, reversed left context, both halves of the text's digest, packed position, 1 if the only one of its kind)
Entry = tuple[bytes, bytes, int, int, int, int]
_META = struct.Struct("<qqqB")


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first `known` bytes are not looked at again."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (differ.bit_length() + 7) // 8


def _number(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def front_code(entries: list[Entry]) -> bytes:
    """Sorted entries, each without what it shares with the one before."""
    out = bytearray()
    suffix = left = b""
    for entry in entries:
        for now, before in ((entry[0], suffix), (entry[1], left)):
            shared = common_prefix(now, before)
            _number(out, shared)
            _number(out, len(now) - shared)
            out += now[shared:]
        out += _META.pack(*entry[2:])
        suffix, left = entry[0], entry[1]
    return bytes(out)


def read_run(blocks: Iterator[bytes]) -> Iterator[tuple[int, Entry]]:
    """(prefix shared with the entry before, entry) of the front-coded blocks of a run; a block starts anew."""
    last = b""
    for data in blocks:
        at, suffix, left = 0, b"", b""
        first = True
        while at < len(data):
            texts = []
            for before in (suffix, left):
                numbers = []
                for _ in range(2):
                    n = shift = 0
                    while (byte := data[at]) > 127:
                        n |= (byte & 127) << shift
                        shift += 7
                        at += 1
                    numbers.append(n | byte << shift)
                    at += 1
                shared, more = numbers
                texts.append((shared, before[:shared] + data[at : at + more]))
                at += more
            (known, suffix), (_, left) = texts
            meta = _META.unpack_from(data, at)
            at += _META.size
            yield common_prefix(suffix, last) if first else known, (suffix, left, *meta)
            first = False
        last = suffix


def merge_runs(runs: list[Iterator[tuple[int, Entry]]]) -> Iterator[tuple[int, Entry]]:
    """Entries of all runs in order of their suffixes, each with the prefix it shares with the one before.

    A tournament of losers: each inner node keeps a run that lost there and how
    much its head shares with the last winner. Of two heads the one that shares
    more with the last winner is smaller; only when both share as much are
    bytes compared, from there on. No byte known to be equal is read again.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[Entry | None] = [None] * size
    shared = [-1] * size  # a run that has ended shares -1 and so always loses
    for k, run in enumerate(runs):
        if (found := next(run, None)) is not None:
            heads[k], shared[k] = found[1], 0
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; updates what the loser shares with the winner."""
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        if heads[a] is None:
            return a, b
        x, y = heads[a][0], heads[b][0]
        n = common_prefix(x, y, shared[a])
        if (x[n:], a) > (y[n:], b):
            a, b = b, a
        shared[b] = n
        return a, b

    def first(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(first(2 * node), first(2 * node + 1))
        return winner

    winner = first(1) if size > 1 else 0
    while heads[winner] is not None:
        yield shared[winner], heads[winner]
        found = next(runs[winner], None)
        heads[winner], shared[winner] = (None, -1) if found is None else (found[1], found[0])
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
