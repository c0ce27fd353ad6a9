"""Byte-level BPE encoding and decoding with segment trees.

Each pre-token's byte positions are the leaves of a segment tree; a leaf holds
the rank of the pair that starts there, and each inner node the leftmost
minimum below it. A merge pops the root, joins two live neighbours and makes
three point updates of logarithmic cost. Short pre-tokens are encoded many at
once, one tree to a matrix row; long ones use a tree of their own, so a text
without any break costs n log n.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emendra.llm.common import by_batch, kept

NONE = np.int64(1) << np.int64(60)
#: Pre-tokens of up to this many bytes are encoded in matrix rows.
SHORT = 64
#: Trees in one matrix.
ROWS = 8192
#: Encoded pre-tokens that a worker remembers.
REMEMBERED = 200_000


def other_tables() -> dict[int, str]:
    """Characters that the tiktoken library, whose results are to be matched, takes for another kind than the regex module does, and one that both take for that kind.

    The two may have Unicode tables of different versions. Without the library there is nothing to match.
    """
    try:
        import tiktoken
    except ImportError:
        return {}
    import regex

    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c <= 0xDFFF)
    found: dict[int, str] = {}
    for kind, example in ((r"\p{L}", "\u00e9"), (r"\p{N}", "\u00b2"), (r"\s", "\u2003")):
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        theirs, ours = set(probe.decode(probe.encode_ordinary(every))), set(regex.findall(kind, every))
        # a private-use character is another symbol in any version
        found |= {ord(c): found.get(ord(c), "\ue000") for c in ours - theirs}
        found |= {ord(c): example for c in theirs - ours}
    return found


def splitter(pattern: str):
    """A function from a text to its pre-tokens, as the tiktoken library cuts them."""
    import regex

    compiled = regex.compile(pattern)
    tables: dict[int, str] | None = None
    other: set[str] = set()

    def split(text: str) -> list[str]:
        nonlocal tables, other
        if not text.isascii():
            if tables is None:
                tables = other_tables()
                other = set(map(chr, tables))
            if not other.isdisjoint(set(text)):
                return [text[m.start() : m.end()] for m in compiled.finditer(text.translate(tables))]
        return compiled.findall(text)

    return split


class SegmentTreeBpe:
    """An encoder for one file of ranks (lines of base64 token and rank) and one pre-token pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.split = splitter(pattern)
        self.first = np.array([self.ranks[bytes([x])] for x in range(256)], dtype=np.int64)
        self.width = np.int64(max(self.ranks.values()) + 1)
        get, pairs = self.ranks.get, {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                if (a := get(token[:cut])) is not None and (b := get(token[cut:])) is not None:
                    pairs[a * int(self.width) + b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.known: dict[str, bytes] = {}

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where they don't join or one is missing (-1)."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.merged[at], NONE)

    def _many(self, words: list[bytes]) -> list[bytes]:
        """Encode words of up to SHORT bytes, one segment tree to a row."""
        longest = max(map(len, words))
        size = 1 << max(1, (longest - 1).bit_length())
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size)
        place = np.arange(size)
        # column `size` stands for "no neighbour"
        ids = np.full((n, size + 1), -1, np.int64)
        ids[:, :size] = np.where(place < lengths[:, None], self.first[raw], -1)
        after = np.broadcast_to(np.minimum(np.arange(size + 1) + 1, size), (n, size + 1)).copy()
        before = np.broadcast_to(np.where(np.arange(size + 1) == 0, size, np.arange(size + 1) - 1), (n, size + 1)).copy()
        tree = np.full((n, 2 * size), NONE, np.int64)
        ranks = self._pair_rank(ids[:, :size], ids[:, 1:])
        tree[:, size:] = np.where(ranks < NONE, ranks * size + place, NONE)
        for node in range(size - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def put(rows, at, value):
            node = at + size
            tree[rows, node] = value
            for _ in range(size.bit_length() - 1):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        live = np.arange(n)
        while len(live := live[tree[live, 1] < NONE]):
            top = tree[live, 1]
            at, gone = top % size, after[live, top % size]
            ids[live, at] = top // size
            ids[live, gone] = -1
            right = after[live, gone]
            after[live, at] = right
            inner = right < size
            before[live[inner], right[inner]] = at[inner]
            put(live, gone, NONE)
            rank = self._pair_rank(ids[live, at], ids[live, right])
            put(live, at, np.where(rank < NONE, rank * size + at, NONE))
            left = before[live, at]
            inner = left < size
            rows, left, at = live[inner], left[inner], at[inner]
            rank = self._pair_rank(ids[rows, left], ids[rows, at])
            put(rows, left, np.where(rank < NONE, rank * size + left, NONE))
        kept = ids[:, :size] >= 0
        flat = ids[:, :size][kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _one(self, word: bytes) -> bytes:
        """Encode one long word with a tree in a flat list."""
        n = len(word)
        size = 1 << (n - 1).bit_length()
        none, width, get = int(NONE), int(self.width), self.pairs.get
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def leaf(a: int) -> int:
            b = after[a]
            rank = get(ids[a] * width + ids[b]) if b < n else None
            return none if rank is None else rank * size + a

        tree = [none] * (2 * size)
        tree[size : size + n] = [leaf(a) for a in range(n)]
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, value: int) -> None:
            node = at + size
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    return
                tree[node] = low

        while (top := tree[1]) < none:
            rank, at = divmod(top, size)
            gone = after[at]
            ids[at], ids[gone] = rank, -1
            after[at] = right = after[gone]
            if right < n:
                before[right] = at
            put(gone, none)
            put(at, leaf(at))
            if before[at] >= 0:
                put(before[at], leaf(before[at]))
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not known yet."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        whole, by_size = self.ranks, {}
        for word in words - self.known.keys():
            raw = word.encode("utf-8")
            if (rank := whole.get(raw)) is not None:
                self.known[word] = rank.to_bytes(4, "little")
            elif len(raw) > SHORT:
                self.known[word] = self._one(raw)
            else:
                by_size.setdefault((len(raw) - 1).bit_length(), []).append((word, raw))
        for group in by_size.values():
            for at in range(0, len(group), ROWS):
                part = group[at : at + ROWS]
                self.known.update(zip([w for w, _ in part], self._many([raw for _, raw in part])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        words = [self.split(t) for t in texts]
        self.learn({w for found in words for w in found})
        return [b"".join(map(self.known.__getitem__, found)) for found in words]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(ranks_path: str, pattern: str) -> SegmentTreeBpe:
    """The worker's encoder for these files, built once."""
    return kept(("bpe", ranks_path, pattern), lambda: SegmentTreeBpe(ranks_path, pattern))


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): every text as token ids; ids is binary, little-endian unsigned 32-bit.

    Null and empty texts have no tokens, null ids stay null, an empty table gives an
    empty result. Every row is encoded on its own, so
    repeated rows give repeated results; further columns are ignored.
    """

    def work(rows: dict) -> dict:
        ids = encoder(ranks_path, pattern).encode([t or "" for t in rows["text"]])
        return {"doc_id": rows["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

    return by_batch(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, n_tokens long, ids binary")


def bpe_decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the bytes that the ids stand for."""

    def work(rows: dict) -> dict:
        decode = encoder(ranks_path, pattern).decode
        return rows | {"decoded": [decode(x or b"") for x in rows["ids"]]}

    return by_batch(encoded.select("doc_id", "n_tokens", "ids"), work, "doc_id long, n_tokens long, ids binary, decoded binary")


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): `bpe_encode` and `bpe_decode` in one worker, so that ids needn't travel in between."""

    def work(rows: dict) -> dict:
        own = encoder(ranks_path, pattern)
        ids = own.encode([t or "" for t in rows["text"]])
        return {"doc_id": rows["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": [own.decode(x) for x in ids]}

    return by_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, n_tokens long, ids binary, decoded binary")


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode the ids again, and digest both."""
    both = bpe_round_trip(docs, ranks_path, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
