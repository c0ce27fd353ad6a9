"""Token counts by trie-shared dynamic programming.

A unigram model segments each pre-token into the pieces of greatest total
score. Distinct pre-tokens go into a trie; the forward scores (best score of
every prefix, and with how many pieces) belong to trie nodes, so a prefix that
many pre-tokens share is computed once. The terminal node of a pre-token stores
its count, of pieces, and its score; texts refer to terminal nodes. Pre-tokens
of over 128 bytes, which share little, have a terminal node without a path.

The vocabulary is a public file of ranked byte tokens; a piece of rank r scores
-log(r + 2), as by Zipf's law. All 256 bytes are pieces, so any text can be
segmented. Of segmentations with equal scores the one with fewer pieces counts.
"""

from __future__ import annotations

import base64
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emendra.llm.byte_bpe import splitter
from emendra.llm.common import by_batch, kept

COUNTS = "doc_id long, n_pretokens long, n_tokens long, score double"
#: Trie nodes and pre-tokens that a worker keeps before it starts anew.
NODES = 300_000
#: Pre-tokens with more bytes are segmented outside the trie, which is to hold what is shared.
LONG = 128


def piece_scores(ranks_path: str) -> dict[bytes, float]:
    with open(ranks_path, "rb") as lines:
        return {base64.b64decode(a): -math.log(int(b) + 2) for a, b in (line.split() for line in lines if line.strip())}


class TrieCounter:
    """Counts of pre-tokens. Node k has score[k] and pieces[k], and its child by byte b is edges[256 * k + b]; `terminal` is the node of each whole pre-token."""

    def __init__(self, ranks_path: str, pattern: str):
        self.scores = piece_scores(ranks_path)
        # lengths of the pieces that end in two bytes, longest first; pieces of one byte fit anywhere
        ends: dict[bytes, set[int]] = {}
        for piece in self.scores:
            if len(piece) > 1:
                ends.setdefault(piece[-2:], {1}).add(len(piece))
        self.lengths = {k: sorted(v, reverse=True) for k, v in ends.items()}
        self.split = splitter(pattern)
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.score, self.pieces = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def _forward(self, word: bytes, end: int, path: list[int], score: list[float], pieces: list[int]) -> tuple[float, int]:
        """Best score and least pieces of word[:end]; path[j] is where those of word[:j] are."""
        get = self.scores.get
        best, count = -math.inf, 0
        for length in self.lengths.get(word[end - 2 : end], (1,)) if end > 1 else (1,):
            start = end - length
            if start >= 0 and (own := get(word[start:end])) is not None:
                before = path[start]
                total = score[before] + own
                if total > best or total == best and pieces[before] + 1 < count:
                    best, count = total, pieces[before] + 1
        return best, count

    def insert(self, text: str) -> int:
        """Walk or grow the trie along a pre-token; its terminal node."""
        word = text.encode("utf-8", "surrogatepass")
        if len(word) > LONG:
            score, pieces, path = [0.0], [0], list(range(len(word) + 1))
            for end in range(1, len(word) + 1):
                best, count = self._forward(word, end, path, score, pieces)
                score.append(best)
                pieces.append(count)
            self.score.append(score[-1])
            self.pieces.append(pieces[-1])
            return len(self.score) - 1
        edges, node, path = self.edges, 0, [0]
        for end, byte in enumerate(word, 1):
            following = edges.get(256 * node + byte)
            if following is None:
                best, count = self._forward(word, end, path, self.score, self.pieces)
                following = edges[256 * node + byte] = len(self.score)
                self.score.append(best)
                self.pieces.append(count)
            node = following
            path.append(node)
        return node

    def count(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(pre-tokens, tokens, score) of each text."""
        words = [self.split(t) for t in texts]
        if len(self.score) > NODES or len(self.terminal) > NODES:
            self.clear()
        terminal = self.terminal
        for word in {w for own in words for w in own} - terminal.keys():
            terminal[word] = self.insert(word)
        found = []
        for own in words:
            nodes = [terminal[w] for w in own]
            found.append((len(own), sum(map(self.pieces.__getitem__, nodes)), math.fsum(map(self.score.__getitem__, nodes))))
        return found


def token_counts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, score): pre-tokens, unigram pieces and their total score in each whole text.

    Null and empty texts have no tokens and score 0. Repeated rows give
    repeated results; an empty table gives an empty result; further columns
    are ignored.
    """

    def work(rows: dict) -> dict:
        counter = kept(("trie", ranks_path, pattern), lambda: TrieCounter(ranks_path, pattern))
        found = counter.count([t or "" for t in rows["text"]])
        return {"doc_id": rows["doc_id"], "n_pretokens": [x[0] for x in found], "n_tokens": [x[1] for x in found], "score": [x[2] for x in found]}

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, COUNTS)
