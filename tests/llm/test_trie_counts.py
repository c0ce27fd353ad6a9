import math
import random

import public_tokenizers
import pytest

from emendra.llm import trie_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def counter():
    return trie_counts.TrieCounter(RANKS, public_tokenizers.PATTERN)


def brute(word, scores):
    """Best (score, -pieces) over every segmentation of a short word."""
    if not word:
        return (0.0, 0)
    found = []
    for cut in range(1, len(word) + 1):
        if word[:cut] in scores:
            rest = brute(word[cut:], scores)
            found.append((scores[word[:cut]] + rest[0], rest[1] - 1))
    return max((round(s, 9), n) for s, n in found)


def test_counts_equal_every_segmentation(counter):
    rng = random.Random(4)
    for _ in range(150):
        word = "".join(rng.choice("abtheing é") for _ in range(rng.randrange(1, 11)))
        node = counter.insert(word)
        pieces, score = counter.pieces[node], counter.score[node]
        want = brute(word.encode(), counter.scores)
        assert (round(score, 6), -pieces) == (round(want[0], 6), want[1])


def test_prefixes_are_shared(counter):
    counter.clear()
    counter.insert("international")
    before = len(counter.score)
    counter.insert("internationally")
    assert len(counter.score) == before + 2


def test_long_and_short_paths_agree(counter, monkeypatch):
    words = ["abc" * 30, "theing" * 10]
    told = lambda node: (counter.pieces[node], counter.score[node])
    inside = [told(counter.insert(w)) for w in words]
    monkeypatch.setattr(trie_counts, "LONG", 8)
    assert [told(counter.insert(w)) for w in words] == inside


def test_token_counts_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "The cat"), (3, "The cat"), (4, "x" * 50_000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = sorted(map(tuple, trie_counts.token_counts(docs, RANKS, public_tokenizers.PATTERN).collect()))
    assert got[0] == (1, 0, 0, 0.0) and got[1] == (2, 0, 0, 0.0)
    assert got[2] == got[3] and got[2][1] == 2 and got[4][2] > 0
    assert all(math.isfinite(r[3]) for r in got)
    assert trie_counts.token_counts(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
