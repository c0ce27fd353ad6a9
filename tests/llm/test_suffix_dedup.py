import hashlib
import random

import pytest

from emendra.llm import suffix_dedup
from emendra.llm.suffix_runs import common_prefix, front_code, merge_runs, read_run


def brute(texts, window):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for raw in raws:
        for at in range(len(raw) - window + 1):
            seen[raw[at : at + window]] = seen.get(raw[at : at + window], 0) + 1
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for at in range(len(raw) - window + 1):
            if seen[raw[at : at + window]] > 1:
                gone[at : at + window] = b"\1" * window
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "bé", "gamma", "d", "epsilon", "zeta", "日本", "theta", "iota"] + [f"w{k}" for k in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(60) for _ in range(4)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        base = text(rng.randrange(1, 150))
        if kind < 0.3:
            base = base + rng.choice(shared)[rng.randrange(40) :] + text(20)
        elif kind < 0.5 and texts:
            own = list(rng.choice(texts) or "x")
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = rng.choice("qxz")
            base = "".join(own)
        elif kind < 0.55:
            base = base + base
        texts.append(base)
    return texts + [None, "", "a" * 700, "ab" * 300, "x" * 199, "y" * 200, "y" * 200]


@pytest.mark.parametrize("crowd,few", [(2048, 12), (2048, 0), (3, 12), (1, 12)])
def test_removal_equals_brute_force(spark, crowd, few, monkeypatch):
    texts = corpus(crowd + few, 60)
    window, gram = 200, 48
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(5)
    monkeypatch.setattr(suffix_dedup, "FEW", few)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, window, gram, crowd).collect()}
    want = brute(texts, window)
    assert [got[k] for k in range(len(texts))] == want
    assert any(x[1] for x in want)


def test_small_windows_and_buffers(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUFFER", 64)
    texts = corpus(3, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, 20, 7).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, 20)


def test_repeated_rows_and_shared_ids(spark):
    a, b = corpus(1, 12)[5] * 3, "unlike anything " * 2 + "".join(map(str, range(200)))
    rows = [(1, a), (1, a), (2, b), (2, a[:250] + "!"), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    want = sorted((k or 0, x[0], x[1]) for (k, _), x in zip(rows, brute([t for _, t in rows], 200)))
    assert got == want
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_many_rows_without_id_equal_brute_force(spark):
    """900 different texts with null ids, and some that share one id."""
    rng = random.Random(12)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(150, 400))) + shared[rng.randrange(600) :][: rng.randrange(150, 300)] for _ in range(900)]
    docs = spark.createDataFrame([(None if k < 800 else 7, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == sorted(brute(texts, 200))


def test_a_text_of_very_many_rows(spark):
    text = "one hot text " * 30
    docs = spark.createDataFrame([(k, text) for k in range(500)] + [(None, "z" + text[:250])], "doc_id long, text string").repartition(4)
    got = suffix_dedup.remove_repeats(docs).collect()
    assert sorted({(r.n_bytes, r.n_removed) for r in got}) == [(251, 250), (390, 390)] and len(got) == 501
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs, 400, 48)


def test_anchors_cut_every_window_once():
    import numpy as np

    rng = random.Random(8)
    texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 900))) for _ in range(20)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = np.concatenate(([0], ends[:-1]))
    text, place, first, last, _ = suffix_dedup.anchors(data, starts, ends)
    for k, own in enumerate(texts):
        windows = [s for a, b in zip(first[text == k], last[text == k]) for s in range(a, b + 1)]
        assert windows == list(range(starts[k], ends[k] - 199))
    assert all(a <= p <= a + 152 and b <= p for p, a, b in zip(place, first, last))


def test_front_coded_runs_merge_in_order():
    rng = random.Random(6)
    entry = lambda: (bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))), bytes(rng.choice(b"xy") for _ in range(3)), rng.randrange(99), -rng.randrange(99), rng.randrange(1 << 50), 1)
    for n in (0, 1, 2, 3, 7):
        runs = [sorted(entry() for _ in range(rng.randrange(0, 40))) for _ in range(n)]
        coded = [[front_code(r[a : a + 9]) for a in range(0, len(r), 9)] for r in runs]
        merged = list(merge_runs([read_run(iter(c)) for c in coded]))
        assert sorted(e for _, e in merged) == sorted(e for r in runs for e in r)
        suffixes = [e[0] for _, e in merged]
        assert suffixes == sorted(suffixes)
        assert [s for s, _ in merged[1:]] == [common_prefix(a, b) for a, b in zip(suffixes, suffixes[1:])]


def test_merging_never_reads_known_prefixes(monkeypatch):
    from emendra.llm import suffix_runs

    read = []
    plain = suffix_runs.common_prefix

    def spy(a, b, known=0):
        read.append((known, plain(a, b)))
        return plain(a, b, known)

    runs = [[(b"p" * 500 + bytes([97 + k, 97 + j]), b"", 0, 0, 0, 1) for j in range(20)] for k in range(4)]
    coded = [[front_code(r)] for r in runs]
    monkeypatch.setattr(suffix_runs, "common_prefix", spy)
    assert len(list(merge_runs([read_run(iter(c)) for c in coded]))) == 80
    assert sum(known == 0 for known, _ in read) <= 8
