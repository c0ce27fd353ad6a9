"""Near copies against brute force."""

import random

import pytest

from emendra.llm import near_copies

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return words


def table(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOCS)


def test_links_equal_brute_force_in_small_and_large_groups(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line = "this line is common to very many of the texts here".split()
    texts = [line + fresh(rng.randrange(1, 60)) for _ in range(60)]
    base = fresh(120)
    texts += [edited(rng, base, rng.randrange(1, 6)) for _ in range(60)]
    texts += [edited(rng, x, rng.randrange(1, 4)) for x in texts[:30] for _ in range(2)] + [["a", "b"], ["A", "b"], ["a"]]
    said = [" ".join(x) for x in texts]
    sets = [{tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(x) - 4))} for t, x in zip(said, texts)]
    parent = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                parent = [parent[j] if p == parent[i] else p for p in parent]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    for group in (2, 1000):
        name = {r.doc_id: r.component for r in near_copies.near_copy_classes(docs, group).collect()}
        got = [name[k] for k in range(len(said))]
        assert len(set(zip(got, parent))) == len(set(got)) == len(set(parent)), group


def test_crowded_shingles_are_dealt_out_and_links_stay(spark, monkeypatch):
    """With salts for nearly all shingles, texts of one group still find each other."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    said = [" ".join(edited(rng, base, 1)) for _ in range(40)] + [" ".join(f"z{rng.randrange(10**6)}" for _ in range(50)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    want = {frozenset(g) for g in groups(near_copies.near_copy_classes(docs))}
    counts = near_copies.np.full(near_copies.CELLS, 10**6)
    counts[::2] = 0
    monkeypatch.setattr(near_copies, "cell_counts", lambda texts: counts)
    monkeypatch.setattr(near_copies, "SALTED", 100)
    assert {frozenset(g) for g in groups(near_copies.near_copy_classes(docs))} == want and len(want) < 40


def groups(classes):
    found = {}
    for r in classes.collect():
        found.setdefault(r.component, set()).add(r.doc_id)
    return found.values()


def test_stage_links_by_similarity_alone(spark):
    """Ten copies with two edits each are dropped however far their fingerprints are, and less similar texts stay."""
    rng = random.Random(1)
    near = []
    for k in range(10):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        near += [(k, " ".join(base)), (100 + k, " ".join(edited(rng, base, 2)))]
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table(spark, near), "").collect()}
    assert got == set(range(10))
    shorter = [(k, " ".join(["same", "words", "here", "for", "ever"] * n)) for k, n in ((1, 1), (2, 40))]
    # 1 of 5 shingles in common
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table(spark, shorter), "").collect()} == {1, 2}


def test_rows_without_id_or_with_one_id_stay_apart(spark):
    rows = [(None, "one text of its own"), (None, "quite another text here"), (7, "a third text stands here"), (7, "and a fourth one too"), (8, "A third  text stands here")]
    kept = corpus_pipeline.drop_near_copies(spark, table(spark, rows), "").collect()
    assert sorted(r.text for r in kept) == sorted(t for k, t in rows if k != 8)
