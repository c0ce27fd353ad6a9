import random
import zlib

import numpy as np

from emendra.llm import toxicity


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["house", "tree", "river", "stone", "cloud", "paper", "green", "walk", "seven", "and"]
    bad = ["grumbleface", "snotbag", "blorkwit", "blorkhead", "blorksome"]
    rows = []
    for k in range(n):
        text = [rng.choice(words) + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(5, 80))]
        label = int(rng.random() < 0.2)
        if label:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((k, " ".join(text), label))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus(600)
    extra = [(1000, None), (1001, ""), (1002, "Blorkish " * 3000), (None, "tree"), (5, rows[5][1])]
    docs = spark.createDataFrame([(k, t, "clash") for k, t, _ in rows] + [(*r, "clash") for r in extra], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(k, x) for k, _, x in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit_model(docs, labels)
    found = toxicity.toxicity_scores(docs, model).collect()
    truth = {k: x for k, _, x in rows}
    assert len(found) == len(rows) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [(truth[r.doc_id], r.predicted) for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.98
    assert {r.predicted for r in found if r.doc_id in (1000, 1001)} == {0}
    assert [r.predicted for r in found if r.doc_id == 1002] == [1]
    assert toxicity.toxicity_scores(docs.limit(0), model).count() == 0


def test_held_out_labels_change_nothing(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    of = lambda flip: spark.createDataFrame([(k, 1 - x if flip and zlib.crc32(str(k).encode()) % 4 == 2 else x) for k, _, x in rows], "doc_id long, toxic int")
    a, b = toxicity.fit_model(docs, of(False)), toxicity.fit_model(docs, of(True))
    assert (a.voters, a.weights) == (b.voters, b.weights)


def test_without_labels_scores_are_constant(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    model = toxicity.fit_model(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.toxicity_scores(docs, model).collect()} == {0}


def voted(rng, y, *chances):
    """Votes of independent voters, each with its chance on toxic and on other rows."""
    return [np.where(y, rng.random(len(y)) < p, rng.random(len(y)) < q) for p, q in chances]


def test_label_model_finds_accuracies_without_labels():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    chances = [(0.8, 0.05), (0.7, 0.02), (0.75, 0.1), (0.65, 0.04), (0.7, 0.08)]
    votes = np.stack(voted(rng, y, *chances), axis=1).astype(float)
    post, rates, _ = toxicity.label_model(votes, np.where(votes.sum(axis=1) > 1, 0.8, 0.1))
    assert np.abs(rates - np.array(chances).T[::-1]).max() < 0.05
    assert np.mean((post > 0.5) == y) > 0.95


def test_pairwise_terms_keep_copies_of_a_voter_from_being_counted_twice(monkeypatch):
    """Four copies of a poor voter lead a model astray that takes them for independent; no labels in either case."""
    rng = np.random.default_rng(5)
    y = rng.random(6000) < 0.4
    good = voted(rng, y, *[(0.8, 0.15)] * 4)
    poor = voted(rng, y, (0.6, 0.35))[0]
    copies = [np.where(rng.random(len(y)) < 0.02, ~poor, poor) for _ in range(4)]
    votes = np.stack([*copies, *good], axis=1).astype(float)
    start = np.where(votes.mean(axis=1) > 0.5, 0.8, 0.2)
    post, _, parent = toxicity.label_model(votes, start)
    with_terms = np.mean((post > 0.5) == y)
    monkeypatch.setattr(toxicity, "forest", lambda votes, post: np.full(votes.shape[1], -1))
    without = np.mean((toxicity.label_model(votes, start)[0] > 0.5) == y)
    majority = np.mean((votes.mean(axis=1) > 0.5) == y)
    assert (parent[:4] >= 0).sum() >= 3
    assert with_terms > 0.9 and with_terms > majority + 0.1 and with_terms > without + 0.1, (with_terms, without, majority)


def test_posteriors_come_from_votes_alone():
    """The labels of a text change nothing but the voters that are mined."""
    rows = corpus(400)
    texts = [t for _, t, _ in rows]
    monkey = toxicity.mine
    try:
        toxicity.mine = lambda texts, labels: ["grumbleface", "snotbag", "blor*", "blork*"]
        a = toxicity.fit(texts, [x for _, _, x in rows])
        b = toxicity.fit(texts, [1 - x for _, _, x in rows])
    finally:
        toxicity.mine = monkey
    assert a.weights == b.weights


def test_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    rows = corpus(200)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(0, "book " * 100_000)] + [(1, rows[1][1])] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(k, x) for k, _, x in rows] * 2, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.append(texts))
    toxicity.fit_model(docs, labels)
    toxicity.fit_model(docs, labels, sample_rows=30)
    toxicity.fit_model(docs, labels, sample_bytes=4000)
    whole, few, small = seen
    assert len(few) == 30 and set(few) <= set(whole) and max(map(len, small)) <= 500 and sum(map(len, small)) <= 4000 and 5 < len(small) < 30
    # repeated rows and labels count once
    assert len(whole) == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k, _, _ in rows) + 1
