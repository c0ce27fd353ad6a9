"""Toxicity scores by weak supervision.

Many voters look at a text: words of a small public lexicon of insults, words
and word beginnings mined from a bounded sample of labelled texts by greedy
multiple cover, and patterns of writing. A generative label model, fitted by
expectation maximisation, estimates from the votes alone how often each voter
is right on toxic and on other texts, and which voters move together: these
are joined in a forest of pairwise terms, the maximum spanning one of their
mutual information given the label, so that the same evidence isn't counted
twice. No label enters it. Its posterior labels train a linear (logistic)
classifier, which scores every text.

Labels serve only to mine voters; they, the language, the source and the id are
never inputs of a score.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emendra.llm.common import by_batch, filter_rows, kept

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that can become voters.
BEGINNINGS = (4, 5, 6, 7)
#: Labelled rows that the fit reads at most, chosen by a hash of their ids, and their bytes; a text of over an eighth of these isn't read.
SAMPLE_ROWS, SAMPLE_BYTES = 8000, 64 << 20
#: Voters wanted for each toxic text, toxic texts that a voter must add, and its least precision.
COVER, ADDED, PRECISION = 3, 2, 0.8
#: Toxic texts that a voter must occur in: this share of them, and this many at least.
SUPPORT_SHARE, SUPPORT = 0.005, 3
PATTERNS = ("shouting", "exclaiming", "lexicon")
#: Common insults in four languages, each a voter of its own whatever the labels say.
LEXICON = (
    "idiot moron stupid dumb loser pathetic worthless disgusting scum trash jerk creep freak coward liar "
    "trottel dummkopf versager abschaum widerlich feigling arschloch schwachkopf "
    "imbécile crétin abruti minable ordure connard débile salaud "
    "imbécil estúpido tonto basura escoria cobarde asqueroso idiota"
).split()
#: Belief of a text with and without lexicon votes, from which the label model starts; and 2 x rows x mutual information that a pairwise term needs.
START, DEPENDENT = (0.95, 0.02), 15.0

SCORES = "doc_id long, held_out boolean, score double, predicted int"


def entries(word: str) -> list[str]:
    """A lower-case word as it can be voted on: itself, and its beginnings, marked by a star."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def pattern_votes(text: str, n_words: int, hit_words: int) -> list[float]:
    """Votes of the patterns; the last says whether any lexicon voter found something, and its silence is a vote too."""
    capitals = sum(c.isupper() for c in text)
    return [float(n_words > 0 and capitals > 2 * n_words), float(text.count("!") > 0.1 * max(n_words, 1)), float(hit_words > 0)]


def mine(texts: list[str], labels: list[int]) -> list[str]:
    """Lexicon voters: entries that together cover each toxic text COVER times, best first."""

    def held(text: str) -> set[str]:
        return {e for w in set(WORD.findall(text.lower())) for e in entries(w)}

    # only entries of enough toxic texts are counted further, and no text's entries are kept
    toxic, clean = Counter(), Counter()
    for text, label in zip(texts, labels):
        if label:
            toxic.update(held(text))
    support = max(SUPPORT, SUPPORT_SHARE * sum(map(bool, labels)))
    toxic = {e: n for e, n in toxic.items() if n >= support}
    for text, label in zip(texts, labels):
        if not label:
            clean.update(held(text) & toxic.keys())
    fit = {e for e, n in toxic.items() if n >= PRECISION * (n + clean[e])}
    covers = defaultdict(list)
    need = []
    for text, label in zip(texts, labels):
        if label:
            for e in held(text) & fit:
                covers[e].append(len(need))
            need.append(COVER)

    def key(e: str) -> tuple:
        gain = sum(need[k] > 0 for k in covers[e]) - 3 * clean[e]
        return -gain, e.endswith("*"), -len(e), e

    heap = [(key(e), e) for e in covers]
    heapq.heapify(heap)
    picked: list[str] = []
    while heap:
        old, e = heapq.heappop(heap)
        if (now := key(e)) != old:
            heapq.heappush(heap, (now, e))
            continue
        if -now[0] < ADDED:
            break
        picked.append(e)
        for k in covers[e]:
            need[k] -= 1
    return picked


@dataclass
class Model:
    """Voters, and the classifier's weights: bias, one for each voter and pattern, then distinct hits and hits by length."""

    voters: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [-6.0])
    known: dict = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self):
        self.place = {v: k for k, v in enumerate(self.voters)}

    def features(self, text: str) -> np.ndarray:
        """Votes of the lexicon and the patterns, and two measures of how many there are."""
        words = WORD.findall(text.lower())
        known, place = self.known, self.place
        hits: set[int] = set()
        hit_words = 0
        for word in set(words):
            own = known.get(word)
            if own is None:
                own = tuple(place[e] for e in entries(word) if e in place)
                if len(known) > 100_000:
                    known.clear()
                known[word] = own
            if own:
                hits.update(own)
                hit_words += 1
        x = np.zeros(len(self.voters) + len(PATTERNS) + 2)
        x[list(hits)] = 1
        x[len(self.voters) :] = [*pattern_votes(text, len(words), hit_words), math.log1p(hit_words), min(1.0, 20 * hit_words / max(len(words), 1))]
        return x

    def score(self, text: str) -> float:
        if len(self.weights) == 1:
            z = self.weights[0]
        else:
            z = self.weights[0] + float(self.features(text) @ np.asarray(self.weights[1:]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def forest(votes: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Parent of each voter (-1: none): the maximum spanning forest of mutual information given the label."""
    n, m = votes.shape
    shared = np.zeros((m, m))
    for own in (1 - post, post):
        total = own.sum() + 1e-9
        both = (votes * own[:, None]).T @ votes / total
        one = np.diag(both)
        for a, b, joint in (
            (one[:, None], one[None, :], both),
            (one[:, None], 1 - one[None, :], one[:, None] - both),
            (1 - one[:, None], one[None, :], one[None, :] - both),
            (1 - one[:, None], 1 - one[None, :], 1 - one[:, None] - one[None, :] + both),
        ):
            joint = np.maximum(joint, 0)
            shared += total / n * np.where(joint > 0, joint * np.log(np.maximum(joint, 1e-300) / np.maximum(a * b, 1e-300)), 0)
    parent, tree = np.full(m, -1), np.arange(m)
    near: dict[int, list[int]] = {k: [] for k in range(m)}
    pairs = [(shared[a, b], a, b) for a, b in zip(*np.triu_indices(m, 1)) if 2 * n * shared[a, b] > DEPENDENT]
    for _, a, b in sorted(pairs, reverse=True):
        if tree[a] != tree[b]:
            tree[tree == tree[b]] = tree[a]
            near[a].append(b)
            near[b].append(a)
    # each tree hangs from its last voter
    seen: set[int] = set()
    for root in range(m - 1, -1, -1):
        todo = [root] if root not in seen else []
        seen.update(todo)
        while todo:
            at = todo.pop()
            for k in near[at]:
                if k not in seen:
                    seen.add(k)
                    parent[k] = at
                    todo.append(k)
    return parent


def _maximise(votes: np.ndarray, post: np.ndarray, parent: np.ndarray, speaks: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Posterior after some rounds of expectation maximisation with the terms of `parent`, and the votes' log likelihood less a penalty for terms."""
    above = np.where(parent >= 0, votes[:, parent], 0.0)
    score = 0.0
    for _ in range(rounds):
        prior = np.clip(post.mean(), 1e-4, 1 - 1e-4)
        said, whole = [], []
        for share, own in ((1 - prior, 1 - post), (prior, post)):
            # chances by the parent's vote, 0 for voters without one
            chance = np.zeros(votes.shape)
            for vote in (0, 1):
                here = (above == vote) * own[:, None]
                rate = ((here * votes).sum(axis=0) + 0.1) / (here.sum(axis=0) + 1.0)
                chance = np.where(above == vote, rate, chance)
            chance = np.clip(chance, 1e-6, 1 - 1e-6)
            spoken, silent = votes * np.log(chance), (1 - votes) * np.log(1 - chance)
            said.append(math.log(share) + spoken.sum(axis=1) + silent[:, speaks].sum(axis=1))
            whole.append(math.log(share) + (spoken + silent).sum(axis=1))
        post = 1 / (1 + np.exp(-np.clip(said[1] - said[0], -30, 30)))
        score = float(np.logaddexp(*whole).sum()) - (parent >= 0).sum() * math.log(len(votes))
    return post, score


def label_model(votes: np.ndarray, start: np.ndarray, abstain: np.ndarray | None = None, rounds: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row; accuracy of each voter (chance to vote on other and on toxic rows); and its parent in the forest.

    Silence of voters that `abstain` says nothing (no insult of one language in
    a text of another), that of others counts. Each voter's chance is estimated
    given the label and its parent's vote. The forest comes from posteriors of
    independent voters, or from the belief at the start if that explains the
    votes better: many copies of one voter can lead the former astray, and a
    belief that follows from the votes the latter.
    """
    speaks = np.ones(votes.shape[1], bool) if abstain is None else ~abstain
    none = np.full(votes.shape[1], -1)
    found = []
    for post in (_maximise(votes, start.astype(float), none, speaks, rounds)[0], start.astype(float)):
        for _ in range(2):
            parent = forest(votes, post)
            post, score = _maximise(votes, post, parent, speaks, rounds)
        found.append((score, post, parent))
    _, post, parent = max(found, key=lambda x: x[0])
    own = np.stack([1 - post, post])
    return post, (own @ votes + 0.1) / (own.sum(axis=1, keepdims=True) + 1.0), parent


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> list[float]:
    """Weights (bias first) of a logistic regression on soft labels, by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def fit(texts: list[str], labels: list[int]) -> Model:
    """A model from labelled texts, whose labels only mine voters; without a toxic and a clean one, or any vote, a constant near the share of toxic ones."""
    voters = list(dict.fromkeys([*mine(texts, labels), *LEXICON])) if len(set(labels)) == 2 else []
    model = Model(voters)
    x = np.stack([model.features(t) for t in texts]) if voters else np.zeros((0, 0))
    # a voter that is silent throughout tells nothing
    heard = x[:, : len(voters)].any(axis=0) if voters else np.zeros(0, bool)
    if not heard.any():
        share = (sum(labels) + 0.01) / (len(labels) + 1)
        return Model([], [math.log(share / (1 - share))])
    voters = [v for v, h in zip(voters, heard) if h]
    x = np.hstack([x[:, : len(heard)][:, heard], x[:, len(heard) :]])
    votes = x[:, : len(voters) + len(PATTERNS)]
    # only the silence of the whole lexicon, the last voter, says something
    abstain = np.arange(votes.shape[1]) < votes.shape[1] - 1
    post, _, _ = label_model(votes, np.where(votes[:, -1] > 0, *START), abstain)
    return Model(voters, logistic(x, post))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def fit_model(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most `sample_rows` labelled rows and `sample_bytes` of text that are not held out; only these are sent to the driver.

    Rows are chosen by a hash of their ids, then by their texts; a text of over
    an eighth of the bytes isn't chosen.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out())
    chosen = usable.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text")
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text", size.alias("size"), F.xxhash64("text").alias("digest")).where(F.col("size") <= sample_bytes // 8)
    place = [F.xxhash64("doc_id"), "doc_id", "toxic", "digest"]
    sizes = joined.select("doc_id", "toxic", "digest", "size").distinct().orderBy(*place).limit(sample_rows).collect()
    taken, total = [], 0
    for r in sizes:
        total += r.size
        if total > sample_bytes:
            break
        taken.append((r.doc_id, r.toxic, r.digest))
    keys = docs.sparkSession.createDataFrame(taken, "doc_id long, toxic int, digest long")
    rows = joined.join(F.broadcast(keys), ["doc_id", "toxic", "digest"], "left_semi").dropDuplicates(["doc_id", "toxic", "digest"])
    found = sorted((r.doc_id, r.toxic, r.text) for r in rows.select("doc_id", "toxic", "text").collect())
    return fit([t for _, _, t in found], [int(x > 0) for _, x, _ in found])


def toxicity_scores(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted): every whole text scored from 0 to 1, higher: likelier toxic.

    Null texts count as empty and get the score of a text without votes; a null
    id is not held out; repeated rows give repeated results; an empty table
    gives an empty result; further columns are ignored.
    """
    voters, weights = model.voters, model.weights

    def work(rows: dict) -> dict:
        own = _model(tuple(voters), tuple(weights))
        scores = [own.score(t or "") for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "held_out": [bool(x) for x in rows["held_out"]], "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out())
    return by_batch(rows, work, SCORES)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Rows of `docs`, with all their columns, whose text scores under `threshold`."""
    voters, weights = tuple(model.voters), tuple(model.weights)
    return filter_rows(docs, "text", lambda texts: [_model(voters, weights).score(t or "") < threshold for t in texts])


def _model(voters: tuple, weights: tuple) -> Model:
    """The worker's model, with what it remembers about words."""
    return kept(("toxicity", voters, weights), lambda: Model(list(voters), list(weights)))
