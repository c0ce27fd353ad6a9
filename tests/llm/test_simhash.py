import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from emendra.llm import simhash
from emendra.llm.components import connected_components


def brute_print(text):
    words = [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")).split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c a b c a b c d", "É é\x85x A\x1cB c  d\te\x0bf g", "x " * 500])
def test_fingerprint_of_odd_texts(text):
    assert simhash.fingerprint(text) == brute_print(text)


def clustered(seed, groups, copies):
    rng = random.Random(seed)
    found = {0}
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(copies):
            x = base
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            found.add(x)
    return [x - (1 << 64) if x >= 1 << 63 else x for x in found]


@pytest.mark.parametrize("radius,bucket", [(2, 64), (2, 2), (1, 2), (0, 2), (4, 64), (4, 2)])
def test_links_equal_brute_force(spark, radius, bucket):
    values = clustered(7, 12, 20)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    nodes = {r.node: r.component for r in connected_components(simhash.hamming_links(frame, radius, bucket)).collect()}
    got = {v: nodes.get(v, v) for v in values}
    assert got == brute_components(values, radius)


def test_buckets_beyond_a_task(spark):
    values = clustered(5, 3, 12)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    nodes = {r.node: r.component for r in connected_components(simhash.hamming_links(frame, 4, 2, dense=3)).collect()}
    assert {v: nodes.get(v, v) for v in values} == brute_components(values, 4)


def test_allocation_keeps_the_pigeonhole_sum():
    rng = np.random.default_rng(1)
    for n in (10, 10**5, 10**9):
        bits = rng.integers(0, 2, (200, 64)).astype(float)
        bits[:, 1] = bits[:, 0]
        plan = simhash.allocate(n, (bits.T @ bits) / 200 * n, 2)
        assert plan and all(t >= 0 for _, t in plan)
        assert len({b for g, _ in plan for b in g}) == sum(len(g) for g, _ in plan)
    assert len(simhash.allocate(10**9, (bits.T @ bits) / 200 * 10**9, 2)) < 3


def test_classes_of_documents(spark):
    text = " ".join(f"word{k}" for k in range(200))
    rows = [(5, text, 1), (3, text.upper(), 2), (9, None, 3), (2, "", 4), (7, "something else entirely here", 5), (5, text, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted((r.doc_id, r.component_id) for r in simhash.simhash_digests(docs).collect())
    assert got == [(2, 2), (3, 3), (5, 3), (5, 3), (7, 7), (9, 2)]
    assert simhash.simhash_digests(docs.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (None, 3), (5, 6)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100 + k: 100 for k in range(50)}


def test_null_ids_name_no_component_of_others(spark):
    rows = [(None, "one two three four"), (5, "one two three four"), (9, "ONE two three four"), (None, "quite another text"), (None, None), (3, ""), (None, "lone")]
    got = sorted(map(str, simhash.simhash_classes(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string")).select("doc_id", "component_id").collect()))
    want = [(None, 5), (5, 5), (9, 5), (None, None), (None, 3), (3, 3), (None, None)]
    assert got == sorted(f"Row(doc_id={a}, component_id={b})" for a, b in want)
