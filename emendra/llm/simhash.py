"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within `radius` differing bits are linked. Bits that are
correlated over all fingerprints are grouped into partitions, and the radius is
shared out among the partitions unequally: thresholds t_i of at least -1 with
sum radius - parts + 1, so that any linked pair agrees in some partition i up
to t_i bits. Dynamic programming picks the thresholds, and the number of
partitions, of least estimated cost (signatures to probe, candidates to
verify). Follows Qin et al., "GPH: Similarity Search in Hamming Space" (2018).

All of it works on distinct fingerprints. A bucket of more than `bucket`
fingerprints is not paired up; its members and those who probe it take an exact
way instead: fingerprints are linked within two bits if and only if they share
a fingerprint one flip away, so each names its 65 neighbours and all that name
the same one are chained to the smallest. Work stays linear either way. (At
four bits they would name 2,081 each, so buckets that fit a task are searched
there.)
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emendra.llm.common import by_batch, durable, join_counted, map_arrow
from emendra.llm.components import connected_components

BITS = 64
SEED = 42
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """A bit is set if it is in over half of the XXH64 hashes of the word shingles, repeats included; no words: 0."""
    from xxhash import xxh64_intdigest as hashed

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return hashed(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    hashes = np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, n)
    by_byte = hashes.view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number. A null text counts as empty."""

    def work(rows: dict) -> dict:
        found = np.array([fingerprint(t, shingle) for t in rows["text"]], np.uint64).view(np.int64)
        return {"doc_id": rows["doc_id"], "fp": found}

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, fp long")


def _moments(batches: Iterator) -> Iterator:
    """Per partition: how often each pair of bits is set together (64 x 64 counts)."""
    import pyarrow as pa

    total = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        if batch.num_rows:
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int32()), "n": pa.array(total.ravel()[at], pa.int64())})


def bit_moments(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and the 64 x 64 counts of bits set together, over all of them."""
    counts = np.zeros(BITS * BITS, np.int64)
    for row in map_arrow(distinct.select("fp"), _moments, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[row.cell] = row.n
    return distinct.count(), counts.reshape(BITS, BITS)


def grouped_bits(n: int, together: np.ndarray, parts: int) -> tuple[list[list[int]], list[float]]:
    """Bits in `parts` groups of like size, correlated bits together; and of each group the share of its bits that is independent."""
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    related = ((together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)) ** 2
    np.fill_diagonal(related, 1)
    free, groups = set(range(BITS)), []
    for part in range(parts):
        width = BITS // parts + (part < BITS % parts)
        mean = related.sum(axis=1)
        group = [max(free, key=lambda b: (mean[b], -b))]
        free.remove(group[0])
        while len(group) < width:
            pull = related[group].sum(axis=0)
            group.append(max(free, key=lambda b: (pull[b], -b)))
            free.remove(group[-1])
        groups.append(sorted(group))
    effective = [len(g) / related[np.ix_(g, g)].sum() for g in groups]
    return groups, effective


def _within(n: int, share: np.ndarray, group: list[int], effective: float, t: int) -> float:
    """Estimated chance that two fingerprints differ in at most `t` of the group's bits."""
    odds = [1.0]
    for b in group:
        differ = 2 * share[b] * (1 - share[b])
        odds = [x * (1 - differ) + y * differ for x, y in zip([*odds, 0], [0, *odds])]
    return min(1.0, sum(odds[: t + 1])) ** min(1.0, max(effective, 1e-3))


def allocate(n: int, together: np.ndarray, radius: int, probe_cost: float = 1.0, verify_cost: float = 0.3, most_parts: int = 6) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, of least estimated cost."""
    share = np.diag(together) / max(n, 1)
    # planned for a corpus ten times as large: candidates grow with its square and signatures in proportion, so a plan
    # that is only just cheapest now would soon change for one with many more signatures; nor must few fingerprints
    # make enumerating all their neighbours look cheap
    planned = max(10 * n, 10_000)
    best: tuple[float, list] = (float("inf"), [])
    for parts in range(1, most_parts + 1):
        groups, effective = grouped_bits(n, together, parts)

        def cost(i: int, t: int) -> float:
            if t < 0:
                return 0.0
            if t > 2:
                return float("inf")
            signatures = sum(comb(len(groups[i]), k) for k in range(t + 1))
            return planned * signatures * probe_cost + planned * planned * _within(planned, share, groups[i], effective[i], t) * verify_cost

        # cheapest[s]: thresholds of the partitions so far that sum to s
        cheapest: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for i in range(parts):
            following: dict[int, tuple[float, list[int]]] = {}
            for s, (paid, chosen) in cheapest.items():
                for t in range(-1, radius + 1):
                    offer = (paid + cost(i, t), [*chosen, t])
                    if s + t not in following or offer < following[s + t]:
                        following[s + t] = offer
            cheapest = following
        paid, chosen = cheapest[radius - parts + 1]
        if paid < best[0]:
            best = (paid, [(g, t) for g, t in zip(groups, chosen) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _buckets(distinct: DataFrame, plan: list[tuple[list[int], int]]) -> tuple[DataFrame, DataFrame]:
    """Index rows and probe rows (part, value, fp): a fingerprint is indexed once a part, and probes all values within the threshold."""
    def bucket(part: int, value):
        return F.struct(F.lit(part).alias("part"), value.alias("value"))

    def probes(part: int, own, flips: list[int]):
        return F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: bucket(part, own.bitwiseXOR(x)))

    index, probe = [], []
    for part, (group, t) in enumerate(plan):
        own = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in group))).cast("long"))
        flips = [_signed(sum(1 << b for b in chosen)) for k in range(t + 1) for chosen in combinations(group, k)]
        index.append(bucket(part, own))
        probe.append(probes(part, own, flips))
    of = lambda column: distinct.select("fp", F.explode(column).alias("x")).select("x.part", "x.value", "fp")
    return of(F.array(*index)), of(F.concat(*probe))


def _dense_links(radius: int):
    """Links of one bucket of bounded size: a search from fingerprint to fingerprint that looks at each once, so there are fewer links than members."""

    def run(pdf):
        import pandas as pd

        left = np.unique(pdf["fp"].to_numpy().astype(np.int64)).view(np.uint64)
        found: list[tuple[int, int]] = []
        while len(left):
            root, todo, left = int(left[:1].view(np.int64)[0]), [left[0]], left[1:]
            while todo and len(left):
                near = np.bitwise_count(left ^ todo.pop()) <= radius
                todo += list(left[near])
                found += [(root, x) for x in left[near].view(np.int64).tolist()]
                left = left[~near]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def hamming_links(distinct: DataFrame, radius: int = 2, bucket: int = 64, dense: int = 20_000) -> DataFrame:
    """Links (a, b) that join every two of the distinct fingerprints `fp` within `radius` bits (0, 1, 2 or 4), directly or over others that are linked.

    Buckets of up to `bucket` fingerprints are paired and verified. Above radius
    2, those that up to `dense` fingerprints probe are searched in one task each;
    all others take the way over shared neighbours.
    """
    if radius not in (0, 1, 2, 4):
        raise ValueError("radius must be 0, 1, 2 or 4.\n\nCause: the way around large buckets is exact for these.\n\nTo fix: choose one of them.")
    n, together = bit_moments(distinct)
    plan = allocate(n, together, radius)
    index, probe = _buckets(distinct, plan)
    hot = durable(index.groupBy("part", "value").count().where(F.col("count") > bucket).select("part", "value"))
    cool = index.join(hot, ["part", "value"], "left_anti")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = cool.withColumnRenamed("fp", "a").join(probe.withColumnRenamed("fp", "b"), ["part", "value"]).where(close & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # whoever is in a large bucket or probes one
    crowd = probe.join(hot, ["part", "value"], "left_semi")
    if radius > 2:
        crowd = durable(crowd)
        sizes = durable(crowd.groupBy("part", "value").count())
        searched = crowd.join(sizes.where(F.col("count") <= dense), ["part", "value"], "left_semi")
        pairs = pairs.unionByName(searched.groupBy("part", "value").applyInPandas(_dense_links(radius), "a long, b long"))
        huge = sizes.where(F.col("count") > dense)
        if huge.isEmpty():
            return pairs.distinct()
        crowd = crowd.join(huge, ["part", "value"], "left_semi")
    return pairs.unionByName(_neighbour_links(crowd.select("fp").distinct(), radius)).distinct()


def _neighbour_links(crowd: DataFrame, radius: int) -> DataFrame:
    """Links of any number of fingerprints, over the ones half the radius away that they share."""
    reach = (radius + 1) // 2
    step = [_signed(sum(1 << b for b in chosen)) for k in range(reach + 1) for chosen in combinations(range(BITS), k)]
    around = crowd.select("fp", F.explode(F.array(*[F.lit(x).cast("long") for x in step])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    if radius == 1:
        around = around.where("fp = near").unionByName(around.where("fp != near").join(crowd.withColumnRenamed("fp", "near"), "near", "left_semi").select("fp", "near"))
    low = around.groupBy("near").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("near", "a")
    return around.join(low, "near").where("fp != a").select("a", F.col("fp").alias("b"))


def simhash_classes(docs: DataFrame, shingle: int = 3, radius: int = 2, bucket: int = 64) -> DataFrame:
    """(doc_id, fp, component_id): each document's fingerprint and the smallest id linked with it, directly or over others.

    Null and empty texts have fingerprint 0 and are linked like any other.
    Repeated rows fall together; a null id never names a component of others
    (one of rows without ids has none);
    an empty table gives an empty result; further columns are ignored.
    """
    prints = durable(fingerprints(docs, shingle))
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    nodes = connected_components(hamming_links(distinct.select("fp"), radius, bucket))
    # component of fingerprints to the smallest document id in it; large components and frequent fingerprints meet in no one task
    placed = durable(distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", F.coalesce("component", "fp").alias("component"), "first"))
    least = durable(placed.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members")))
    named = durable(join_counted(placed.select("fp", "n", "component"), least, ["component"], "members").select("fp", "n", "component_id"))
    return join_counted(prints, named, ["fp"], "n").select("doc_id", "fp", "component_id")


def simhash_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): three-word shingles, links at two or fewer differing bits."""
    return simhash_classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
