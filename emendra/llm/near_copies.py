"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two searches, and every one is verified on its whole sets:

1. SimHash fingerprints of the five-word shingles within two bits, by the
   generalised pigeonhole search of `simhash`. It finds most copies with small
   edits at little cost, but at a similarity of 0.8 fingerprints differ in some
   ten of 64 bits, a radius at which no partition of the bits is selective.
2. What lies beyond that radius: a set-similarity join with prefixes. In any one
   order of all shingles, two sets that are similar enough share a shingle among
   the first n - ceil(0.8 n) + 1 of each. Shingles of rare cells of a counting
   sketch come first, so that common lines bring few texts together; the sketch
   decides the cost, never the result. Follows Bayardo, Ma and Srikant, "Scaling
   Up All Pairs Similarity Search" (2007).

Texts that share a shingle are paired up in groups of up to `group`. In a larger
group each is compared to one of the group, then in rounds to HUBS others that
are in other components; groups that have fallen into one component are done,
and only texts in different ones are paired up in the end. So a large group of
near copies costs some comparisons a text. A shingle of very many texts is dealt
to several tasks.

Pairs are screened by size and by 512 parity bits before their sets are made;
only texts of pairs that pass are sent around for that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emendra.llm.common import by_batch, durable, map_arrow
from emendra.llm.components import connected_components
from emendra.llm.exact_dedup import text_digest
from emendra.llm.simhash import fingerprint, hamming_links

SHINGLE = 5
#: Cells of the counting sketch, and those that travel in one row.
CELLS, CHUNK = 1 << 18, 1 << 14
#: Texts of a large group that all others are compared to in a round.
HUBS = 8
#: Shingles that a text of large groups holds at hand, the least of each residue.
SLOTS = 16
#: Rows of one shingle in a task, about.
SALTED = 20_000
#: 64-bit words of the parity bits.
PARITY = 8
#: Node ids that are broadcast at most (8 bytes each); more are joined by a shuffle.
ASKED = 1 << 20
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def node_column(text: str = "text") -> Column:
    """64 bits that stand for a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingles(words: list[bytes]) -> np.ndarray:
    """The set of a text's five-word shingles as sorted 64-bit hashes; a shorter text is one shingle, no words are none."""
    from xxhash import xxh64_intdigest as hashed

    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([hashed(b" ".join(words), len(words))], np.uint64)
    single = np.fromiter(map(hashed, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        mixed = (mixed ^ single[k : k + n]) * _FACTORS[k]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 0.8 or more; two empty ones have."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _cell(found: np.ndarray, cells: int) -> np.ndarray:
    return (found >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def prefix(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which a similar set shares one: the first of the order (count of the cell, hash)."""
    first = len(found) - -(-4 * len(found) // 5) + 1 if len(found) else 0
    return found[np.lexsort((found, counts[_cell(found, len(counts))]))[:first]]


def _chunks(total: np.ndarray) -> Iterator:
    import pyarrow as pa

    for k in range(0, len(total), CHUNK):
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "n": pa.array([total[k : k + CHUNK].astype("<i8").tobytes()], pa.binary())})


def cell_counts(texts: DataFrame) -> np.ndarray:
    """How many shingles of all texts fall into each cell of the sketch; tasks send their sums in a few rows."""

    def counted(batches: Iterator) -> Iterator:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingles(words_of(t)) for t in batch.column(0).slice(at, 256).to_pylist()]
                total += np.bincount(_cell(np.concatenate(sets), CELLS), minlength=CELLS)
        yield from _chunks(total)

    def summed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1)):
                known[k] = known.get(k, 0) + np.frombuffer(n.as_py(), "<i8")
        if known:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(known), pa.int32()), "n": pa.array([x.tobytes() for x in known.values()], pa.binary())})

    schema = "chunk int, n binary"
    counts = np.zeros(CELLS, np.int64)
    for row in map_arrow(map_arrow(texts.select("text"), counted, schema).repartition("chunk"), summed, schema).toLocalIterator():
        counts[row.chunk : row.chunk + CHUNK] = np.frombuffer(bytes(row.n), "<i8")
    return counts


PREFIXES = "token long, salt int, node long, size int, rest int"


def _prefixes(counts: np.ndarray):
    """Rows of each text's prefix: `rest` shingles from this one on; `salt` deals out shingles of crowded cells, -1: not crowded."""
    salts = np.maximum(0, counts - 2 * int(counts.mean())) // SALTED

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                sets = [shingles(words_of(t)) for t in rows.column(1).to_pylist()]
                first = [prefix(s, counts) for s in sets]
                n = [len(x) for x in first]
                if not sum(n):
                    continue
                token = np.concatenate(first)
                node = np.repeat(rows.column(0).to_numpy(zero_copy_only=False), n)
                size = np.repeat(np.array([len(s) for s in sets], np.int32), n)
                rest = size - np.concatenate([np.arange(k, dtype=np.int32) for k in n])
                salt = salts[_cell(token, len(counts))]
                salt = np.where(salt > 0, (node.view(np.uint64) % np.maximum(salt, 1).astype(np.uint64)).astype(np.int32), -1).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"token": token.view(np.int64), "salt": salt, "node": node, "size": size, "rest": rest})

    return run


FOUND = "a long, b long, large int, rest int"


def _paired(group: int):
    """Pairs of each run of equal tokens and salts: all in runs of up to `group` nodes, else one to all others.

    The rows of larger and of salted runs follow as (token, node, size, rest),
    the size in `large`, which is 0 for pairs.
    """

    def of_run(token: int, salted: bool, node: np.ndarray, size: np.ndarray, rest: np.ndarray) -> list[tuple]:
        node, at = np.unique(node, return_index=True)
        size, rest = size[at].astype(np.int64), rest[at].astype(np.int64)
        out = []
        if salted or len(node) > group:
            out.append((np.full(len(node), token, np.int64), node, size.astype(np.int32), rest.astype(np.int32)))
        if len(node) < 2:
            return out
        if len(node) <= group:
            a, b = np.triu_indices(len(node), 1)
        else:
            # the same few of a group for most of its tokens
            hub = int(np.argmin(node.view(np.uint64) * _FACTORS[1]))
            b = np.delete(np.arange(len(node)), hub)
            a = np.full(len(b), hub)
        # the first shingle that two share leaves no more than the rest from there to share
        fits = 9 * np.minimum(rest[a], rest[b]) >= 4 * (size[a] + size[b])
        a, b = node[a[fits]], node[b[fits]]
        return [*out, (np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), np.int32), np.zeros(len(a), np.int32))]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple] = []
        waiting = 0

        def made(pieces: list[tuple]) -> Iterator:
            """All runs of rows that come in order."""
            token, salt, node, size, rest = [np.concatenate(x) for x in zip(*pieces)]
            edges = np.flatnonzero((token[1:] != token[:-1]) | (salt[1:] != salt[:-1])) + 1
            starts = np.concatenate([[0], edges, [len(token)]])
            found: list[tuple] = []
            rows = 0
            for k in np.flatnonzero((np.diff(starts) > 1) | (salt[starts[:-1]] >= 0)).tolist():
                x, y = starts[k], starts[k + 1]
                found += of_run(int(token[x]), salt[x] >= 0, node[x:y], size[x:y], rest[x:y])
                rows += y - x
                if rows > 50_000:
                    yield batch_of(found)
                    found, rows = [], 0
            if found:
                yield batch_of(found)

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            rows = np.unique(np.rec.fromarrays([np.concatenate(x) for x in zip(*found)], names="a,b,large,rest"))
            return pa.RecordBatch.from_pydict({k: np.ascontiguousarray(rows[k]) for k in rows.dtype.names})

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            held.append(columns)
            waiting += batch.num_rows
            if waiting < 100_000:
                continue
            # the last run may go on in the next batch
            last = columns[0][-1], columns[1][-1]
            open_ = [((c[0] == last[0]) & (c[1] == last[1])) for c in held]
            over = [tuple(x[~o] for x in c) for c, o in zip(held, open_)]
            held = [tuple(x[o] for x in c) for c, o in zip(held, open_)]
            waiting = 0
            if sum(len(c[0]) for c in over):
                yield from made(over)
        if held and sum(len(c[0]) for c in held):
            yield from made(held)

    return run


def parities(found: np.ndarray) -> list[int]:
    """512 bits, each whether an odd number of the shingles falls to it: two sets differ in as many shingles as bits at least."""
    odd = np.bincount((found >> np.uint64(7) & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


#: Whether two texts (size, bits) and (m, odd) may be similar: their sets differ in no more than a ninth of both sizes.
MAY_BE = "9 * (" + " + ".join(f"bit_count(bits[{k}] ^ odd[{k}])" for k in range(PARITY)) + ") <= size + m and 5 * least(size, m) >= 4 * greatest(size, m)"


#: Of the shingles that two texts share in large groups, the one to compare them at: the first slot in which both hold the same, else any.
ONCE = "coalesce(" + ", ".join(f"nullif(slots[{k}], nullif(slots[{k}], other[{k}]))" for k in range(SLOTS)) + ", token) = token"


def _verified(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows = batch.slice(at, 64)
            sets = [[shingles(words_of(t)) for t in rows.column(k).to_pylist()] for k in (2, 3)]
            yield rows.select([0, 1]).filter(pa.array([similar(a, b) for a, b in zip(*sets)], pa.bool_()))


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, text) are similar. Texts travel, as they compress and hashes of shingles don't."""
    asked = durable(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), tidy=True)
    few = asked.count() <= ASKED
    wanted = texts.join(F.broadcast(asked) if few else asked, "node", "left_semi").dropDuplicates(["node"])
    side = lambda end, name: wanted.select(F.col("node").alias(end), F.col("text").alias(name))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    return durable(map_arrow(both, _verified, "a long, b long"), tidy=True)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_pairs(sketches: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of nodes that chain all whose fingerprints `fp` are linked by SimHash, and all without words."""
    first = durable(sketches.groupBy("fp").agg(F.min("node").alias("first")), tidy=True)
    links = hamming_links(first.select("fp"), radius)
    far = links.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = sketches.join(first, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    blank = sketches.where("size = 0")
    none = blank.select(F.col("node").alias("a"), F.lit(blank.agg(F.min("node")).first()[0]).cast("long").alias("b"))
    return far.unionByName(same).unionByName(none)


def similar_links(texts: DataFrame, sketches: DataFrame, group: int = 16, rounds: int = 1) -> DataFrame:
    """Links (a, b) that join every two nodes whose texts (node, text) are similar, directly or over others that are linked.

    `sketches`: (node, size, bits, fp) of each node once.
    """
    counts = cell_counts(texts)
    rows = map_arrow(texts.select("node", "text"), _prefixes(counts), PREFIXES)
    dealt = rows.repartition("token", "salt").sortWithinPartitions("token", "salt")
    found = durable(map_arrow(dealt, _paired(group), FOUND), tidy=True)
    bare = sketches.select("node", "size", "bits")
    other = bare.select(F.col("node").alias("b"), F.col("size").alias("m"), F.col("bits").alias("odd"))
    pairs = _ordered(found.where("large = 0").select("a", "b").unionByName(simhash_pairs(sketches)))
    pairs = durable(pairs.join(bare.withColumnRenamed("node", "a"), "a").join(other, "b").where(MAY_BE).select("a", "b"), tidy=True)
    links = verified(texts, pairs)
    large = found.where("large > 0").select(F.col("a").alias("token"), F.col("b").alias("node")).distinct()
    if not large.isEmpty():
        large = durable(large.join(bare, "node"), tidy=True)
    for turn in range(rounds + 1):
        if large.isEmpty():
            break
        component = connected_components(links)
        placed = large.drop("component").join(component, "node", "left").select("token", "node", "size", "bits", F.coalesce("component", "node").alias("component"))
        open_ = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("token")
        large = durable(placed.join(open_, "token", "left_semi"), tidy=True)
        held = large.groupBy("node").agg(*[F.min(F.when(F.pmod("token", F.lit(SLOTS)) == k, F.col("token"))).alias(f"s{k}") for k in range(SLOTS)])
        # two texts that share many shingles of large groups are compared at one of them
        ready = large.join(held.select("node", F.array(*[f"s{k}" for k in range(SLOTS)]).alias("slots")), "node")
        near = f"c != component and {ONCE} and {MAY_BE}"
        named = [F.col("node").alias("a"), F.col("size").alias("m"), F.col("bits").alias("odd"), F.col("component").alias("c"), F.col("slots").alias("other")]
        if turn < rounds:
            first = Window.partitionBy("token").orderBy(F.xxhash64("node", F.lit(turn)))
            hub = ready.withColumn("place", F.row_number().over(first)).where(F.col("place") <= HUBS).select("token", *named)
            fits = ready.withColumnRenamed("node", "b").join(hub, "token").where(near)
        else:
            fits = ready.withColumnRenamed("node", "b").join(ready.select("token", *named), "token").where(f"a < b and {near}")
        more = durable(_ordered(fits.select("a", "b")).join(pairs, ["a", "b"], "left_anti"), tidy=True)
        pairs = pairs.unionByName(more)
        links = links.unionByName(verified(texts, more))
    return links


SKETCHES = "doc_id long, sha string, node long, size int, bits array<long>, fp long"


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, node, size, bits, fp) of each row: the digest of its text, its node, its number of shingles, parity bits and fingerprint."""

    def work(rows: dict) -> dict:
        sets = [shingles(words_of(t)) for t in rows["text"]]
        prints = np.array([fingerprint(t, SHINGLE) for t in rows["text"]], np.uint64).view(np.int64)
        return {"doc_id": rows["doc_id"], "sha": [text_digest(t) for t in rows["text"]], "node": rows["node"], "size": list(map(len, sets)), "bits": list(map(parities, sets)), "fp": prints}

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", node_column().alias("node")), work, SKETCHES, 64)


def near_copy_classes(docs: DataFrame, group: int = 16) -> DataFrame:
    """(doc_id, sha, component): each row's id, the digest of its text, and a name of the near copies it is linked with.

    Texts of the same words are near copies, as are null and empty texts.
    Repeated rows give repeated results, null ids are no ids of one document,
    an empty table gives an empty result; further columns are ignored. Texts
    and shingles are told apart by 64-bit hashes.
    """
    keyed = durable(sketched(docs), tidy=True)
    texts = docs.select(node_column().alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    sketches = durable(keyed.select("node", "size", "bits", "fp").dropDuplicates(["node"]), tidy=True)
    component = connected_components(similar_links(texts, sketches, group))
    return keyed.select("doc_id", "sha", "node").join(component, "node", "left").select("doc_id", "sha", F.coalesce("component", "node").alias("component"))
