"""Removal of repeated passages over a distributed, sparse suffix array.

A byte goes if a string of `window` bytes that covers it also starts anywhere
else in the corpus. Sorting every suffix would exchange far more than the
corpus, so only anchors are sorted: of the grams (short substrings) of a window
the one with the least hash is its anchor, and equal windows have equal anchors
at equal places. An anchor thus stands for a stretch of neighbouring windows,
its extent, and every window belongs to exactly one.

1. Grams that occur as anchors only once can't repeat (counted with map-side
   combining, whatever their frequency).
2. Of the rest, equal extents are one suffix with a count. All windows of an
   extent that occurs twice repeat.
3. Extents that occur once but share the gram with others are compared: every
   task sorts the suffixes from their anchors into runs, exchanges them
   front-coded, and loser trees merge the runs without ever re-reading known
   prefixes. Of the extents of a gram, those that share a window have a common
   prefix on the right of the anchor, which the merge has found, and one on the
   left: at each offset of the anchor in the window, runs of neighbours with
   long enough prefixes are classes, and windows are equal if both classes are.
4. A gram with more than `crowd` different extents isn't merged in one task:
   their windows are counted by digest instead, spread over all tasks.

A text goes by its 128-bit digest: rows of equal texts, whatever their ids,
share what is found, and rows that share an id but not the text never meet.
Texts travel compressed, twice: to the extents to be compared, of equal ones
only one, and to the ranges to be removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emendra.llm.common import durable, join_counted, map_arrow
from emendra.llm.suffix_runs import common_prefix, front_code, merge_runs, read_run

WINDOW, GRAM = 200, 48
#: Bytes of text that are hashed at once, and of suffixes sorted into one run.
BUFFER, RUN = 1 << 20, 24 << 20
#: Different extents of a gram that are compared in one task, and up to which each is compared with its neighbours one by one.
CROWD, FEW = 50_000, 12
#: Extents to a part of the exchange.
PART_ENTRIES = 50_000
#: Digests of texts that a task remembers, so as to send equal ones once.
REMEMBERED = 100_000
KEY = ["k1", "k2"]

_LOW = np.uint64((1 << 24) - 1)
_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(max(n, BUFFER + WINDOW), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Anchors of the texts data[start:end]: arrays of text number, anchor, first and last window start, gram hash.

    `data` has under 16 M bytes. The order of hashes, and of equal ones by
    place, doesn't depend on where a window stands.
    """
    n = len(data)
    counts = np.maximum(0, ends - starts - window + 1)
    if not counts.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(_BASE, n), out=sums[1:])
    hashes = (sums[gram:] - sums[:-gram]) * _powers(_INVERSE, n - gram + 1)
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(32)
    m, w = len(hashes), window - gram + 1
    keys = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
    keys[:m] = (hashes & ~_LOW) | np.arange(m, dtype=np.uint64)
    rows = keys.reshape(-1, w)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    onward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(onward[: m - w + 1], upto[w - 1 : m]) & _LOW).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    place = least[at]
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
    last = np.concatenate((new[1:], [len(at)])) - 1
    return text[new], place[new], at[new], at[last], hashes[place[new]].view(np.int64)


def _digest(data: bytes) -> tuple[int, int]:
    """A text's 128-bit digest as two signed numbers."""
    from xxhash import xxh3_128_digest

    found = xxh3_128_digest(data)
    return int.from_bytes(found[:8], "little", signed=True), int.from_bytes(found[8:], "little", signed=True)


def unpack(position: int) -> tuple[int, int, int]:
    """An extent in one number: anchor at `place`, first window `before` bytes earlier, `more` further windows."""
    return position >> 16, position >> 8 & 255, position & 255


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _anchor_rows(whole: bool, window: int, gram: int):
    """Arrow rows of anchors of (text): the gram hash, or with `whole` also the extent's digest, the text's, and the packed position."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(x[3] for x in held), np.uint8)
            ends = np.cumsum([len(x[3]) for x in held])
            starts = np.concatenate(([0], ends[:-1]))
            text, place, first, last, hashes = anchors(data, starts, ends, window, gram)
            if not whole:
                return pa.RecordBatch.from_pydict({"h": pa.array(hashes, pa.int64())})
            view = memoryview(data)
            digests = np.fromiter((xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (last + window).tolist())), np.uint64, len(first)).view(np.int64)
            one, two, base = (np.array([x[k] for x in held], np.int64)[text] for k in range(3))
            positions = (place - starts[text] + base) << 16 | (place - first) << 8 | (last - first)
            return pa.RecordBatch.from_pydict({"h": pa.array(hashes, pa.int64()), "e": pa.array(digests, pa.int64()), "k1": pa.array(one, pa.int64()), "k2": pa.array(two, pa.int64()), "pos": pa.array(positions, pa.int64())})

        for batch in batches:
            for text in batch.column(0):
                raw = _raw(text.as_py())
                if len(raw) < window:
                    continue
                key = _digest(raw) if whole else (0, 0)
                for at in range(0, len(raw) - window + 1, BUFFER):
                    piece = raw[at : at + BUFFER + window - 1]
                    if size + len(piece) > 2 * BUFFER:
                        yield flush()
                        held.clear()
                        size = 0
                    held.append((*key, at, piece))
                    size += len(piece)
        if held:
            yield flush()

    return run


def _compressed(once: bool):
    """(k1, k2, z): digests and compressed bytes of (text), most equal ones of a task `once`; or with doc_id of (doc_id, text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        seen: set = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                raws = [_raw(t.as_py()) for t in rows.column(rows.num_columns - 1)]
                keys = [_digest(r) for r in raws]
                if once:
                    new = [k for k, key in enumerate(keys) if key not in seen and not seen.add(key)]
                    raws, keys = [raws[k] for k in new], [keys[k] for k in new]
                    if len(seen) > REMEMBERED:
                        seen.clear()
                made = {"k1": pa.array([a for a, _ in keys], pa.int64()), "k2": pa.array([b for _, b in keys], pa.int64()), "z": pa.array([packer.compress(r) for r in raws], pa.binary())}
                yield pa.RecordBatch.from_pydict(made if once else {"doc_id": rows.column(0), **made})

    return run


def _cut_runs(parts: int, window: int):
    """Sorted, front-coded runs of the suffixes from the anchors of each row (k1, k2, z, [(h, pos, single)])."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        opener = zstandard.ZstdDecompressor()
        packer = zstandard.ZstdCompressor(level=3)
        task = TaskContext.get().partitionId() << 24
        held: dict[int, list] = {}
        size = number = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size, number
            rows = []
            for part, entries in sorted(held.items()):
                entries.sort()
                for seq, at in enumerate(range(0, len(entries), 4096)):
                    rows.append((part, task + number, seq, packer.compress(front_code(entries[at : at + 4096]))))
            held.clear()
            size, number = 0, number + 1
            for at in range(0, len(rows), 64):
                columns = list(zip(*rows[at : at + 64]))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["part", "run", "seq", "block"])

        for batch in batches:
            for one, two, z, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                raw = opener.decompress(z.as_py())
                for item in wanted.as_py():
                    place, before, more = unpack(item["pos"])
                    first = place - before
                    entry = (raw[place : first + more + window], raw[first:place][::-1], one, two, item["pos"], item["single"])
                    held.setdefault(item["h"] % parts, []).append(entry)
                    size += len(entry[0]) + len(entry[1]) + 200
                if size > RUN:
                    yield from flush()
        if held:
            yield from flush()

    return run


def shared_windows(group: list[tuple[int, tuple]], window: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """(number in the group, start, end) of bytes covered by windows that single extents share with others of the group.

    `group`: (prefix shared with the one before, entry) of different extents with one gram, in order.
    """
    if not any(e[-1] for _, e in group):
        return
    yield from (_shared_by_few if len(group) <= FEW else _shared_by_classes)(group, window)


def _shared_by_few(group: list[tuple[int, tuple]], window: int) -> Iterator[tuple[int, int, int]]:
    """Each extent's neighbours, as far as the running minimum of their common prefixes reaches a window."""
    for i, (_, (_, left, _, _, pos, single)) in enumerate(group):
        if not single:
            continue
        place, before, more = unpack(pos)
        for side in (range(i - 1, -1, -1), range(i + 1, len(group))):
            right = 1 << 30
            for j in side:
                right = min(right, group[max(i, j) if j > i else j + 1][0])
                if right < window - before:
                    break
                low, high = max(-before, -common_prefix(left, group[j][1][1])), min(more - before, right - window)
                if low <= high:
                    yield i, place + low, place + high + window


def _shared_by_classes(group: list[tuple[int, tuple]], window: int) -> Iterator[tuple[int, int, int]]:
    """At each offset of the anchor in the window: classes of extents that agree on the right and on the left of it."""
    m = len(group)
    entries = [e for _, e in group]
    right = np.array([shared for shared, _ in group], np.int64)
    order = sorted(range(m), key=lambda k: entries[k][1])
    left = np.array([0, *(common_prefix(entries[a][1], entries[b][1]) for a, b in zip(order, order[1:]))], np.int64)
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    place, before, more = np.array([unpack(e[4]) for e in entries], np.int64).T
    single = np.array([e[5] for e in entries], bool)
    owners, firsts = [], []
    for offset in range(int((before - more).min()), int(before.max()) + 1):
        own = np.flatnonzero((offset <= before) & (offset >= before - more))
        if len(own) < 2:
            continue
        # class numbers grow where neighbours share less than the window's part on that side
        key = np.cumsum(right < window - offset)[own] * (m + 1) + np.cumsum(left < offset)[rank[own]]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        hit = own[(counts[inverse] > 1) & single[own]]
        owners.append(hit)
        firsts.append(place[hit] - offset)
    if not owners:
        return
    owner, first = np.concatenate(owners), np.concatenate(firsts)
    if not len(owner):
        return
    inorder = np.lexsort((first, owner))
    owner, first = owner[inorder], first[inorder]
    # neighbouring windows of an extent make one range
    starts = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (first[1:] != first[:-1] + 1))))
    lasts = np.append(starts[1:], len(owner)) - 1
    yield from zip(owner[starts].tolist(), first[starts].tolist(), (first[lasts] + window).tolist())


def _merge_parts(window: int, gram: int):
    """Ranges of single extents that repeat elsewhere, from the blocks of each part, which come part by part and run by run."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        opener = zstandard.ZstdDecompressor()

        def ranges(runs: dict[int, list[bytes]]) -> Iterator[tuple]:
            group: list[tuple[int, tuple]] = []
            for shared, entry in merge_runs([read_run(map(opener.decompress, blocks)) for blocks in runs.values()]):
                if shared < gram and group:
                    yield from of_group(group)
                    group = []
                group.append((shared, entry))
            yield from of_group(group)

        def of_group(group: list[tuple[int, tuple]]) -> Iterator[tuple]:
            for k, a, b in shared_windows(group, window):
                yield *group[k][1][2:5], a, b

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(columns[k], pa.int64()) for k in (0, 1, 3, 4)], names=[*KEY, "first", "last"])

        def merged(runs: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
            out: list[list] = []
            for *own, a, b in ranges(runs):
                if out and out[-1][:3] == own and a <= out[-1][4] and b >= out[-1][3]:
                    out[-1][3:] = [min(a, out[-1][3]), max(b, out[-1][4])]
                    continue
                if len(out) >= 20_000:
                    yield batch_of(out)
                    out = []
                out.append([*own, a, b])
            if out:
                yield batch_of(out)

        part, runs = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                now = batch.column(0)[k].as_py()
                if now != part:
                    if runs:
                        yield from merged(runs)
                    part, runs = now, {}
                runs.setdefault(batch.column(1)[k].as_py(), []).append(batch.column(3)[k].as_py())
        if runs:
            yield from merged(runs)

    return run


def _window_digests(window: int):
    """Digests of all windows of extents of crowded grams: (w1, w2, k1, k2, first, single)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from xxhash import xxh3_128_digest

        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for one, two, z, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                raw = opener.decompress(z.as_py())
                digests, firsts, singles = bytearray(), [], []
                for item in wanted.as_py():
                    place, before, more = unpack(item["pos"])
                    for at in range(place - before, place - before + more + 1):
                        digests += xxh3_128_digest(raw[at : at + window])
                        firsts.append(at)
                        singles.append(item["single"])
                halves = np.frombuffer(bytes(digests), "<i8").reshape(-1, 2)
                columns = {"w1": halves[:, 0], "w2": halves[:, 1], "k1": np.full(len(firsts), one), "k2": np.full(len(firsts), two), "first": np.array(firsts, np.int64)}
                yield pa.RecordBatch.from_pydict({k: np.ascontiguousarray(v) for k, v in columns.items()} | {"single": pa.array(singles, pa.int32())})

    return run


def _remove(batches: Iterator) -> Iterator:
    """What is left of each text: rows (doc_id, z, ranges)."""
    import hashlib

    import pyarrow as pa
    import zstandard

    opener = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[tuple] = []
        for key, z, ranges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            raw = opener.decompress(z.as_py())
            spans: list[list[int]] = []
            for r in sorted((r["first"], r["last"]) for r in ranges.as_py() or []):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append(list(r))
            edges = [0, *(x for s in spans for x in s), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((key, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"first": a, "last": b} for a, b in spans], kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.binary())
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept")
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], type=kinds[k]) for k in range(len(names))], names=list(names))


def repeated_ranges(own: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(k1, k2, first, last): byte ranges of texts (text), named by their digests, that repeated windows cover; some may be there twice."""
    if not 1 <= gram <= window < gram + 256:
        raise ValueError("window must be less than 256 bytes longer than gram.\n\nCause: an extent's windows are counted in one byte.\n\nTo fix: choose a longer gram.")
    spark = own.sparkSession
    # written first, so that the join below has plain exchanges on both sides, whose hot parts can be split
    often = durable(map_arrow(own, _anchor_rows(False, window, gram), "h long").groupBy("h").count().where("count > 1").select("h"))
    rows = map_arrow(own, _anchor_rows(True, window, gram), "h long, e long, k1 long, k2 long, pos long")
    found = durable(rows.join(often, "h", "left_semi"))
    kinds = durable(found.groupBy("h", "e").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "pos")).alias("at")).select("h", "e", "n", "at.k1", "at.k2", "at.pos"))
    whole = join_counted(found, kinds.where("n > 1").select("h", "e", "n"), ["h", "e"], "n").select(*KEY, "pos")
    # windows from place - before on, `more` further ones
    first = F.shiftright("pos", 16) - F.shiftright("pos", 8).bitwiseAND(F.lit(255).cast("long"))
    covered = whole.select(*KEY, first.alias("first"), (first + F.col("pos").bitwiseAND(F.lit(255).cast("long")) + window).alias("last"))
    # grams with several kinds of extent of which one is single
    mixed = durable(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("h", "m"))
    wanted = durable(join_counted(kinds, mixed, ["h"], "m").select("h", *KEY, "pos", (F.col("n") == 1).cast("int").alias("single"), (F.col("m") > crowd).alias("crowded")))
    sizes = {r.crowded: r["count"] for r in wanted.groupBy("crowded").count().collect()}
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sizes.get(False, 0) // PART_ENTRIES + 1)
    texts = map_arrow(own, _compressed(True), "k1 long, k2 long, z binary")

    def with_text(rows: DataFrame) -> DataFrame:
        listed = rows.groupBy(*KEY).agg(F.collect_list(F.struct("h", "pos", "single")).alias("wanted"))
        return listed.join(texts, KEY).dropDuplicates(KEY).select(*KEY, "z", "wanted")

    runs = map_arrow(with_text(wanted.where("not crowded")), _cut_runs(parts, window), "part int, run long, seq int, block binary")
    dealt = runs.repartition(parts, "part").sortWithinPartitions("part", "run", "seq")
    covered = covered.unionByName(map_arrow(dealt, _merge_parts(window, gram), "k1 long, k2 long, first long, last long"))
    if sizes.get(True):
        windows = map_arrow(with_text(wanted.where("crowded")), _window_digests(window), "w1 long, w2 long, k1 long, k2 long, first long, single int")
        again = windows.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
        covered = covered.unionByName(windows.where("single = 1").join(again, ["w1", "w2"]).select(*KEY, "first", (F.col("first") + window).alias("last")))
    return covered


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed, kept): each text without its repeated passages.

    Texts are UTF-8 bytes, null counts as empty; matches never cross texts.
    `removed` are maximal byte runs, `kept` the remaining bytes. Repeated rows
    repeat each other, so all but short ones vanish; null and shared ids tell
    nothing about texts; an empty table gives an empty result; further columns
    are ignored. `window` is less than 256 bytes longer than `gram`.
    """
    covered = repeated_ranges(docs.select("text"), window, gram, crowd)
    # sets are combined before the exchange, so that a text of very many rows adds little
    listed = covered.groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    packed = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _compressed(False), "doc_id long, k1 long, k2 long, z binary")
    joined = packed.join(listed, KEY, "left").select("doc_id", "z", "ranges")
    return map_arrow(joined, _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<first: long, last: long>>, kept binary")
