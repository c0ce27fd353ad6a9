"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark questions and answers are normalised to words. A window is ten
consecutive words of an item, or a shorter item as a whole. Windows overlap, so
as patterns they would take ten times the benchmark: instead every window names
the rarest of its grams of five words, and these grams are the patterns of one
automaton, which scans each normalised document once. Around a gram that is
found, the document's words are compared with the item's, so that exactly the
windows count; hits are mapped back to offsets in the original text.

The items reach the executors in broadcast blocks of at most `block_chars`
characters. The driver reads one block at a time and keeps none. Documents are
scanned once for each block; a benchmark of up to 4 M characters is one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emendra.llm.common import by_batch, durable, filter_rows, kept

#: A-Z become a-z; every other ASCII character that is no letter or digit becomes a blank.
_NORMAL = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Words of a pattern, and characters of the benchmark in one automaton.
GRAM, BLOCK_CHARS = 5, 1 << 22

HITS = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start: int, end: int>>"


def normal_words(text: str | None) -> list[bytes]:
    """Words of a text, in UTF-8: A-Z lower-cased, cut at every ASCII character that is no letter or digit."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def _line(words: list[bytes]) -> str:
    return b" ".join(words).decode("utf-8", "surrogatepass")


class Windows:
    """The automaton of a block of items (line of normalised words, ids), and what tells windows from grams."""

    def __init__(self, items: list[tuple[str, tuple[str, ...]]], size: int):
        import ahocorasick

        seen: dict[str, str] = {}
        self.items = [([seen.setdefault(w, w) for w in line.split(" ")], ids) for line, ids in items]
        self.size = size
        counts: Counter[str] = Counter()
        for words, _ in self.items:
            n = min(GRAM, size, len(words))
            counts.update(" ".join(words[k : k + n]) for k in range(len(words) - n + 1))
        places: dict[str, list[tuple[int, int]]] = {}
        for at, (words, _) in enumerate(self.items):
            m = min(size, len(words))
            n = min(GRAM, m)
            grams = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]
            order = [(counts[g], k) for k, g in enumerate(grams)]
            # a window that an item repeats is looked for at its first place
            firsts = {" ".join(words[first : first + m]): first for first in range(len(words) - m, -1, -1)}
            for k in {min(order[first : first + m - n + 1])[1] for first in firsts.values()}:
                places.setdefault(grams[k], []).append((at, k))
        self.automaton = ahocorasick.Automaton()
        for gram, found in places.items():
            self.automaton.add_word(f" {gram} ", (gram.count(" ") + 1, found))
        if places:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[int], set[str]]:
        """Number of words, indexes of the words hit, and ids of the items with windows in the text."""
        raw = normal_words(text)
        if not raw or not len(self.automaton):
            return len(raw), [], set()
        line = f" {_line(raw)} "
        hit: set[int] = set()
        items: set[str] = set()
        seen_to = seen_words = 0
        words: list[str] = []
        for end, (n, places) in self.automaton.iter(line):
            # words before the gram's last one, counted on from the last gram found
            seen_words += line.count(" ", seen_to, end)
            seen_to = end
            words = words or line[1:-1].split(" ")
            first = seen_words - n
            for at, k in places:
                own, ids = self.items[at]
                m = min(self.size, len(own))
                left = right = 0
                while left < min(m - n, k, first) and own[k - left - 1] == words[first - left - 1]:
                    left += 1
                while right < min(m - n, len(own) - k - n, len(words) - seen_words) and own[k + n + right] == words[seen_words + right]:
                    right += 1
                if left + n + right >= m:
                    hit.update(range(first - left, seen_words + right))
                    items.update(ids)
        return len(raw), sorted(hit), items


def _windows(block: Broadcast, size: int) -> Windows:
    """The worker's automaton of a block, built once."""
    name, items = block.value
    return kept(("windows", name, size), lambda: Windows(items, size))


def runs(places: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of runs of neighbouring words (index, start, end)."""
    spans: list[tuple[int, int]] = []
    last = -2
    for k, start, end in places:
        spans[-1:] = [(spans[-1][0], end)] if k == last + 1 else [*spans[-1:], (start, end)]
        last = k
    return spans


def word_places(text: str | None, hit: list[int]) -> list[tuple[int, int, int]]:
    """(index, start, end) of some words of a text, in code points of the original."""
    if not hit:
        return []
    wanted = set(hit)
    return [(k, *m.span()) for k, m in enumerate(_WORD.finditer(text)) if k in wanted]


def _pieces(words: list[bytes], size: int, most: int) -> Iterator[list[bytes]]:
    """An item's words in pieces of at most some `most` characters (but a window at least) that hold every window once or more."""
    first = 0
    while True:
        last, chars = first, 0
        while last < len(words) and (chars < most or last - first < 2 * size):
            chars += len(words[last]) + 1
            last += 1
        yield words[first:last]
        if last >= len(words):
            return
        first = last - size + 1


def benchmark_blocks(benchmark: DataFrame, size: int, block_chars: int) -> list[Broadcast]:
    """Broadcast blocks of bounded size: (digest, [(line of normalised words, item ids), ...]).

    Items are normalised, and equal ones united, on the executors; the driver
    holds one block at a time. A longer item comes in overlapping pieces.
    """
    import hashlib

    def work(rows: dict) -> dict:
        made = [(_line(piece), None if i is None else str(i)) for i, t in zip(rows["item_id"], rows["text"]) if (words := normal_words(t)) for piece in _pieces(words, size, block_chars)]
        return {"line": [w for w, _ in made], "item": [i for _, i in made]}

    rows = by_batch(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), work, "line string, item string")
    grouped = rows.groupBy("line").agg(F.sort_array(F.collect_set("item")).alias("items"))
    sc = benchmark.sparkSession.sparkContext
    blocks: list[Broadcast] = []
    held: list[tuple[str, tuple]] = []
    chars = 0

    def close() -> None:
        held.sort()
        blocks.append(sc.broadcast((hashlib.sha256(repr(held).encode("utf-8", "surrogatepass")).hexdigest(), held.copy())))
        held.clear()

    for row in grouped.toLocalIterator():
        if held and chars + len(row.line) > block_chars:
            close()
            chars = 0
        held.append((row.line, tuple(row["items"])))
        chars += len(row.line)
    if held or not blocks:
        close()
    return blocks


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, spans): what each document shares with the benchmark.

    A document word inside any occurrence of a window is hit. `spans` are code
    point ranges of runs of hit words in the original text; `item_ids` are
    sorted as strings. Null and empty texts have no words, items without words
    no window; an item without id hits, but names nothing; an empty benchmark
    hits nothing. Repeated rows give repeated results, whatever the number of
    blocks; an empty table gives an empty result. Further columns are ignored.
    """
    blocks = benchmark_blocks(benchmark, window, block_chars)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans_of = lambda places: [{"start": a, "end": b} for a, b in runs(places)]

    def at_once(rows: dict) -> dict:
        own = _windows(blocks[0], window)
        found = [own.scan(t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "n_words": [x[0] for x in found], "n_hit": [len(x[1]) for x in found], "item_ids": [sorted(x[2]) for x in found], "spans": [spans_of(word_places(t, x[1])) for t, x in zip(rows["text"], found)]}

    if len(blocks) == 1:
        return by_batch(rows, at_once, HITS)

    def counted(rows: dict) -> dict:
        return {"doc_id": rows["doc_id"], "key": [row_key(i, t) for i, t in zip(rows["doc_id"], rows["text"])], "n_words": [len(normal_words(t)) for t in rows["text"]]}

    def scanned(block: Broadcast):
        def work(rows: dict) -> dict:
            own = _windows(block, window)
            found = [(i, t, x) for i, t in zip(rows["doc_id"], rows["text"]) if (x := own.scan(t))[1]]
            return {"key": [row_key(i, t) for i, t, _ in found], "places": [[{"k": k, "start": a, "end": b} for k, a, b in word_places(t, x[1])] for _, t, x in found], "items": [sorted(x[2]) for _, _, x in found]}

        return work

    def united(rows: dict) -> dict:
        places = [[(p["k"], p["start"], p["end"]) for p in own] for own in rows["places"]]
        return {"key": rows["key"], "n_hit": list(map(len, places)), "item_ids": rows["items"], "spans": list(map(spans_of, places))}

    # rows of the same id and text have one key; they share what is found, and each stays a row of its own
    hits = None
    for number, block in enumerate(blocks):
        own = by_batch(rows, scanned(block), "key string, places array<struct<k: int, start: int, end: int>>, items array<string>")
        own = own.groupBy("key").agg(F.first("places").alias("places"), F.first("items").alias("items"))
        hits = own if hits is None else hits.unionByName(own)
    whole = hits.groupBy("key").agg(*[F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("places", "items")])
    found = by_batch(whole, united, "key string, n_hit long, item_ids array<string>, spans array<struct<start: int, end: int>>")
    none = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c)
    return by_batch(rows, counted, "doc_id long, key string, n_words long").join(found, "key", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), none("item_ids"), none("spans"))


def row_key(doc_id: int | None, text: str | None) -> str:
    import hashlib

    return hashlib.sha256(f"{doc_id} {text or ''}".encode("utf-8", "surrogatepass")).hexdigest()


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of `docs`, with all their columns, whose text holds no window of the benchmark."""
    for number, block in enumerate(benchmark_blocks(benchmark, window, block_chars)):
        # written between blocks, so that a task holds one automaton at a time
        docs = filter_rows(durable(docs) if number else docs, "text", lambda texts, block=block: [not _windows(block, window).scan(t)[1] for t in texts])
    return docs


def contamination_digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) with windows of ten words."""
    hits = contamination(docs, benchmark)
    return hits.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
