"""Secret scanning with one combined deterministic automaton.

All rules are compiled together by subset construction and minimisation into
transition arrays. The automaton reads a text backwards, so that one pass over
its bytes tells for all rules at once where their matches begin. From there
spans follow (leftmost, longest, not overlapping), for which only the bytes of
matches are looked at again.

Patterns are over ASCII: "letters in either case" are A-Z and a-z, not the long
s or the Kelvin sign, which some expression libraries fold to s and k.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emendra.llm.byte_dfa import Dfa, compile_dfa
from emendra.llm.common import by_batch, kept


@dataclass(frozen=True)
class Rule:
    """A kind of secret: `prefix`, then one or more of the class `value`; matches with fewer than `least` of these are dropped."""

    kind: str
    prefix: str
    value: str
    least: int = 1

    @property
    def pattern(self) -> str:
        return f"{self.prefix}{self.value}+"

    @property
    def begins(self) -> str:
        """Matches from wherever a match that is long enough begins; counts only where no prefix is rare enough, as counters multiply states."""
        return f"{self.prefix}{self.value}" if self.prefix else f"{self.value}{{{self.least}}}"


#: The fixed patterns of the three base kinds, in order.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 8),
    Rule("access", "AKIA", "[A-Z0-9]", 12),
    Rule("hex", "", "[0-9a-f]", 32),
)
#: Further kinds, by their publicly documented prefixes.
EXTRA = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY----", "-"),
)

SPANS = "doc_id long, spans array<struct<kind: string, start: int, end: int>>"


class Scanner:
    """The automata of a list of rules."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.all: Dfa = compile_dfa([r.begins for r in rules], anywhere=True, backwards=True)
        self.own = [compile_dfa([r.pattern], anywhere=False) for r in rules]
        self.prefix = [compile_dfa([r.prefix], anywhere=False) if r.prefix else None for r in rules]

    def beginnings(self, data: bytes) -> list[tuple[int, int]]:
        """(place, bits of the rules that begin there), last place first: the one pass over all bytes."""
        dfa = self.all
        state, table, final, rules = dfa.start, dfa.table, dfa.first_final, dfa.rules
        found = []
        at = len(data)
        for byte in reversed(data):
            at -= 1
            state = table[state + byte]
            if state >= final:
                found.append((at, rules[state]))
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes: leftmost, longest and not overlapping for each rule; too short matches are dropped."""
        found = []
        done = [0] * len(self.rules)
        for start, bits in reversed(self.beginnings(data)):
            for k, rule in enumerate(self.rules):
                if not bits >> k & 1 or start < done[k]:
                    continue
                done[k] = self.own[k].longest(data, start)
                prefix = self.prefix[k]
                value = prefix.longest(data, start) if prefix else start
                if done[k] - value >= rule.least:
                    found.append((k, start, done[k]))
        return found


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return kept(("secrets", rules), lambda: Scanner(rules))


def scan_text(text: str | None, rules: tuple[Rule, ...] = BASE + EXTRA) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by the order of the rules."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    found = scanner(rules).spans(data)
    if not found:
        return []
    if len(data) != len(text):
        cuts = sorted({x for _, a, b in found for x in (a, b)})
        place, seen, at = {}, 0, 0
        for cut in cuts:
            at += len(data[seen:cut].decode("utf-8", "surrogatepass"))
            place[cut], seen = at, cut
        found = [(k, place[a], place[b]) for k, a, b in found]
    return [(rules[k].kind, a, b) for k, a, b in sorted(found, key=lambda x: (x[1], x[0]))]


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
    """(doc_id, spans): the secrets in each whole text, in code points, end exclusive, by start and rule.

    Spans of different kinds may overlap. Null and empty texts have no spans;
    repeated rows give repeated results; an empty table gives an empty result;
    further columns are ignored.
    """

    def work(rows: dict) -> dict:
        return {"doc_id": rows["doc_id"], "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t, rules)] for t in rows["text"]]}

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, SPANS)


def secret_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    found = secret_spans(docs)
    base = [r.kind for r in BASE]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of, base), F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
