"""A small sentence splitter in the manner of Punkt (Kiss and Strunk, 2006), with a fixed list of abbreviations."""

from __future__ import annotations

import re

#: Lower-case abbreviations whose full stop does not end a sentence.
ABBREVIATIONS = frozenset(
    """a.m adj al apr art assn aug ave bd bldg blvd bros ca capt cf ch chap cir cmdr co col comm corp ct dec dept dist dr e.g ed eds
    esq est et etc ex feb fed fig figs fri gen gov hon hr hwy i.e inc jan jr jul jun lt ltd maj mar mon mr mrs ms mt nos nov oct op p
    p.m pp pres prof pt pub rd ref rep rev rt sat sec sen sept seq sgt sr st stat sun supp thu tue u.k u.s univ v vol vs wed""".split()
)
#: These may also stand at the end of a sentence, before a word that begins like one.
MAY_END = frozenset("a.m p.m etc u.s u.k co corp inc jr ltd sr".split())
STARTERS = frozenset("the a an it he she they we i you this that these those there his her its their our in on at but and so if when while as for".split())

_END = re.compile(r"""[.!?]+["'”’)\]]*(?=\s)|\n[ \t]*\n""")
_WORD_BEFORE = re.compile(r"[^\s\"'“‘(\[]+$")


def _ends(text: str, stop: re.Match, before: str) -> bool:
    """Whether a run of stops, and closing quotes, ends a sentence."""
    following = text[stop.end() :].lstrip()
    if not following:
        return True
    opener = following.lstrip("\"'“‘([")[:1]
    marks = stop[0].rstrip("\"'”’)]")
    if marks.endswith(("...", "..")) or opener.islower():
        return False
    if "!" in marks or "?" in marks:
        return True
    word = before.lower()
    if re.fullmatch(r"[a-z]", word) or re.fullmatch(r"(?:[a-z]\.)+[a-z]", word) or word in ABBREVIATIONS:
        may = word in MAY_END or "." in word
        nearest = re.match(r"[^\W\d_]+", following)
        return bool(may and nearest and nearest[0].lower() in STARTERS)
    return True


def split_sentences(text: str) -> list[str]:
    """Sentences of a text, stripped; blank ones are left out. An empty line ends a sentence whatever stands before it."""
    found, start = [], 0
    for stop in _END.finditer(text):
        word = _WORD_BEFORE.search(text, start, stop.start())
        if stop[0][0] == "\n" or _ends(text, stop, word[0] if word else ""):
            found.append(text[start : stop.end()])
            start = stop.end()
    found.append(text[start:])
    return [s.strip() for s in found if s.strip()]
