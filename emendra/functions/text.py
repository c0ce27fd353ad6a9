"""Text preparation: paragraphs, marks and tokens, as Column expressions and as plain functions of the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "¶"
#: The 29 characters that Python's str.isspace and \\s take for white space, as a character class.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed patterns: a token keeps the white space that follows it; a paragraph ends at newlines with blanks between them.
TOKEN = rf"((?:[^(){SPACE}]+|[().?!-])[{SPACE}]*)"
KEY = rf"[^(){SPACE}]+|[().?!-]"
PARAGRAPH_END = r"(?:\n *)+"

_TOKEN = re.compile(TOKEN)
_KEY = re.compile(KEY)
_PARAGRAPH_END = re.compile(PARAGRAPH_END)


def strip(text: Column) -> Column:
    """Without white space, in Python's sense, at both ends."""
    return F.regexp_replace(text, F.lit(rf"^[{SPACE}]+|[{SPACE}]+$"), F.lit(""))


def paragraphs(text: Column) -> Column:
    """Stripped paragraphs that aren't blank."""
    return F.filter(F.transform(F.split(text, PARAGRAPH_END, -1), strip), lambda x: x != "")


def mark_paragraphs(text: Column) -> Column:
    """The text on one line, its paragraphs joined by a mark."""
    return F.array_join(paragraphs(text), f" {MARK} ")


def tokenize(text: Column) -> Column:
    """Tokens, each with the white space after it."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def keys(text: Column) -> Column:
    """What the tokens of a text are matched by, in one pass: tokens without the white space after them."""
    return F.regexp_extract_all(text, F.lit(KEY), F.lit(0))


def normalize(tokens: Column) -> Column:
    """What tokens are matched by."""
    return F.transform(tokens, strip)


def join_tokens(tokens: Column, start: Column, end: Column) -> Column:
    """Text of the tokens from `start` (0-based) up to `end`."""
    return F.array_join(F.slice(tokens, start + 1, end - start), "")


def unmark(text: Column) -> Column:
    return F.replace(text, F.lit(f"{MARK} "), F.lit("\n\n"))


def split_at_mark(text: Column) -> Column:
    return F.split(text, f"{MARK} ", -1)


def plain_paragraphs(text: str) -> list[str]:
    return [p for p in (part.strip() for part in _PARAGRAPH_END.split(text)) if p]


def plain_mark_paragraphs(text: str) -> str:
    return f" {MARK} ".join(plain_paragraphs(text))


def plain_tokenize(text: str) -> list[str]:
    return _TOKEN.findall(text)


def plain_keys(text: str) -> list[str]:
    return _KEY.findall(text)


def plain_mark_sentences(text: str, splitter: Callable[[str], list]) -> str:
    """Sentences joined by a mark. A splitter may give texts, or tuples that begin with one."""
    found = [s[0] if isinstance(s, tuple) else s for s in splitter(text)]
    return f" {MARK} ".join(s.strip() for s in found)
