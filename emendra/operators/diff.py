"""Token-level differences of text pairs.

Cutting into tokens and matching run in one Arrow UDF, since sending tokens
from the JVM to Python costs more than making them there. Pairs of identical
texts never get that far: their tokens and their single equal operation are
made by native expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emendra.functions import text as T

OPS = "array<struct<tag: string, i1: int, i2: int, j1: int, j2: int>>"
DIFF = f"struct<source_tokens: array<string>, test_tokens: array<string>, ops: {OPS}>"

Prepare = Callable[[str], str]
#: A processor turns two texts into (source tokens, test tokens, operations).
Processor = Callable[[str, str], tuple[list[str], list[str], list[tuple[str, int, int, int, int]]]]


def match_keys(source: list[str], test: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Ratcliff/Obershelp operations, by the standard library's matcher with its defaults."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, source, test).get_opcodes()


def match_tokens(source: list[str], test: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Operations on stripped tokens."""
    return match_keys([t.strip() for t in source], [t.strip() for t in test])


def whole_document(source: str, test: str):
    """The default processor: paragraphs are marked, and the texts are compared as wholes."""
    a, b = (T.plain_tokenize(T.plain_mark_paragraphs(x)) for x in (source, test))
    return a, b, match_tokens(a, b)


def by_sentence(splitter: Callable[[str], list] | None = None) -> Processor:
    """A processor that marks sentences, found by `splitter` or the built-in one, instead of paragraphs."""

    def process(source: str, test: str):
        from emendra.functions.sentences import split_sentences

        find = splitter or split_sentences
        a, b = (T.plain_tokenize(T.plain_mark_sentences(x, find)) for x in (source, test))
        return a, b, match_tokens(a, b)

    return process


def _udf(processor: Processor):
    def run(source: pd.Series, test: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(source, test):
            if a is None or b is None:
                rows.append((None, None, None))
                continue
            left, right, ops = processor(a, b)
            rows.append((left, right, [dict(zip(("tag", "i1", "i2", "j1", "j2"), op)) for op in ops]))
        return pd.DataFrame(rows, columns=["source_tokens", "test_tokens", "ops"])

    # filters on its result would otherwise be pushed below it and run it twice
    return F.pandas_udf(run, DIFF).asNondeterministic()


TAGS = ("equal", "delete", "insert", "replace")


def _flat_ops(source: pd.Series, test: pd.Series) -> pd.Series:
    import numpy as np

    def flat(a: str | None, b: str | None):
        if a is None or b is None:
            return None
        left, right = (T.plain_keys(T.plain_mark_paragraphs(x)) for x in (a, b))
        return np.array([(TAGS.index(tag), *ends) for tag, *ends in match_keys(left, right)], np.int32).ravel()

    return pd.Series([flat(a, b) for a, b in zip(source, test)], dtype=object)


def pair_ops(pairs: DataFrame) -> DataFrame:
    """`pairs` (with source and test) and their ops alone: what `diff_pairs` finds, without sending tokens back."""
    from emendra.session import attach

    attach(pairs.sparkSession)
    flat = F.pandas_udf(_flat_ops, "array<int>").asNondeterministic()
    same = F.col("source") == F.col("test")
    n = F.size(T.keys(T.mark_paragraphs(F.when(same, F.col("source")))))
    own = F.when(n > 0, F.array(F.lit(0), F.lit(0), n, F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    found = pairs.withColumn("_o", flat(F.when(~same, F.col("source")), F.when(~same, F.col("test")))).withColumn("_o", F.when(same, own).otherwise(F.col("_o")))
    names = F.array(*map(F.lit, TAGS))
    at = lambda k, n: F.element_at("_o", k * 5 + n)
    op = lambda k: F.struct(F.element_at(names, at(k, 1) + 1).alias("tag"), *[at(k, n).alias(c) for n, c in ((2, "i1"), (3, "i2"), (4, "j1"), (5, "j2"))])
    places = F.when(F.size("_o") > 0, F.sequence(F.lit(0), (F.size("_o") / 5).cast("int") - 1)).when(F.col("_o").isNotNull(), F.array().cast("array<int>"))
    return found.select(*pairs.columns, F.transform(places, op).alias("ops"))


def diff_pairs(pairs: DataFrame, processor: Processor | None = None) -> DataFrame:
    """`pairs` (with source and test) and their source_tokens, test_tokens and ops; all three are null if a side is."""
    from emendra.session import attach

    attach(pairs.sparkSession)
    if processor is not None:
        found = pairs.withColumn("_d", _udf(processor)("source", "test"))
    else:
        same = F.col("source") == F.col("test")
        compared = F.when(same, F.lit(None).cast("string"))
        other = _udf(whole_document)(F.when(~same, F.col("source")).otherwise(compared), F.when(~same, F.col("test")))
        tokens = T.tokenize(T.mark_paragraphs(F.when(same, F.col("source"))))
        found = pairs.withColumn("_d", other).withColumn("_t", tokens)
        n = F.size("_t")
        equal = F.when(n > 0, F.array(F.struct(F.lit("equal").alias("tag"), F.lit(0).alias("i1"), n.alias("i2"), F.lit(0).alias("j1"), n.alias("j2")))).otherwise(F.array().cast(OPS))
        own = F.struct(F.col("_t").alias("source_tokens"), F.col("_t").alias("test_tokens"), equal.alias("ops"))
        found = found.withColumn("_d", F.when(same, own).otherwise(F.col("_d"))).drop("_t")
    return found.select(*pairs.columns, F.col("_d.source_tokens"), F.col("_d.test_tokens"), F.col("_d.ops"))


def diff_distinct(pairs: DataFrame, processor: Processor | None = None) -> DataFrame:
    """As `diff_pairs`, but each distinct (source, test) is compared once; for inputs with many repeated pairs."""
    keyed = pairs.withColumn("_k", F.sha2(F.concat(F.sha2("source", 256), F.sha2("test", 256)), 256))
    once = diff_pairs(keyed.where("_k is not null").dropDuplicates(["_k"]).select("_k", "source", "test"), processor).drop("source", "test")
    return keyed.join(once, "_k", "left").drop("_k")
