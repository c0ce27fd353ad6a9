"""The functions as SQL functions of a session, and as a table function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from emendra.operators import diff as D


def mark_sentences(splitter=None):
    """A UDF from a text to its sentences joined by a mark."""

    def run(texts: pd.Series) -> pd.Series:
        from emendra.functions.sentences import split_sentences
        from emendra.functions.text import plain_mark_sentences

        return texts.map(lambda t: None if t is None else plain_mark_sentences(t, splitter or split_sentences))

    return F.pandas_udf(run, "string")


class TextChanges:
    """Table function: the changes between two texts, one row each."""

    def eval(self, source: str, test: str):
        if source is None or test is None:
            return
        left, right, ops = D.whole_document(source, test)
        for tag, i1, i2, j1, j2 in ops:
            if tag != "equal":
                yield tag, "".join(left[i1:i2]) if i1 < i2 else None, "".join(right[j1:j2]) if j1 < j2 else None, i1, i2, j1, j2


def register(spark: SparkSession) -> None:
    """diff_ops(source, test), mark_sentences(text) and LATERAL text_changes(source, test)."""
    from emendra.session import attach

    attach(spark)
    spark.udf.register("diff_ops", D._udf(D.whole_document))
    spark.udf.register("mark_sentences", mark_sentences())
    spark.udtf.register("text_changes", F.udtf(TextChanges, returnType="operation string, source_text string, test_text string, source_start int, source_end int, test_start int, test_end int"))
