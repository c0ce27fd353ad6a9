"""Paged documents. The built-in extractor reads PDFs as `pdf_text` says; another can be given."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emendra.sources.pdf_text import extract_pages

PAGES = "array<struct<page_number: int, text: string>>"

def pages_of(texts: Column) -> Column:
    """Pages, numbered from 1, from an array of texts."""
    return F.transform(texts, lambda text, k: F.struct((k + 1).alias("page_number"), text.alias("text")))


def join_pages(pages: str = "pages", preserve_pages: bool = False) -> Column:
    """Text of all pages with empty lines between; with `preserve_pages`, pages that aren't blank begin with their number."""
    from emendra.functions.text import strip

    def shown(p: Column) -> Column:
        text = F.coalesce(p["text"], F.lit(""))
        if not preserve_pages:
            return text
        return F.when(strip(text) != "", F.concat(F.lit("[Page "), p["page_number"].cast("string"), F.lit("]\n"), text)).otherwise(text)

    return F.array_join(F.transform(pages, shown), "\n\n")


def read_pdfs(spark: SparkSession, path: str, preserve_pages: bool = False, extractor: Callable[[bytes], list[str]] = extract_pages) -> DataFrame:
    """(path, text, pages, page_count, status, error): one row per PDF file; a file that can't be read has an error."""
    from emendra.session import attach

    attach(spark)

    def run(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for content in contents:
            try:
                rows.append(([{"page_number": k, "text": t or ""} for k, t in enumerate(extractor(content), 1)], None))
            except Exception as e:
                rows.append((None, f"Unable to read the PDF.\n\nCause: {e}\n\nTo fix: check that the file is a valid PDF with text."))
        return pd.DataFrame(rows, columns=["pages", "error"])

    read = F.pandas_udf(run, f"struct<pages: {PAGES}, error: string>").asNondeterministic()
    found = spark.read.format("binaryFile").load(path).select("path", read("content").alias("d")).select("path", "d.*")
    return found.select("path", join_pages("pages", preserve_pages).alias("text"), "pages", F.when(F.col("pages").isNotNull(), F.size("pages")).alias("page_count"), F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "error")
