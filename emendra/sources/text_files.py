"""Text sources: whole files with strict decoding, folders of them, and inputs that are a path or the text itself."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decoded(content: Column) -> Column:
    """struct<text, status, error> of UTF-8 bytes. Invalid ones are an error and never replaced; newlines become \\n."""
    text = F.try_validate_utf8(content.cast("string"))
    ok = text.isNotNull()
    return F.struct(
        F.regexp_replace(text, "\r\n?", "\n").alias("text"),
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.when(~ok, F.lit("Unable to decode.\n\nCause: the file is not valid UTF-8.\n\nTo fix: convert it to UTF-8.")).alias("error"),
    )


def read_texts(spark: SparkSession, path: str | list[str], pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, text, status, error): one row per file; `pattern` is a glob on file names."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", decoded(F.col("content")).alias("d")).select("path", "d.*")


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.txt", recursive: bool = False) -> DataFrame:
    """(key, text, status, error): files of a folder by their path relative to it."""
    rows = read_texts(spark, folder, pattern, recursive)
    base = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    plain = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"^[a-z]+:/+", "")
    return rows.select(F.substring(plain, F.lit(len(base) + 2), F.lit(1 << 20)).alias("key"), "text", "status", "error")


def read_input(spark: SparkSession, value: str) -> str:
    """Text of a command-line input: the content of an existing file (a PDF by its suffix), else the value itself."""
    try:
        is_file = os.path.isfile(value)
    except (OSError, ValueError):
        is_file = False
    if not is_file:
        return value
    if value.lower().endswith(".pdf"):
        from emendra.sources.pdf import read_pdfs

        row = read_pdfs(spark, value).first()
    else:
        row = read_texts(spark, value).first()
    if row.status != "ok":
        raise ValueError(f"Unable to read {value}.\n\n{row.error}")
    return row.text


def write_texts(rows: DataFrame, column: str, path: str) -> None:
    """One line per row; for JSON or HTML columns without line breaks."""
    rows.select(F.col(column).cast("string")).write.text(path)
