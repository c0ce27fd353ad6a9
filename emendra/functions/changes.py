"""Changes and statistics of compared pairs, as higher-order functions over their operations: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emendra.functions import text as T

OPERATIONS = ("delete", "insert", "replace")
STATS = (
    "total_changes", "deletions", "insertions", "replacements", "longest_change_length", "shortest_change_length",
    "average_change_length", "change_ratio", "chars_added", "chars_deleted", "chars_net_change", "levenshtein_distance",
)


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def changes(ops: str = "ops", source: str = "source_tokens", test: str = "test_tokens") -> Column:
    """array<struct<operation, source_text, test_text, source_position, test_position>>: operations that aren't equal.

    Positions count tokens. A deletion has no test side, an insertion no source side; paragraph marks are kept.
    """

    def change(op: Column) -> Column:
        has_source, has_test = op["tag"] != "insert", op["tag"] != "delete"
        return F.struct(
            op["tag"].alias("operation"),
            F.when(has_source, T.join_tokens(F.col(source), op["i1"], op["i2"])).alias("source_text"),
            F.when(has_test, T.join_tokens(F.col(test), op["j1"], op["j2"])).alias("test_text"),
            F.when(has_source, _span(op["i1"], op["i2"])).alias("source_position"),
            F.when(has_test, _span(op["j1"], op["j2"])).alias("test_position"),
        )

    return F.transform(F.filter(ops, lambda op: op["tag"] != "equal"), change)


def with_changes(diffed: DataFrame) -> DataFrame:
    return diffed.withColumn("changes", changes())


def of_operation(column: str, operation: str | None) -> Column:
    """Changes of one operation, or all for None."""
    if operation is None:
        return F.col(column)
    if operation not in OPERATIONS:
        raise ValueError(f"Invalid operation: {operation!r}\n\nCause: a change is one of {', '.join(OPERATIONS)}.\n\nTo fix: pass one of these, or None for all changes.")
    return F.filter(column, lambda c: c["operation"] == operation)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def stats(column: str = "changes", source: str = "source", test: str = "test", levenshtein: bool = False, threshold: int | None = None) -> Column:
    """A struct of the twelve statistics of a pair.

    The length of a change is that of its source side, or of its test side if
    it has none. The ratio is to the longer raw text and may exceed 1, as
    paragraph marks count above but not below. Raw equality gives zeros. The
    edit distance is quadratic and so only computed on demand, up to
    `threshold` if given (-1 above it).
    """
    own = F.col(column)
    count = lambda kind: F.size(F.filter(own, lambda c: c["operation"] == kind))
    lengths = F.transform(own, lambda c: F.length(F.when(F.coalesce(c["source_text"], F.lit("")) != "", c["source_text"]).otherwise(F.coalesce(c["test_text"], F.lit("")))))
    added = _total(F.transform(own, lambda c: F.coalesce(F.length(c["test_text"]), F.lit(0))))
    gone = _total(F.transform(own, lambda c: F.coalesce(F.length(c["source_text"]), F.lit(0))))
    longest = F.greatest(F.length(source), F.length(test))
    n = F.size(own)
    same = F.col(source) == F.col(test)
    distance = F.lit(None).cast("int") if not levenshtein else F.levenshtein(source, test) if threshold is None else F.levenshtein(source, test, threshold)
    values = {
        "total_changes": n,
        "deletions": count("delete"),
        "insertions": count("insert"),
        "replacements": count("replace"),
        "longest_change_length": F.coalesce(F.array_max(lengths), F.lit(0)),
        "shortest_change_length": F.coalesce(F.array_min(lengths), F.lit(0)),
        "average_change_length": F.when(n > 0, _total(lengths).cast("double") / n).otherwise(F.lit(0.0)),
        "change_ratio": F.when(longest > 0, _total(lengths).cast("double") / longest).otherwise(F.lit(0.0)),
        "chars_added": added,
        "chars_deleted": gone,
        "chars_net_change": added - gone,
    }
    shown = [F.when(same, F.lit(0).cast("double" if k in ("average_change_length", "change_ratio") else "int")).otherwise(v).alias(k) for k, v in values.items()]
    return F.when(own.isNotNull(), F.struct(*shown, distance.alias("levenshtein_distance")))


def unchanged(ops: str = "ops") -> Column:
    """Number of equal operations."""
    return F.size(F.filter(ops, lambda op: op["tag"] == "equal"))
