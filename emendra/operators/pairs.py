"""Pairing of document sets and versions, and summaries over compared pairs.

A set is a DataFrame (key, text). Joins are on the key, so Catalyst picks the
strategy; a null key never pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emendra.functions.changes import stats, with_changes
from emendra.operators.diff import diff_pairs


def pair_by_key(old: DataFrame, new: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, source, test) of the keys that both sets have."""
    return old.select(key, F.col(text).alias("source")).join(new.select(key, F.col(text).alias("test")), key)


def left_status(old: DataFrame, new: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, source, test, status) of all keys of `old`; without a partner the status is missing_in_dir2, else compared."""
    right = new.select(key, F.col(text).alias("test"), F.lit(True).alias("_there"))
    joined = old.select(key, F.col(text).alias("source")).join(right, key, "left")
    return joined.select(key, "source", "test", F.when(F.col("_there"), "compared").otherwise("missing_in_dir2").alias("status"))


def snapshot_status(old: DataFrame, new: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, source, test, status) of the keys of either set: deleted, new or modified."""
    left = old.select(key, F.col(text).alias("source"), F.lit(True).alias("_old"))
    right = new.select(key, F.col(text).alias("test"), F.lit(True).alias("_new"))
    status = F.when(F.col("_new").isNull(), "deleted").when(F.col("_old").isNull(), "new").otherwise("modified")
    return left.join(right, key, "full_outer").select(key, "source", "test", status.alias("status"))


def missing_keys(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    return old.select(key).join(new.select(key), key, "left_anti")


def paired_keys(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    return old.select(key).join(new.select(key), key, "left_semi")


def compare_many(source: DataFrame, tests: DataFrame) -> DataFrame:
    """One source text against many test texts. `source` must have one row (source); that is checked, and it is then a literal of the plan."""
    rows = source.select("source").take(2)
    if len(rows) != 1:
        raise ValueError(f"One source is needed.\n\nCause: the source has {'no' if not rows else 'several'} rows.\n\nTo fix: filter it to one row.")
    return tests.withColumn("source", F.lit(rows[0].source))


def with_previous(versions: DataFrame, document: str = "doc", version: str = "version", text: str = "text") -> DataFrame:
    """Each version with the text of the one before of the same document as source; the first one's source is null."""
    order = Window.partitionBy(document).orderBy(version)
    return versions.select(document, version, F.lag(text).over(order).alias("source"), F.col(text).alias("test"))


def version_stats(versions: DataFrame, document: str = "doc", version: str = "version", text: str = "text") -> DataFrame:
    """(doc, version, total_changes, change_ratio, cumulative_changes); a first version has 0 changes."""
    found = with_changes(diff_pairs(with_previous(versions, document, version, text))).withColumn("stats", stats())
    n = F.coalesce(F.col("stats.total_changes"), F.lit(0))
    so_far = Window.partitionBy(document).orderBy(version).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return found.select(document, version, n.alias("total_changes"), F.coalesce("stats.change_ratio", F.lit(0.0)).alias("change_ratio")).withColumn("cumulative_changes", F.sum("total_changes").over(so_far))


def _times(condition) -> F.Column:
    return F.count(F.when(condition, F.lit(1)))


def batch_summary(rows: DataFrame) -> DataFrame:
    """Totals over rows (status, changes): a missing row has null changes, which count as none."""
    return rows.agg(
        F.count(F.lit(1)).alias("total_files"),
        _times(F.col("status") == "compared").alias("compared"),
        _times(F.coalesce("changes", F.lit(0)) > 0).alias("with_changes"),
        _times(F.col("status") == "error").alias("errors"),
        _times(F.col("status") == "missing_in_dir2").alias("missing"),
    )


def report_summary(rows: DataFrame) -> DataFrame:
    """Sum of changes, files with changes and mean ratio over rows with `stats`."""
    return rows.agg(F.sum("stats.total_changes").alias("total_changes"), _times(F.col("stats.total_changes") > 0).alias("files_with_changes"), F.avg("stats.change_ratio").alias("mean_change_ratio"))


def ci_summary(rows: DataFrame) -> DataFrame:
    """Counters over rows (status, changes)."""
    return rows.agg(
        F.count(F.lit(1)).alias("total_files"),
        _times((F.col("status") != "modified") | (F.coalesce("changes", F.lit(0)) > 0)).alias("files_with_changes"),
        F.sum(F.coalesce("changes", F.lit(0))).alias("total_changes"),
    )


def by_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def by_operation(changed: DataFrame) -> DataFrame:
    """Number of changes of each kind over all pairs."""
    return changed.select(F.explode("changes.operation").alias("operation")).groupBy("operation").agg(F.count(F.lit(1)).alias("n"))


#: Heading of the table of edited files; rows are `ci_line`s.
CI_HEAD = "| Edits | Per mille | Out | In | Swapped | Where |\n| ---: | ---: | ---: | ---: | ---: | :--- |\n"


def ci_line(path: str = "path", stats_column: str = "stats") -> F.Column:
    """A pair's row in a markdown table of edited files: number of edits, touched characters in a thousand, edits by kind, and its path."""
    s = F.col(stats_column)
    cells = [s["total_changes"], F.floor(s["change_ratio"] * 1000), s["deletions"], s["insertions"], s["replacements"], F.replace(path, F.lit("|"), F.lit("\\|"))]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cells]), F.lit(" |"))


def ci_table(rows: DataFrame, path: str = "path") -> str:
    """A markdown table of the rows (path, stats) with changes, by path; the caller prints it, so it is for as many as a reader bears."""
    lines = rows.where("stats.total_changes > 0").select(path, ci_line(path).alias("line")).orderBy(path)
    return CI_HEAD + "".join(f"{r.line}\n" for r in lines.toLocalIterator())
