"""Comparisons over streams: stateless differences, versions of documents by keyed state, and windowed counts of changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emendra.functions import changes as C
from emendra.operators.diff import diff_pairs, whole_document

TRACKED = "doc string, version long, total_changes int, change_ratio double"


def stream_stats(pairs: DataFrame) -> DataFrame:
    """Statistics of each pair of a stream; no state is kept."""
    return C.with_changes(diff_pairs(pairs)).withColumn("stats", C.stats())


def _compared(before: str | None, now: str) -> tuple[int, float]:
    if before is None or before == now:
        return 0, 0.0
    left, right, ops = whole_document(before, now)
    sizes = [len("".join(left[i1:i2]) if tag != "insert" else "".join(right[j1:j2])) for tag, i1, i2, j1, j2 in ops if tag != "equal"]
    longest = max(len(before), len(now))
    return len(sizes), sum(sizes) / longest if longest else 0.0


def _track(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, text = state.get if state.exists else (-1, None)
    rows = []
    for row in pd.concat(list(parts)).dropna(subset=["version"]).sort_values("version").itertuples():
        if row.version <= last:
            continue
        changes, ratio = _compared(text, row.text or "")
        rows.append((key[0], row.version, changes, ratio))
        last, text = row.version, row.text or ""
    state.update((last, text))
    yield pd.DataFrame(rows, columns=["doc", "version", "total_changes", "change_ratio"])


def track_versions(versions: DataFrame) -> DataFrame:
    """(doc, version, total_changes, change_ratio) for a stream of (doc string, version long, text): each version against the one before.

    The state of a document is its last version and text. A version that is
    not newer than the last one seen is ignored, as is one without a number; a
    first version has 0 changes. Versions of a document that come in one
    micro-batch are put in order, so they must fit a task: bound the batch by
    the source's options (such as maxFilesPerTrigger).
    """
    from emendra.session import attach

    attach(versions.sparkSession)
    return versions.groupBy("doc").applyInPandasWithState(_track, TRACKED, "version long, text string", "append", GroupStateTimeout.NoTimeout)


def changes_by_window(stats: DataFrame, time: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, pairs, changes) of a stream of rows with `time` and `stats`, by tumbling windows; rows later than `late` are dropped."""
    return stats.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("pairs"), F.sum("stats.total_changes").alias("changes"))
