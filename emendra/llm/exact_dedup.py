"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary, merged level by level, names the few digests that may be
very frequent. Their winners are computed exactly, broadcast (at most
`counters` rows, a number that grows with the table up to 65,536) and resolve their copies where these are read; all other
digests go through an ordinary shuffle with map-side combining. So one text
that makes up a third of the corpus never meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from emendra.llm.common import by_batch, durable, map_arrow

SUMMARY = "text_sha256 string, n long"
#: Rows of one digest that may meet in a task, about, and counters of the summary, which follow from it.
ROWS, LEAST_COUNTERS, MOST_COUNTERS = 1_000_000, 256, 1 << 16


def misra_gries(counts: dict, key, n: int, counters: int) -> None:
    """Add `n` occurrences of `key` to a summary of at most `counters` counters."""
    if key in counts or len(counts) < counters:
        counts[key] = counts.get(key, 0) + n
        return
    cut = min(n, min(counts.values()))
    for k in [k for k, v in counts.items() if v == cut]:
        del counts[k]
    for k in counts:
        counts[k] -= cut
    if n > cut:
        misra_gries(counts, key, n - cut, counters)


def _summarise(counters: int, counted: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts: dict = {}
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, n in zip(keys, batch.column(1).to_pylist() if counted else [1] * len(keys)):
                misra_gries(counts, key, n, counters)
        yield pa.RecordBatch.from_pydict({"text_sha256": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    return run


def text_digest(text: str | None) -> str:
    """SHA-256 of a text with A-Z lower-cased; null counts as empty."""
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass").lower()).hexdigest()


def with_digest(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """`docs` with all its columns, and the digest of its text as column `name`."""
    schema = StructType([*docs.schema.fields, StructField(name, StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col))
            yield batch.append_column(name, pa.array([text_digest(t.as_py()) for t in texts], pa.string()))

    return map_arrow(docs, run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rid, text_sha256): SHA-256 of each text with A-Z lower-cased; a null text counts as empty.

    `rid` tells apart rows that share an id and a text.
    """

    def work(rows: dict) -> dict:
        return {"doc_id": rows["doc_id"], "text_sha256": [text_digest(t) for t in rows["text"]]}

    hashed = by_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, text_sha256 string")
    return hashed.withColumn("rid", F.monotonically_increasing_id())


def heavy_candidates(hashed: DataFrame, counters: int, fan_in: int = 32) -> list[str]:
    """At most `counters` digests; every digest of over 1/(counters+1) of the rows is among them. Summaries merge `fan_in` at a time."""
    level = map_arrow(hashed.select("text_sha256"), _summarise(counters, False), SUMMARY)
    parts = level.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // fan_in)
        level = map_arrow(level.repartition(parts), _summarise(counters, True), SUMMARY)
    return [r.text_sha256 for r in level.collect()]


def _decide(winner: Column, size: Column) -> list[Column]:
    kept = (F.col("doc_id").eqNullSafe(winner["doc_id"])) & (F.col("rid") == winner["rid"])
    return [F.col("doc_id"), winner["doc_id"].alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.col("text_sha256")]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the
    row with the largest id stays; of rows that also share the id, exactly one.
    Null texts count as empty, a null id loses against any other. An empty
    table gives an empty result; further columns are ignored.
    """
    hashed = durable(digests(docs, id_col, text_col))
    counters = counters or min(MOST_COUNTERS, max(LEAST_COUNTERS, hashed.count() // ROWS))
    best = [F.max(F.struct("doc_id", "rid")).alias("winner"), F.count(F.lit(1)).alias("size")]
    likely = heavy_candidates(hashed, counters)
    spark = docs.sparkSession
    names = spark.createDataFrame([(x,) for x in likely], "text_sha256 string")
    verified = hashed.join(F.broadcast(names), "text_sha256", "left_semi").groupBy("text_sha256").agg(*best)
    rows = verified.where("size > 1").select("text_sha256", "winner.doc_id", "winner.rid", "size").collect()
    winners = spark.createDataFrame([(r[0], (r[1], r[2]), r[3]) for r in rows], "text_sha256 string, winner struct<doc_id: long, rid: long>, size long")
    heavy = hashed.join(F.broadcast(winners), "text_sha256").select(_decide(F.col("winner"), F.col("size")))
    light = hashed.join(F.broadcast(winners), "text_sha256", "left_anti")
    chosen = light.groupBy("text_sha256").agg(*best)
    return heavy.unionByName(light.join(chosen, "text_sha256").select(_decide(F.col("winner"), F.col("size"))))
