"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from emendra.session import attach


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the one that the session names in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own, as in tests.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("No shared folder for checkpoints.\n\nCause: spark.checkpoint.dir is unset on a cluster.\n\nTo fix: name a folder that the driver and all executors share.")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="emendra-checkpoint-"))
    return sc.getCheckpointDir()


#: Spark's setting by which a query that is done deletes its shuffle files.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, tidy: bool = False) -> DataFrame:
    """`df` written to the shared folder and cut off from its lineage.

    `tidy` deletes the shuffle files of that run at once; else they stay until the driver collects garbage.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if not tidy:
        return df.checkpoint(eager=True)
    before = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true")
    try:
        # the setting counts for plans made now
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(TIDY, before)


_KEPT: dict = {}


def kept(key: tuple, build: Callable):
    """What a Python worker keeps between tasks: one automaton, model or encoder. Asking for another lets the last one go."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


def map_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """`run` over the Arrow batches of each partition."""
    attach(df.sparkSession)
    return df.mapInArrow(run, schema)


def by_batch(df: DataFrame, work: Callable[[dict[str, list]], dict[str, list]], schema: str, slice_rows: int = 256) -> DataFrame:
    """`work` over lists of column values, in slices that bound a Python worker's memory."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                found = work({n: part.column(k).to_pylist() for k, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], type=f.type) for f in out_schema], schema=out_schema)

    return map_arrow(df, run, schema)


def filter_rows(df: DataFrame, column: str, keep: Callable[[list], list[bool]], slice_rows: int = 256) -> DataFrame:
    """Rows of `df` for whose `column` values `keep` says so; all columns pass through as they are."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.names.index(column)
            for first in range(0, batch.num_rows, slice_rows):
                part = batch.slice(first, slice_rows)
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))

    return map_arrow(df, run, df.schema)


def join_counted(big: DataFrame, small: DataFrame, keys: list[str], count: str, hot: int = 2000) -> DataFrame:
    """Inner join with `small`, which has each key once and in `count` how often it occurs in `big`.

    Keys of more than 1/`hot` of the rows, of which there are fewer than `hot`,
    are broadcast, so that none meets in one task. `big` is read twice.
    """
    from pyspark.sql import functions as F

    total = small.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    often = small.where(F.col(count) * hot > total)
    rest = big.join(F.broadcast(often.select(keys)), keys, "left_anti").join(small.where(F.col(count) * hot <= total), keys)
    return big.join(F.broadcast(often), keys).unionByName(rest)


def own_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns to add, none of which `df` has."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(f"{mark}{w}" in taken for w in wanted):
        mark += "_"
    return [mark + w for w in wanted]


def one_row_per(df: DataFrame, *keys: str) -> DataFrame:
    """One of the rows that agree in all `keys`; `df` should be dealt by these already."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    (number,) = own_names(df, "place")
    place = Window.partitionBy(*keys).orderBy(*keys)
    return df.withColumn(number, F.row_number().over(place)).where(F.col(number) == 1).drop(number)
