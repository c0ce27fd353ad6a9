"""Making the package importable in Python workers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it runs from a source folder.

    Executors that have the package installed, or get it as --py-files, don't need the folder.
    """
    held = spark.sparkContext.environment
    known = held.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        held["PYTHONPATH"] = os.pathsep.join(filter(None, [*known, ROOT]))
    return spark
