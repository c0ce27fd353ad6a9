"""Connected components of a graph of any size, by alternating large-star and small-star steps.

Follows Kiveris, Lattanzi, Mirrokni, Rastogi and Vassilvitskii, "Connected
Components in MapReduce and Beyond" (2014): links move towards the smallest
node seen until every component is a star. No component is ever held in one
task, and the number of links never grows. Only a graph of few links goes to
the driver, as each of those steps is several exchanges whatever they hold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emendra.llm.common import durable

#: Links that go to the driver at most (16 bytes each); their nodes are broadcast. More are linked by stars.
HELD = 1 << 17


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return moved.where("a != b").distinct()


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b), sorted, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while (low[u] != low[v]).any():
        x, y = low[u], low[v]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    return nodes, nodes[low]


def connected_components(edges: DataFrame, held: int | None = None) -> DataFrame:
    """(node, component) for every node of `edges` (a, b), whole numbers; component is the smallest node reachable.

    Repeated links and links to oneself change nothing; rows with a null end are ignored.
    Up to `held` links (HELD) are linked on the driver.
    """
    links = durable(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a != b").distinct(), tidy=True)
    if links.count() <= (HELD if held is None else held):
        import pyarrow as pa

        found = links.toArrow()
        nodes, component = least_reachable(found["a"].to_numpy(), found["b"].to_numpy())
        return F.broadcast(edges.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array(component, pa.int64())})))
    while True:
        links = durable(_small_star(_large_star(links)), tidy=True)
        # stars: nobody has two parents, or a parent and children
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        if ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child > 1 or child > 0 and parent > 0").isEmpty():
            break
    found = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
