"""Components of small and large graphs, and what they leave on disk."""

import random

import pytest

from emendra.llm import near_copies
from emendra.llm.common import TIDY, durable
from emendra.llm.components import connected_components


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_driver_and_stars_equal_brute_force(spark):
    rng = random.Random(4)
    name = [rng.randrange(-(2**63), 2**63) for _ in range(300)]
    links = [(name[k], name[k + 1]) for k in range(60)] + [(name[100 + rng.randrange(180)], name[100 + rng.randrange(180)]) for _ in range(120)]
    low = {}
    for a, b in links:
        if a != b:
            x, y = low.setdefault(a, a), low.setdefault(b, b)
            low = {k: min(x, y) if v in (x, y) else v for k, v in low.items()}
    edges = spark.createDataFrame([*links, *links[:9], (name[299], name[299]), (None, name[298]), (name[297], None)], "a long, b long")
    for held in (None, 0):
        assert {r.node: r.component for r in connected_components(edges, held).collect()} == low, held
        assert connected_components(edges.limit(0), held).count() == 0


def test_few_links_take_few_tasks(many_partitions):
    """A chain needs many rounds of stars, each of them several exchanges."""
    spark = many_partitions
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b")
    spark.sparkContext.setJobGroup("few links", "")
    assert {r.component for r in connected_components(edges).collect()} == {0}
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("few links") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(s.numTasks for s in stages if s) < 4 * 64


def test_near_copies_leave_few_shuffle_files(many_partitions):
    """The files of a step go when it is written, not when the driver collects garbage."""
    spark = many_partitions
    before, setting = shuffle_files(spark), spark.conf.get(TIDY)
    df = durable(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), tidy=True)
    assert shuffle_files(spark) <= before and df.count() == 7 and spark.conf.get(TIDY) == setting
    rng = random.Random(8)
    base = [f"w{k}" for k in range(100)]
    said = [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(40)] + [" ".join(f"z{rng.randrange(10**6)}" for _ in range(30)) for _ in range(40)]
    classes = near_copies.near_copy_classes(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"))
    assert len(shuffle_files(spark) - before) < 1000
    assert classes.select("component").distinct().count() == 41
