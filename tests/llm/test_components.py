"""Components of links: right for any shape, and few tasks a round."""

import random

import numpy as np
import pytest

from shelfscope.llm import common


def graph(seed):
    """Hubs of hubs, long chains in shuffled order and random links, with repeats and negative names."""
    rng = random.Random(seed)
    name = rng.sample(range(-5000, 5000), 1200)
    pairs = [(0, i) for i in range(1, 150)] + [(200 + i, i % 3) for i in range(90)]
    pairs += [(i, i + 1) for i in range(300, 500)] + [(550, 550), (560, 561), (561, 560)]
    pairs += [(rng.randrange(600, 1200), rng.randrange(600, 1200)) for _ in range(450)]
    links = [(name[a], name[b]) for a, b in pairs] + [(name[560], name[561]), (None, name[3])]
    rng.shuffle(links)
    return links


def brute(links):
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    node, root = common.spanning(*np.array(real, np.int64).T)
    return {x: x for pair in real for x in pair} | dict(zip(node.tolist(), root.tolist()))


@pytest.mark.parametrize("seed, rows, hub, fold", [(1, 1_000_000, 256, 1 << 16), (2, 0, 3, 5), (3, 20, 3, 1 << 16)])
def test_any_shape(spark, monkeypatch, seed, rows, hub, fold):
    """Nodes to be moved are broadcast, or joined with links that are dealt by salt."""
    for key, value in (("BROADCAST_ROWS", rows), ("_HUB", hub), ("FOLD_LINKS", fold)):
        monkeypatch.setattr(common, key, value)
    links = graph(seed)
    got = common.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert dict(got) == brute(links) and len(got) == len(dict(got))


def test_tasks_of_a_round(spark):
    """Every task leaves files and lines in the event log, whatever its rows."""
    rng = random.Random(5)
    links = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(2500)]
    frame, sc = spark.createDataFrame(links, "a long, b long").repartition(8), spark.sparkContext
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc.setJobGroup("components", "components")
    try:
        got = dict(common.components(frame).collect())
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == brute(links)
    tracker = sc.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("components")]
    stages = {s: tracker.getStageInfo(s) for j in jobs for s in j.stageIds}
    tasks = sum(s.numCompletedTasks for s in stages.values() if s)
    assert 0 < tasks <= 200
