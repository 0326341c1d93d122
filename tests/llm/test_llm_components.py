"""Classes of links: against union-find, and what a run asks of the driver."""

import random

import pytest

from urlsieve.llm import simhash


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if find(x) != x}


def graphs():
    dice = random.Random(7)
    path = list(range(-150, 150))
    dice.shuffle(path)
    return {
        "none": [],
        "loops": [(3, 3), (5, 5), (5, 4)],
        "path": list(zip(path, path[1:])),
        "hub": [(1000, i) for i in range(300)] + [(i, -5) for i in range(0, 300, 7)],
        "random": [(dice.randrange(-(1 << 62), 1 << 62) >> 52 << 40, dice.randrange(700)) for _ in range(500)] * 2,
        "pairs": [(2 * i + 1, 2 * i) for i in range(400)],
    }


@pytest.mark.parametrize("name", list(graphs()))
@pytest.mark.parametrize("most", [simhash.EDGES, 40])
def test_components(spark, name, most):
    """Blocks of any size give the classes; every node but the smallest of its class is listed once."""
    edges = graphs()[name]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = [(r["node"], r["root"]) for r in simhash.components(frame, most).collect()]
    assert len(got) == len(dict(got)) and dict(got) == brute(edges)


def test_components_ask_little_of_the_driver(spark):
    """Tasks and stages cost the driver memory: with many shuffle partitions a run must not start all of them at each step."""
    edges = spark.createDataFrame(graphs()["path"] + [(x + 500, y + 500) for x, y in graphs()["hub"]], "a long, b long")
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    sc = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("components", "")
        simhash.components(edges).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    seen = sc.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup("components") for s in seen.getJobInfo(j).stageIds}
    ran = [i.numCompletedTasks for i in map(seen.getStageInfo, stages) if i and i.numCompletedTasks]
    assert sum(ran) < 900 and len(ran) < 40, (sum(ran), len(ran))
