import random

import numpy as np
import pytest

from pricebridge.llm.components import connected_components, least_of


def brute(links):
    label = {x: x for ab in links for x in ab if ab[0] != ab[1]}
    while True:
        new = dict(label)
        for a, b in links:
            if a != b:
                new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def generated(seed=0, nodes=300, links=220):
    rng = random.Random(seed)
    names = [rng.getrandbits(64) - (1 << 63) for _ in range(nodes)]
    some = [(rng.choice(names), rng.choice(names)) for _ in range(links)]
    return some + some[:30] + [(names[0], names[0])]


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_generated_links(spark, few):
    links = generated()
    got = connected_components(spark.createDataFrame(links, "a long, b long"), few=few).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["label"] for r in got} == brute(links)


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([(3, 3)], "a long, b long")).collect() == []
    assert [len(x) for x in least_of(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def test_long_chains():
    rng = np.random.default_rng(1)
    names = rng.permutation(100_000)
    nodes, labels = least_of(names[:-1], names[1:])
    assert len(nodes) == 100_000 and not labels.any()


def test_few_links_take_few_tasks(spark):
    """Rounds on few links wrote hundreds of MB of event logs and small files where there are many partitions."""
    sc = spark.sparkContext
    links = [(i, i + 1) for i in range(200)]
    frame = spark.createDataFrame(links, "a long, b long")
    sc.setJobGroup("few-links", "")
    try:
        assert {r["label"] for r in connected_components(frame).collect()} == {0}
        assert len(sc.statusTracker().getJobIdsForGroup("few-links")) <= 8
    finally:
        sc.setJobGroup("", "")
