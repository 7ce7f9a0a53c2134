"""Traversal of many starts against a plain breadth-first search."""

import random
from collections import deque

import pytest

from loquat.operators import topicgraph

NODES = "topic_key string, domains array<string>"


def plain(member: dict, start: str, max_hops: int, most: int | None = 50):
    if start not in member:
        return []
    hops, via = {start: 0}, {}
    queue = deque([start])
    while queue:
        t = queue.popleft()
        if hops[t] >= max(max_hops, 1):
            continue
        for other, domains in member.items():
            shared = member[t] & domains
            if not shared or other == start:
                continue
            if other not in hops:
                hops[other] = hops[t] + 1
                queue.append(other)
            if hops[other] == hops[t] + 1:
                via[other] = min(via.get(other, "~"), min(shared))
    return sorted((h, t, via[t]) for t, h in hops.items() if h)[:most]


@pytest.fixture(scope="module")
def member():
    rng = random.Random(3)
    chain = {f"c{i:02}": {f"d{i:02}", f"d{i + 1:02}"} for i in range(31)}
    hub = {f"h{i:03}": {"hub", f"own{i}"} for i in range(120)}
    mixed = {f"m{i:02}": {f"x{rng.randrange(25)}" for _ in range(rng.randrange(0, 3))} for i in range(40)}
    return chain | hub | mixed


def test_many_starts_are_plain_searches(spark, member):
    n = spark.createDataFrame([(t, sorted(d)) for t, d in member.items()], NODES)
    starts = ["c00", "C15", "h000", "m01", "m02", "nothing", None, "c00"]
    for hops, most in ((10, 50), (3, None), (0, 50)):
        got = topicgraph.traverse_all(n, spark.createDataFrame([(s,) for s in starts], "start string"), hops, most).collect()
        for s in {(s or "").lower() for s in starts}:
            assert sorted((r.hops, r.topic_key, r.domain) for r in got if r.start == s) == plain(member, s, hops, most), (s, hops)


def test_one_start_over_edges_has_a_plan_of_constant_size(spark, member):
    chain = spark.createDataFrame([(f"c{i:02}", f"c{i + 1:02}", f"d{i + 1:02}") for i in range(30)], "a string, b string, via string")
    sizes = []
    for hops in (2, 10):
        found = topicgraph.traverse(chain, "C00", hops)
        sizes.append(len(found._jdf.queryExecution().toString()))
        assert [(r.hops, r.topic_key, r.domain) for r in found.collect()] == [(i, f"c{i:02}", f"d{i:02}") for i in range(1, hops + 1)]
    assert sizes[1] < 1.5 * sizes[0]
    assert topicgraph.traverse(chain, "unknown", 3).count() == 0 and topicgraph.traverse(chain.limit(0), "c00", 3).count() == 0
    assert topicgraph.traverse(chain, "c10", 0).count() == 2  # direct neighbours are always found


def test_empty_graphs(spark):
    n = spark.createDataFrame([], NODES)
    assert topicgraph.traverse_all(n, spark.createDataFrame([("a",)], "start string")).columns == ["start", "topic_key", "domain", "hops"]
    assert topicgraph.traverse_all(n, spark.createDataFrame([("a",)], "start string")).count() == 0
