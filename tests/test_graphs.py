"""Components of random graphs against brute force."""

import random

import pytest

from traceframe.operators import sweeps


def _mutual(edges):
    nodes = sorted({x for e in edges for x in e})
    reach = {n: {n} for n in nodes}
    while True:
        grown = {n: set().union(reach[n], *(reach[b] for a, b in edges if a in reach[n])) for n in nodes}
        if grown == reach:
            break
        reach = grown
    groups = {n: frozenset(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    return {(n, min(g)) for n, g in groups.items() if len(g) > 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(38)]
    got = {(r.node, r.component) for r in sweeps.strong_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == _mutual(edges) and got


def test_no_edges_and_too_many_nodes(spark):
    empty = spark.createDataFrame([], "src int, dst int")
    assert sweeps.strong_components(empty).count() == 0
    with pytest.raises(ValueError, match="too many"):
        sweeps.reachable(spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int"), nodes=2)
