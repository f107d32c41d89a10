import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corvanta.llm.components import connected_components


def brute(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def test_chain_star_and_ignored(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    random.Random(1).shuffle(chain)
    star = [(100, x) for x in range(101, 130)]
    links = chain + star + [(500, 500), (None, 7), (7, None)] + star[:3]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == brute(chain + star)


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), max_size=30))
def test_random(spark, links):
    links = [(a, b) for a, b in links if a != b]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == brute(links)
