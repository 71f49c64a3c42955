import random

from tamarind.operators.graph import connected_components


def brute(edges):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    edges += [(100 + i, 101 + i) for i in range(20)] + [(200, 300 + i) for i in range(15)]
    edges = [(a, b) for a, b in edges if a != b] * 2
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df, "a", "b").collect()}
    assert got == brute(edges)


def test_components_of_nothing(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")
    assert connected_components(df, "a", "b").count() == 0
