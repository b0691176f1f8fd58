import random

from vecspark.llm.components import connected_components


def test_random_graphs(spark):
    random.seed(5)
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(1000, k) for k in range(1001, 1100)]
    loose = [(random.randrange(2000, 2200), random.randrange(2000, 2200)) for _ in range(120)]
    edges = chain + star + loose + [(5, 5), (100, 101)] + [(-7, -3)]
    random.shuffle(edges)
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
