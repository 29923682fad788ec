import random

from truthframe.operators.components import connected_components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)]
    edges += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + edges[:9], "src long, dst long")).collect()}
    assert got == brute(edges)


def test_components_of_nothing_and_nulls(spark):
    df = spark.createDataFrame([(None, 1), (2, None), (3, 3)], "src long, dst long")
    assert connected_components(df).count() == 0
