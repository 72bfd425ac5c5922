import random

from gridtable.llm.graph import components


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(500, 500)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: find(x) for x in root if x in got}
    assert set(root) - set(got) <= {x for x in root if find(x) == x and sum(x in e and e[0] != e[1] for e in edges) == 0}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
