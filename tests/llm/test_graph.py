import random

from corpusflow.llm.graph import components
from corpusflow.plans.staging import Staging


def test_components_against_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (2000, 2000)] + [(3000, 3001 + i) for i in range(50)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        top[hi] = lo
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), Staging(spark)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(x, find(x)) for x in top if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long"), Staging(spark)).count() == 0
