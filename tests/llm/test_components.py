"""Components against a union-find."""

import random

import pytest

from skyreel.llm.components import components


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(4)
    edges = {
        "random": [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(55)],
        "chain": [(k, k + 1) for k in rng.sample(range(40), 40)],
        "star": [(7, k) for k in range(30)] + [(k, 7) for k in range(100, 120)],
        "none": [],
    }[kind]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((x, top(x)) for x in list(root))
