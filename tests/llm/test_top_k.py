"""Exact top-k against whole products."""

import math

import pytest

from skyreel.llm import top_k

SCHEMA = "vec_id long, embedding array<float>, score string"


def by_hand(vectors, queries, k):
    good = lambda e: e is not None and all(x is not None and math.isfinite(x) for x in e)
    whole = [(v, [math.floor(1024 * x) for x in e]) for v, e in vectors if v is not None and good(e)]
    out = []
    for q, e in whole:
        if q in queries:
            found = sorted(((-sum(a * b for a, b in zip(e, other)), v) for v, other in whole if v != q and len(other) == len(e)))[:k]
            out += [(q, rank, v, -s) for rank, (s, v) in enumerate(found, 1)]
    return sorted(out)


def search(spark, vectors, queries, k=10):
    table = spark.createDataFrame([(v, e, "x") for v, e in vectors], SCHEMA)
    return sorted(map(tuple, top_k.top_k(table, table.where(table.vec_id.isin(queries)), k).select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("width", [1, 7, 64])
def test_random_and_tied(spark, width, monkeypatch):
    monkeypatch.setattr(top_k, "SLICE", 90)
    monkeypatch.setattr(top_k, "QUERIES", 5)
    import struct

    import numpy as np

    rng = np.random.default_rng(width)
    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    vectors = [(k, [single(x) for x in rng.normal(size=width) * rng.choice([0.01, 1, 5])]) for k in range(300)]
    vectors += [(1000 + k, vectors[3][1]) for k in range(40)]
    assert search(spark, vectors, list(range(0, 300, 25)) + [1000]) == by_hand(vectors, set(range(0, 300, 25)) | {1000}, 10)


def test_edges(spark):
    vectors = [(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [0.5, -1.0]), (7, [1.0]), (8, []), (9, []), (None, [1.0, 1.0]), (10, [3e38, 1.0])]
    got = search(spark, vectors, [1, 2, 4, 7, 8])
    assert [(q, r, v) for q, r, v, _ in got] == [(1, 1, 10), (1, 2, 6), (8, 1, 9)]
    assert got[0][3] == (1 << 63) - 1 and got[1][3] == 1024 * 512 + 2048 * -1024
    assert search(spark, [], [1]) == []
    assert search(spark, [(1, [1.0])], [1]) == []
