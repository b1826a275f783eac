"""Exact top-k search by multi-resolution segment statistics.

Vectors are cut into segments; a segment keeps its mean and deviation. For segments of ``L`` components the part of the
inner product is at most ``L (mean mean' + deviation deviation')``, which is the distance bound of segment statistics,
written for products: ``|x - y|^2 = |x|^2 + |y|^2 - 2 x y``. Bounds are taken from coarse to fine segments; candidates whose
bound falls below the k-th best score found so far are dropped, and only survivors get their exact score.

Queries and candidates are packed in blocks. Blocks of queries meet slices of candidates, each slice keeps the best k of
each query, and the best of the slices are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared

SCALE = 1_024
LEVELS = (4, 8, 16)
"""Segments a vector is cut into, coarse to fine."""
QUERIES, BLOCK = 2_048, 512
"""Queries of a block (on average), and candidates whose bounds are taken at once."""
SLICE = 16_384
"""Candidates that a block of queries meets in one task, on average."""
SAFE = 1 << 53
LONG = (-(1 << 63), (1 << 63) - 1)


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v: array<double> of whole numbers) of the vectors that take part: no null or non-finite component."""
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    good = rows.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # written by hand: floor() returns a long, which large components overflow
    return good.select("vec_id", F.transform("e", lambda x: F.when(F.abs(x) * SCALE < float(SAFE), F.floor(F.when(F.abs(x) * SCALE < float(SAFE), x * SCALE)).cast("double")).otherwise(x * SCALE)).alias("v"))


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and deviations of each row's segments, each times the root of the segment's length, and the cuts."""
    width = x.shape[1]
    cuts = np.unique(np.linspace(0, width, min(segments, width) + 1).astype(int))
    length = np.diff(cuts)
    total = np.add.reduceat(x, cuts[:-1], axis=1)
    mean = total / length
    spread = np.sqrt(np.maximum(np.add.reduceat((x - np.repeat(mean, length, axis=1)) ** 2, cuts[:-1], axis=1), 0))
    return mean * np.sqrt(length), spread, cuts


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; Python integers where doubles would not hold them, cut off at the limits of a long."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if most < SAFE:
        return (q @ x.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in x]
    scores = [[sum(int(a) * b for a, b in zip(row, other)) for other in whole] for row in q]
    return np.array([[min(max(s, LONG[0]), LONG[1]) for s in row] for row in scores], np.int64).reshape(len(q), len(x))


class Best:
    """The best k candidates of each query of a block so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.bar = np.full(len(ids), -np.inf)
        self.levels = [segment_statistics(q, s)[:2] for s in LEVELS]

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        alive = np.ones((len(self.ids), len(ids)), bool)
        slack = 1e-9 * (np.linalg.norm(self.q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :] + 1)
        for (mean, spread), segments in zip(self.levels, LEVELS):
            others, deviations, _ = segment_statistics(x, segments)
            bound = mean @ others.T + spread @ deviations.T + slack
            alive &= bound >= self.bar[:, None]
            if not alive.any():
                return
        alive &= self.ids[:, None] != ids[None, :]
        columns = np.flatnonzero(alive.any(axis=0))
        scores = exact_scores(self.q, x[columns])
        for row in np.flatnonzero(alive.any(axis=1)):
            mine = np.flatnonzero(alive[row, columns] & (scores[row] >= self.bar[row]))
            if not len(mine):
                continue
            both = self.found[row] + list(zip((-scores[row, mine]).tolist() if scores[row, mine].min() > LONG[0] else [-int(s) for s in scores[row, mine]], ids[columns[mine]].tolist()))
            both.sort()
            self.found[row] = both[: self.k]
            if len(self.found[row]) == self.k:
                self.bar[row] = float(-self.found[row][-1][0])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row of ``queries`` the ``k`` rows of ``vectors`` with the highest
    integer inner products, ties to the smaller vec_id; all rows, if there are fewer.

    Both have vec_id and embedding; a row doesn't meet its own vec_id. Vectors of different lengths don't meet. Null
    ids and vectors, and vectors with null or non-finite components, take no part; an empty vector meets empty ones with
    score 0. A vec_id that repeats counts once for each row. Scores beyond a long are cut off at its limits.
    """
    spark = prepared(vectors.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    points = quantised(vectors).withColumn("width", F.size("v"))
    asking = quantised(queries).withColumn("width", F.size("v"))
    count = points.count()
    slices = max(1, -(-count // SLICE))
    blocks = max(1, -(-asking.count() // QUERIES))
    points = points.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int"))
    points = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asking = asking.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    asking = asking.select(F.col("vec_id").alias("q_id"), F.col("v").alias("q"), F.col("width").alias("q_width"), F.col("block").alias("q_block"), F.col("slice").alias("q_slice"))

    def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
        return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.zeros(0)]).reshape(rows, -1) if rows else np.zeros((0, 0))

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(asked) and len(held):
            best = Best(asked["q_id"].to_numpy(), matrix(asked["q"], len(asked)), k)
            ids, x = held["vec_id"].to_numpy(), matrix(held["v"], len(held))
            order = np.argsort(-np.linalg.norm(x, axis=1), kind="stable")  # large vectors raise the bar early
            for a in range(0, len(ids), BLOCK):
                best.meet(ids[order[a : a + BLOCK]], x[order[a : a + BLOCK]])
            for query, found in zip(best.ids.tolist(), best.found):
                for score, vec in found:
                    out["query_id"].append(query)
                    out["vec_id"].append(vec)
                    out["score"].append(-score)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    met = asking.groupBy("q_block", "q_slice", "q_width").cogroup(points.groupBy("block", "slice", "width")).applyInArrow(search, "query_id long, vec_id long, score long")
    turn = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
