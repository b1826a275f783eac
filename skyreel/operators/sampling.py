"""Rate-limited sampling: the first picture, then each one at least an interval after the last taken.

Every choice depends on the one before it, yet a block of rows can be solved without knowing what came
before: only the few rows within one interval of its start can be its first choice, and from each of
them the rest of the block follows.  So blocks are solved in parallel to a small table (first choice ->
last choice), the tables of a stream are chained in order, and the blocks are then walked once, in
parallel, from their known beginning.  Blocks are runs of row numbers, so a stream of any length is
spread evenly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import Lane, numbered
from .sequential import replay

BLOCK_ROWS = 65_536


def _next_choice(seconds: np.ndarray, last: float, start: int, interval: float) -> int:
    """First row from ``start`` on that is due after ``last`` was taken: an interval later, or rewound."""
    step = 64
    while start < len(seconds):
        piece = seconds[start : start + step]
        due = (piece >= last + interval) | (piece < last)
        if due.any():
            return start + int(due.argmax())
        start, step = start + step, step * 2
    return len(seconds)


def _walk(seconds: np.ndarray, first: int, interval: float) -> list[int]:
    taken = []
    at = first
    while at < len(seconds):
        taken.append(at)
        at = _next_choice(seconds, seconds[at], at + 1, interval)
    return taken


def _solve_block(seconds: np.ndarray, interval: float) -> tuple[np.ndarray, list[float]]:
    """The rows that can be first, and the last choice each of them leads to."""
    later = np.flatnonzero(seconds >= seconds[0] + interval)
    reach = int(later[0]) + 1 if len(later) else len(seconds)
    final: dict[int, float] = {}
    for first in range(reach - 1, -1, -1):
        path = []
        at = first
        while at < len(seconds) and at not in final:
            path.append(at)
            at = _next_choice(seconds, seconds[at], at + 1, interval)
        outcome = final[at] if at < len(seconds) else float(seconds[path[-1]])
        for row in path:
            final[row] = outcome
    return seconds[:reach], [final[i] for i in range(reach)]


def due_rows(
    frames: DataFrame, on: Lane, seconds: str, frames_per_second: float, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Frames a subscriber at ``frames_per_second`` receives; frames without a time always are.

    A rate of zero (keyframes) or infinity passes everything the decoder produced.
    """
    if frames_per_second <= 0 or frames_per_second == float("inf"):
        return frames
    interval = 1 / frames_per_second
    keys = list(on.keys)
    spot = [*keys, *on.order]
    timed = numbered(frames.where(F.col(seconds).isNotNull()).select(*spot, F.col(seconds).cast("double").alias("__s")), on, "__n")
    narrow = cut_lineage(timed.withColumn("__b", F.floor((F.col("__n") - 1) / F.lit(block_rows))))
    types = dict(frames.dtypes)
    key_fields = ", ".join(f"{k} {types[k]}" for k in keys)

    blocks = [*keys, "__b"]
    rows = narrow.select(*blocks, *on.order, "__n", "__s")
    tables = replay(
        rows, blocks, ["__n"], lambda: _Block(len(blocks), interval), f"{key_fields}, __b long, head array<double>, final array<double>"
    )
    begun = replay(tables, keys, ["__b"], lambda: _Chain(interval), f"{key_fields}, __b long, __last double")
    spot_fields = ", ".join(f"{c} {types[c]}" for c in spot)
    known = rows.join(begun, blocks).select(*rows.columns, "__last")
    taken = replay(known, blocks, ["__n"], lambda: _Walk(len(keys), interval), spot_fields)
    chosen = frames.join(taken, spot, "left_semi")
    return chosen.unionByName(frames.where(F.col(seconds).isNull()))


class _Block:
    """Collects a block's times and sums it up as a table; a block is never longer than ``block_rows``."""

    def __init__(self, width: int, interval: float):
        self.width, self.interval, self.times = width, interval, []

    def feed(self, rows: list[tuple]) -> list[tuple]:
        self.who = rows[0][: self.width]
        self.times.extend(row[-1] for row in rows)
        return []

    def finish(self) -> list[tuple]:
        head, final = _solve_block(np.array(self.times), self.interval)
        return [(*self.who, head.tolist(), final)]


class _Chain:
    """Passes the last choice from block to block; one small row per block."""

    def __init__(self, interval: float):
        self.interval, self.last = interval, None

    def feed(self, rows: list[tuple]) -> list[tuple]:
        out = []
        for *who, head, final in rows:
            out.append((*who, self.last))
            first = 0 if self.last is None else _next_choice(np.array(head), self.last, 0, self.interval)
            if first < len(head):
                self.last = final[first]
        return out

    def finish(self) -> list[tuple]:
        return []


class _Walk:
    """Takes the due rows of a block whose beginning is known."""

    def __init__(self, keys: int, interval: float):
        self.keys, self.interval, self.fresh = keys, interval, True

    def feed(self, rows: list[tuple]) -> list[tuple]:
        if self.fresh:
            self.last, self.fresh = rows[0][-1], False
        times = np.array([row[-2] for row in rows])
        first = 0 if self.last is None else _next_choice(times, self.last, 0, self.interval)
        taken = _walk(times, first, self.interval)
        if taken:
            self.last = float(times[taken[-1]])
        return [(*rows[i][: self.keys], *rows[i][self.keys + 1 : -3]) for i in taken]

    def finish(self) -> list[tuple]:
        return []
