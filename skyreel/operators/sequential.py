"""State machines over ordered rows, one pass, constant memory.

Some rules are sequential by nature (a tracker, a lease).  Their rows are hashed by key and *epoch* -
an epoch starts where the machine's state provably no longer matters, so one busy key spreads over
many tasks - sorted inside each partition by Spark's spilling sort, and streamed through a Python
machine in Arrow batches.  Nothing is gathered per group: a machine sees a batch's rows at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


class Machine(Protocol):
    """Takes the rows of one run in order, as tuples of the frame's columns; returns output tuples."""

    def feed(self, rows: list[tuple]) -> list[tuple]: ...

    def finish(self) -> list[tuple]: ...


def replay(
    df: DataFrame,
    run_keys: Sequence[str],
    order: Sequence[str],
    machine: Callable[[], Machine],
    schema: StructType | str,
    width: int | None = None,
) -> DataFrame:
    """Run a fresh ``machine`` over every run of ``run_keys``, rows in ``order``, on ``width`` tasks (``width_for`` counts written rows)."""
    keys = list(run_keys)
    out_type = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out_type)
    spots = [df.columns.index(k) for k in keys]
    run_of = itemgetter(*spots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, live = None, None
        for batch in batches:
            rows = zip(*[column.to_pylist() for column in batch.columns])
            out: list[tuple] = []
            for run_id, piece in groupby(rows, key=run_of):
                if live is None or run_id != current:
                    if live is not None:
                        out.extend(live.finish())
                    current, live = run_id, machine()
                out.extend(live.feed(list(piece)))
            yield from _batch(out, arrow)
        if live is not None:
            yield from _batch(live.finish(), arrow)

    # An explicit count: these rows are few but slow, so AQE must not fold them into one task by size.
    width = width or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By a hash of the keys: a shuffle by the keys themselves is left out after a join on them, and AQE may then read
    # that join's input by mapper, which deals a run's rows to several tasks.
    placed = df.repartition(width, F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
    return placed.mapInArrow(run, out_type)


ROWS_A_TASK = 250_000


def width_for(written: DataFrame) -> int:
    """Tasks for rows that have been written already (counting them is cheap): one for so many, and no fewer than a shuffle has."""
    return max(int(written.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-written.count() // ROWS_A_TASK))


def _batch(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        columns = [pa.array(values, type=field.type) for values, field in zip(zip(*rows), schema)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)
