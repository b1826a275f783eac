"""Order-dependent column work on keys of any size.

``Window.partitionBy(stream)`` puts a whole stream on one task, and one camera may own a third of a
table.  A :class:`Lane` splits every key into consecutive *chunks* of its own order (an hour of
packets, a block of part numbers).  Each function below runs the window inside a chunk, reduces every
chunk to one summary row, runs a prefix over those few summary rows, and joins the carry back on
``(key, chunk)``.  The wide rows are shuffled once, by ``(key, chunk)``; what crosses the chunk
boundary is one row per chunk.

The chunk expression must never decrease along the lane's order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "__chunk"


@dataclass(frozen=True)
class Lane:
    """Rows of ``keys`` in the order of ``order``, split where ``chunk`` changes.

    ``keys`` and ``order`` are column names without nulls; ``order`` has to be unique within a key for
    deterministic results.  ``descending`` walks the lane from its end.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunk: Column
    descending: bool = False

    def reversed(self) -> "Lane":
        return replace(self, descending=not self.descending)

    def by(self, *keys: str) -> "Lane":
        return replace(self, keys=tuple(keys))

    def ordering(self) -> list[Column]:
        return [F.col(c).desc() if self.descending else F.col(c).asc() for c in self.order]

    def within(self) -> Window:
        return Window.partitionBy(*self.keys, CHUNK).orderBy(*self.ordering())

    def across(self) -> Window:
        step = F.col(CHUNK).desc() if self.descending else F.col(CHUNK).asc()
        return Window.partitionBy(*self.keys).orderBy(step)


def lane(keys: str | Sequence[str], order: str | Sequence[str], chunk: Column) -> Lane:
    as_tuple = lambda v: (v,) if isinstance(v, str) else tuple(v)
    return Lane(as_tuple(keys), as_tuple(order), chunk)


def time_chunk(column: str, seconds: int = 86_400) -> Column:
    """Chunk number of a timestamp column: one chunk per ``seconds``."""
    return F.floor(F.unix_seconds(F.col(column).cast("timestamp")) / F.lit(seconds))


def block(column: str, size: int) -> Column:
    """Chunk number of an integer column: one chunk per ``size`` values."""
    return F.floor(F.col(column) / F.lit(size))


_WITHIN = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
_EMPTY = {"sum": 0, "count": 0}


def running(df: DataFrame, on: Lane, inclusive: bool = True, **aggregates: tuple[str, Column]) -> DataFrame:
    """Add running ``sum``/``count``/``max``/``min`` columns along the lane.

    ``aggregates`` maps a new column name to ``(kind, column)``.  With ``inclusive=False`` the
    current row is left out; an empty prefix is 0 for sums and counts, null for extremes.
    """
    base = df.withColumn(CHUNK, on.chunk)
    frame = on.within().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    earlier = on.across().rowsBetween(Window.unboundedPreceding, -1)

    totals = base.groupBy(*on.keys, CHUNK).agg(
        *[_WITHIN[kind](column).alias(f"__t_{name}") for name, (kind, column) in aggregates.items()]
    )
    merge = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    carry = totals.select(
        *on.keys,
        CHUNK,
        *[
            merge[kind](F.col(f"__t_{name}")).over(earlier).alias(f"__c_{name}")
            for name, (kind, _) in aggregates.items()
        ],
    )
    local = base.withColumns(
        {f"__l_{name}": _WITHIN[kind](column).over(frame) for name, (kind, column) in aggregates.items()}
    )
    joined = _join_carry(local, carry, on)

    def combined(name: str, kind: str) -> Column:
        here, before = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if kind in _EMPTY:
            return F.coalesce(here, F.lit(_EMPTY[kind])) + F.coalesce(before, F.lit(_EMPTY[kind]))
        return (F.greatest if kind == "max" else F.least)(here, before)

    return joined.select(
        *df.columns, *[combined(name, kind).alias(name) for name, (kind, _) in aggregates.items()]
    )


def previous(
    df: DataFrame, on: Lane, where: Column | None = None, inclusive: bool = False, **values: Column
) -> DataFrame:
    """Add, per row, ``values`` as they stood on the last earlier row (for which ``where`` holds).

    With ``inclusive=True`` the current row itself may be the one that answers.
    """
    base = df.withColumn(CHUNK, on.chunk)
    packed = F.struct(*[column.alias(name) for name, column in values.items()])
    position = F.struct(*[F.col(c) for c in on.order])
    if where is not None:
        packed, position = F.when(where, packed), F.when(where, position)
    frame = on.within().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    earlier = on.across().rowsBetween(Window.unboundedPreceding, -1)

    # The chunk's last answering row: max_by skips null positions and combines on the map side.
    pick = F.min_by if on.descending else F.max_by
    last = base.groupBy(*on.keys, CHUNK).agg(pick(packed, position).alias("__lane_value"))
    carry = last.select(*on.keys, CHUNK, F.last("__lane_value", ignorenulls=True).over(earlier).alias("__lane_before"))

    local = base.withColumn("__lane_here", F.last(packed, ignorenulls=True).over(frame))
    joined = _join_carry(local, carry, on)
    answer = F.coalesce(F.col("__lane_here"), F.col("__lane_before"))
    return joined.withColumn("__lane_answer", answer).select(
        *df.columns, *[F.col("__lane_answer").getField(name).alias(name) for name in values]
    )


def following(
    df: DataFrame, on: Lane, where: Column | None = None, inclusive: bool = False, **values: Column
) -> DataFrame:
    """:func:`previous` looking the other way: the first later row that answers."""
    return previous(df, on.reversed(), where, inclusive, **values)


def around(df: DataFrame, on: Lane, where: Column, **values: Column) -> DataFrame:
    """Add ``before_*`` and ``after_*``: ``values`` on the nearest earlier and later rows for which ``where`` holds.

    Both directions share one shuffle, one sort and one summary per chunk.
    """
    base = df.withColumn(CHUNK, on.chunk)
    packed = F.when(where, F.struct(*[column.alias(name) for name, column in values.items()]))
    position = F.when(where, F.struct(*[F.col(c) for c in on.order]))
    ends = base.groupBy(*on.keys, CHUNK).agg(
        F.min_by(packed, position).alias("__lane_first"), F.max_by(packed, position).alias("__lane_last")
    )
    whole = Window.unboundedPreceding, Window.unboundedFollowing
    carry = ends.select(
        *on.keys, CHUNK,
        F.last("__lane_last", ignorenulls=True).over(on.across().rowsBetween(whole[0], -1)).alias("__lane_before"),
        F.first("__lane_first", ignorenulls=True).over(on.across().rowsBetween(1, whole[1])).alias("__lane_after"),
    )
    local = base.withColumns(
        {
            "__lane_l": F.last(packed, ignorenulls=True).over(on.within().rowsBetween(whole[0], -1)),
            "__lane_r": F.first(packed, ignorenulls=True).over(on.within().rowsBetween(1, whole[1])),
        }
    )
    joined = _join_carry(local, carry, on).withColumns(
        {
            "__lane_before": F.coalesce("__lane_l", "__lane_before"),
            "__lane_after": F.coalesce("__lane_r", "__lane_after"),
        }
    )
    pick = lambda side, name: F.col(f"__lane_{side}").getField(name).alias(f"{side}_{name}")
    return joined.select(*df.columns, *[pick("before", n) for n in values], *[pick("after", n) for n in values])


def preceding(df: DataFrame, on: Lane, rows: int, name: str, value: Column) -> DataFrame:
    """Add the list of ``value`` over the ``rows`` rows before (fewer at a key's beginning), oldest first; nulls are left out.

    One pass: a chunk's own rows come from a window inside it, those of chunks before it from the last ``rows`` of each.
    """
    base = df.withColumn(CHUNK, on.chunk).withColumn("__value", F.struct(value.alias("v")))
    backward = Window.partitionBy(*on.keys, CHUNK).orderBy(*on.reversed().ordering())
    ends = base.withColumn("__back", F.row_number().over(backward)).where(F.col("__back") <= rows)
    ends = ends.groupBy(*on.keys, CHUNK).agg(F.sort_array(F.collect_list(F.struct((-F.col("__back")).alias("b"), F.col("__value").alias("v")))).alias("__end"))
    gathered = F.flatten(F.collect_list("__end").over(on.across().rowsBetween(-rows, -1)))
    carry = ends.select(*on.keys, CHUNK, F.transform(gathered, lambda e: e["v"]).alias("__earlier"))
    local = base.withColumn("__here", F.collect_list("__value").over(on.within().rowsBetween(-rows, -1)))
    held = F.size("__earlier")
    taken = F.least(F.lit(rows) - F.size("__here"), held)
    both = F.concat(F.slice("__earlier", held - taken + 1, taken), F.col("__here"))
    told = F.filter(F.transform(both, lambda e: e["v"]), lambda v: v.isNotNull())
    return _join_carry(local, carry, on).select(*df.columns, told.alias(name))


def numbered(df: DataFrame, on: Lane, name: str = "row_no", start: int = 1) -> DataFrame:
    """Add the row's position in its key, counted from ``start``."""
    numbered_rows = running(df, on, **{name: ("count", F.lit(1))})
    if start == 1:
        return numbered_rows
    return numbered_rows.withColumn(name, F.col(name) + F.lit(start - 1))


def sessions(df: DataFrame, on: Lane, starts: Column, name: str = "session") -> DataFrame:
    """Number the runs of a lane that begin wherever ``starts`` is true (the first row is run 1)."""
    flagged = running(df, on, **{name: ("sum", F.when(starts, 1).otherwise(0).cast("long"))})
    return flagged


def trailing(
    df: DataFrame, on: Lane, rows: int, value: Column, name: str, block_rows: int = 4_096
) -> DataFrame:
    """Add the list of ``value`` over the last ``rows`` rows (this one included), oldest first.

    Rows are numbered first, then windows run over blocks of ``block_rows`` consecutive rows, each
    block also holding copies of the ``rows - 1`` rows before it, so no block depends on the key's size.
    """
    counted = numbered(df, on, "__n").withColumn("__value", value)
    reach = rows - 1
    if reach > block_rows:
        raise ValueError("a block must be at least as long as the look-back")
    home = F.floor((F.col("__n") - 1) / F.lit(block_rows))
    spill = F.floor((F.col("__n") - 1 + F.lit(reach)) / F.lit(block_rows))
    copies = counted.withColumn("__home", home).withColumn(
        "__block", F.explode(F.array_distinct(F.array(F.col("__home"), spill)))
    )
    frame = Window.partitionBy(*on.keys, "__block").orderBy("__n").rowsBetween(-reach, 0)
    return (
        copies.withColumn(name, F.collect_list("__value").over(frame))
        .where(F.col("__block") == F.col("__home"))
        .select(*df.columns, name)
    )


def _join_carry(local: DataFrame, carry: DataFrame, on: Lane) -> DataFrame:
    """Plain equality keeps the partitioning and order the window left: the wide rows do not move again."""
    return local.join(carry, [*on.keys, CHUNK], "left")
