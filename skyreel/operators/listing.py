"""Orders, positions and fair picks over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


PLACE_BITS = 33
"""Of the ids that ``monotonically_increasing_id`` gives; the bits above them are the partition's number."""


def positioned(df: DataFrame, order: Sequence[str], name: str = "position", start: int = 1) -> DataFrame:
    """Global row numbers in ``order`` (unique) without a single-task window.

    Rows are range-partitioned and sorted once and kept. The id Spark gives the kept rows holds their partition and their
    place in it, so partition sizes are all that is added up: one shuffle of the rows.
    """
    kept = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("__i", F.monotonically_increasing_id())
    part, place = F.shiftright("__i", PLACE_BITS), F.col("__i").bitwiseAND((1 << PLACE_BITS) - 1)
    sizes = kept.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(
        "__p",
        F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"),
    )
    # one row a partition
    return kept.withColumn("__p", part).join(F.broadcast(before), "__p").select(*df.columns, (place + F.col("__o") + F.lit(start)).alias(name))


def by_name(df: DataFrame, name: str = "name", ignore_case: bool = False) -> DataFrame:
    """Ordinal order, or case-insensitive with the ordinal one deciding ties."""
    return df.orderBy(F.upper(name), name) if ignore_case else df.orderBy(name)


def turn(key: Column, seed: str) -> Column:
    """Where a key stands in the shuffled order of ``seed``; the same seed always gives the same order."""
    return F.md5(F.concat_ws("|", F.lit(seed), key))


def fair_pick(candidates: DataFrame, slots: int, seed: str, key: str = "name") -> DataFrame:
    """``slots`` candidates in an order that differs per ``seed``."""
    return candidates.orderBy(turn(F.col(key), seed), key).limit(slots)


def newest_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int, keep: str | None = None
) -> DataFrame:
    """The first ``rows`` rows per key in ``order``; map tasks keep only that many before the shuffle.

    ``keep`` names a column to hold each row's place.
    """
    place = keep or "__place"
    spot = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = df.withColumn(place, spot).where(F.col(place) <= rows)
    return kept if keep else kept.drop(place)
