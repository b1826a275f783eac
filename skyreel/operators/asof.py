"""As-of alignment of two tables on a shared key and an integer position.

Both sides are laid on one lane and every left row reads the nearest right row before or after it,
so the work is a sort inside chunks; no pair of rows is ever enumerated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import around, lane, previous


def _one_lane(left, right, key, left_pos, right_pos, right_order, chunk_size):
    lefts = left.select(
        F.col(key).alias("__key"),
        F.col(left_pos).cast("long").alias("__pos"),
        F.lit(1).alias("__side"),
        F.lit(None).cast("long").alias("__tie"),
        F.struct(*left.columns).alias("__l"),
        F.lit(None).cast(right.select(F.struct(*right.columns).alias("r")).schema["r"].dataType).alias("__r"),
    )
    rights = right.where(F.col(right_pos).isNotNull()).select(
        F.col(key).alias("__key"),
        F.col(right_pos).cast("long").alias("__pos"),
        F.lit(0).alias("__side"),
        F.col(right_order).cast("long").alias("__tie"),
        F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("__l"),
        F.struct(*right.columns).alias("__r"),
    )
    both = lefts.unionByName(rights)
    on = lane("__key", ("__pos", "__side", "__tie"), F.floor(F.col("__pos") / F.lit(chunk_size)))
    return both, on


def backward(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_pos: str,
    right_pos: str,
    right_order: str,
    chunk_size: int,
    tolerance: int | None = None,
    into: str = "match",
) -> DataFrame:
    """Left rows with the last right row at or before them (null when none, or beyond ``tolerance``).

    Of several right rows at one position the one with the largest ``right_order`` answers.
    """
    both, on = _one_lane(left, right, key, left_pos, right_pos, right_order, chunk_size)
    found = previous(both, on, where=F.col("__side") == 0, __m=F.col("__r"), __mp=F.col("__pos"))
    match: Column = F.col("__m")
    if tolerance is not None:
        match = F.when(F.col("__pos") - F.col("__mp") <= tolerance, match)
    return found.where(F.col("__side") == 1).select("__l.*", match.alias(into))


def nearest(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_pos: str,
    right_pos: str,
    right_order: str,
    chunk_size: int,
    into: str = "match",
) -> DataFrame:
    """Left rows with the right row at the smallest distance.

    Ties go to the smallest ``right_order``: between the two sides and within one position.  To give
    the first of several rows at one position, right rows are first reduced to one per position.
    """
    first = right.where(F.col(right_pos).isNotNull()).groupBy(key, right_pos).agg(
        F.min_by(F.struct(*right.columns), F.col(right_order)).alias("__only")
    ).select("__only.*")
    both, on = _one_lane(left, first, key, left_pos, right_pos, right_order, chunk_size)
    found = around(both, on, F.col("__side") == 0, row=F.col("__r"), pos=F.col("__pos"), tie=F.col("__tie"))
    gap_before = F.col("__pos") - F.col("before_pos")
    gap_after = F.col("after_pos") - F.col("__pos")
    take_before = F.col("after_pos").isNull() | (
        F.col("before_pos").isNotNull()
        & ((gap_before < gap_after) | ((gap_before == gap_after) & (F.col("before_tie") <= F.col("after_tie"))))
    )
    return found.where(F.col("__side") == 1).select(
        "__l.*", F.when(take_before, F.col("before_row")).otherwise(F.col("after_row")).alias(into)
    )
