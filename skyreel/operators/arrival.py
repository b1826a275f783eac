"""Order of arrival: what came late, what came without a time, and what that means downstream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Lane, running


def arrival_flags(packets: DataFrame, on: Lane, pts: str = "pts") -> DataFrame:
    """Marks packets without a time, and those behind the newest time already seen (a tracker restarts there)."""
    seen = running(packets, on, inclusive=False, __top=("max", F.col(pts)))
    return seen.withColumns(
        {"missing": F.col(pts).isNull(), "regressed": F.coalesce(F.col(pts) < F.col("__top"), F.lit(False))}
    ).drop("__top")


def late_rows(rows: DataFrame, on: Lane, at_us: str, allowed_us: int) -> DataFrame:
    """Rows further behind the newest time seen than a watermark of ``allowed_us`` lets through: the side table."""
    seen = running(rows, on, inclusive=False, __top=("max", F.col(at_us)))
    return seen.where(F.col("__top") - F.col(at_us) > allowed_us).drop("__top")


def lateness(packets: DataFrame, key: str) -> DataFrame:
    """Per stream: packets without a time, and regressions."""
    return packets.groupBy(key).agg(
        F.count_if("missing").alias("missing"), F.count_if("regressed").alias("regressed"), F.count(F.lit(1)).alias("packets")
    )
