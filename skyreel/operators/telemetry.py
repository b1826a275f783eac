"""Sensor telemetry: bulk ST 0601 decoding and synthesis, accounting, alignment, quality checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import klv
from ..functions.constants import CLASSIFICATIONS, ST0601_KEY, SYNTHETIC_DESIGNATION
from ..schemas import TELEMETRY
from . import asof
from .ordered import Lane, previous

SENSOR_FIELDS = [
    "latitude", "longitude", "altitude_m", "true_bearing", "relative_elevation", "horizontal_fov", "vertical_fov",
]

# --- decoding -----------------------------------------------------------------------------------


def decode_telemetry(packets: DataFrame, data: str = "data") -> DataFrame:
    """``packets`` with one wide set of telemetry columns each, undecodable ones marked in ``status``."""
    kept = [f.name for f in packets.schema.fields if f.name != data]
    schema = StructType([*(packets.schema[n] for n in kept), *TELEMETRY.fields])
    own = to_arrow_schema(TELEMETRY)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = klv.decode_telemetry_batch([p or b"" for p in batch.column(data).to_pylist()])
            made = []
            for field in own:
                values = found[field.name]
                if pa.types.is_map(field.type):
                    values = [None if v is None else list(v.items()) for v in values]
                made.append(pa.array(values, field.type, from_pandas=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *made], [*kept, *own.names])

    return packets.mapInArrow(decode, schema)


def klv_accounting(decoded: DataFrame, received: str, key: str = "stream") -> DataFrame:
    """Kept and rejected packets per stream; packets of other standards are kept raw."""
    rejected = F.col("status").isin("malformed", "bad_checksum")
    return decoded.groupBy(key).agg(
        F.count_if(~rejected).alias("packets"),
        F.count_if(rejected).alias("rejected"),
        F.max(F.when(~rejected, F.col(received))).alias("last_seen"),
    )


def checksum_audit(decoded: DataFrame, key: str = "stream") -> DataFrame:
    """How many of each stream's ST 0601 packets fail their sum, and which share."""
    ours = decoded.where("status <> 'not_0601'")
    failed = F.count_if(F.col("status") == "bad_checksum")
    return ours.groupBy(key).agg(
        F.count(F.lit(1)).alias("packets"), failed.alias("failed"), (failed / F.count(F.lit(1))).alias("failed_share")
    )


def provenance(designation: Column) -> Column:
    """Whether a set's position was configured by us rather than reported."""
    return F.coalesce(designation == SYNTHETIC_DESIGNATION, F.lit(False))


# --- synthesis ----------------------------------------------------------------------------------


def sensor_in_range() -> Column:
    """Sensors an encoder accepts; the others must be refused, never clamped."""
    inside = lambda c, lo, hi: F.col(c).between(lo, hi) & ~F.isnan(c)
    known = F.coalesce(F.length("classification"), F.lit(0)) == 0
    return (
        inside("latitude", -90, 90) & inside("longitude", -180, 180) & inside("altitude_m", -900, 19000)
        & inside("true_bearing", 0, 360) & inside("relative_elevation", -180, 180)
        & inside("horizontal_fov", 0, 180) & inside("vertical_fov", 0, 180)
        & (known | F.upper("classification").isin(CLASSIFICATIONS))
    )


def encode_telemetry(sensors: DataFrame, timestamp_us: str, into: str = "data") -> DataFrame:
    """A fixed sensor's ST 0601 packet per row, for rows :func:`sensor_in_range` accepts."""
    consumed = {*SENSOR_FIELDS, "classification"}
    kept = [f for f in sensors.schema.fields if f.name not in consumed]
    schema = StructType([*kept]).add(into, "binary")
    names = [f.name for f in kept]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[names].copy()
            marks = batch["classification"].fillna("").str.upper()
            packets = pd.Series(index=batch.index, dtype=object)
            for mark, rows in batch.groupby(marks):
                packets.loc[rows.index] = _packets(rows, mark, timestamp_us)
            yield out.assign(**{into: packets})

    return sensors.where(sensor_in_range()).mapInPandas(encode, schema)


def _packets(rows: pd.DataFrame, mark: str, timestamp_us: str) -> list[bytes]:
    """Packets of rows that share a layout, assembled as one byte matrix."""
    count = len(rows)
    constant = lambda raw: np.tile(np.frombuffer(raw, np.uint8), (count, 1))
    number = lambda tag, column: np.hstack(
        [constant(bytes([tag, int(klv.SCALES[tag][1][2])])), klv.quantised(tag, rows[column].to_numpy(float))]
    )
    stamp = rows[timestamp_us].to_numpy(np.int64).astype(">i8").view(np.uint8).reshape(count, 8)
    security = b""
    if mark:
        code = bytes([CLASSIFICATIONS.index(mark) + 1])
        security = klv.item(48, klv.item(1, code) + klv.item(22, b"\x00\x0c"))
    body = np.hstack(
        [
            constant(b"\x02\x08"), stamp,
            number(5, "true_bearing"),
            constant(klv.item(10, SYNTHETIC_DESIGNATION.encode())),
            number(13, "latitude"), number(14, "longitude"), number(15, "altitude_m"),
            number(16, "horizontal_fov"), number(17, "vertical_fov"),
            constant(klv.item(18, bytes(4))),
            number(19, "relative_elevation"),
            constant(security), constant(klv.item(65, b"\x10")), constant(b"\x01\x02"),
        ]
    )
    whole = np.hstack([constant(ST0601_KEY + klv.length_bytes(body.shape[1] + 2)), body])
    sums = whole[:, 0::2].sum(axis=1, dtype=np.int64) * 256 + whole[:, 1::2].sum(axis=1, dtype=np.int64)
    tail = (sums & 0xFFFF).astype(">u2").view(np.uint8).reshape(count, 2)
    return [row.tobytes() for row in np.hstack([whole, tail])]


def synthesise_telemetry(sensors: DataFrame, from_us: int, to_us: int, step_us: int = 1_000_000) -> DataFrame:
    """One packet per tick for every enabled source with a sensor and no telemetry of its own.

    ``sensors(name, enabled, own_klv, <sensor fields>, classification)``.  Time unrolls in two steps, blocks
    of ticks first, so a long span spreads over tasks instead of becoming one huge array.
    """
    wanted = sensors.where("enabled and not own_klv").drop("enabled", "own_klv")
    per_block = 4_096
    span = step_us * per_block
    blocks = wanted.withColumn("__from", F.explode(F.sequence(F.lit(from_us), F.lit(to_us), F.lit(span)))).repartition("name", "__from")
    last = F.least(F.col("__from") + (span - step_us), F.lit(to_us))
    ticks = blocks.withColumn("timestamp_us", F.explode(F.sequence(F.col("__from"), last, F.lit(step_us).cast("long"))))
    return encode_telemetry(ticks.drop("__from"), "timestamp_us")


# --- alignment ----------------------------------------------------------------------------------


def nearest_klv(frames: DataFrame, samples: DataFrame, key: str, pts: str, order: str, chunk_ticks: int) -> DataFrame:
    """Every frame with the telemetry sample closest to it in time; samples without a pts are no candidates."""
    return asof.nearest(frames, samples, key, pts, pts, order, chunk_ticks, into="klv")


def platform_state_at_detection(
    detections: DataFrame, telemetry: DataFrame, key: str, at_us: str, order: str, tolerance_us: int, chunk_us: int
) -> DataFrame:
    """Detections with the telemetry of their microsecond, else the last one before within the tolerance."""
    return asof.backward(detections, telemetry, key, at_us, at_us, order, chunk_us, tolerance_us, into="platform")


# --- quality ------------------------------------------------------------------------------------


def path_continuity(sets: DataFrame, on: Lane, max_step: float = 0.001, fov_ratio: float = 16 / 9, fov_slack: float = 0.02) -> DataFrame:
    """Which rules of a plausible flight each set keeps."""
    before = previous(sets, on, __lat=F.col("sensor_latitude"), __lon=F.col("sensor_longitude"))
    step = lambda now, then: F.coalesce(F.abs(F.col(now) - F.col(then)) <= max_step, F.lit(True))
    ratio = F.col("sensor_horizontal_fov") / F.when(F.col("sensor_vertical_fov") != 0, F.col("sensor_vertical_fov"))
    return before.withColumns(
        {
            "step_ok": step("sensor_latitude", "__lat") & step("sensor_longitude", "__lon"),
            "attitude_ok": F.col("platform_heading").between(0, 360)
            & F.col("platform_pitch").between(-20, 20)
            & F.col("platform_roll").between(-50, 50),
            "elevation_ok": F.col("sensor_relative_elevation").between(-90, 0),
            "fov_ok": F.coalesce(F.abs(ratio - fov_ratio) <= fov_slack, F.lit(False)),
        }
    ).drop("__lat", "__lon")


def clock_agreement(sets: DataFrame, key: str, pts: str, timestamp_us: str, seconds_per_tick: float, slack: float = 0.05) -> DataFrame:
    """Whether the carriage's clock and the telemetry's own span the same time."""
    carriage = (F.max(pts) - F.min(pts)) * F.lit(seconds_per_tick)
    telemetry = (F.max(timestamp_us) - F.min(timestamp_us)) / 1e6
    return sets.groupBy(key).agg(
        carriage.alias("pts_seconds"), telemetry.alias("tag_seconds"), (F.abs(carriage - telemetry) <= slack).alias("agree")
    )
