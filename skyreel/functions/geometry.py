"""Bearings, ranges, boxes and rates as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_320.0


def wrap(degrees: Column) -> Column:
    return ((degrees % 360.0) + 360.0) % 360.0


def sensor_bearing(heading: Column, azimuth: Column) -> Column:
    return wrap(heading + azimuth)


def north_in_image(bearing: Column, roll: Column) -> Column:
    return wrap(-(bearing + F.coalesce(roll, F.lit(0.0))))


def bearing_between(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing, degrees clockwise from north."""
    rad = lambda c: c * math.pi / 180.0
    a, b, turn = rad(lat1), rad(lat2), rad(lon2 - lon1)
    east = F.sin(turn) * F.cos(b)
    north = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(turn)
    return wrap(F.atan2(east, north) * 180.0 / math.pi)


def bearing_difference(a: Column, b: Column) -> Column:
    return wrap(a - b + 180.0) - 180.0


def look_bearing(lat: Column, lon: Column, to_lat: Column, to_lon: Column, heading: Column, azimuth: Column) -> Column:
    return F.coalesce(bearing_between(lat, lon, to_lat, to_lon), sensor_bearing(heading, azimuth))


def slant_range_residual(
    lat: Column, lon: Column, alt: Column, to_lat: Column, to_lon: Column, to_alt: Column, reported: Column
) -> Column:
    """Straight-line distance to the frame centre on a local plane, minus the reported range."""
    north = (to_lat - lat) * METRES_PER_DEGREE
    east = (to_lon - lon) * METRES_PER_DEGREE * F.cos(lat * math.pi / 180.0)
    drop = to_alt - alt
    return F.sqrt(north * north + east * east + drop * drop) - reported


# --- boxes --------------------------------------------------------------------------------------
# Pixel boxes are one-based and inclusive; canvas boxes are continuous edges on a square canvas.


def _clamp(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def place(width: Column, height: Column, strategy: str, size: int) -> Column:
    """Where the frame lands on the model canvas: ``struct(left, top, width, height)``."""
    if strategy == "stretch":
        values = [F.lit(0), F.lit(0), F.lit(size), F.lit(size)]
    else:
        gain = letterbox_gain(width, height, size)
        w, h = F.rint(width * gain), F.rint(height * gain)
        values = [F.rint((size - w) / 2.0 - 0.1), F.rint((size - h) / 2.0 - 0.1), w, h]
    return F.struct(*[v.cast("int").alias(n) for v, n in zip(values, ["left", "top", "width", "height"])])


def letterbox_gain(width: Column, height: Column, size: int) -> Column:
    return F.least(F.lit(float(size)) / height, F.lit(float(size)) / width)


def to_model(
    left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column, strategy: str, size: int
) -> Column:
    """A pixel box as canvas edges ``struct(x1, y1, x2, y2)``."""
    x1, y1, x2, y2 = (c.cast("double") for c in (left - 1, top - 1, right, bottom))
    if strategy == "stretch":
        edges = [x1 * size / width, y1 * size / height, x2 * size / width, y2 * size / height]
    else:
        gain, at = letterbox_gain(width, height, size), place(width, height, strategy, size)
        px, py = at.getField("left"), at.getField("top")
        edges = [x1 * gain + px, y1 * gain + py, x2 * gain + px, y2 * gain + py]
    return F.struct(*[e.alias(n) for e, n in zip(edges, ["x1", "y1", "x2", "y2"])])


def to_frame(
    x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, strategy: str, size: int
) -> Column:
    """Canvas edges as a pixel box ``struct(left, top, right, bottom)`` inside the frame."""
    if strategy == "stretch":
        fx1, fy1, fx2, fy2 = x1 / size * width, y1 / size * height, x2 / size * width, y2 / size * height
    else:
        gain, at = letterbox_gain(width, height, size), place(width, height, strategy, size)
        px, py = at.getField("left"), at.getField("top")
        fx1, fy1, fx2, fy2 = (x1 - px) / gain, (y1 - py) / gain, (x2 - px) / gain, (y2 - py) / gain
    # clamped as doubles: what a model returns may lie beyond an int, or be no number at all
    pixel = lambda edge, most, first: _clamp(F.rint(F.nanvl(edge, F.lit(0.0))) + first, F.lit(1.0), most.cast("double")).cast("int")
    left, top = pixel(fx1, width, 1.0), pixel(fy1, height, 1.0)
    right = F.greatest(left, pixel(fx2, width, 0.0))
    bottom = F.greatest(top, pixel(fy2, height, 0.0))
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def to_frame_normalised(
    cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column, strategy: str, size: int
) -> Column:
    return to_frame(
        (cx - w / 2) * size, (cy - h / 2) * size, (cx + w / 2) * size, (cy + h / 2) * size,
        width, height, strategy, size,
    )


def iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap of two pixel boxes ``[left, top, right, bottom]`` on continuous edges."""
    al, at, ar, ab = (c.cast("double") for c in (a[0], a[1], a[2] + 1, a[3] + 1))
    bl, bt, br, bb = (c.cast("double") for c in (b[0], b[1], b[2] + 1, b[3] + 1))
    w = F.greatest(F.lit(0.0), F.least(ar, br) - F.greatest(al, bl))
    h = F.greatest(F.lit(0.0), F.least(ab, bb) - F.greatest(at, bt))
    shared = w * h
    union = (ar - al) * (ab - at) + (br - bl) * (bb - bt) - shared
    return F.when(union <= 0, F.lit(0.0)).otherwise(shared / F.when(union > 0, union))


def logit_cutoff(probability: float) -> float:
    return math.log(probability / (1 - probability))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def confidence_pct(score: Column) -> Column:
    return F.rint(score * 100).cast("int")


def pixel_number(column: Column, row: Column, width: Column, height: Column) -> Column:
    outside = (column < 1) | (column > width) | (row < 1) | (row > height)
    message = F.concat(
        F.lit("pixel ("), column.cast("string"), F.lit(", "), row.cast("string"), F.lit(") is outside a "),
        width.cast("string"), F.lit("x"), height.cast("string"), F.lit(" frame"),
    )
    number = column.cast("long") + (row.cast("long") - 1) * width.cast("long")
    return F.when(outside, F.raise_error(message).cast("long")).otherwise(number)


def pixel_position(number: Column, width: Column) -> Column:
    return F.struct(
        ((number - 1) % width + 1).cast("int").alias("column"),
        (F.floor((number - 1) / width) + 1).cast("int").alias("row"),
    )


# --- rates --------------------------------------------------------------------------------------


def queue_depth(packets_per_second: Column, seconds: Column, ceiling: int) -> Column:
    wanted = F.ceil(F.greatest(seconds, F.lit(0.5)) * packets_per_second)
    return F.least(F.lit(ceiling), F.greatest(F.lit(4), F.least(wanted, F.lit(2**31 - 1)).cast("int")))


def effective_rate(declared: Column, observed: Column, synthetic: Column) -> Column:
    arriving = F.when(F.isnan(observed) | (observed == float("inf")), 0.0).otherwise(F.coalesce(observed, F.lit(0.0)))
    return F.greatest(declared, F.when(arriving > 0, arriving + synthetic).otherwise(0.0))


def misdeclared(declared: Column, observed: Column, synthetic: Column) -> Column:
    return effective_rate(declared, observed, synthetic) > declared * 1.25


def queue_room(packets_per_second: Column, queue_packets: int, queue_seconds: float) -> Column:
    return F.lit(float(queue_packets)) / packets_per_second - F.lit(float(queue_seconds))


def fitting_preroll(asked: Column, room: Column, reaches: Column) -> Column:
    """Seconds of pre-roll a viewer's queue can hold; ``reaches`` is how far back ``min(asked, room)`` lands."""
    ask = F.least(asked, room)
    return (
        F.when(asked <= 0, asked)
        .when(room <= 0, F.lit(0.0))
        .when(reaches <= room, ask)
        .otherwise(F.greatest(F.lit(0.0), ask - (reaches - room)))
    )
