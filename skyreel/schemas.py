"""Column layouts of the domain tables."""

from __future__ import annotations

from pyspark.sql import types as T

PART = T.StructType([T.StructField("key", T.StringType()), T.StructField("size", T.LongType())])

DOCUMENT = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("file_name", T.StringType()),
        T.StructField("storage_key", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("thumbnail_key", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("parts", T.ArrayType(PART)),
    ]
)

RECORDING = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("ends_at", T.TimestampType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("truncated", T.BooleanType()),
    ]
)

FORWARD_STATUS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("connected", T.BooleanType()),
    ]
)

# One row of the shared stream registry, as each owner writes it in JSON.
REGISTRY = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("heartbeat", T.TimestampType()),
        T.StructField("owner", T.StringType()),
        T.StructField("owner_address", T.StringType()),
        T.StructField("packets", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("viewers", T.IntegerType()),
        T.StructField("buffered_seconds", T.DoubleType()),
        T.StructField("startable", T.BooleanType()),
        T.StructField("recording", RECORDING),
        T.StructField("forwards", T.ArrayType(FORWARD_STATUS)),
        T.StructField("detection_enabled", T.BooleanType()),
        T.StructField("detection_rate", T.IntegerType()),
        T.StructField("detection_model", T.StringType()),
        T.StructField("detection_labels", T.ArrayType(T.StringType())),
        T.StructField("detection_worker", T.StringType()),
    ]
)

SENSOR = T.StructType(
    [
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("altitude_m", T.DoubleType()),
        T.StructField("true_bearing", T.DoubleType()),
        T.StructField("relative_elevation", T.DoubleType()),
        T.StructField("horizontal_fov", T.DoubleType()),
        T.StructField("vertical_fov", T.DoubleType()),
        T.StructField("classification", T.StringType()),
    ]
)

FORWARD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
    ]
)

SOURCE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("forwards", T.ArrayType(FORWARD)),
        T.StructField("static_sensor", SENSOR),
    ]
)

PACKET = T.StructType(
    [
        T.StructField("stream", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("stream_index", T.IntegerType()),
        T.StructField("pts", T.LongType()),
        T.StructField("dts", T.LongType()),
        T.StructField("duration", T.LongType()),
        T.StructField("is_key", T.BooleanType()),
        T.StructField("data", T.BinaryType()),
    ]
)

TELEMETRY_NUMBERS = [
    "platform_heading",
    "platform_pitch",
    "platform_roll",
    "sensor_latitude",
    "sensor_longitude",
    "sensor_true_altitude",
    "sensor_horizontal_fov",
    "sensor_vertical_fov",
    "sensor_relative_azimuth",
    "sensor_relative_elevation",
    "sensor_relative_roll",
    "slant_range",
    "frame_center_latitude",
    "frame_center_longitude",
    "frame_center_elevation",
]

TELEMETRY = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("timestamp_us", T.LongType()),
        T.StructField("mission_id", T.StringType()),
        T.StructField("platform_designation", T.StringType()),
        T.StructField("image_source_sensor", T.StringType()),
        T.StructField("image_coordinate_system", T.StringType()),
        *[T.StructField(name, T.DoubleType()) for name in TELEMETRY_NUMBERS],
        T.StructField("classification", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("unparsed", T.MapType(T.IntegerType(), T.BinaryType())),
    ]
)

VMTI_TARGET = T.StructType(
    [
        T.StructField("target_id", T.IntegerType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("top", T.IntegerType()),
        T.StructField("right", T.IntegerType()),
        T.StructField("bottom", T.IntegerType()),
        T.StructField("confidence", T.IntegerType()),
        T.StructField("ontology_class", T.StringType()),
        T.StructField("track_uuid", T.StringType()),
        T.StructField("track_status", T.IntegerType()),
        T.StructField("track_started_us", T.LongType()),
        T.StructField("track_last_seen_us", T.LongType()),
        T.StructField("track_algorithm", T.StringType()),
        T.StructField("track_confidence", T.IntegerType()),
    ]
)
