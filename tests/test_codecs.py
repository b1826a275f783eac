"""KLV packets byte by byte."""

import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyreel.functions import klv
from skyreel.functions.constants import ST0601_KEY, SYNTHETIC_DESIGNATION
from skyreel.operators import telemetry, vmti
from skyreel.schemas import VMTI_TARGET


def packet(*tlvs, key=ST0601_KEY, fix=True):
    body = b"".join(klv.item(t, v) for t, v in tlvs) + b"\x01\x02"
    whole = key + klv.length_bytes(len(body) + 2) + body
    return whole + (klv.checksum(whole) if fix else 0).to_bytes(2, "big")


def signed(value, limit, bits=32):
    return struct.pack(">i" if bits == 32 else ">h", round(value / limit * (2 ** (bits - 1) - 1)))


MINIMUM = [
    (2, (1_714_979_289_123_000).to_bytes(8, "big")), (3, b"MISSION-42"), (5, struct.pack(">H", round(123.4 / 360 * 65535))),
    (6, signed(-3.5, 20, 16)), (10, b"MQ-9"), (13, signed(59.9139, 90)), (14, signed(10.7522, 180)),
    (15, struct.pack(">H", round((1500.5 + 900) / 19900 * 65535))), (48, klv.item(1, b"\x04")), (65, b"\x0e"), (4, b"N123"),
]


def test_minimum_set():
    got = klv.decode_telemetry_packet(packet(*MINIMUM))
    assert got["status"] == "ok" and got["timestamp_us"] == 1_714_979_289_123_000
    assert got["mission_id"] == "MISSION-42" and got["classification"] == "SECRET" and got["version"] == 14
    assert got["platform_heading"] == pytest.approx(123.4, abs=0.003)
    assert got["platform_pitch"] == pytest.approx(-3.5, abs=0.001)
    assert got["sensor_latitude"] == pytest.approx(59.9139, abs=1e-7)
    assert got["sensor_true_altitude"] == pytest.approx(1500.5, abs=0.2)
    assert got["unparsed"] == {4: b"N123"}


def test_refusals():
    good = packet(*MINIMUM)
    assert klv.decode_telemetry_packet(b"\x00" + good)["status"] == "not_0601"
    assert klv.decode_telemetry_packet(good[:-3])["status"] == "malformed"
    assert klv.decode_telemetry_packet(good[:-1] + bytes([good[-1] ^ 1]))["status"] == "bad_checksum"
    no_sum = ST0601_KEY + b"\x03" + klv.item(65, b"\x01")
    assert klv.decode_telemetry_packet(no_sum)["status"] == "bad_checksum"
    early = ST0601_KEY + b"\x07" + klv.item(1, b"\x00\x00") + klv.item(65, b"\x01")
    assert klv.decode_telemetry_packet(early)["status"] == "malformed"


def test_odd_values():
    got = klv.decode_telemetry_packet(
        packet((2, b"\x01"), (13, b"\x80\x00\x00\x00"), (5, b"\x01"), (65, b"\x01\x02"), (48, klv.item(1, b"\x09")), (3, b"a"), (3, b"b"))
    )
    assert got["sensor_latitude"] is None and got["platform_heading"] is None
    assert got["unparsed"] == {2: b"\x01", 65: b"\x01\x02"}
    assert got["classification"] == "UNKNOWN (9)" and got["mission_id"] == "b"


@pytest.mark.parametrize("size", [0, 127, 128, 255, 256, 70_000])
def test_lengths(size):
    raw = klv.length_bytes(size)
    assert klv.read_length(raw, 0) == (size, len(raw))


@pytest.mark.parametrize("tag", [1, 127, 128, 16_383, 2_097_151])
def test_tags(tag):
    raw = klv.oid(tag)
    assert klv.read_tag(raw, 0) == (tag, len(raw))


def test_checksum_is_the_word_sum():
    data = bytes(range(1, 200))
    total = sum(b << (8 * ((i + 1) % 2)) for i, b in enumerate(data)) & 0xFFFF
    assert klv.checksum(data) == total


def test_synthesis_round_trip_and_refusal(spark):
    row = dict(name="s", enabled=True, own_klv=False, latitude=59.9, longitude=10.7, altitude_m=100.0, true_bearing=45.0,
               relative_elevation=-5.0, horizontal_fov=60.0, vertical_fov=40.0, classification="secret")
    bad = {**row, "name": "bad", "latitude": 91.0}
    off = {**row, "name": "off", "enabled": False}
    sensors = spark.createDataFrame(pd.DataFrame([row, bad, off]))
    out = telemetry.decode_telemetry(telemetry.synthesise_telemetry(sensors, 0, 9_999 * 1_000_000).drop("timestamp_us"))
    rows = out.agg(F.count("*").alias("n"), F.min("status").alias("lo"), F.max("status").alias("hi"), F.max("timestamp_us").alias("t"),
                   F.first("classification").alias("c"), F.first("platform_designation").alias("d"), F.first("version").alias("v"),
                   F.countDistinct("timestamp_us").alias("ticks")).first()
    assert (rows.n, rows.ticks, rows.lo, rows.hi, rows.t) == (10_000, 10_000, "ok", "ok", 9_999_000_000)
    assert (rows.c, rows.d, rows.v) == ("SECRET", SYNTHETIC_DESIGNATION, 16)


def test_vmti_round_trip(spark):
    frames = spark.createDataFrame(
        [("s", 1, 7_000_000, 1920, 1080, "EO", "urn:o"), ("s", 2, 8_000_000, 1920, 1080, "EO", None)],
        "stream string, frame long, timestamp_us long, frame_width int, frame_height int, sensor string, ontology string",
    )
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in VMTI_TARGET.fields)
    uuid = "f81d4fae-7dec-11d0-a765-00a0c91e6bf6"
    targets = spark.createDataFrame(
        [("s", 1, 1, 10, 20, 100, 200, 68, "dog", uuid, 1, 5, 6, "ByteTrack", None), ("s", 1, 2_097_151, 1, 1, 1920, 1080, None, None, None, None, None, None, None, None)],
        f"stream string, frame long, {fields}",
    )
    packets = vmti.encode_vmti(frames, targets, ["stream", "frame"])
    got = vmti.decode_vmti(packets).orderBy("frame", "target_id").collect()
    assert [r.target_id for r in got] == [1, 2_097_151, None]
    dog = got[0]
    assert (dog.left, dog.top, dog.right, dog.bottom, dog.confidence, dog.ontology_class) == (10, 20, 100, 200, 68, "dog")
    assert (dog.track_uuid, dog.track_started_us, dog.track_last_seen_us, dog.ontology) == (uuid, 5, 6, "urn:o")
    assert (got[2].reported, got[2].timestamp_us, got[2].status) == (0, 8_000_000, "ok")
    raw = packets.where("frame = 1").first().data
    assert bytes.fromhex(uuid.replace("-", "")) in raw  # network order


def test_table_functions(spark):
    from skyreel.functions.udtfs import register

    register(spark)
    spark.createDataFrame([(packet(*MINIMUM),)], "data binary").createOrReplaceTempView("raw_packets")
    row = spark.sql("select t.* from raw_packets, lateral decode_telemetry(data) t").first()
    assert (row.status, row.mission_id, row.version) == ("ok", "MISSION-42", 14)
    assert spark.sql("select t.status from raw_packets, lateral decode_vmti(data) t").first().status == "not_0903"
