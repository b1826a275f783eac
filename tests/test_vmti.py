"""VMTI packets written and read one item at a time, and whole batches of them against that."""

import random
import uuid

import numpy as np
import pytest

from skyreel.functions import klv, ragged
from skyreel.functions.constants import ST0903_KEY
from skyreel.operators import vmti
from skyreel.schemas import VMTI_TARGET

def _pack(target, width, ontology, left, top, right, bottom, confidence, name, track, status, started, seen, algorithm, sure) -> bytes:
    pixel = lambda column, line: klv.shortest(column + (line - 1) * width)
    out = klv.oid(target)
    out += klv.item(1, pixel((left + right) // 2, (top + bottom) // 2))
    out += klv.item(2, pixel(left, top)) + klv.item(3, pixel(right, bottom))
    if confidence is not None:
        out += klv.item(5, bytes([confidence]))
    if name is not None:
        uri = klv.item(1, ontology.encode()) if ontology is not None else b""
        out += klv.item(102, uri + klv.item(2, name.encode()))
    if track is not None:
        tracker = klv.item(1, uuid.UUID(track).bytes) + klv.item(2, bytes([status]))
        tracker += klv.item(3, klv.shortest(started)) + klv.item(4, klv.shortest(seen))
        if algorithm is not None:
            tracker += klv.item(6, algorithm.encode())
        if sure is not None:
            tracker += klv.item(7, bytes([sure]))
        out += klv.item(104, tracker)
    return out


def _packet(header: tuple, packs: list[bytes]) -> bytes:
    timestamp, width, height, sensor, _ = header
    body = klv.item(2, timestamp.to_bytes(8, "big")) + klv.item(4, b"\x04") + klv.item(6, klv.shortest(len(packs)))
    body += klv.item(8, klv.shortest(width)) + klv.item(9, klv.shortest(height)) + klv.item(10, sensor.encode())
    if packs:
        body += klv.item(101, b"".join(klv.length_bytes(len(p)) + p for p in packs))
    body += b"\x01\x02"
    whole = ST0903_KEY + klv.length_bytes(len(body) + 2) + body
    return whole + klv.checksum(whole).to_bytes(2, "big")


def plain_decode(packet: bytes) -> list[dict]:
    """The targets of one packet as column values, each with the frame's own."""
    if packet[:16] != ST0903_KEY:
        return [{"status": "not_0903"}]
    number = lambda value: int.from_bytes(value, "big")
    try:
        size, at = klv.read_length(packet, 16)
        if at + size != len(packet):
            raise klv.Malformed
        tags = {}
        for tag, value, end in klv.items(packet, at):
            if tag == 1 and (end != len(packet) or len(value) != 2):
                raise klv.Malformed
            tags[tag] = value
        if 1 not in tags or klv.checksum(packet[:-2]) != number(tags[1]):
            return [{"status": "bad_checksum"}]
        frame = {
            "status": "ok", "timestamp_us": number(tags[2]), "frame_width": number(tags[8]), "frame_height": number(tags[9]),
            "sensor": tags[10].decode(), "reported": number(tags[6]),
        }
        targets = list(_targets(tags.get(101, b""), frame["frame_width"]))
    except (klv.Malformed, KeyError, UnicodeDecodeError, IndexError, ZeroDivisionError, ValueError):
        return [{"status": "malformed"}]
    if frame["timestamp_us"] >= 1 << 63 or max(frame["frame_width"], frame["frame_height"], frame["reported"]) >= 1 << 31 or any(v >= 1 << 63 for t in targets for v in t.values() if isinstance(v, int)) or any(t[c] > 1 << 31 for t in targets for c in ("top", "bottom")):
        return [{"status": "malformed"}]
    return [{**frame, **target} for target in targets] or [frame]


def _targets(series: bytes, width: int):
    number = lambda value: int.from_bytes(value, "big")
    at = 0
    while at < len(series):
        size, at = klv.read_length(series, at)
        pack, at = series[at : at + size], at + size
        target_id, inner = klv.read_tag(pack, 0)
        tags = {tag: value for tag, value, _ in klv.items(pack, inner)}
        spot = lambda tag: divmod(number(tags[tag]) - 1, width)  # noqa: B023, E731
        (top, left), (bottom, right) = spot(2), spot(3)
        row = {"target_id": target_id, "left": left + 1, "top": top + 1, "right": right + 1, "bottom": bottom + 1}
        if 5 in tags:
            row["confidence"] = tags[5][0]
        if 102 in tags:
            thing = {tag: value for tag, value, _ in klv.items(tags[102])}
            row["ontology_class"] = thing[2].decode()
            if 1 in thing:
                row["ontology"] = thing[1].decode()
        if 104 in tags:
            track = {tag: value for tag, value, _ in klv.items(tags[104])}
            row |= {
                "track_uuid": str(uuid.UUID(bytes=track[1])), "track_status": track[2][0],
                "track_started_us": number(track[3]), "track_last_seen_us": number(track[4]),
            }
            if 6 in track:
                row["track_algorithm"] = track[6].decode()
            if 7 in track:
                row["track_confidence"] = track[7][0]
        yield row


def random_target(rng, number):
    left, top = rng.randint(1, 1900), rng.randint(1, 1000)
    maybe = lambda value, share=0.5: value if rng.random() < share else None
    tracked = rng.random() < 0.5
    track = (str(uuid.UUID(int=rng.getrandbits(128))), rng.randint(0, 2), rng.randint(0, 1 << rng.randint(1, 62)), rng.getrandbits(62), maybe("Byte\u00e9"), maybe(rng.randint(0, 100)))
    return (number, left, top, rng.randint(left, 1920), rng.randint(top, 1080), maybe(rng.randint(0, 100)), maybe("class " * rng.randint(1, 40)), *(track if tracked else (None,) * 6))


def random_packet(rng):
    ontology, width, count = rng.choice([None, "urn:o"]), 1920, rng.choice([0, 1, 2, 9, 200])
    numbers = sorted(rng.sample([1, 2, 127, 128, 16_383, 16_384, 2_097_151, *range(300, 600)], count))
    targets = [random_target(rng, n) for n in numbers]
    packs = [_pack(n, width, ontology, *t) for n, *t in targets]
    return _packet((rng.randint(0, 1 << rng.randint(1, 62)), width, 1080, rng.choice(["EO", "", "s\u00f8r" * 50]), ontology), packs)


def damaged(rng, packet):
    data = bytearray(packet)
    for _ in range(rng.randint(1, 3)):
        kind = rng.random()
        if kind < 0.5:
            data[rng.randrange(16, len(data))] = rng.choice([0, 1, 2, 3, 5, 102, 104, 127, 128, 129, 130, 132, 255])
        elif kind < 0.7:
            del data[rng.randrange(len(data)) :]
        else:
            del data[(at := rng.randrange(len(data))) : at + rng.randint(1, 5)]
        if len(data) < 20:
            return bytes(data)
    if rng.random() < 0.8 and len(data) > 20:  # a right sum, so that what lies behind it is read
        body = bytes(data[16:])
        try:
            size, at = klv.read_length(bytes(data), 16)
            body = bytes(data[at:-2])
        except klv.Malformed:
            pass
        whole = ST0903_KEY + klv.length_bytes(len(body) + 2) + body
        data = whole + klv.checksum(whole).to_bytes(2, "big")
    return bytes(data)


def batch_decode(packets):
    import pyarrow as pa

    place, columns = vmti._decoded(ragged.of_arrow(pa.array(packets, pa.binary())))
    rows = pa.table(columns).to_pylist()
    return [(int(p), {k: v for k, v in row.items() if v is not None}) for p, row in zip(place, rows)]


@pytest.mark.parametrize("seed", range(6))
def test_a_batch_reads_what_one_item_at_a_time_reads(seed):
    rng = random.Random(seed)
    packets = [random_packet(rng) for _ in range(60)]
    packets += [damaged(rng, rng.choice(packets[:60])) for _ in range(1_500)] + [b"", b"x", ST0903_KEY, ST0903_KEY + b"\x00", None]
    rng.shuffle(packets)
    want = [(place, row) for place, packet in enumerate(packets) for row in plain_decode(packet or b"")]
    assert batch_decode(packets) == want
    assert {row["status"] for _, row in want} == {"ok", "malformed", "bad_checksum", "not_0903"}
    assert batch_decode([]) == []


def test_sound_packets_are_read_whole():
    rng = random.Random(9)
    packets = [random_packet(rng) for _ in range(30)]
    for packet in packets:
        assert vmti.decode_vmti_packet(packet) == plain_decode(packet)


@pytest.mark.parametrize("batch", [1, 3, 1_000])
def test_packets_do_not_depend_on_the_batches(spark, batch):
    rng = random.Random(batch)
    frames, targets, want = [], [], {}
    for number in range(40):
        key = rng.choice(["a", None, "b"])
        header = (rng.getrandbits(50), 1920, 1080, "EO", rng.choice([None, "urn:o"]))
        some = [random_target(rng, n) for n in range(1, rng.choice([0, 1, 5, 30]) + 1)]
        if number % 7:
            frames.append((key, number, *header))
            want[key, number] = _packet(header, [_pack(n, 1920, header[4], *t) for n, *t in some])
        targets += [(key, number, *t) for t in some]  # some of frames that nobody listed
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in VMTI_TARGET.fields)
    order = [f.name for f in VMTI_TARGET.fields]
    assert order[:1] == ["target_id"]
    key = "stream string, frame long, "
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        packets = vmti.encode_vmti(
            spark.createDataFrame(frames, key + "timestamp_us long, frame_width int, frame_height int, sensor string, ontology string"),
            spark.createDataFrame(targets, key + fields), ["stream", "frame"],
        )
        got = {(r.stream, r.frame): bytes(r.data) for r in packets.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_numbers_in_bytes():
    values = np.array([0, 1, 127, 128, 255, 256, 65_535, 65_536, 1 << 31, (1 << 32) - 1])
    for made, plain in ((ragged.shortest(values), klv.shortest), (ragged.sizes(values), klv.length_bytes), (ragged.oids(values), klv.oid)):
        assert [bytes(v) for v in made.arrow().to_pylist()] == [plain(int(v)) for v in values]
    with pytest.raises(ValueError):
        ragged.sizes(np.array([1 << 32]))
