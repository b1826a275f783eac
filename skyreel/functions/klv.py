"""Small helpers over KLV bytes: BER lengths and tags, scales, the checksum both local sets share."""

from __future__ import annotations

import re

import numpy as np

from .constants import CLASSIFICATIONS, ST0601_KEY

# Fixed values of ST 0601: tag -> (column, wire type, low, high).  Signed types map +-(2^n - 1) to the range.
SCALES = {
    5: ("platform_heading", ">u2", 0.0, 360.0),
    6: ("platform_pitch", ">i2", -20.0, 20.0),
    7: ("platform_roll", ">i2", -50.0, 50.0),
    13: ("sensor_latitude", ">i4", -90.0, 90.0),
    14: ("sensor_longitude", ">i4", -180.0, 180.0),
    15: ("sensor_true_altitude", ">u2", -900.0, 19000.0),
    16: ("sensor_horizontal_fov", ">u2", 0.0, 180.0),
    17: ("sensor_vertical_fov", ">u2", 0.0, 180.0),
    18: ("sensor_relative_azimuth", ">u4", 0.0, 360.0),
    19: ("sensor_relative_elevation", ">i4", -180.0, 180.0),
    20: ("sensor_relative_roll", ">u4", 0.0, 360.0),
    21: ("slant_range", ">u4", 0.0, 5_000_000.0),
    23: ("frame_center_latitude", ">i4", -90.0, 90.0),
    24: ("frame_center_longitude", ">i4", -180.0, 180.0),
    25: ("frame_center_elevation", ">u2", -900.0, 19000.0),
}
TEXTS = {3: "mission_id", 10: "platform_designation", 11: "image_source_sensor", 12: "image_coordinate_system"}


class Malformed(ValueError):
    pass


def checksum(data: bytes) -> int:
    """Sum of big-endian 16-bit words, modulo 2^16; an odd last byte counts as a high half."""
    octets = np.frombuffer(data, dtype=np.uint8)
    return (int(octets[0::2].sum(dtype=np.int64)) * 256 + int(octets[1::2].sum(dtype=np.int64))) & 0xFFFF


def length_bytes(size: int) -> bytes:
    if size < 128:
        return bytes([size])
    body = size.to_bytes((size.bit_length() + 7) // 8, "big")
    if len(body) > 4:
        raise ValueError("a local set cannot be longer than a four-byte length says")
    return bytes([0x80 | len(body)]) + body


def item(tag: int, value: bytes) -> bytes:
    return bytes([tag]) + length_bytes(len(value)) + value


def shortest(value: int) -> bytes:
    return value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big")


def oid(value: int) -> bytes:
    groups = [value & 0x7F]
    while value := value >> 7:
        groups.append(0x80 | (value & 0x7F))
    return bytes(reversed(groups))


# A tag is up to three bytes with the high bit and one without; a length is one byte, or says how many follow.
TAG = rb"(?P<tag>[\x80-\xff]{0,3}[\x00-\x7f])"
LENGTH = rb"(?P<size>[\x00-\x7f]|\x81.|\x82..|\x83...|\x84[\x00-\x7f]...)"
TAG_FIELD, LENGTH_FIELD, ITEM_HEAD = (re.compile(p, re.DOTALL) for p in (TAG, LENGTH, TAG + LENGTH))


def _tag_number(raw: bytes) -> int:
    return sum((byte & 0x7F) << (7 * place) for place, byte in enumerate(reversed(raw)))


def _size_number(raw: bytes) -> int:
    return int.from_bytes(raw[1:] or raw, "big")


def read_length(data: bytes, at: int) -> tuple[int, int]:
    """A BER length and the offset after it."""
    found = LENGTH_FIELD.match(data, at)
    if found is None:
        raise Malformed
    return _size_number(found["size"]), found.end()


def read_tag(data: bytes, at: int) -> tuple[int, int]:
    """A BER-OID tag of at most four bytes and the offset after it."""
    found = TAG_FIELD.match(data, at)
    if found is None:
        raise Malformed
    return _tag_number(found["tag"]), found.end()


def places(data: bytes, at: int = 0) -> list[tuple[int, int, int, int]]:
    """``(tag, where its head, its value and what follows it begin)`` of every item up to the end of ``data``."""
    out = []
    while at < len(data):
        head = ITEM_HEAD.match(data, at)
        if head is None or head.end() + _size_number(head["size"]) > len(data):
            raise Malformed
        out.append((_tag_number(head["tag"]), at, head.end(), head.end() + _size_number(head["size"])))
        at = out[-1][-1]
    return out


def items(data: bytes, at: int = 0):
    """Every ``(tag, value, offset after the value)`` up to the end of ``data``."""
    return [(tag, data[begin:end], end) for tag, _, begin, end in places(data, at)]


def scaled(tag: int, raw: np.ndarray) -> np.ndarray:
    """Numbers out of rows of big-endian bytes; NaN at the wrong length or the reserved error value."""
    _, wire, low, high = SCALES[tag]
    width = int(wire[2])
    if raw.shape[1] != width:
        return np.full(len(raw), np.nan)
    steps = np.ascontiguousarray(raw).view(wire)[:, 0].astype(np.int64)
    if wire[1] == "u":
        return low + steps * (high - low) / float(2 ** (8 * width) - 1)
    top = 2 ** (8 * width - 1) - 1
    return np.where(steps < -top, np.nan, steps * high / float(top))


def quantised(tag: int, values: np.ndarray) -> np.ndarray:
    """Numbers on the wire scale of ``tag``, as rows of big-endian bytes."""
    _, wire, low, high = SCALES[tag]
    width = int(wire[2])
    if wire[1] == "i":
        steps = np.rint(values / high * float(2 ** (8 * width - 1) - 1))
    else:
        steps = np.rint((values - low) / (high - low) * float(2 ** (8 * width) - 1))
    return steps.astype(np.int64).astype(wire).view(np.uint8).reshape(len(values), width)


def marking(security: bytes) -> str | None:
    """The classification inside an ST 0102 set; an unknown code is named, not dropped."""
    try:
        codes = [value[0] for tag, value, _ in items(security) if tag == 1 and len(value) == 1]
    except Malformed:
        codes = []
    named = dict(enumerate(CLASSIFICATIONS[:5], 1))
    return named.get(codes[0], f"UNKNOWN ({codes[0]})") if codes else None


# --- whole batches ------------------------------------------------------------------------------


class Layout:
    """Where the items of a packet lie. Packets of one length whose item heads agree share it."""

    def __init__(self, packet: bytes):
        self.sound, self.items, heads = False, [], []
        try:
            size, body = read_length(packet, 16)
            if body + size == len(packet):
                self.items = places(packet, body)
                sums = [(begin, end) for tag, _, begin, end in self.items if tag == 1]
                self.sound = all(end == len(packet) and end - begin == 2 for begin, end in sums)
                heads = [np.arange(head, begin) for _, head, begin, _ in self.items]
        except Malformed:
            pass
        self.summed = self.sound and any(tag == 1 for tag, *_ in self.items)
        self.fixed = np.concatenate([np.arange(16, body), *heads]) if self.sound else np.arange(len(packet))


def decode_telemetry_batch(packets: list[bytes]) -> dict[str, np.ndarray]:
    """ST 0601 packets as columns; ``status`` says why nothing else of a row is set.

    Packets of one length are laid out as a byte matrix. The first row's layout is found once and holds for all rows with
    the same item heads, whose items are then slices of the matrix; the other rows go round again.
    """
    count = len(packets)
    out = {name: np.full(count, np.nan) for name, *_ in SCALES.values()}
    out |= {name: np.full(count, None, object) for name in ("status", "unparsed", "timestamp_us", "classification", "version", *TEXTS.values())}
    out["status"][:] = "not_0601"
    lengths: dict[int, list[int]] = {}
    for row, packet in enumerate(packets):
        if len(packet) > 16 and packet.startswith(ST0601_KEY):
            lengths.setdefault(len(packet), []).append(row)
    for size, rows in lengths.items():
        rows = np.array(rows)
        matrix = np.frombuffer(b"".join(packets[r] for r in rows), np.uint8).reshape(len(rows), size)
        while len(rows):
            layout = Layout(packets[rows[0]])
            alike = (matrix[:, layout.fixed] == matrix[0, layout.fixed]).all(axis=1)
            _fill(out, rows[alike], matrix[alike], layout)
            rows, matrix = rows[~alike], matrix[~alike]
    return out


def _fill(out: dict[str, np.ndarray], rows: np.ndarray, matrix: np.ndarray, layout: Layout) -> None:
    if not layout.summed:
        out["status"][rows] = "bad_checksum" if layout.sound else "malformed"
        return
    words = matrix[:, :-2]
    sums = (words[:, 0::2].sum(axis=1, dtype=np.int64) * 256 + words[:, 1::2].sum(axis=1, dtype=np.int64)) & 0xFFFF
    good = sums == matrix[:, -2].astype(np.int64) * 256 + matrix[:, -1]
    out["status"][rows] = np.where(good, "ok", "bad_checksum")
    rows, matrix = rows[good], matrix[good]
    others: dict[int, list[bytes]] = {}
    for tag, _, begin, end in layout.items:
        raw = matrix[:, begin:end]
        if tag in SCALES:
            out[SCALES[tag][0]][rows] = scaled(tag, raw)
        elif tag in TEXTS:
            out[TEXTS[tag]][rows] = _each(raw, lambda value: value.decode("ascii", "replace").replace("\ufffd", "?"))
        elif tag == 48:
            out["classification"][rows] = _each(raw, marking)
        elif (tag, end - begin) == (2, 8):
            out["timestamp_us"][rows] = np.ascontiguousarray(raw).view(">i8")[:, 0].astype(np.int64)
        elif (tag, end - begin) == (65, 1):
            out["version"][rows] = raw[:, 0].astype(np.int64)
        elif tag != 1:
            others[tag] = [row.tobytes() for row in raw]
    for place, row in enumerate(rows):
        out["unparsed"][row] = {tag: values[place] for tag, values in others.items()}


def _each(raw: np.ndarray, make) -> np.ndarray:
    """``make`` of every row's bytes, called once for each different value."""
    known: dict[bytes, str | None] = {}
    out = np.empty(len(raw), object)
    for place, row in enumerate(raw):
        value = row.tobytes()
        if value not in known:
            known[value] = make(value)
        out[place] = known[value]
    return out


def decode_telemetry_packet(packet: bytes) -> dict:
    """One packet as column values."""
    row = {name: column.tolist()[0] for name, column in decode_telemetry_batch([packet]).items()}
    return {name: None if value != value else value for name, value in row.items()}
