"""Detections as ST 0903 packets and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.constants import ST0903_KEY
from ..functions.ragged import Frontier, Ragged, beside, field, item, long_numbers, masked, octets, of_arrow, oids, same, shortest, sizes, starts_of
from ..schemas import VMTI_TARGET

MAX_TARGET_ID = 2_097_151

# --- encoding -----------------------------------------------------------------------------------


def refuse_target() -> Column:
    """Why a target row cannot be encoded, or null."""
    percent = lambda c: F.col(c).isNotNull() & ~F.col(c).between(0, 100)
    return (
        F.when((F.col("frame_width") < 1) | (F.col("frame_height") < 1), "the frame has no pixels")
        .when(~F.col("target_id").between(1, MAX_TARGET_ID), "the target id is out of range")
        .when((F.col("left") > F.col("right")) | (F.col("top") > F.col("bottom")), "the box is inside out")
        .when(
            (F.col("left") < 1) | (F.col("top") < 1) | (F.col("right") > F.col("frame_width")) | (F.col("bottom") > F.col("frame_height")),
            "the box is outside the frame",
        )
        .when(percent("confidence") | percent("track_confidence"), "a confidence is a percentage")
        .when(F.col("track_last_seen_us") < F.col("track_started_us"), "the track was seen before it started")
    )


def encode_vmti(frames: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """One packet per frame, ``frames(*keys, timestamp_us, frame_width, frame_height, sensor, ontology)``.

    Frames and their targets (:data:`VMTI_TARGET` plus the keys) are laid in one order, the frame before its
    targets, and streamed: one shuffle, no join. All packets that end in a batch are written as one buffer; of a frame that goes on,
    its row and its targets' bytes are carried to the next. Rows :func:`refuse_target` names must be taken out before.
    """
    marked = frames.select(*keys, *HEADER).unionByName(targets.select(*keys, *TARGET_COLUMNS), allowMissingColumns=True)
    bare = F.regexp_replace("track_uuid", "urn:|uuid:|[{}-]", "")  # however a UUID is written
    rows = marked.select(
        *[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)], F.coalesce("target_id", F.lit(0)).alias("target_id"), *HEADER,
        *[c for c in TARGET_COLUMNS[1:] if c != "track_uuid"], F.when(F.col("track_uuid").isNotNull(), F.coalesce(F.unhex(bare), F.lit(b""))).alias("track_uuid"),
    )
    schema = StructType([*[StructField(f"k{n}", frames.schema[k].dataType) for n, k in enumerate(keys)], StructField("data", BinaryType())])
    arrow, own = to_arrow_schema(schema), [f"k{n}" for n in range(len(keys))]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, series, count = None, Ragged(np.zeros(0, np.uint8), np.zeros(1, np.int64)), 0
        for batch in batches:
            if batch.num_rows:
                done, held, series, count = _written(batch, own, held, series, count)
                if done is not None:
                    yield pa.RecordBatch.from_arrays(done, schema=arrow)
        if held is not None and held.column("target_id")[0].as_py() == 0:
            yield pa.RecordBatch.from_arrays([*(held.column(k) for k in own), _packets(held, series, np.array([count])).arrow().cast(pa.binary())], schema=arrow)

    width = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows, much work: not for AQE to fold
    placed = rows.repartition(width, *own).sortWithinPartitions(*own, "target_id")
    return placed.mapInArrow(write, schema).toDF(*keys, "data")


HEADER = ["timestamp_us", "frame_width", "frame_height", "sensor", "ontology"]
TARGET_COLUMNS = [f.name for f in VMTI_TARGET.fields]


def _written(batch: pa.RecordBatch, keys: list[str], held: pa.RecordBatch | None, series: Ragged, count: int):
    """The packets that end in a batch, and the frame that goes on: its row, its targets' bytes and their number.

    ``held`` is the row of the frame that the batch before left open, with target id 0, or -1 if nobody listed that frame.
    """
    if held is not None:
        batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
    changed = np.zeros(batch.num_rows - 1, bool)
    for key in keys:
        column = batch.column(key)
        here, before = column.slice(1), column.slice(0, batch.num_rows - 1)
        differ = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
        changed |= differ | (here.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False))
    frame = np.r_[0, np.cumsum(changed)]
    first = np.flatnonzero(np.r_[True, changed])
    target = _ints(batch, "target_id")[0]
    header = np.full(len(first), -1)
    listed = np.flatnonzero(target == 0)
    header[frame[listed]] = listed  # of equal frames the last
    rows = np.flatnonzero((target > 0) & (header[frame] >= 0))
    packs = _packs(batch.take(pa.array(rows)), batch.take(pa.array(header[frame[rows]])))
    packs = beside(sizes(packs.lengths), packs)
    whole = packs.joined(np.searchsorted(frame[rows], np.arange(len(first))))
    number = np.bincount(frame[rows], minlength=len(first))
    if held is not None:
        whole = beside(Ragged(series.data, np.r_[series.lengths, np.zeros(len(first) - 1, np.int64)]), whole)
        number[0] += count
    last = len(first) - 1
    ended = np.flatnonzero(header[:last] >= 0)
    done = None
    if len(ended):
        heads = batch.take(pa.array(header[ended]))
        done = [*(heads.column(k) for k in keys), _packets(heads, whole.take(ended), number[ended]).arrow().cast(pa.binary())]
    open_ = int(header[last])
    held = batch.slice(open_ if open_ >= 0 else int(first[last]), 1)
    if open_ < 0:
        held = held.set_column(held.schema.get_field_index("target_id"), held.schema.field("target_id"), pa.array([-1], held.schema.field("target_id").type))
    return done, held, whole.take(np.array([last])), int(number[last])


def _ints(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, and where they are."""
    column = batch.column(name)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_valid().to_numpy(zero_copy_only=False)


def _packs(targets: pa.RecordBatch, heads: pa.RecordBatch) -> Ragged:
    """Every target's pack, without its length."""
    value = lambda name: _ints(targets, name)[0]
    there = lambda name: targets.column(name).is_valid().to_numpy(zero_copy_only=False)
    width = _ints(heads, "frame_width")[0]
    pixel = lambda column, line: shortest(column + (line - 1) * width)
    left, top, right, bottom = (value(c) for c in ("left", "top", "right", "bottom"))
    ontology = of_arrow(heads.column("ontology"))
    named, tracked = there("ontology_class"), there("track_uuid")
    uri = item(1, ontology, heads.column("ontology").is_valid().to_numpy(zero_copy_only=False))
    thing = beside(uri, item(2, of_arrow(targets.column("ontology_class"))))
    number = of_arrow(targets.column("track_uuid"))
    if (number.lengths[tracked] != 16).any():
        raise ValueError("a track's UUID cannot be read")
    track = beside(
        item(1, number), item(2, octets(value("track_status"))), item(3, shortest(value("track_started_us"))), item(4, shortest(value("track_last_seen_us"))),
        item(6, of_arrow(targets.column("track_algorithm")), there("track_algorithm")), item(7, octets(value("track_confidence")), there("track_confidence")),
    )
    return beside(
        oids(value("target_id")), item(1, pixel((left + right) // 2, (top + bottom) // 2)), item(2, pixel(left, top)), item(3, pixel(right, bottom)),
        item(5, octets(value("confidence")), there("confidence")), item(102, thing, named), item(104, track, tracked),
    )


def _packets(heads: pa.RecordBatch, series: Ragged, count: np.ndarray) -> Ragged:
    """Whole packets of frames and their targets' series."""
    rows = len(count)
    body = beside(
        item(2, long_numbers(_ints(heads, "timestamp_us")[0])), same(bytes([4, 1, 4]), rows), item(6, shortest(count)), item(8, shortest(_ints(heads, "frame_width")[0])),
        item(9, shortest(_ints(heads, "frame_height")[0])), item(10, of_arrow(heads.column("sensor"))), item(101, series, count > 0), same(bytes([1, 2]), rows),
    )
    whole = beside(same(ST0903_KEY, rows), sizes(body.lengths + 2), body)
    ends = np.cumsum(whole.lengths)
    sums = checksums(whole.data, ends - whole.lengths, ends)
    return beside(whole, Ragged(np.stack([sums >> 8, sums & 0xFF], axis=1).astype(np.uint8).ravel(), np.full(rows, 2)))


def checksums(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of big-endian 16-bit words from each ``begin`` to its ``end``, modulo 2^16; an odd last byte is a high half."""
    high = np.r_[0, np.cumsum(np.where(np.arange(len(data)) % 2 == 0, data, 0).astype(np.int64))]
    low = np.r_[0, np.cumsum(np.where(np.arange(len(data)) % 2 == 1, data, 0).astype(np.int64))]
    even, odd = high[end] - high[begin], low[end] - low[begin]
    return np.where(begin % 2 == 0, even * 256 + odd, odd * 256 + even) & 0xFFFF


# --- decoding -----------------------------------------------------------------------------------


def decode_vmti(packets: DataFrame, data: str = "data") -> DataFrame:
    """One row per target (one with a null id for an empty or unreadable frame) and the packet's status."""
    kept = [f for f in packets.schema.fields if f.name != data]
    names = [f.name for f in kept]
    schema = StructType([*kept, *FRAME.fields, *VMTI_TARGET.fields])
    own = [f.name for f in schema.fields[len(names) :]]
    arrow = to_arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, columns = _decoded(of_arrow(batch.column(data)))
            carried = [batch.column(n).take(pa.array(places, pa.int64())) for n in names]
            yield pa.RecordBatch.from_arrays([*carried, *(columns[n].cast(arrow.field(n).type) for n in own)], schema=arrow)

    return packets.mapInArrow(decode, schema)


FRAME = StructType(
    [
        StructField("status", StringType()),
        StructField("timestamp_us", LongType()),
        StructField("frame_width", IntegerType()),
        StructField("frame_height", IntegerType()),
        StructField("sensor", StringType()),
        StructField("reported", IntegerType()),
        StructField("ontology", StringType()),
    ]
)


def _decoded(packets: Ragged) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The packet of every row, and the rows as columns: one for each target of a sound packet, and one for a packet without any."""
    count = len(packets)
    begin = starts_of(packets.lengths)
    end = begin + packets.lengths
    data = np.r_[packets.data, np.zeros(Frontier.PAD, np.uint8)]
    front = Frontier(data)
    key = np.frombuffer(ST0903_KEY, np.uint8)
    is_0903 = packets.lengths >= 16
    for k in range(16):
        is_0903[is_0903] = data[begin[is_0903] + k] == key[k]
    size, body, ok = front.lengths(np.where(is_0903, begin + 16, begin), np.where(is_0903, end, begin))
    sound = is_0903 & ok & (body + size == end)
    items = front.items(np.where(sound, body, 0), np.where(sound, end, 0))
    row, tag, first, stop, bad = items
    sums = tag == 1
    bad[row[sums & ((stop != end[row]) | (stop - first != 2))]] = True
    sound &= ~bad
    spot = {t: field(items, t, count) for t in (1, 2, 6, 8, 9, 10, 101)}
    told = front.numbers(*spot[1])
    summed = sound & (spot[1][0] >= 0)
    summed[summed] = checksums(data, begin[summed], end[summed] - 2) == told[summed]
    number = {t: front.numbers(*spot[t]) for t in (2, 6, 8, 9)}
    sensor, unread = front.texts(*spot[10])
    fine = summed & ~unread & (spot[10][0] >= 0)
    for t in (2, 6, 8, 9):
        fine &= number[t] >= 0
    for t in (6, 8, 9):
        fine &= number[t] < 1 << 31
    series = np.where(fine & (spot[101][0] >= 0), spot[101], 0)
    owner, at, to, torn = front.slices(series[0], series[1])
    target, columns, lost = _targets(front, at, to, number[8][owner])
    fine &= ~torn
    fine[owner[lost]] = False
    status = np.where(~is_0903, "not_0903", np.where(fine, "ok", np.where(sound & ~summed, "bad_checksum", "malformed")))
    kept = np.flatnonzero(fine[owner])
    bare = np.flatnonzero(np.bincount(owner[kept], minlength=count) == 0)
    place = np.r_[owner[kept], bare]
    order = np.argsort(place, kind="stable")
    place = place[order]
    from_target = pa.array(np.r_[kept, np.full(len(bare), -1)][order])
    from_target = pc.if_else(pc.less(from_target, 0), pa.scalar(None, pa.int64()), from_target)
    frame = {"timestamp_us": number[2], "frame_width": number[8], "frame_height": number[9], "reported": number[6]}
    out = {"status": pa.array(status[place], pa.string())}
    out |= {name: masked(values[place], fine[place]) for name, values in frame.items()}
    out["sensor"] = masked(sensor.take(pa.array(place)), fine[place])
    out |= {name: column.take(from_target) for name, column in columns.items()}
    return place, out


def _targets(front: Frontier, at: np.ndarray, end: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array], np.ndarray]:
    """Ids, columns, and which targets cannot be read."""
    count = len(at)
    target, inner, ok = front.tags(at, end)
    lost = ~ok | (width < 1)
    items = front.items(np.where(lost, 0, inner), np.where(lost, 0, end))
    lost |= items[4]
    spot = {t: field(items, t, count) for t in (2, 3, 5, 102, 104)}
    corner = {t: front.numbers(*spot[t]) for t in (2, 3)}
    lost |= (corner[2] < 0) | (corner[3] < 0)
    line = np.maximum(width, 1)
    lost |= ((corner[2] - 1) // line >= 1 << 31) | ((corner[3] - 1) // line >= 1 << 31)  # no picture has so many lines
    columns = {"target_id": pa.array(target)}
    for names, t in ((("left", "top"), 2), (("right", "bottom"), 3)):
        columns[names[0]], columns[names[1]] = pa.array((corner[t] - 1) % line + 1), pa.array((corner[t] - 1) // line + 1)

    def nested(tag: int):
        begin, stop = spot[tag]
        return begin >= 0, front.items(np.where(begin < 0, 0, begin), np.where(begin < 0, 0, stop))

    def octet(items: tuple, tag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First bytes, where there are any, and where an item is empty."""
        begin, stop = field(items, tag, count)
        return front.data[np.maximum(begin, 0)].astype(np.int64), begin >= 0, (begin >= 0) & (begin == stop)

    value, there, empty = octet(items, 5)
    lost |= empty
    columns["confidence"] = masked(value, there)
    named, thing = nested(102)
    columns["ontology_class"], wrong = front.texts(*field(thing, 2, count))
    columns["ontology"], odd = front.texts(*field(thing, 1, count))
    lost |= named & (thing[4] | wrong | odd | (field(thing, 2, count)[0] < 0))
    tracked, track = nested(104)
    begin, stop = field(track, 1, count)
    whole = tracked & (begin >= 0) & (stop - begin == 16)
    columns["track_uuid"] = masked(_dashed(front.data[np.where(whole, begin, 0)[:, None] + np.arange(16)]), whole)
    value, there, empty = octet(track, 2)
    columns["track_status"] = masked(value, there)
    since, seen = (front.numbers(*field(track, t, count)) for t in (3, 4))
    columns["track_started_us"], columns["track_last_seen_us"] = masked(since, since >= 0), masked(seen, seen >= 0)
    columns["track_algorithm"], wrong = front.texts(*field(track, 6, count))
    sure, given, hollow = octet(track, 7)
    columns["track_confidence"] = masked(sure, given)
    lost |= tracked & (track[4] | ~whole | ~there | empty | (since < 0) | (seen < 0) | wrong | hollow)
    return target, columns, lost


HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _dashed(raw: np.ndarray) -> pa.Array:
    """Rows of sixteen bytes as UUIDs."""
    digits = np.stack([HEX[raw >> 4], HEX[raw & 15]], axis=2).reshape(len(raw), 32)
    text = np.insert(digits, [8, 12, 16, 20], ord("-"), axis=1)
    return Ragged(text.ravel(), np.full(len(raw), 36)).arrow().cast(pa.string())


def decode_vmti_packet(packet: bytes) -> list[dict]:
    """The targets of one packet as column values, each with the frame's own."""
    _, columns = _decoded(Ragged(np.frombuffer(packet, np.uint8), np.array([len(packet)])))
    rows = pa.table(columns).to_pylist()
    return [{name: value for name, value in row.items() if value is not None} for row in rows]
