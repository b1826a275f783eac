"""Byte strings of many lengths as one buffer: whole columns of them are put together and taken apart by array operations.

Writing goes lengths first: prefix sums give every field its offset, and all fields of a batch are scattered into one buffer. Reading
goes a frontier at a time: all byte strings of a batch advance by one item a step, each at its own offset.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each of some byte strings begins that lie one after another."""
    return np.cumsum(lengths) - lengths


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Every byte's place, for byte strings at ``starts``."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - starts_of(lengths), lengths)


@dataclass
class Ragged:
    """Byte strings one after another, and their lengths."""

    data: np.ndarray
    lengths: np.ndarray

    def __len__(self) -> int:
        return len(self.lengths)

    def where(self, keep: np.ndarray) -> "Ragged":
        """Empty where ``keep`` does not hold."""
        return Ragged(self.data[np.repeat(keep, self.lengths)], np.where(keep, self.lengths, 0))

    def take(self, rows: np.ndarray) -> "Ragged":
        lengths = self.lengths[rows]
        return Ragged(self.data[_places(starts_of(self.lengths)[rows], lengths)], lengths)

    def joined(self, first: np.ndarray) -> "Ragged":
        """Runs of rows as one byte string each; a run ends where the next of ``first`` begins and may be empty."""
        ends = np.r_[0, np.cumsum(self.lengths)]
        return Ragged(self.data, np.diff(ends[np.r_[first, len(self)]]))

    def arrow(self) -> pa.Array:
        offsets = np.r_[0, np.cumsum(self.lengths)]
        kind, width = (pa.binary(), np.int32) if offsets[-1] < 1 << 31 else (pa.large_binary(), np.int64)
        return pa.Array.from_buffers(kind, len(self), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(np.ascontiguousarray(self.data))])


def beside(*parts: Ragged) -> Ragged:
    """Row by row, the parts one after another."""
    total = sum(p.lengths for p in parts)
    out, at = np.empty(int(total.sum()), np.uint8), starts_of(total)
    for part in parts:
        out[_places(at, part.lengths)] = part.data
        at = at + part.lengths
    return Ragged(out, total)


def same(value: bytes, rows: int) -> Ragged:
    return Ragged(np.tile(np.frombuffer(value, np.uint8), rows), np.full(rows, len(value)))


def of_matrix(matrix: np.ndarray, lengths: np.ndarray) -> Ragged:
    """The last ``lengths`` bytes of every row."""
    width = matrix.shape[1]
    return Ragged(matrix[np.arange(width) >= width - lengths[:, None]], lengths)


def octets(values: np.ndarray) -> Ragged:
    """Numbers of one byte."""
    return Ragged(values.astype(np.uint8), np.ones(len(values), np.int64))


def _wide(values: np.ndarray) -> np.ndarray:
    return values.astype(">u8").view(np.uint8).reshape(len(values), 8)


def _significant(matrix: np.ndarray) -> np.ndarray:
    used = matrix != 0
    return np.where(used.any(axis=1), matrix.shape[1] - used.argmax(axis=1), 1)


def long_numbers(values: np.ndarray) -> Ragged:
    """Big-endian numbers of eight bytes."""
    return Ragged(_wide(values).ravel(), np.full(len(values), 8))


def shortest(values: np.ndarray) -> Ragged:
    """Big-endian numbers in as few bytes as hold them, one at least."""
    matrix = _wide(values)
    return of_matrix(matrix, _significant(matrix))


def sizes(values: np.ndarray) -> Ragged:
    """BER lengths: one byte below 128, else how many bytes follow."""
    if len(values) and values.max() >= 1 << 32:
        raise ValueError("a local set cannot be longer than a four-byte length says")
    matrix = np.zeros((len(values), 5), np.uint8)
    matrix[:, 1:] = _wide(values)[:, 4:]
    body = _significant(matrix)
    long = values >= 128
    matrix[np.flatnonzero(long), 4 - body[long]] = 0x80 | body[long]
    return of_matrix(matrix, np.where(long, body + 1, 1))


def oids(values: np.ndarray) -> Ragged:
    """BER-OID numbers: seven bits a byte, the high bit on all but the last."""
    groups = np.stack([(values >> (7 * k)) & 0x7F for k in (4, 3, 2, 1, 0)], axis=1).astype(np.uint8)
    lengths = _significant(groups)
    groups[:, :-1] |= 0x80
    return of_matrix(groups, lengths)


def item(tag: int, value: Ragged, keep: np.ndarray | None = None) -> Ragged:
    """Tag, length and value; nothing where ``keep`` does not hold."""
    whole = beside(octets(np.full(len(value), tag)), sizes(value.lengths), value)
    return whole if keep is None else whole.where(keep)


def of_arrow(column: pa.Array) -> Ragged:
    """The bytes of a text or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Ragged(data[offsets[0] : offsets[-1]], np.diff(offsets))


# --- reading ------------------------------------------------------------------------------------


class Frontier:
    """Tagged items of many byte strings at once. ``data`` needs PAD bytes behind the last of them."""

    PAD = 16

    def __init__(self, data: np.ndarray):
        self.data = data

    def lengths(self, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """BER lengths, the places after them, and where they can be read at all."""
        head = self.data[at].astype(np.int64)
        more = np.where(head >= 128, head - 128, 0)
        ok = (at < end) & (head != 128) & (more <= 4) & (at + 1 + more <= end)
        more = np.where(ok, more, 0)
        size = np.where(head < 128, head, 0)
        for k in range(4):
            size = np.where(k < more, size << 8 | self.data[at + 1 + np.minimum(k, more)], size)
        return size, at + 1 + more, ok & (size < 1 << 31)

    def tags(self, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """BER-OID tags of at most four bytes, the places after them, and where they can be read."""
        tag, open_, used = np.zeros(len(at), np.int64), np.ones(len(at), bool), np.zeros(len(at), np.int64)
        for k in range(4):
            byte = self.data[at + k].astype(np.int64)
            tag = np.where(open_, tag << 7 | byte & 0x7F, tag)
            used += open_
            open_ = open_ & (byte >= 128)
        return tag, at + used, ~open_ & (at + used <= end)

    def items(self, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, tag, begin, stop) of all items of the byte strings from ``at`` to ``end``, each row's in order, and the rows that cannot be read."""
        rows, at, bad = np.flatnonzero(at < end), at.copy(), np.zeros(len(at), bool)
        found = []
        while len(rows):
            tag, after, ok = self.tags(at[rows], end[rows])
            size, begin, fine = self.lengths(np.where(ok, after, at[rows]), end[rows])
            stop = begin + size
            ok &= fine & (stop <= end[rows])
            bad[rows[~ok]] = True
            rows = rows[ok]
            found.append((rows, tag[ok], begin[ok], stop[ok]))
            at[rows] = stop[ok]
            rows = rows[at[rows] < end[rows]]
        empty = np.zeros(0, np.int64)
        return *(np.concatenate([f[k] for f in found]) if found else empty for k in range(4)), bad

    def slices(self, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, begin, stop) of byte strings that follow one another, each behind its length, and the rows that cannot be read.

        The last may say that it is longer than what is left.
        """
        rows, at, bad = np.flatnonzero(at < end), at.copy(), np.zeros(len(at), bool)
        found = []
        while len(rows):
            size, begin, ok = self.lengths(at[rows], end[rows])
            bad[rows[~ok]] = True
            rows, begin, stop = rows[ok], begin[ok], (begin + size)[ok]
            found.append((rows, begin, np.minimum(stop, end[rows])))
            at[rows] = stop
            rows = rows[stop < end[rows]]
        empty = np.zeros(0, np.int64)
        whole = [np.concatenate([f[k] for f in found]) if found else empty for k in range(3)]
        order = np.argsort(whole[0], kind="stable")
        return *(w[order] for w in whole), bad

    def numbers(self, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Big-endian numbers of up to eight bytes, -1 for what no signed 64 bits hold or is not there (``begin`` below 0)."""
        value, size = np.zeros(len(begin), np.uint64), stop - begin
        for k in range(8):
            here = k < size
            value = np.where(here, value << np.uint64(8) | self.data[np.where(here, begin + k, 0)], value)
        return np.where((begin < 0) | (size > 8) | (value >> np.uint64(63) > 0), -1, value.astype(np.int64))

    def bytes(self, begin: np.ndarray, stop: np.ndarray) -> Ragged:
        lengths = np.where(begin < 0, 0, stop - begin)
        return Ragged(self.data[_places(np.where(begin < 0, 0, begin), lengths)], lengths)

    def texts(self, begin: np.ndarray, stop: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """UTF-8 texts, null where there is none, and the rows that are not UTF-8 (null too)."""
        raw = self.bytes(begin, stop).arrow()
        bad = np.zeros(len(begin), bool)
        try:
            texts = raw.cast(pa.string())
        except pa.ArrowInvalid:
            out = []
            for k, value in enumerate(raw.to_pylist()):
                try:
                    out.append(value.decode())
                except UnicodeDecodeError:
                    out.append(None)
                    bad[k] = True
            texts = pa.array(out, pa.string())
        return masked(texts, (begin >= 0) & ~bad), bad


def field(items: tuple, tag: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, stop) of the last item ``tag`` of every row; -1 where there is none."""
    row, tags, begin, stop = items[:4]
    out = np.full((2, rows), -1)
    chosen = tags == tag
    out[0, row[chosen]], out[1, row[chosen]] = begin[chosen], stop[chosen]
    return out[0], out[1]


def masked(values: pa.Array | np.ndarray, keep: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow column that is null where ``keep`` does not hold."""
    if isinstance(values, np.ndarray):
        return pa.array(np.where(keep, values, 0), kind, mask=~keep)
    return pc.if_else(pa.array(keep), values, pa.scalar(None, values.type))
