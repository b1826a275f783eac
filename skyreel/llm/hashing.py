"""Word and shingle hashes of a whole Arrow text column, by array operations only.

A word is a run of bytes other than blank and 0x09-0x0D, with A-Z lower-cased. Its hash is a polynomial over random
64-bit values of its bytes, read off one running sum; shingles mix the hashes of neighbouring words. Texts are worked
through in pieces of about ``PIECE`` bytes, cut at white space, so memory does not follow the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
U = np.uint64
_rng = np.random.default_rng(20_240_229)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]
STEP = U(0x9E3779B97F4A7C15)
BACK = U(pow(int(STEP), -1, 1 << 64))
PLACES = _rng.integers(1, 1 << 63, 8, dtype=U) * U(2) + U(1)
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
NEWLINE = 10


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, STEP), np.full(size, BACK)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its row offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes, or of one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


def _word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word; no word goes on over a position in ``cuts``."""
    inside = ~BLANK[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[cuts] = True
    edges = np.flatnonzero(edge)
    starts, ends = edges[:-1], edges[1:]
    keep = inside[starts]
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64)
    up, down = _powers(1 << max(19, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts]), starts


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As above, over any length: long inputs are cut at white space."""
    if len(data) <= 2 * PIECE:
        return _word_hashes(data, cuts) if len(data) else (np.zeros(0, U), np.zeros(0, np.int64))
    found, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data):
            blank = np.flatnonzero(BLANK[data[at + PIECE // 2 : end]])
            if len(blank):
                end = at + PIECE // 2 + int(blank[-1]) + 1
                break
            end = min(end + PIECE, len(data))  # one word of more than half a piece
        hashes, starts = _word_hashes(data[at:end], cuts[(cuts >= at) & (cuts < end)] - at)
        found.append((hashes, starts + at))
        at = end
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def shingles(words: np.ndarray, unit: np.ndarray, size: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hash and unit of every ``size``-word shingle inside a unit (a document, a line), in order of units; a shorter
    unit of at least ``least`` words is one shingle as a whole. ``unit`` ascends."""
    count = len(words)
    out, owner = [], []
    if count >= size:
        whole = np.flatnonzero(unit[: count - size + 1] == unit[size - 1 :])
        total = np.zeros(len(whole), U)
        for k in range(size):
            total += words[whole + k] * PLACES[k]
        out.append(mixed(total))
        owner.append(unit[whole])
    if count and least < size:
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        length = np.diff(np.r_[first, count])
        for short in range(least, size):
            at = first[length == short]
            if len(at):
                total = np.full(len(at), PLACES[short])
                for k in range(short):
                    total += words[at + k] * PLACES[k]
                out.append(mixed(total))
                owner.append(unit[at])
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(owner)


def sets(hashes: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each unit, ascending inside it; units ascend."""
    if len(hashes):
        bits = 64 - int(unit.max()).bit_length()
        packed = (unit.astype(U) << U(bits)) | (hashes >> U(64 - bits)) if bits < 64 else hashes
        order = np.argsort(packed)
        packed, hashes, unit = packed[order], hashes[order], unit[order]
        if ((packed[1:] == packed[:-1]) & (hashes[1:] != hashes[:-1])).any():  # equal leading bits of different hashes
            order = np.lexsort((hashes, unit))
            hashes, unit = hashes[order], unit[order]
    keep = np.r_[True, (hashes[1:] != hashes[:-1]) | (unit[1:] != unit[:-1])] if len(hashes) else np.zeros(0, bool)
    return hashes[keep], unit[keep]


def spans(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The units, and where the rows of each begin and end."""
    first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else np.zeros(0, np.int64)
    return unit[first], first, np.r_[first[1:], len(unit)].astype(np.int64)


def signatures(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, from sums of its mixed members."""
    if not len(first):
        return np.zeros(0, U), np.zeros(0, U)
    return (
        mixed(np.add.reduceat(mixed(hashes + STEP), first)),
        mixed(np.add.reduceat(mixed(hashes ^ PLACES[7]), first)),
    )
