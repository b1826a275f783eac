"""Media types by extension, out of a public table, and by leading bytes, by a trie over them."""

from __future__ import annotations

import mimetypes
from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .constants import MAGIC_BYTES, MEDIA_TYPES

Segments = tuple[tuple[int, str], ...]
"""Bytes that lie at offsets, in hexadecimal, ascending."""


@cache
def public_types() -> dict[str, str]:
    """Extension to media type: the table that comes with Python, under the fixed values of ``constants``."""
    table = mimetypes.MimeTypes(()).types_map[True]
    return {extension[1:].lower(): kind for extension, kind in table.items()} | MEDIA_TYPES


def read_types(spark: SparkSession, path: str) -> dict[str, str]:
    """The public table and what a file in the ``mime.types`` format (a type, then its extensions, ``#`` for notes) adds to it.

    Of several types that name an extension the first counts. The fixed values of ``constants`` stay.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "#.*", "").alias("line")).where("trim(line) <> ''")
    read: dict[str, str] = {}
    for row in lines.collect():  # a table of types: thousands of short lines at most
        kind, *extensions = row.line.split()
        for extension in extensions:
            read.setdefault(extension.lower(), kind)
    return public_types() | read | MEDIA_TYPES


class Trie:
    """Signatures by the bytes they ask for. An inner node asks for one more run of bytes; nodes that part at a place share all before it."""

    def __init__(self, signatures: list[tuple[Segments, str]]):
        self.types = sorted({kind for segments, kind in signatures if not segments})
        waiting: dict[tuple[int, str], list[tuple[Segments, str]]] = {}
        for segments, kind in signatures:
            if segments:
                at, magic = segments[0]
                waiting.setdefault((at, magic[:2]), []).append((segments, kind))
        # branches at one offset exclude each other
        self.branches: dict[int, list[tuple[str, "Trie"]]] = {}
        for (at, _), group in sorted(waiting.items()):
            shared = _shared([segments[0][1] for segments, _ in group])
            rest = [(_after(segments, len(shared)), kind) for segments, kind in group]
            self.branches.setdefault(at, []).append((shared, Trie(rest)))

    def found(self, head: Column) -> Column:
        """The types of all signatures in ``head`` (hexadecimal)."""
        parts = [F.array(*[F.lit(kind) for kind in self.types])] if self.types else []
        for at, branches in self.branches.items():
            chosen = None
            for magic, below in branches:
                met = F.substring(head, 2 * at + 1, len(magic)) == magic
                chosen = F.when(met, below.found(head)) if chosen is None else chosen.when(met, below.found(head))
            parts.append(F.coalesce(chosen, F.array().cast("array<string>")))
        return parts[0] if len(parts) == 1 else F.concat(*parts)


def _shared(words: list[str]) -> str:
    size = 0
    while all(len(w) > size for w in words) and len({w[size : size + 2] for w in words}) == 1:
        size += 2
    return words[0][:size]


def _after(segments: Segments, size: int) -> Segments:
    (at, magic), *rest = segments
    return ((at + size // 2, magic[size:]), *rest) if len(magic) > size else tuple(rest)


@cache
def known() -> Trie:
    return Trie(MAGIC_BYTES)
