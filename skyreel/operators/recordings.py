"""Recordings: what a document says about the capture that made it, when captures open, extend and roll."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import media, names
from ..functions.constants import (
    DETECTION_KEY,
    NOTE_FAILED,
    NOTE_FAILED_TRUNCATED,
    NOTE_TRUNCATED,
    STARTED_KEY,
    STREAM_KEY,
)


def recording_metadata(
    stream: Column,
    started: Column,
    seconds: Column,
    parts: Column,
    failed: Column,
    truncated: Column,
    classification: Column,
    detection: Column,
) -> Column:
    """The metadata map of a recording; what does not apply is absent."""
    note = (
        F.when(failed & truncated, NOTE_FAILED_TRUNCATED).when(failed, NOTE_FAILED).when(truncated, NOTE_TRUNCATED)
    )
    entries = {
        STREAM_KEY: stream,
        STARTED_KEY: names.second_text(started),
        "Duration": media.fmt_duration(seconds),
        "Recording parts": F.when(parts > 1, parts.cast("string")),
        "Recording": note,
        "Classification": classification,
        DETECTION_KEY: detection,
    }
    return media.only_present(F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)]))


def snapshot_metadata(stream: Column, taken: Column, note: Column, classification: Column, detection: Column) -> Column:
    entries = {
        STREAM_KEY: stream,
        "Captured": names.second_text(taken),
        "Snapshot": note,
        "Classification": classification,
        DETECTION_KEY: detection,
    }
    return media.only_present(F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)]))
