"""Media types, and the wording of probed media values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names, signatures
from .constants import MODEL_ALIASES, UNKNOWN_TYPE

HEAD_BYTES = 512


def _literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def guess_content_type(file_name: Column, types: dict[str, str] | None = None) -> Column:
    """Media type by extension (of the last path segment), out of ``types`` or the public table (``signatures.read_types`` reads larger ones)."""
    base = F.element_at(F.split(file_name, "/", -1), -1)
    extension = F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1))
    return F.coalesce(_literal_map(signatures.public_types() if types is None else types)[extension], F.lit(UNKNOWN_TYPE))


def _useless(content_type: Column) -> Column:
    return content_type.isNull() | (names.trimmed(content_type) == "") | (content_type == UNKNOWN_TYPE)


def effective_type(content_type: Column, file_name: Column) -> Column:
    return F.when(_useless(content_type), guess_content_type(file_name)).otherwise(content_type)


def document_kind(content_type: Column, file_name: Column) -> Column:
    kind = effective_type(content_type, file_name)
    low = F.lower(kind)
    return (
        F.when(low.startswith("image/"), "Image")
        .when(low.startswith("video/"), "Video")
        .when(low.startswith("audio/"), "Audio")
        .when(kind == "application/pdf", "Pdf")
        .when(low.startswith("text/") | kind.isin("application/json", "application/xml"), "Text")
        .otherwise("Other")
    )


def kind_label(kind: Column) -> Column:
    return _literal_map(
        {"Image": "Images", "Video": "Video", "Audio": "Audio", "Text": "Text", "Pdf": "PDF", "Other": "Other"}
    )[kind]


def can_analyze(content_type: Column, file_name: Column) -> Column:
    low = F.lower(effective_type(content_type, file_name))
    return ~low.contains("svg") & (
        low.startswith("image/") | low.startswith("video/") | low.startswith("audio/")
    )


def detect_type(content: Column) -> Column:
    """Media type the leading bytes prove; null when no signature, or two disagreeing ones, match."""
    head = F.hex(F.substring(content.cast("binary"), 1, HEAD_BYTES))
    hits = F.array_distinct(signatures.known().found(head))
    return F.when(F.size(hits) == 1, hits[0])


def resolve_content_type(declared: Column, file_name: Column, content: Column) -> Column:
    return F.coalesce(detect_type(content), effective_type(declared, file_name))


def normalize_model(model: Column) -> Column:
    """Canonical detector name; null for the worker's default; an unknown name fails the query."""
    word = F.lower(names.trimmed(model))
    default = model.isNull() | (names.trimmed(model) == "") | (F.lower(model) == "default")
    known = _literal_map(MODEL_ALIASES)[word]
    return F.when(default, F.lit(None).cast("string")).otherwise(
        F.coalesce(
            known,
            F.raise_error(F.concat(F.lit("Unknown detection model '"), word, F.lit("'."))).cast("string"),
        )
    )


# --- wording ------------------------------------------------------------------------------------


def fixed(value: Column, digits: int) -> Column:
    """Number text with exactly ``digits`` decimals, half away from zero on the decimal reading.

    Going through a decimal first means 0.405 held as 0.40499999999999997 still reads 0.41.
    """
    return F.round(value.cast("decimal(30,9)"), digits).cast(f"decimal(30,{digits})").cast("string")


def trimmed(value: Column, digits: int) -> Column:
    """:func:`fixed` without trailing zeros."""
    return F.rtrim(F.rtrim(fixed(value, digits), F.lit("0")), F.lit("."))


def fmt_duration(seconds: Column) -> Column:
    whole = F.floor(seconds)
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    second, minute, hour = whole % 60, F.floor(whole / 60) % 60, F.floor(whole / 3600) % 24
    return (
        F.when(seconds < 60, F.concat(trimmed(seconds, 2), F.lit(" s")))
        .when(seconds < 3600, F.concat(minute.cast("string"), F.lit(":"), two(second)))
        .otherwise(F.concat(hour.cast("string"), F.lit(":"), two(minute), F.lit(":"), two(second)))
    )


def fmt_bitrate(bits_per_second: Column) -> Column:
    return F.when(
        bits_per_second >= 1_000_000, F.concat(trimmed(bits_per_second / 1e6, 2), F.lit(" Mbit/s"))
    ).otherwise(F.concat(trimmed(bits_per_second / 1e3, 1), F.lit(" kbit/s")))


def fmt_frame_rate(numerator: Column, denominator: Column) -> Column:
    usable = (numerator != 0) & (denominator != 0)
    rate = numerator.cast("double") / F.when(denominator != 0, denominator)
    return F.when(usable, F.concat(trimmed(rate, 2), F.lit(" fps")))


def fmt_aspect(numerator: Column, denominator: Column) -> Column:
    usable = (numerator != 0) & (denominator != 0)
    return F.when(usable, F.concat(numerator.cast("string"), F.lit(":"), denominator.cast("string")))


def fmt_sample_rate(hertz: Column) -> Column:
    return F.concat(trimmed(hertz / 1e3, 1), F.lit(" kHz"))


def fmt_dimensions(width: Column, height: Column) -> Column:
    return F.concat(width.cast("string"), F.lit(" x "), height.cast("string"), F.lit(" px"))


def capitalise(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def stream_label(kind: Column, ordinal: Column) -> Column:
    return F.when(ordinal > 1, F.concat(capitalise(kind), F.lit(" "), ordinal.cast("string"))).otherwise(
        capitalise(kind)
    )


def meaningful(value: Column) -> Column:
    """The trimmed value, or null for blanks and probe placeholders."""
    return F.when((names.trimmed(value) != "") & ~value.isin("N/A", "unknown"), names.trimmed(value))


def put_if_meaningful(entries: Column, key: Column, value: Column) -> Column:
    kept = meaningful(value)
    return F.when(kept.isNull(), entries).otherwise(F.map_concat(entries, F.create_map(key, kept)))


def only_present(entries: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def human_size(size: Column) -> Column:
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(size < kb, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < mb, F.concat(trimmed(size / kb, 1), F.lit(" KB")))
        .when(size < gb, F.concat(trimmed(size / mb, 1), F.lit(" MB")))
        .otherwise(F.concat(trimmed(size / gb, 1), F.lit(" GB")))
    )


def table_size(size: Column) -> Column:
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(size >= gb, F.concat(fixed(size / gb, 1), F.lit(" GB")))
        .when(size >= mb, F.concat(fixed(size / mb, 1), F.lit(" MB")))
        .when(size >= kb, F.concat(fixed(size / kb, 0), F.lit(" kB")))
        .otherwise(F.concat(size.cast("string"), F.lit(" B")))
    )


def throughput_text(bits_per_second: Column, total_bytes: Column) -> Column:
    """Measured rate; else how much arrived; else a dash for a source with no stream."""
    return (
        F.when(bits_per_second >= 1e6, F.concat(fixed(bits_per_second / 1e6, 1), F.lit(" Mb/s")))
        .when(bits_per_second.isNotNull(), F.concat(fixed(bits_per_second / 1e3, 0), F.lit(" kb/s")))
        .when(total_bytes.isNull(), F.lit("—"))
        .otherwise(table_size(total_bytes))
    )
