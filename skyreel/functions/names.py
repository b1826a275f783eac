"""Names, keys and identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import NAME_REFUSALS

UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
NAME_PATTERN = r"^[A-Za-z0-9._/-]{1,128}$"
MAX_IDENTIFIER_BYTES = 512


def trimmed(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def sanitize_file_name(name: Column) -> Column:
    """Drop any client path; a name that is only blanks becomes ``file``."""
    bare = F.regexp_replace(last_segment(F.regexp_replace(name, r"\\", "/")), "\u0000", "_")
    return F.when(trimmed(bare) == "", F.lit("file")).otherwise(bare)


def file_name_from_key(key: Column) -> Column:
    last = last_segment(key)
    return F.when(trimmed(last) == "", key).otherwise(last)


def document_key(doc_id: Column, name: Column) -> Column:
    return F.concat(F.lit("documents/"), doc_id, F.lit("/"), name)


def thumbnail_key(doc_id: Column) -> Column:
    return F.concat(F.lit("thumbnails/"), doc_id, F.lit(".jpg"))


def part_key(doc_id: Column, number: Column, extension: Column | str) -> Column:
    """``recordings/{id}/{number, at least five digits}{extension}``."""
    ext = F.lit(extension) if isinstance(extension, str) else extension
    return F.concat(F.lit("recordings/"), doc_id, F.lit("/"), F.format_string("%05d", number.cast("long")), ext)


def document_id_for_key(key: Column) -> Column:
    """The id a key carries, else one derived from the key.

    Keys we wrote have the id as their second-last segment.  Any other key hashes to a GUID whose first
    three groups are little-endian, so a rescan of an object always finds the same row.
    """
    segments = F.split(key, "/", -1)
    embedded = F.when(F.size(segments) >= 2, F.element_at(segments, -2))
    digest = F.md5(key)
    pair = lambda i: F.substring(digest, 2 * i + 1, 2)
    derived = F.concat(
        pair(3), pair(2), pair(1), pair(0), F.lit("-"), pair(5), pair(4), F.lit("-"), pair(7), pair(6),
        F.lit("-"), F.substring(digest, 17, 4), F.lit("-"), F.substring(digest, 21, 12),
    )
    return F.when(embedded.rlike(UUID_PATTERN), F.lower(embedded)).otherwise(derived)


def capture_file_name(stream: Column, at: Column, extension: str = ".ts") -> Column:
    """Stream name flattened, then the capture second."""
    flat = F.regexp_replace(F.regexp_replace(stream, "/", "-"), "\u0000", "_")
    return F.concat(flat, F.lit("-"), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit(extension))


def detection_reference(stream: Column, at: Column, target: Column) -> Column:
    """One line naming a detection: the stream, the microsecond, the target number."""
    moment = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.concat(stream, F.lit("@"), moment, F.lit("#"), target.cast("string"))


def second_text(at: Column) -> Column:
    """The universal sortable rendering, which recordings and registry rows share."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss'Z'")


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def scheme_of(url: Column) -> Column:
    """Text before ``://`` in lower case; a path without one is a file."""
    at = F.instr(url, "://")
    return F.when(at > 1, F.lower(F.substring_index(url, "://", 1))).otherwise(F.lit("file"))


def scheme_allowed(url: Column, allowed: list[str]) -> Column:
    blank = url.isNull() | (trimmed(url) == "")
    return ~blank & F.coalesce(scheme_of(url).isin([a.lower() for a in allowed]), F.lit(False))


def local_output(name: Column, base: str) -> Column:
    """Where a viewer pulls a stream from; the name is percent-escaped, spaces included."""
    escaped = F.regexp_replace(F.regexp_replace(F.url_encode(name), r"\+", "%20"), r"\*", "%2A")
    return F.concat(F.lit(base.rstrip("/") + "?streamid="), F.regexp_replace(escaped, "%7E", "~"))


# --- stream names and identifiers ---------------------------------------------------------------


def _described(candidate: Column) -> Column:
    return F.when(F.length(candidate) <= 64, candidate).otherwise(
        F.concat(F.substring(candidate, 1, 64), F.lit("..."))
    )


def name_rejection(candidate: Column) -> Column:
    """Why a bare name cannot be a stream name, or null."""
    quoted = F.concat(F.lit(NAME_REFUSALS["unusable"][0]), _described(candidate), F.lit(NAME_REFUSALS["unusable"][1]))
    slashes = (
        candidate.startswith("/")
        | candidate.endswith("/")
        | candidate.contains("//")
        | F.array_contains(F.split(candidate, "/", -1), "..")
    )
    return F.when(
        ~candidate.rlike(NAME_PATTERN),
        F.concat(quoted, F.lit(NAME_REFUSALS["letters"])),
    ).when(
        slashes,
        F.concat(quoted, F.lit(NAME_REFUSALS["slashes"])),
    )


def _presented(identifier: Column) -> Column:
    """Identifier without padding NULs and white space, with the percent-escaped envelope undone."""
    bare = trimmed(F.regexp_replace(identifier, "\u0000+$", ""))
    return F.when(bare.startswith("%23!::"), F.concat(F.lit("#!::"), bare.substr(F.lit(7), F.length(bare)))).otherwise(bare)


def envelope_pairs(content: Column) -> Column:
    """``k=v,k=v`` as a map; parts without a key are ignored and a repeated key keeps its last value."""
    parts = F.filter(F.split(content, ",", -1), lambda p: F.instr(p, "=") > 1)
    # LAST_WIN on duplicate keys is part of the session's configuration.
    return F.map_from_entries(
        F.transform(
            parts,
            lambda p: F.struct(
                F.substring_index(p, "=", 1).alias("key"),
                p.substr(F.instr(p, "=") + 1, F.length(p)).alias("value"),
            ),
        )
    )


def _strict_pairs(identifier: Column) -> Column:
    return F.when(identifier.startswith("#!::"), envelope_pairs(identifier.substr(F.lit(5), F.length(identifier))))


def parse_stream_id(identifier: Column, intent: str = "publish") -> Column:
    """``struct(name, rejection)`` of a presented identifier; exactly one of the two is null."""
    value = _presented(identifier)
    enveloped = value.startswith("#!::")
    pairs = envelope_pairs(value.substr(F.lit(5), F.length(value)))
    refused_mode, refusal = {"publish": "request", "subscribe": "publish"}[intent], NAME_REFUSALS[intent]
    candidate = F.when(enveloped, pairs["r"]).otherwise(value)
    rejection = (
        F.when(identifier.isNull(), F.lit(NAME_REFUSALS["none"]))
        .when(
            F.octet_length(identifier) > MAX_IDENTIFIER_BYTES,
            F.lit(NAME_REFUSALS["long"].format(most=MAX_IDENTIFIER_BYTES)),
        )
        .when(value == "", F.lit(NAME_REFUSALS["empty"]))
        .when(enveloped & F.coalesce(pairs["m"] == refused_mode, F.lit(False)), F.lit(refusal))
        .when(
            enveloped & pairs["r"].isNull(),
            F.lit(NAME_REFUSALS["no resource"]),
        )
        .otherwise(name_rejection(candidate))
    )
    return F.struct(F.when(rejection.isNull(), candidate).alias("name"), rejection.alias("rejection"))


def preroll_position(identifier: Column) -> Column:
    """Seconds a viewer asked to start back from the live edge, or null."""
    asked = trimmed(_strict_pairs(identifier)["user_from"]).try_cast("double")
    return F.when(asked > 0, asked)


def carries_session_key(identifier: Column) -> Column:
    return F.coalesce(F.map_contains_key(_strict_pairs(identifier), "s"), F.lit(False))
