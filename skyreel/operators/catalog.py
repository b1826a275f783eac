"""The document catalog: reading, writing, reconciling with the object store, retention, parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media, names
from ..functions.constants import DETECTION_KEY, STARTED_KEY, STREAM_KEY
from ..schemas import PART
from . import asof
from .ordered import Lane, block, lane, running

# --- reading and encoding -----------------------------------------------------------------------


def list_documents(catalog: DataFrame) -> DataFrame:
    """Newest first; equal instants by id."""
    return catalog.orderBy(F.desc("created_at"), "id")


def get_document(catalog: DataFrame, doc_id: str) -> DataFrame:
    return catalog.where(F.col("id") == doc_id)


def decode_metadata(text: Column) -> Column:
    """JSON object text as a map; blank or malformed text is an empty map."""
    empty = F.create_map().cast("map<string,string>")
    parsed = F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, empty)


def decode_parts(text: Column) -> Column:
    """JSON array text as parts; blank is empty, malformed fails: a lost list loses a recording."""
    blank = text.isNull() | (F.trim(text) == "")
    parsed = F.from_json(text, f"array<{PART.simpleString()}>")
    failure = F.raise_error(F.concat(F.lit("this is no list of parts: "), text))
    return (
        F.when(blank, F.array().cast(f"array<{PART.simpleString()}>"))
        .when(parsed.isNull() & (F.trim(text) != "null"), failure.cast(f"array<{PART.simpleString()}>"))
        .otherwise(F.coalesce(parsed, F.array().cast(f"array<{PART.simpleString()}>")))
    )


def encode_metadata(metadata: Column) -> Column:
    return F.when(metadata.isNull() | (F.size(metadata) <= 0), F.lit("{}")).otherwise(F.to_json(metadata))


def encode_parts(parts: Column) -> Column:
    return F.when(parts.isNull() | (F.size(parts) <= 0), F.lit("[]")).otherwise(F.to_json(parts))


def decode_catalog(df: DataFrame, metadata: str = "metadata", parts: str | None = None) -> DataFrame:
    out = df.withColumn(metadata, decode_metadata(F.col(metadata)))
    return out if parts is None else out.withColumn(parts, decode_parts(F.col(parts)))


def document_response(catalog: DataFrame, part_count: str) -> DataFrame:
    """The listing's projection: preview and segmentation as flags."""
    return catalog.select(
        "id",
        "file_name",
        "size",
        "created_at",
        F.col("thumbnail_key").isNotNull().alias("has_thumbnail"),
        (F.coalesce(F.col(part_count), F.lit(0)) > 0).alias("segmented"),
    )


def search_documents(
    catalog: DataFrame, as_of: Column, text: str = "", kind: str | None = None, when: str | None = None
) -> DataFrame:
    """Name contains ``text``, kind label equals ``kind``, created today / in the last 7 or 30 days."""
    out = catalog
    if text.strip():
        out = out.where(F.contains(F.lower("file_name"), F.lit(text.strip().lower())))
    if kind is not None:
        label = media.kind_label(media.document_kind(F.col("content_type"), F.col("file_name")))
        out = out.where(label == kind)
    created = F.col("created_at")
    if when == "today":
        out = out.where(F.to_date(created) == F.to_date(as_of))
    elif when in ("7 days", "30 days"):
        out = out.where(created > as_of - F.expr(f"interval {when}"))
    return out


# --- writing ------------------------------------------------------------------------------------


def duplicate_ids(new: DataFrame, catalog: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` whose key the catalog already holds: what an insert has to refuse."""
    return new.join(catalog.select(key), key, "left_semi")


def append_documents(new: DataFrame, catalog: DataFrame, key: str = "id") -> DataFrame:
    """The catalog with the unheard-of rows of ``new``; :func:`duplicate_ids` names the refused ones."""
    return catalog.unionByName(new.join(catalog.select(key), key, "left_anti"))


def upsert_documents(changes: DataFrame, catalog: DataFrame, order: str, key: str = "id") -> DataFrame:
    """Whole-row replacement by key; of several changes to one key the last by ``order`` stays.

    Changes are reduced per key before they meet the catalog, so a key changed a million times costs one
    row, and the catalog itself is only filtered.
    """
    last = changes.groupBy(key).agg(F.max_by(F.struct(*catalog.columns), F.col(order)).alias("row")).select("row.*")
    return catalog.join(last.select(key), key, "left_anti").unionByName(last)


def delete_documents(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """The catalog without ``ids``; an id that is not there is not an error."""
    return catalog.join(ids.select("id").distinct(), "id", "left_anti")


def deletion_keys(catalog: DataFrame, parts: DataFrame, ids: DataFrame) -> DataFrame:
    """Object keys to drop before the rows of ``ids``: own object, previews, every part.

    ``catalog(id, storage_key, thumbnail_key)``, ``parts(id, key)``.
    """
    gone = ids.select("id").distinct()
    doomed = catalog.join(gone, "id", "left_semi")
    own = doomed.select(
        "id", F.explode(F.array_compact(F.array("storage_key", "thumbnail_key"))).alias("key")
    )
    return own.unionByName(parts.join(gone, "id", "left_semi").select("id", "key"))


# --- reconciliation -----------------------------------------------------------------------------


def import_objects(listing: DataFrame) -> DataFrame:
    """Catalog rows for objects nobody told us about. ``listing(key, size, last_modified)``."""
    name = names.file_name_from_key(F.col("key"))
    return listing.select(
        names.document_id_for_key(F.col("key")).alias("id"),
        name.alias("file_name"),
        F.col("key").alias("storage_key"),
        media.guess_content_type(name).alias("content_type"),
        F.col("size"),
        F.col("last_modified").alias("created_at"),
    )


RECONCILED = ("id", "file_name", "storage_key", "content_type", "size", "created_at", "segmented")


def reconcile(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """What the store says about the catalog: one row per Added, Updated or Removed document.

    ``listing(key, size, last_modified)`` is the truth; ``catalog(id, file_name, storage_key,
    content_type, size, created_at, segmented)``.  Documents stored in parts live elsewhere and are left
    out; a changed size is an update that keeps the row's identity, and every other column of the catalog with it.
    """
    stored = listing.select(
        F.col("key").alias("s_key"), F.col("size").alias("s_size"), F.col("last_modified").alias("s_at")
    )
    known = catalog.where(~F.col("segmented"))
    both = known.join(stored, F.col("storage_key") == F.col("s_key"), "full_outer")
    change = (
        F.when(F.col("storage_key").isNull(), "Added")
        .when(F.col("s_key").isNull(), "Removed")
        .when(F.col("size") != F.col("s_size"), "Updated")
    )
    key = F.coalesce("storage_key", "s_key")
    new_name = names.file_name_from_key(key)
    return (
        both.withColumn("change", change)
        .where(F.col("change").isNotNull())
        .select(
            "change",
            F.coalesce("id", names.document_id_for_key(key)).alias("id"),
            key.alias("storage_key"),
            F.coalesce("file_name", new_name).alias("file_name"),
            F.when(F.col("change") == "Added", media.guess_content_type(new_name))
            .otherwise(F.col("content_type"))
            .alias("content_type"),
            F.coalesce("s_size", "size").alias("size"),
            F.coalesce("created_at", "s_at").alias("created_at"),
            *[c for c in catalog.columns if c not in RECONCILED],
        )
    )


def analysis_requests(changes: DataFrame) -> DataFrame:
    """What an analyser gets to do after a reconciliation: every document that is new or whose bytes were replaced."""
    return changes.where(F.col("change").isin("Added", "Updated")).select("id", "storage_key", "file_name", "content_type")


def reconciliation_summary(changes: DataFrame) -> DataFrame:
    tally = changes.agg(
        *[F.count_if(F.col("change") == kind).alias(kind.lower()) for kind in ("Added", "Updated", "Removed")]
    )
    return tally.withColumn("any_changes", F.col("added") + F.col("updated") + F.col("removed") > 0)


def change_feed(changes: DataFrame) -> DataFrame:
    """Reconciliation results as feed events."""
    return changes.select(F.col("change").alias("kind"), "id", F.col("storage_key").alias("key"), F.col("file_name").alias("name"))


def duplicate_storage_keys(catalog: DataFrame, key: str = "storage_key") -> DataFrame:
    """Violations of the catalog's one-row-per-object rule."""
    return catalog.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def dangling_references(catalog: DataFrame, parts: DataFrame, listing: DataFrame) -> DataFrame:
    """Keys the catalog names (own object, thumbnail, parts) that the store does not hold."""
    referenced = (
        catalog.select("id", F.lit("object").alias("role"), F.col("storage_key").alias("key"))
        .unionByName(
            catalog.where("thumbnail_key is not null").select(
                "id", F.lit("thumbnail").alias("role"), F.col("thumbnail_key").alias("key")
            )
        )
        .unionByName(parts.select("id", F.lit("part").alias("role"), "key"))
    )
    return referenced.join(listing.select("key"), "key", "left_anti").select("id", "role", "key")


# --- retention ----------------------------------------------------------------------------------


def retention_candidates(catalog: DataFrame, cutoff: Column | None) -> DataFrame:
    """Stream-produced documents created at or before ``cutoff``; no cutoff keeps everything."""
    if cutoff is None:
        return catalog.where(F.lit(False))
    return catalog.where(F.map_contains_key("metadata", F.lit(STREAM_KEY)) & (F.col("created_at") <= cutoff))


def retention_sweep(catalog: DataFrame, registry: DataFrame, cutoff: Column | None) -> DataFrame:
    """Candidates minus recordings still open. ``registry(name, recording_started)``, text as recorded."""
    open_now = registry.where("recording_started is not null").select(
        F.col("name").alias("o_stream"), F.col("recording_started").alias("o_started")
    )
    due = retention_candidates(catalog, cutoff)
    return due.join(
        open_now,
        (due["metadata"][STREAM_KEY] == F.col("o_stream")) & (due["metadata"][STARTED_KEY] == F.col("o_started")),
        "left_anti",
    )


def abandoned_entries(registry: DataFrame, as_of_us: Column, abandoned_us: int) -> DataFrame:
    return registry.where(as_of_us - F.col("heartbeat_us") > F.lit(abandoned_us))


def retention_summary(expired: DataFrame, abandoned: DataFrame) -> DataFrame:
    counted = expired.select(F.lit(1).alias("d"), F.lit(0).alias("e")).unionByName(
        abandoned.select(F.lit(0).alias("d"), F.lit(1).alias("e"))
    )
    return counted.agg(
        F.coalesce(F.sum("d"), F.lit(0)).alias("documents"), F.coalesce(F.sum("e"), F.lit(0)).alias("entries")
    )


# --- analysis and detections --------------------------------------------------------------------


def merge_supplied(probed: Column, supplied: Column) -> Column:
    """Analysis: what the uploader supplied wins over what was probed."""
    return F.map_concat(probed, supplied)


def merge_recorded(first: Column, later: Column) -> Column:
    """Recording: what is known later wins."""
    return F.map_concat(first, later)


def merge_analysis(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog rows with fresh analysis. ``results(id, probed map, thumbnail)``; empty results do nothing."""
    useful = results.where(F.col("thumbnail").isNotNull() | (F.size("probed") > 0))
    return catalog.join(useful, "id").select(
        "id",
        F.col("thumbnail").alias("thumbnail_key"),
        merge_supplied(F.col("probed"), F.col("metadata")).alias("metadata"),
    )


def orphan_thumbnails(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """Previews of documents deleted while they were analysed."""
    return results.where("thumbnail is not null").join(catalog.select("id"), "id", "left_anti").select("id", "thumbnail")


def find_by_detection(catalog: DataFrame, reference: str) -> DataFrame:
    return catalog.where(F.col("metadata")[DETECTION_KEY] == reference)


def documents_by_detection(detections: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every (detection, document) pair that names each other. ``detections(reference, ...)``."""
    documents = catalog.select(F.col("id"), F.col("metadata")[DETECTION_KEY].alias("reference")).where(
        "reference is not null"
    )
    return detections.join(documents, "reference")


# --- parts --------------------------------------------------------------------------------------


def part_lane(block_parts: int = 4_096) -> Lane:
    return lane("doc_no", "part_no", block("part_no", block_parts))


def part_offsets(parts: DataFrame) -> DataFrame:
    """``parts(doc_no, part_no, size)`` with each part's first byte and the byte after its last."""
    placed = running(parts, part_lane(), inclusive=False, start_byte=("sum", F.col("size")))
    return placed.withColumn("end_byte", F.col("start_byte") + F.col("size"))


def assemble_parts(parts: DataFrame) -> DataFrame:
    """One row per segmented document: its total size and part count. No parts, no document."""
    return parts.groupBy("doc_no").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("part_count"))


def part_lists(parts: DataFrame, key: Column) -> DataFrame:
    """The whole ordered part list of each document, one row a document."""
    return part_slices(parts, key, None).drop("slice_no")


def part_slices(parts: DataFrame, key: Column, per_slice: int | None = 1_000) -> DataFrame:
    """Part lists as they are stored: consecutive slices of at most ``per_slice`` parts."""
    slice_no = F.lit(0).cast("long") if per_slice is None else F.floor((F.col("part_no") - 1) / F.lit(per_slice))
    entry = F.struct(F.col("part_no"), key.alias("key"), F.col("size"))
    return (
        parts.withColumn("slice_no", slice_no)
        .groupBy("doc_no", "slice_no")
        .agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        .select(
            "doc_no", "slice_no",
            F.transform("entries", lambda e: F.struct(e["key"].alias("key"), e["size"].alias("size"))).alias("parts"),
        )
    )


def locate_position(offsets: DataFrame, positions: DataFrame, block_bytes: int) -> DataFrame:
    """The part that holds each byte position. ``positions(doc_no, position, ...)``.

    An as-of search on ``(document, byte)``: parts and positions of even one huge document spread over
    blocks of ``block_bytes``.  Positions past the end, or negative, have no part.
    """
    real = offsets.where("size > 0").select("doc_no", "part_no", "start_byte", "end_byte")
    found = asof.backward(positions, real, "doc_no", "position", "start_byte", "part_no", block_bytes, into="part")
    inside = F.col("part").isNotNull() & (F.col("position") < F.col("part.end_byte"))
    return found.select(
        *positions.columns,
        F.when(inside, F.col("part.part_no")).alias("part_no"),
        F.when(inside, F.col("position") - F.col("part.start_byte")).alias("offset_in_part"),
    )


PARTS_A_BLOCK = 1_024


def byte_range_plan(offsets: DataFrame, requests: DataFrame, block_bytes: int) -> DataFrame:
    """Reads that serve each ``requests(request_id, doc_no, from_byte, length)``: one row per part touched.

    First and last part are found by position, then every part in between is fetched by its number, so
    the work is the size of the answer.
    """
    total = offsets.groupBy("doc_no").agg(F.max("end_byte").alias("__end"))
    asked = (
        requests.join(total, "doc_no")
        .withColumn("__to", F.least(F.col("from_byte") + F.col("length"), F.col("__end")))
        .where((F.col("from_byte") >= 0) & (F.col("from_byte") < F.col("__to")))
        .select("request_id", "doc_no", "from_byte", "__to")
    )
    ends = F.array(
        F.struct(F.lit(True).alias("begins"), F.col("from_byte").alias("position")),
        F.struct(F.lit(False).alias("begins"), (F.col("__to") - 1).alias("position")),
    )
    both = asked.withColumn("__e", F.explode(ends)).select(*asked.columns, "__e.begins", "__e.position")
    found = locate_position(offsets, both, block_bytes)
    side = lambda begins: F.max(F.when(F.col("begins") if begins else ~F.col("begins"), F.col("part_no")))
    spans = found.groupBy("request_id", "doc_no", "from_byte", "__to").agg(side(True).alias("__a"), side(False).alias("__z"))
    # a block at a time, so that no row holds the numbers of a whole recording
    blocks = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__a") / PARTS_A_BLOCK), F.floor(F.col("__z") / PARTS_A_BLOCK))))
    inside = F.sequence(F.greatest("__a", F.col("__b") * PARTS_A_BLOCK), F.least(F.col("__z"), F.col("__b") * PARTS_A_BLOCK + PARTS_A_BLOCK - 1))
    numbers = blocks.withColumn("part_no", F.explode(inside)).drop("__a", "__z", "__b")
    stored = offsets.where("size > 0").select("doc_no", "part_no", "start_byte", "end_byte")
    touched = numbers.join(stored, ["doc_no", "part_no"])
    begin = F.greatest("from_byte", "start_byte")
    return touched.select(
        "request_id",
        "doc_no",
        "part_no",
        (begin - F.col("start_byte")).alias("offset_in_part"),
        (F.least("__to", "end_byte") - begin).alias("read_length"),
    )
