"""Catalog queries: listing, writing, reconciliation, retention, parts, byte ranges."""

from pyspark.sql import functions as F

from ..functions import media, names
from ..functions.constants import DETECTION_KEY, STARTED_KEY, STREAM_KEY
from ..operators import catalog as ops
from ..session import cut_lineage
from . import shapes
from .registry import query
from .shapes import with_shapes

CATALOG = with_shapes("catalog")
CUTOFF = "1999-06-30 00:00:00"
NTZ = lambda text: F.lit(text).cast("timestamp_ntz")


def with_metadata(documents, started=None):
    """Catalog rows with the metadata map their producer writes."""
    entries = {STREAM_KEY: F.col("stream")}
    if started is not None:
        entries[STARTED_KEY] = started
    pairs = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])
    return documents.withColumn("metadata", media.only_present(pairs))


def flat(documents):
    return documents.select("id", "file_name", "storage_key", "size", "created_at", "thumbnail_key")


FLAT = "id, file_name, storage_key, size, created_at, thumbnail_key"


@query("s02_list_documents", f"{CATALOG} select {FLAT} from catalog order by created_at desc, id")
def _(t):
    return flat(ops.list_documents(shapes.catalog(t)))


@query("s03_get_document", f"{CATALOG} select {FLAT} from catalog where id = '1234'")
def _(t):
    narrowed = shapes.catalog(t).where("doc_no = 1234")  # the number the id is made of: reaches the scan
    return flat(ops.get_document(narrowed, "1234"))


@query(
    "s04_decode_catalog",
    """select event_id, case when json_valid(text) then json_extract_string(text, '$.k') end as k,
  case when json_valid(text) then len(json_keys(text)) else 0 end as entries
from (select event_id, case when event_id % 10 = 0 then substr(props, 1, 4) when event_id % 10 = 1 then ''
    else props end as text from events)""",
)
def _(t):
    text = (
        F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 4))
        .when(F.col("event_id") % 10 == 1, "")
        .otherwise(F.col("props"))
    )
    decoded = ops.decode_catalog(t.events.select("event_id", text.alias("metadata")))
    return decoded.select("event_id", F.col("metadata")["k"].alias("k"), F.size("metadata").alias("entries"))


@query(
    "s05_encode_catalog",
    """select event_id, case when event_id % 3 = 0 then '{}' else '{"kind":"' || event_type || '"}' end as metadata,
  case when event_id % 2 = 0 then '[]' else '[{"key":"recordings/' || event_id || '/00000.ts","size":' || user_id || '}]' end
    as parts from events""",
)
def _(t):
    metadata = F.when(F.col("event_id") % 3 != 0, F.create_map(F.lit("kind"), F.col("event_type")))
    part = F.struct(
        names.part_key(F.col("event_id").cast("string"), F.lit(0), ".ts").alias("key"), F.col("user_id").alias("size")
    )
    parts = F.when(F.col("event_id") % 2 != 0, F.array(part))
    return t.events.select(
        "event_id", ops.encode_metadata(metadata).alias("metadata"), ops.encode_parts(parts).alias("parts")
    )


@query(
    "s06_append_documents",
    f"""{CATALOG}, held as (select * from catalog where doc_no % 10 <> 0),
  fresh as (select * from catalog where doc_no % 5 = 0)
select {FLAT} from held union all select {FLAT} from fresh where id not in (select id from held)""",
)
def _(t):
    documents = shapes.catalog(t)
    return flat(ops.append_documents(documents.where("doc_no % 5 = 0"), documents.where("doc_no % 10 <> 0")))


@query(
    "s06_refused_duplicates",
    f"""{CATALOG} select id, storage_key from catalog where doc_no % 5 = 0 and doc_no % 10 <> 0""",
)
def _(t):
    documents = shapes.catalog(t)
    refused = ops.duplicate_ids(documents.where("doc_no % 5 = 0"), documents.where("doc_no % 10 <> 0"))
    return refused.select("id", "storage_key")


@query(
    "s07_upsert_documents",
    f"""{CATALOG}, changes as (
    select id, file_name, storage_key, size + 1 as size, created_at, thumbnail_key from catalog where doc_no % 4 = 0
      and doc_no % 8 <> 0
    union all select id, 'renamed', storage_key, size, created_at, thumbnail_key from catalog where doc_no % 8 = 0)
select * from changes union all select {FLAT} from catalog where id not in (select id from changes)""",
)
def _(t):
    documents = flat(shapes.catalog(t)).withColumn("doc_no", F.col("id").cast("long"))
    first = documents.where("doc_no % 4 = 0").withColumn("size", F.col("size") + 1).withColumn("version", F.lit(1))
    second = documents.where("doc_no % 8 = 0").withColumn("file_name", F.lit("renamed")).withColumn("version", F.lit(2))
    return flat(ops.upsert_documents(first.unionByName(second), documents, "version"))


@query("s08_delete_documents", f"{CATALOG} select {FLAT} from catalog where doc_no % 6 <> 0")
def _(t):
    documents = shapes.catalog(t)
    doomed = documents.where("doc_no % 6 = 0").select("id")
    return flat(ops.delete_documents(documents, doomed.unionByName(doomed)))


def keyed_parts(t):
    doc = F.col("doc_no").cast("string")
    return shapes.parts(t).select(doc.alias("id"), names.part_key(doc, F.col("part_no") - 1, ".ts").alias("key"))


KEYED = """keyed as (select cast(doc_no as varchar) as id,
    'recordings/' || doc_no || '/' || lpad(cast(part_no - 1 as varchar), 5, '0') || '.ts' as key from parts)"""


@query(
    "s08_deletion_keys",
    f"""{with_shapes("catalog", "parts")}, {KEYED},
  gone as (select id, storage_key, thumbnail_key from catalog where doc_no % 6 = 0)
select id, storage_key as key from gone union all select id, thumbnail_key from gone where thumbnail_key is not null
union all select id, key from keyed where id in (select id from gone)""",
)
def _(t):
    documents = shapes.catalog(t)
    return ops.deletion_keys(documents, keyed_parts(t), documents.where("doc_no % 6 = 0").select("id"))


# --- reconciliation -----------------------------------------------------------------------------


def snapshots(t):
    """The store has lost every 11th object, resized every 7th and gained ones outside our keys."""
    documents = shapes.catalog(t)
    held = documents.where("doc_no % 11 <> 0").select(
        F.when(F.col("doc_no") % 13 == 0, F.concat(F.lit("incoming/"), "file_name"))
        .otherwise(F.col("storage_key"))
        .alias("key"),
        (F.col("size") + F.when(F.col("doc_no") % 7 == 0, 5).otherwise(0)).alias("size"),
        F.col("created_at").alias("last_modified"),
    )
    known = documents.select("id", "file_name", "storage_key", "content_type", "size", "created_at", "doc_no")
    thumbnail = F.when(F.col("doc_no") % 3 == 0, names.thumbnail_key(F.col("id"))).alias("thumbnail_key")
    metadata = F.create_map(F.lit("Pages"), (F.col("doc_no") % 5).cast("string")).alias("metadata")
    return held, known.select("*", thumbnail, metadata, (F.col("doc_no") % 17 == 0).alias("segmented")).drop("doc_no")


SNAPSHOTS = f"""{CATALOG}, listing as (
    select case when doc_no % 13 = 0 then 'incoming/' || file_name else storage_key end as key,
      size + case when doc_no % 7 = 0 then 5 else 0 end as size, created_at as last_modified
    from catalog where doc_no % 11 <> 0),
  known as (select * from catalog where doc_no % 17 <> 0),
  changes as (select case when k.storage_key is null then 'Added' when l.key is null then 'Removed' else 'Updated' end
      as change, k.id, l.key, k.storage_key, k.file_name, k.size as old_size, l.size as new_size,
      coalesce(k.created_at, l.last_modified) as created_at
    from known k full join listing l on k.storage_key = l.key
    where k.storage_key is null or l.key is null or k.size <> l.size),
  hashed as (select *, md5(key) as h, split_part(key, '/', -2) as parent, split_part(key, '/', -1) as leaf from changes),
  diff as (select change, coalesce(id, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '-' ||
      substr(h, 11, 2) || substr(h, 9, 2) || '-' || substr(h, 15, 2) || substr(h, 13, 2) || '-' || substr(h, 17, 4) || '-' ||
      substr(h, 21, 12)) as id, coalesce(storage_key, key) as storage_key, coalesce(file_name, leaf) as file_name,
    case when change = 'Added' then case regexp_extract(leaf, '\\.([^.]*)$', 1) when 'pdf' then 'application/pdf'
      when 'mp4' then 'video/mp4' when 'jpg' then 'image/jpeg' when 'txt' then 'text/plain' when 'ts' then 'video/mp2t'
      when 'svg' then 'image/svg+xml' else 'application/octet-stream' end end as content_type,
    coalesce(new_size, old_size) as size, created_at from hashed)"""


@query(
    "j01_reconcile",
    f"""{SNAPSHOTS} select d.change, d.id, d.storage_key, d.file_name, d.content_type, d.size, d.created_at,
  case when k.doc_no % 3 = 0 then 'thumbnails/' || k.id || '.jpg' end as thumbnail_key, k.doc_no % 5 || '' as pages
from diff d left join known k on k.id = d.id and d.change <> 'Added'""",
)
def _(t):
    changes = ops.reconcile(*snapshots(t))
    return changes.withColumn("pages", F.col("metadata")["Pages"]).drop("metadata")


@query("j01_analysis_requests", f"{SNAPSHOTS} select id, storage_key, file_name, content_type from diff where change in ('Added', 'Updated')")
def _(t):
    return ops.analysis_requests(ops.reconcile(*snapshots(t)))


@query(
    "a02_reconciliation_summary",
    f"""{SNAPSHOTS} select count(*) filter (change = 'Added') as added, count(*) filter (change = 'Updated') as updated,
  count(*) filter (change = 'Removed') as removed, count(*) > 0 as any_changes from diff""",
)
def _(t):
    return ops.reconciliation_summary(ops.reconcile(*snapshots(t)))


@query(
    "s12_change_feed",
    f"{SNAPSHOTS} select change as kind, id, storage_key as key, file_name as name from diff",
)
def _(t):
    return ops.change_feed(ops.reconcile(*snapshots(t)))


@query(
    "u05_all_keys",
    f"""{SNAPSHOTS} select key, bool_or(stored) as stored, bool_or(cataloged) as cataloged from (
    select key, true as stored, false as cataloged from listing
    union all select storage_key, false, true from catalog) group by key""",
)
def _(t):
    listing, documents = snapshots(t)
    both = listing.select("key", F.lit(True).alias("stored"), F.lit(False).alias("cataloged")).unionByName(
        documents.select(F.col("storage_key").alias("key"), F.lit(False).alias("stored"), F.lit(True).alias("cataloged"))
    )
    return both.groupBy("key").agg(F.bool_or("stored").alias("stored"), F.bool_or("cataloged").alias("cataloged"))


@query("a21_unique_storage_key", "select url, count(*) as copies from pages group by url having count(*) > 1")
def _(t):
    return ops.duplicate_storage_keys(t.pages, "url")


@query(
    "j12_dangling_references",
    f"""{with_shapes("catalog", "parts")}, {KEYED},
  listing as (select storage_key as key from catalog where doc_no % 9 <> 0
    union all select thumbnail_key from catalog where doc_no % 2 = 0 and thumbnail_key is not null
    union all select key from keyed where cast(id as bigint) % 5 <> 0),
  referenced as (select id, 'object' as role, storage_key as key from catalog
    union all select id, 'thumbnail', thumbnail_key from catalog where thumbnail_key is not null
    union all select id, 'part', key from keyed)
select id, role, key from referenced where key not in (select key from listing)""",
)
def _(t):
    documents, parts = shapes.catalog(t), keyed_parts(t)
    listing = (
        documents.where("doc_no % 9 <> 0").select(F.col("storage_key").alias("key"))
        .unionByName(documents.where("doc_no % 2 = 0 and thumbnail_key is not null").select(F.col("thumbnail_key").alias("key")))
        .unionByName(parts.where("cast(id as long) % 5 <> 0").select("key"))
    )
    return ops.dangling_references(documents, parts, listing)


# --- retention ----------------------------------------------------------------------------------


@query(
    "p23_retention_candidates",
    f"{CATALOG} select id, stream, created_at from catalog where stream is not null and created_at <= timestamp '{CUTOFF}'",
)
def _(t):
    due = ops.retention_candidates(with_metadata(shapes.catalog(t)), NTZ(CUTOFF))
    return due.select("id", "stream", "created_at")


SWEEP = f"""{with_shapes("catalog", "beats", "registry")}, started as (
    select *, strftime(created_at, '%Y-%m-%d %H:%M:%SZ') as started from catalog),
  open_now as (select name, strftime(max(created_at), '%Y-%m-%d %H:%M:%SZ') as started from catalog
    join registry on stream = name where created_at <= timestamp '{CUTOFF}' and recording_us is not null group by name),
  swept as (select id, stream, created_at from started s where stream is not null
    and created_at <= timestamp '{CUTOFF}'
    and not exists (select 1 from open_now o where o.name = s.stream and o.started = s.started))"""


def swept(t):
    documents = with_metadata(shapes.catalog(t), names.second_text(F.col("created_at")))
    recording = shapes.registry(t).where("recording_us is not null").select("name")
    # Whoever records now has been at it since the newest old document of that stream.
    since = (
        documents.where(F.col("created_at") <= NTZ(CUTOFF)).groupBy(F.col("stream").alias("name"))
        .agg(names.second_text(F.max("created_at")).alias("recording_started"))
    )
    open_now = recording.join(since, "name")
    return ops.retention_sweep(documents, open_now, NTZ(CUTOFF)).select("id", "stream", "created_at")


@query("j02_retention_sweep", f"{SWEEP} select * from swept")
def _(t):
    return swept(t)


@query(
    "a03_retention_summary",
    f"""{SWEEP} select (select count(*) from swept) as documents,
  (select count(*) from registry where {shapes.AS_OF_US} - heartbeat_us > 86400000000) as entries""",
)
def _(t):
    abandoned = ops.abandoned_entries(shapes.registry(t), F.lit(shapes.AS_OF_US), shapes.DAY_US)
    return ops.retention_summary(swept(t), abandoned)


# --- projections over documents -----------------------------------------------------------------


@query(
    "p29_document_response",
    f"""{CATALOG}, pieces as (select l_orderkey as doc_no, count(*) as n from lineitem group by 1)
select id, file_name, size, created_at, thumbnail_key is not null as has_thumbnail, coalesce(n, 0) > 0 as segmented
from catalog left join pieces using (doc_no)""",
)
def _(t):
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_no")).agg(F.count(F.lit(1)).alias("part_count"))
    return ops.document_response(shapes.catalog(t).join(counts, "doc_no", "left"), "part_count")


@query(
    "p30_search_documents",
    f"""{CATALOG} select {FLAT} from catalog where contains(lower(file_name), 'oc-1') and (file_name like '%.mp4' or file_name like '%.ts')
  and created_at > timestamp '2000-01-01' - interval 30 days""",
)
def _(t):
    found = ops.search_documents(shapes.catalog(t), NTZ("2000-01-01 00:00:00"), " OC-1 ", "Video", "30 days")
    return flat(found)


@query(
    "p30_search_today",
    f"{CATALOG} select {FLAT} from catalog where cast(created_at as date) = date '1999-05-05'",
)
def _(t):
    return flat(ops.search_documents(shapes.catalog(t), NTZ("1999-05-05 12:00:00"), when="today"))


@query("t01_newest_first", f"{CATALOG} select id, created_at, row_number() over (order by created_at desc, id) as position from catalog")
def _(t):
    from ..operators.listing import positioned

    rows = shapes.catalog(t).select("id", "created_at", (-names.micros(F.col("created_at"))).alias("age"))
    return positioned(rows, ["age", "id"]).select("id", "created_at", "position")


@query(
    "t07_by_file_name",
    """select page_id, split_part(url, '/', -1) as file_name,
  row_number() over (order by upper(split_part(url, '/', -1)), page_id) as position from pages""",
)
def _(t):
    from ..operators.listing import positioned

    name = names.last_segment(F.col("url"))
    rows = t.pages.select("page_id", name.alias("file_name"), F.upper(name).alias("folded"))
    return positioned(rows, ["folded", "page_id"]).select("page_id", "file_name", "position")


# --- detections and analysis --------------------------------------------------------------------


def detections(t):
    return shapes.beats(t).select(
        names.detection_reference(F.col("name"), F.col("ts"), F.col("k") + 1).alias("reference"),
        F.col("seq").alias("detection_no"),
    )


def captured(t):
    """Documents that say which detection caused them: every third event produced one."""
    reference = names.detection_reference(F.col("name"), F.col("ts"), F.col("k") + 1)
    return shapes.beats(t).where("seq % 3 = 0").select(
        F.concat(F.lit("doc-"), F.col("seq").cast("string")).alias("id"),
        F.create_map(F.lit(DETECTION_KEY), reference).alias("metadata"),
    )


REFERENCES = f"""{with_shapes("beats")}, refs as (
    select seq, name || '@' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '#' || (k + 1) as reference from beats)"""


@query("p24_detection_reference", f"{REFERENCES} select seq as detection_no, reference from refs")
def _(t):
    return detections(t)


@query(
    "p25_find_by_detection",
    f"""{REFERENCES} select 'doc-' || seq as id from refs where seq % 3 = 0
  and reference = 'cam-8@2024-01-01T00:00:07.179575Z#70'""",
)
def _(t):
    return ops.find_by_detection(captured(t), "cam-8@2024-01-01T00:00:07.179575Z#70").select("id")


@query(
    "j10_documents_by_detection",
    f"{REFERENCES} select reference, seq as detection_no, 'doc-' || seq as id from refs where seq % 3 = 0",
)
def _(t):
    return ops.documents_by_detection(detections(t), captured(t))


def analysis(t):
    """Analysis results for labelled documents, some of which are gone; probes without findings too."""
    results = t.labels.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(
            F.col("quality") == 1,
            F.create_map(F.lit("Quality"), F.col("quality").cast("string"), F.lit("lang"), F.lit("probed")),
        ).otherwise(F.create_map().cast("map<string,string>")).alias("probed"),
        F.when(F.col("toxic") == 0, names.thumbnail_key(F.col("doc_id").cast("string"))).alias("thumbnail"),
    )
    held = t.documents.where("doc_id % 4 <> 0").select(
        F.col("doc_id").cast("string").alias("id"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata")
    )
    return results, held


ANALYSIS = """with results as (select cast(doc_id as varchar) as id, quality, case when toxic = 0 then
    'thumbnails/' || doc_id || '.jpg' end as thumbnail from labels),
  held as (select cast(doc_id as varchar) as id, lang from documents where doc_id % 4 <> 0)"""


@query(
    "j11_merge_analysis",
    f"""{ANALYSIS} select id, thumbnail as thumbnail_key, lang, case when quality = 1 then '1' end as quality
  from results join held using (id) where thumbnail is not null or quality = 1""",
)
def _(t):
    merged = ops.merge_analysis(*analysis(t))
    return merged.select(
        "id", "thumbnail_key", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["Quality"].alias("quality")
    )


@query(
    "j11_orphan_thumbnails",
    f"{ANALYSIS} select id, thumbnail from results where thumbnail is not null and id not in (select id from held)",
)
def _(t):
    return ops.orphan_thumbnails(*analysis(t))


@query(
    "u03_metadata_merges",
    """select event_id, event_type as recorded_kind, 'first' as analysed_kind, 3 as entries from events""",
)
def _(t):
    first = F.create_map(F.lit("kind"), F.lit("first"), F.lit("a"), F.lit("1"))
    second = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("b"), F.lit("2"))
    recorded, analysed = ops.merge_recorded(first, second), ops.merge_supplied(second, first)
    return t.events.select(
        "event_id",
        recorded["kind"].alias("recorded_kind"),
        analysed["kind"].alias("analysed_kind"),
        F.size(recorded).alias("entries"),
    )


# --- parts --------------------------------------------------------------------------------------

OFFSETS = f"""{with_shapes("parts")}, offsets as (select doc_no, part_no, size,
    cast(sum(size) over (partition by doc_no order by part_no) - size as bigint) as start_byte,
    cast(sum(size) over (partition by doc_no order by part_no) as bigint) as end_byte from parts)"""


def offsets(t, parts=None):
    parts = shapes.parts(t) if parts is None else parts
    return ops.part_offsets(parts.select("doc_no", "part_no", "size"))


def stored_offsets(t, parts=None):
    """The part index as a stored table: the searches below read it several times."""
    return cut_lineage(offsets(t, parts))


@query(
    "a01_assemble_parts",
    "select l_orderkey as doc_no, cast(sum(cast(l_quantity as bigint)) as bigint) as size, count(*) as part_count "
    "from lineitem group by 1",
)
def _(t):
    sizes = t.lineitem.select(F.col("l_orderkey").alias("doc_no"), F.col("l_quantity").cast("long").alias("size"))
    return ops.assemble_parts(sizes)


@query(
    "a01_part_lists",
    f"""{with_shapes("parts")} select doc_no,
  string_agg('recordings/' || doc_no || '/' || lpad(cast(part_no - 1 as varchar), 5, '0') || '.ts=' || size, ' '
    order by part_no) as parts from parts group by all""",
)
def _(t):
    key = names.part_key(F.col("doc_no").cast("string"), F.col("part_no") - 1, ".ts")
    lists = ops.part_lists(shapes.parts(t), key)
    text = F.array_join(F.transform("parts", lambda p: F.concat_ws("=", p["key"], p["size"].cast("string"))), " ")
    return lists.select("doc_no", text.alias("parts"))


@query("w01_part_offsets", f"{OFFSETS} select * from offsets")
def _(t):
    return offsets(t)


@query(
    "j17_locate_position",
    f"""{OFFSETS}, positions as (select doc_no, part_no as request_id, o1 % 400 as position from parts)
select p.doc_no, p.request_id, p.position, coalesce(o.part_no, -1) as part_no,
  coalesce(p.position - o.start_byte, -1) as offset_in_part
from positions p left join offsets o on p.doc_no = o.doc_no and o.start_byte <= p.position and p.position < o.end_byte""",
)
def _(t):
    positions = shapes.parts(t).select("doc_no", F.col("part_no").alias("request_id"), (F.col("o1") % 400).alias("position"))
    found = ops.locate_position(stored_offsets(t), positions, block_bytes=1 << 26)
    return found.fillna(-1, ["part_no", "offset_in_part"])  # past the end


@query(
    "j18_byte_range_plan",
    f"""{OFFSETS}, requests as (select doc_no * 100 + part_no as request_id, doc_no, o1 % 300 as from_byte,
    size * 3 as length from parts)
select r.request_id, r.doc_no, o.part_no, greatest(r.from_byte, o.start_byte) - o.start_byte as offset_in_part,
  least(r.from_byte + r.length, o.end_byte) - greatest(r.from_byte, o.start_byte) as read_length
from requests r join offsets o on r.doc_no = o.doc_no and o.start_byte < r.from_byte + r.length and o.end_byte > r.from_byte""",
)
def _(t):
    parts = cut_lineage(shapes.parts(t))  # numbered once, for the index and the requests
    requests = parts.select(
        (F.col("doc_no") * 100 + F.col("part_no")).alias("request_id"),
        "doc_no",
        (F.col("o1") % 300).alias("from_byte"),
        (F.col("size") * 3).alias("length"),
    )
    return ops.byte_range_plan(stored_offsets(t, parts), requests, block_bytes=1 << 26)
