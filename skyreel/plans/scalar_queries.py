"""Column functions over whole tables: names, media types, geometry, wording."""

import re

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import media, names, rules
from ..functions.constants import CLASSIFICATIONS, COCO_NAMES, DETECTION_KEY, UNKNOWN_TYPE
from . import shapes
from .registry import query
from .shapes import with_shapes

ALLOWED = ["srt", "rtsp", "udp", "https"]
BEATS = with_shapes("beats")
BOXES = with_shapes("boxes")
EXTENSION_LIST = ["", ".pdf", ".MP4", ".ts", ".jpeg", ".svg", ".mp3", ".json", ".xml", ".txt", ".zip", ".unknownext"]
SQL_EXTENSIONS = "[" + ", ".join(f"'{e}'" for e in EXTENSION_LIST) + "]"
SQL_TYPES = """map {'pdf': 'application/pdf', 'mp4': 'video/mp4', 'ts': 'video/mp2t', 'jpeg': 'image/jpeg', 'svg': 'image/svg+xml', 'mp3': 'audio/mpeg',
  'json': 'application/json', 'xml': 'application/xml', 'txt': 'text/plain', 'zip': 'application/zip'}"""

FILES = f"""with files as (select page_id, url, html, 'clip-' || page_id || {SQL_EXTENSIONS}[page_id % {len(EXTENSION_LIST)} + 1]
    as file_name, case page_id % 5 when 0 then null when 1 then ' ' when 2 then 'application/octet-stream'
    when 3 then 'IMAGE/png' else 'application/xml' end as declared from pages),
  typed as (select *, lower(regexp_extract(file_name, '\\.([^.]*)$', 1)) as ext from files),
  guessed as (select *, coalesce({SQL_TYPES}[ext], '{UNKNOWN_TYPE}') as guess from typed),
  effective as (select *, case when declared is null or trim(declared) = '' or declared = '{UNKNOWN_TYPE}' then guess
    else declared end as kind_type from guessed)"""


def files(t):
    extension = F.element_at(F.array(*[F.lit(e) for e in EXTENSION_LIST]), (F.col("page_id") % len(EXTENSION_LIST) + 1).cast("int"))
    declared = F.element_at(
        F.array(F.lit(None).cast("string"), F.lit(" "), F.lit(UNKNOWN_TYPE), F.lit("IMAGE/png"), F.lit("application/xml")),
        (F.col("page_id") % 5 + 1).cast("int"),
    )
    name = F.concat(F.lit("clip-"), F.col("page_id").cast("string"), extension)
    return t.pages.select("page_id", "url", "html", name.alias("file_name"), declared.alias("declared"))


@query("p01_guess_content_type", f"{FILES} select page_id, guess from guessed")
def _(t):
    return files(t).select("page_id", media.guess_content_type(F.col("file_name")).alias("guess"))


@query(
    "p02_document_kind",
    f"""{FILES} select page_id, case when lower(kind_type) like 'image/%' then 'Image' when lower(kind_type) like 'video/%'
  then 'Video' when lower(kind_type) like 'audio/%' then 'Audio' when kind_type = 'application/pdf' then 'Pdf'
  when lower(kind_type) like 'text/%' or kind_type in ('application/json', 'application/xml') then 'Text' else 'Other' end
  as kind from effective""",
)
def _(t):
    return files(t).select("page_id", media.document_kind(F.col("declared"), F.col("file_name")).alias("kind"))


@query(
    "p03_resolve_content_type",
    f"""{FILES} select page_id, case page_id % 4 when 0 then 'text/html' when 1 then 'application/pdf' when 2 then kind_type
  else case when html like '<html%' then 'text/html' else kind_type end end as content_type from effective""",
)
def _(t):
    content = (
        F.when(F.col("page_id") % 4 == 0, F.col("html"))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("%PDF-1.7"), "html"))
        .when(F.col("page_id") % 4 == 2, F.lit(""))
        .otherwise(F.concat(F.lit(" "), "html"))
    )
    return files(t).select(
        "page_id", media.resolve_content_type(F.col("declared"), F.col("file_name"), content).alias("content_type")
    )


# What files of a kind begin with (``.`` is any byte, a number in braces so many of them), and their type.
BEGINNINGS = """
  ('FFD8FF', 'image/jpeg'), ('89504E470D0A1A0A', 'image/png'), ('474946383961', 'image/gif'), ('474946383761', 'image/gif'), ('38425053', 'image/vnd.adobe.photoshop'),
  ('00000100', 'image/x-icon'), ('0000000C6A5020200D0A870A', 'image/jp2'), ('52494646{4}57454250', 'image/webp'), ('{4}6674797068656963', 'image/heic'), ('{4}6674797061766966', 'image/avif'),
  ('41542654464F524D', 'image/vnd.djvu'), ('762F3101', 'image/aces'), ('000001BA', 'video/mpeg'), ('000001B3', 'video/mpeg'), ('464C5601', 'video/x-flv'), ('1A45DFA3', 'video/x-matroska'),
  ('52494646{4}41564920', 'video/x-msvideo'), ('{4}6674797069736F6D', 'video/mp4'), ('{4}667479706D703431', 'video/mp4'), ('{4}667479706D703432', 'video/mp4'), ('{4}667479704D345620', 'video/x-m4v'),
  ('{4}6674797071742020', 'video/quicktime'), ('{4}6674797033677034', 'video/3gpp'), ('{4}6674797033677035', 'video/3gpp'), ('47{187}47{187}47', 'video/mp2t'), ('494433', 'audio/mpeg'),
  ('664C6143', 'audio/flac'), ('4F676753', 'audio/ogg'), ('4D546864', 'audio/midi'), ('52494646{4}57415645', 'audio/x-wav'), ('464F524D{4}41494646', 'audio/x-aiff'), ('2321414D52', 'audio/amr'),
  ('2E736E64', 'audio/basic'), ('{4}667479704D344120', 'audio/mp4'), ('25504446', 'application/pdf'), ('1F8B08', 'application/gzip'), ('377ABCAF271C', 'application/x-7z-compressed'),
  ('526172211A07', 'application/x-rar-compressed'), ('425A68', 'application/x-bzip2'), ('FD377A585A00', 'application/x-xz'), ('28B52FFD', 'application/zstd'), ('04224D18', 'application/x-lz4'),
  ('4C5A4950', 'application/x-lzip'), ('4D534346', 'application/vnd.ms-cab-compressed'), ('EDABEEDB', 'application/x-rpm'), ('{257}7573746172', 'application/x-tar'), ('0061736D', 'application/wasm'),
  ('7F454C46', 'application/x-elf'), ('3C3F786D6C20', 'application/xml'), ('7B5C72746631', 'application/rtf'), ('252150532D41646F6265', 'application/postscript'),
  ('53514C69746520666F726D6174203300', 'application/vnd.sqlite3'), ('435753', 'application/x-shockwave-flash'), ('465753', 'application/x-shockwave-flash'), ('{128}4449434D', 'application/dicom'),
  ('894844460D0A1A0A', 'application/x-hdf5'), ('43444601', 'application/x-netcdf'), ('53494D504C4520203D', 'application/fits'), ('50415231', 'application/vnd.apache.parquet'),
  ('4F626A01', 'application/vnd.apache.avro'), ('4F524300', 'application/vnd.apache.orc'), ('D4C3B2A1', 'application/vnd.tcpdump.pcap'), ('A1B2C3D4', 'application/vnd.tcpdump.pcap'),
  ('676C5446', 'model/gltf-binary'), ('774F4646', 'font/woff'), ('774F4632', 'font/woff2'), ('4F54544F', 'font/otf'), ('3C21444F43545950452068746D6C', 'text/html'), ('3C68746D6C', 'text/html'),
  ('424547494E3A5643415244', 'text/vcard'), ('424547494E3A5643414C454E444152', 'text/calendar'), ('', null), ('504B0304', null), ('25504446{4}66747970', 'application/pdf'),
  ('25504446{124}7573746172', 'application/pdf'), ('25504446{253}7573746172', null)"""
FILLING = "41"


def written(pattern: str) -> str:
    """The hexadecimal beginning with its gaps filled."""
    return re.sub(r"\{(\d+)\}", lambda m: FILLING * int(m[1]), pattern)


@query(
    "p03_detect_signatures",
    f"""with known(pattern, kind) as (values {BEGINNINGS}), numbered as (select *, row_number() over (order by pattern, kind) - 1 as n from known)
select page_id, kind from pages join numbered on page_id % (select count(*) from numbered) = n""",
)
def _(t):
    """Every page behind one of the beginnings, dealt out by its id."""
    known = re.findall(r"\('([^']*)', (?:'([^']*)'|null)\)", BEGINNINGS)
    heads = [written(pattern) for pattern, _ in sorted(known)]
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("page_id") % len(heads) + 1).cast("int"))
    content = F.concat(F.unhex(head), F.encode(F.concat(F.lit("  "), "html"), "UTF-8"))
    return t.pages.select("page_id", media.detect_type(content).alias("kind"))


@query(
    "p04_can_analyze",
    f"""{FILES} select page_id, not contains(lower(kind_type), 'svg') and regexp_matches(lower(kind_type),
  '^(image|video|audio)/') as can_analyze from effective""",
)
def _(t):
    return files(t).select("page_id", media.can_analyze(F.col("declared"), F.col("file_name")).alias("can_analyze"))


@query(
    "p05_sanitize_file_name",
    r"""select page_id, case when trim(leaf) = '' then 'file' else leaf end as name from (select page_id,
  split_part(replace(case when page_id % 2 = 0 then replace(url, '/', '\') else url end, '\', '/'), '/', -1) as leaf
  from pages)""",
)
def _(t):
    given = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "/", r"\\")).otherwise(F.col("url"))
    return t.pages.select("page_id", names.sanitize_file_name(given).alias("name"))


@query(
    "p06_object_keys",
    f"""{with_shapes("parts")} select doc_no, part_no, 'documents/' || doc_no || '/f-' || part_no || '.ts' as object_key,
  'thumbnails/' || doc_no || '.jpg' as thumbnail, 'recordings/' || doc_no || '/' ||
  case when part_no < 100000 then lpad(cast(part_no as varchar), 5, '0') else cast(part_no as varchar) end || '.ts' as part_key
  from parts""",
)
def _(t):
    doc = F.col("doc_no").cast("string")
    name = F.concat(F.lit("f-"), F.col("part_no").cast("string"), F.lit(".ts"))
    return shapes.parts(t).select(
        "doc_no", "part_no",
        names.document_key(doc, name).alias("object_key"),
        names.thumbnail_key(doc).alias("thumbnail"),
        names.part_key(doc, F.col("part_no"), ".ts").alias("part_key"),
    )


KEYS = """with hashed as (select page_id, url, md5(url) as h from pages), keyed as (select page_id, case when page_id % 2 = 0
    then 'documents/' || upper(substr(h, 1, 8)) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4)
      || '-' || substr(h, 21, 12) || '/x.bin' else url end as key from hashed),
  digested as (select *, md5(key) as h, split_part(key, '/', -2) as parent, split_part(key, '/', -1) as leaf from keyed)"""


def keyed(t):
    h = F.md5("url")
    groups = [F.upper(F.substring(h, 1, 8)), *[F.substring(h, a, n) for a, n in [(9, 4), (13, 4), (17, 4), (21, 12)]]]
    own = F.concat(F.lit("documents/"), F.concat_ws("-", *groups), F.lit("/x.bin"))
    return t.pages.select("page_id", F.when(F.col("page_id") % 2 == 0, own).otherwise(F.col("url")).alias("key"))


@query(
    "p07_document_id_for_key",
    f"""{KEYS} select page_id, case when page_id % 2 = 0 then lower(parent) else substr(h, 7, 2) || substr(h, 5, 2) ||
  substr(h, 3, 2) || substr(h, 1, 2) || '-' || substr(h, 11, 2) || substr(h, 9, 2) || '-' || substr(h, 15, 2) ||
  substr(h, 13, 2) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) end as id from digested""",
)
def _(t):
    return keyed(t).select("page_id", names.document_id_for_key(F.col("key")).alias("id"))


@query(
    "p08_file_name_from_key",
    f"{KEYS} select page_id, case when trim(leaf) = '' then key else leaf end as file_name from digested",
)
def _(t):
    return keyed(t).select("page_id", names.file_name_from_key(F.col("key")).alias("file_name"))


@query(
    "p09_import_objects",
    f"""with o as (select page_id, 'in/' || page_id || '/clip-' || page_id || {SQL_EXTENSIONS}[page_id % {len(EXTENSION_LIST)} + 1]
    as key, length(html) as size, timestamp '2024-01-01' + to_days(cast(page_id as int)) as seen_at from pages),
  p as (select *, md5(key) as h, split_part(key, '/', -1) as leaf from o)
select substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '-' || substr(h, 11, 2) ||
  substr(h, 9, 2) || '-' || substr(h, 15, 2) || substr(h, 13, 2) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) as id,
  leaf as file_name, key as storage_key,
  coalesce({SQL_TYPES}[lower(regexp_extract(leaf, '\\.([^.]*)$', 1))], '{UNKNOWN_TYPE}') as content_type,
  cast(size as bigint) as size, seen_at as created_at from p""",
)
def _(t):
    from ..operators.catalog import import_objects

    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    listing = files(t).select(
        F.concat(F.lit("in/"), F.col("page_id").cast("string"), F.lit("/"), "file_name").alias("key"),
        F.length("html").cast("long").alias("size"),
        (start + F.make_dt_interval(F.col("page_id").cast("int"))).alias("last_modified"),
    )
    return import_objects(listing)


NAMES = r"""with candidates as (select page_id, case page_id % 4 when 0 then regexp_replace(url, '^https?://', '')
    when 1 then 'live/cam-' || page_id when 2 then 'a//b' || page_id else '../' || page_id end as candidate from pages),
  quoted as (select *, '''' || case when length(candidate) <= 64 then candidate else substr(candidate, 1, 64) || '...' end
    || ''' is not a usable stream name; ' as q from candidates),
  judged as (select *, case when not regexp_full_match(candidate, '[A-Za-z0-9._/-]{1,128}') then q ||
      'allowed are letters, digits, dot, dash, underscore and slash, up to 128 of them'
    when starts_with(candidate, '/') or ends_with(candidate, '/') or contains(candidate, '//')
      or list_contains(string_split(candidate, '/'), '..') then q ||
      'a slash must separate two non-empty segments and ''..'' is not one of them' end as rejection from quoted)"""


def candidates(t):
    bare = F.regexp_replace("url", "^https?://", "")
    number = F.col("page_id").cast("string")
    pick = F.col("page_id") % 4
    return t.pages.select(
        "page_id",
        F.when(pick == 0, bare).when(pick == 1, F.concat(F.lit("live/cam-"), number))
        .when(pick == 2, F.concat(F.lit("a//b"), number)).otherwise(F.concat(F.lit("../"), number)).alias("candidate"),
    )


@query(
    "p10_validate_stream_name",
    f"{NAMES} select page_id, case when rejection is null then candidate end as name, rejection from judged",
)
def _(t):
    parsed = names.parse_stream_id(F.concat(F.lit(" "), F.col("candidate"), F.lit("\u0000\u0000")))
    return candidates(t).select("page_id", parsed["name"].alias("name"), parsed["rejection"].alias("rejection"))


IDENTIFIERS = f"""{NAMES}, presented as (select page_id, candidate, rejection, case page_id % 3 when 0 then '#!::' when 1
    then '%23!::' else '' end as envelope, case page_id % 5 when 0 then 'm=request' when 1 then 'm=publish' when 2 then 'bad'
    else 's=abc' end as mode, page_id % 7 = 0 as unnamed, page_id % 6 = 0 as rolled from judged)"""


def identifiers(t):
    number = F.col("page_id")
    envelope = F.element_at(F.array(F.lit("#!::"), F.lit("%23!::"), F.lit("")), (number % 3 + 1).cast("int"))
    mode = F.element_at(F.array(*[F.lit(m) for m in ["m=request", "m=publish", "bad", "s=abc", "s=abc"]]), (number % 5 + 1).cast("int"))
    resource = F.when(number % 7 == 0, F.lit("x=1")).otherwise(F.concat(F.lit("r=first,r="), F.col("candidate")))
    back = F.when(number % 6 == 0, F.concat(F.lit(",user_from="), (number % 50 - 20).cast("string"))).otherwise("")
    full = F.concat(envelope, F.lit("u=admin,"), resource, F.lit(","), mode, back)
    return candidates(t).select("page_id", F.when(envelope == "", F.col("candidate")).otherwise(full).alias("identifier"))


@query(
    "p11_parse_stream_id",
    f"""{IDENTIFIERS}, verdict as (select page_id, candidate, case when envelope = '' then rejection
    when mode = 'm=request' then 'the caller asked to receive (m=request) and this is the ingest port'
    when unnamed then 'the stream identifier carries no resource key (r), so the stream has no name'
    else rejection end as rejection from presented)
select page_id, case when rejection is null then candidate end as name, rejection from verdict""",
)
def _(t):
    parsed = names.parse_stream_id(F.col("identifier"))
    return identifiers(t).select("page_id", parsed["name"].alias("name"), parsed["rejection"].alias("rejection"))


@query(
    "p12_preroll_position",
    f"""{IDENTIFIERS} select page_id, case when envelope = '#!::' and rolled and page_id % 50 - 20 > 0
  then cast(page_id % 50 - 20 as double) end as seconds from presented""",
)
def _(t):
    return identifiers(t).select("page_id", names.preroll_position(F.col("identifier")).alias("seconds"))


@query(
    "p13_carries_session_key",
    f"{IDENTIFIERS} select page_id, envelope = '#!::' and mode = 's=abc' as carries from presented",
)
def _(t):
    return identifiers(t).select("page_id", names.carries_session_key(F.col("identifier")).alias("carries"))


@query(
    "p14_scheme_allowed",
    f"""{with_shapes("sources")} select name, case when url is null then false when instr(url, '://') > 1
  then lower(split_part(url, '://', 1)) in ('srt', 'rtsp', 'udp', 'https') else false end as allowed from sources""",
)
def _(t):
    return shapes.sources(t).select("name", names.scheme_allowed(F.col("url"), ALLOWED).alias("allowed"))


def configured(t):
    """Sources with their forwards and fixed sensor as nested values."""
    c = F.col("cust_no")
    forward = lambda i, url: F.struct(i.alias("id"), url.alias("url"))
    forwards = F.when(
        c % 3 == 0,
        F.array(
            forward(F.lit("a"), F.when(c % 9 == 0, F.lit(" ")).otherwise(F.lit("udp://out-1"))),
            forward(F.when(c % 2 == 0, F.lit("a")).otherwise(F.lit("")), F.lit("ftp://out-2")),
        ),
    ).otherwise(F.array(forward(F.lit("b"), F.lit("srt://out-3"))))
    sensor = F.when(
        c % 2 == 1,
        F.struct(
            (c % 100 - 5).cast("double").alias("latitude"),
            (c % 360 - 170).cast("double").alias("longitude"),
            (c % 2000 * 10).cast("double").alias("altitude_m"),
            (c % 380).cast("double").alias("true_bearing"),
            F.lit(-10.0).alias("relative_elevation"),
            (c % 50).cast("double").alias("horizontal_fov"),
            F.lit(20.0).alias("vertical_fov"),
            F.when(c % 5 == 0, F.lit("secret")).when(c % 5 == 1, F.lit("COSMIC")).otherwise(F.lit("")).alias("classification"),
        ),
    )
    name = F.when(c % 40 == 7, F.concat("name", F.lit("/"))).otherwise(F.col("name"))
    return shapes.sources(t).select(name.alias("name"), "url", "enabled", forwards.alias("forwards"), sensor.alias("sensor"), "cust_no")


@query(
    "p15_refuse_source",
    f"""{with_shapes("sources")}, c as (select *, case when cust_no % 40 = 7 then name || '/' else name end as shown,
    lower(split_part(url, '://', 1)) as scheme, instr(url, '://') > 1 as has_scheme from sources)
select shown as name, case
  when cust_no % 40 = 7 then '''' || shown || ''' is not a usable stream name; a slash must separate two non-empty segments and ''..'' is not one of them'
  when url is not null and not has_scheme then 'Transport ''file'' is not allowed. Allowed: {", ".join(ALLOWED)}.'
  when cust_no % 9 = 0 then 'A forward needs a URL.'
  when cust_no % 3 = 0 and cust_no % 2 = 0 then 'Two forwards share the id ''a''.'
  when cust_no % 3 = 0 then 'Transport ''ftp'' is not allowed. Allowed: {", ".join(ALLOWED)}.'
  when cust_no % 2 = 0 then null
  when cust_no % 100 - 5 > 90 then 'A sensor latitude is -90 to 90 degrees.'
  when cust_no % 360 - 170 > 180 then 'A sensor longitude is -180 to 180 degrees.'
  when cust_no % 2000 * 10 > 19000 then 'A sensor altitude is -900 to 19000 metres.'
  when cust_no % 380 > 360 then 'A true bearing is 0 to 360 degrees.'
  when cust_no % 50 <= 0 then 'A field of view is above 0 and up to 180 degrees.'
  when cust_no % 5 = 1 then '''COSMIC'' is not an ST 0102 classification. One of: {", ".join(CLASSIFICATIONS)}.'
  end as refusal from c""",
)
def _(t):
    refusal = rules.refuse_source(F.col("name"), F.col("url"), F.col("forwards"), F.col("sensor"), ALLOWED)
    return configured(t).select("name", refusal.alias("refusal"))


@query(
    "p16_with_forward_ids",
    f"""{with_shapes("sources")}, c as (select *, case when cust_no % 40 = 7 then name || '/' else name end as shown from sources)
select shown as name, case when cust_no % 3 <> 0 then 'b' when cust_no % 2 = 0 then 'a,a'
  else 'a,' || md5(shown || chr(10) || 'ftp://out-2' || chr(10) || '1') end as ids from c""",
)
def _(t):
    filled = rules.with_forward_ids(F.col("name"), F.col("forwards"))
    return configured(t).select("name", F.array_join(F.transform(filled, lambda f: f["id"]), ",").alias("ids"))


SQL_COCO = "[" + ", ".join(f"'{n}'" for n in COCO_NAMES) + "]"


@query(
    "p17_normalize_labels",
    f"""select vec_id, array_to_string(list_filter({SQL_COCO}, lambda n: n in ({SQL_COCO}[label + 1], {SQL_COCO}[vec_id % 80 + 1],
  'dog')), ',') as labels from embeddings""",
)
def _(t):
    coco = F.array(*[F.lit(n) for n in COCO_NAMES])
    pick = lambda c: F.element_at(coco, (c + 1).cast("int"))
    asked = F.array(F.concat(F.lit("  "), F.upper(pick(F.col("label")))), pick(F.col("vec_id") % 80), F.lit("Dog"), F.lit(" "))
    return t.embeddings.select("vec_id", F.array_join(rules.normalize_labels(asked), ",").alias("labels"))


@query(
    "p18_normalize_model",
    """select vec_id, case label % 5 when 0 then 'rf-detr' when 1 then 'yolo26' when 2 then 'rf-detr' end as model
  from embeddings""",
)
def _(t):
    given = F.element_at(
        F.array(F.lit(" RFDETR"), F.lit("Yolo "), F.lit("rf-detr"), F.lit("DEFAULT"), F.lit(" ")), (F.col("label") % 5 + 1).cast("int")
    )
    return t.embeddings.select("vec_id", media.normalize_model(given).alias("model"))


@query(
    "p19_filter_detections_by_labels",
    f"""{BOXES} select det, frame, class_id from boxes where {SQL_COCO}[class_id + 1] in ('dog', 'car', 'person')""",
)
def _(t):
    coco = F.array(*[F.lit(n) for n in COCO_NAMES])
    label = F.get(coco, F.col("class_id"))
    wanted = F.array(F.lit("dog"), F.lit("car"), F.lit("person"))
    return shapes.boxes(t).where(rules.keep_labelled(label, wanted)).select("det", "frame", "class_id")


@query(
    "p26_capture_file_name",
    f"""{BEATS} select seq, replace('site/' || name, '/', '-') || '-' || strftime(ts, '%Y%m%d-%H%M%S') || '.jpg' as file_name
  from beats""",
)
def _(t):
    name = names.capture_file_name(F.concat(F.lit("site/"), "name"), F.col("ts"), ".jpg")
    return shapes.beats(t).select("seq", name.alias("file_name"))


@query(
    "p27_recording_metadata",
    f"""{BEATS} select seq, name as stream, strftime(ts, '%Y-%m-%d %H:%M:%SZ') as started,
  case when k > 1 then cast(k as varchar) end as parts,
  case when kind = 'error' and k % 2 = 0 then 'Incomplete: the recorder could not keep up with the stream, and then the recording failed before it finished. It is short of what was asked for.'
  when kind = 'error' then 'Incomplete: this recording failed before it finished, so it is short of what was asked for. What is here was captured and stored before that.'
  when k % 2 = 0 then 'Truncated: the recorder could not keep up with the stream.' end as note, case when bytes // 100 < 60 then bytes // 100 || ' s' else bytes // 6000 || ':' || lpad(cast(bytes // 100 % 60 as varchar), 2, '0') end as duration, kind as detection,
  case when k % 3 = 0 then 'SECRET' end as classification, 4 + cast(k > 1 as int) + cast(kind = 'error' or k % 2 = 0 as int)
  + cast(k % 3 = 0 as int) as entries from beats""",
)
def _(t):
    from ..operators.recordings import recording_metadata

    rows = shapes.beats(t).withColumn(
        "m",
        recording_metadata(
            F.col("name"), F.col("ts"), F.floor(F.col("bytes") / 100).cast("double"), F.col("k"), F.col("kind") == "error", F.col("k") % 2 == 0,
            F.when(F.col("k") % 3 == 0, F.lit("SECRET")), F.col("kind"),
        ),
    )
    m = F.col("m")
    return rows.select(
        "seq", m["Live stream"].alias("stream"), m["Recording started"].alias("started"), m["Recording parts"].alias("parts"),
        m["Recording"].alias("note"), m["Duration"].alias("duration"), m[DETECTION_KEY].alias("detection"), m["Classification"].alias("classification"), F.size(m).alias("entries"),
    )


@query(
    "p28_local_output",
    """select page_id, 'srt://localhost:9001?streamid=' || url_encode(url || ' ~*') as output from pages""",
)
def _(t):
    given = F.concat(F.col("url"), F.lit(" ~*"))
    return t.pages.select("page_id", names.local_output(given, "srt://localhost:9001/").alias("output"))


@query(
    "p33_telemetry_age_flag",
    f"""{BEATS} select seq, case when k % 10 = 0 then 'unknown' when ({shapes.AS_OF_US} - at_us) / 1e6 > 86400 then 'stale' end as flag
  from beats""",
)
def _(t):
    from ..operators.registry import telemetry_age_flag

    received = F.when(F.col("k") % 10 != 0, F.col("at_us"))
    return shapes.beats(t).select("seq", telemetry_age_flag(received, F.lit(shapes.AS_OF_US), stale_us=shapes.DAY_US).alias("flag"))


# --- wording ------------------------------------------------------------------------------------

DEC = lambda e: f"cast({e} as decimal(30, 9))"
TRIM = lambda e, d: f"regexp_replace(regexp_replace(cast(cast(round({DEC(e)}, {d}) as decimal(30, {d})) as varchar), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"  # noqa: E731,E501


@query(
    "f01_fmt_duration",
    f"""{BEATS}, s as (select seq, case kind when 'view' then value / 10 when 'click' then value * 7 else value * 400 end as x
    from beats)
select seq, case when x < 60 then {TRIM("x", 2)} || ' s' when x < 3600 then (cast(floor(x) as bigint) // 60) || ':' ||
  lpad(cast(cast(floor(x) as bigint) % 60 as varchar), 2, '0') else (cast(floor(x) as bigint) // 3600 % 24) || ':' ||
  lpad(cast(cast(floor(x) as bigint) // 60 % 60 as varchar), 2, '0') || ':' ||
  lpad(cast(cast(floor(x) as bigint) % 60 as varchar), 2, '0') end as duration from s""",
)
def _(t):
    value = F.col("value")
    x = F.when(F.col("kind") == "view", value / 10).when(F.col("kind") == "click", value * 7).otherwise(value * 400)
    return shapes.beats(t).select("seq", media.fmt_duration(x).alias("duration"))


@query(
    "f02_fmt_bitrate",
    f"""{BOXES}, b as (select det, frame, qty * qty * 1237 as bps from boxes) select det, frame, case when bps >= 1000000 then
  {TRIM("bps / 1e6", 2)} || ' Mbit/s' else {TRIM("bps / 1e3", 1)} || ' kbit/s' end as bitrate from b""",
)
def _(t):
    bps = F.col("qty") * F.col("qty") * 1237
    return shapes.boxes(t).select("det", "frame", media.fmt_bitrate(bps).alias("bitrate"))


@query(
    "f03_fmt_rates",
    f"""{BOXES} select det, frame, case when qty % 5 <> 0 and class_id <> 0 then {TRIM("class_id * 1000.0 / (qty % 5 * 1001)", 2)} || ' fps' end
  as frame_rate, case when qty % 5 <> 0 and class_id <> 0 then class_id || ':' || (qty % 5) end as aspect from boxes""",
)
def _(t):
    n, d = F.col("class_id"), F.col("qty") % 5
    return shapes.boxes(t).select(
        "det", "frame", media.fmt_frame_rate(n * 1000, d * 1001).alias("frame_rate"), media.fmt_aspect(n, d).alias("aspect")
    )


@query(
    "f04_fmt_streams",
    f"""{BOXES} select det, frame, {TRIM("qty * 1025 / 1e3", 1)} || ' kHz' as sample_rate, "right" || ' x ' || bottom || ' px' as
  dimensions, case when qty % 3 > 1 then 'Audio ' || (qty % 3) else 'Audio' end as label from boxes""",
)
def _(t):
    return shapes.boxes(t).select(
        "det", "frame", media.fmt_sample_rate(F.col("qty") * 1025).alias("sample_rate"),
        media.fmt_dimensions(F.col("right"), F.col("bottom")).alias("dimensions"),
        media.stream_label(F.lit("audio"), F.col("qty") % 3).alias("label"),
    )


@query(
    "f05_put_if_meaningful",
    f"""{BEATS} select seq, case k % 4 when 3 then 'v' || k end as stored, 1 + cast(k % 4 = 3 as int) as entries from beats""",
)
def _(t):
    value = F.element_at(
        F.array(F.lit(" "), F.lit("N/A"), F.lit("unknown"), F.concat(F.lit(" v"), F.col("k").cast("string"))), (F.col("k") % 4 + 1)
    )
    stored = media.put_if_meaningful(F.create_map(F.lit("a"), F.lit("1")), F.lit("b"), value)
    return shapes.beats(t).select("seq", stored["b"].alias("stored"), F.size(stored).alias("entries"))


@query(
    "f24_human_size",
    f"""{BOXES}, s as (select det, frame, cast(qty as bigint) * class_id * class_id * "left" * top % 5000000000 as n from boxes)
select det, frame, case when n < 1024 then n || ' B' when n < 1048576 then {TRIM("n / 1024.0", 1)} || ' KB'
  when n < 1073741824 then {TRIM("n / 1048576.0", 1)} || ' MB' else {TRIM("n / 1073741824.0", 1)} || ' GB' end as human,
  case when n >= 1073741824 then round({DEC("n / 1073741824.0")}, 1) || ' GB' when n >= 1048576 then
  round({DEC("n / 1048576.0")}, 1) || ' MB' when n >= 1024 then cast(round({DEC("n / 1024.0")}, 0) as bigint) || ' kB' else n || ' B' end as listed from s""",
)
def _(t):
    n = F.col("qty") * F.col("class_id") * F.col("class_id") * F.col("left") * F.col("top") % 5_000_000_000
    return shapes.boxes(t).select("det", "frame", media.human_size(n).alias("human"), media.table_size(n).alias("listed"))


@query(
    "f25_throughput_text",
    f"""{BEATS}, s as (select seq, case when k % 4 <> 0 then value * k * 100.0 end as bps, case when k % 3 <> 0 then bytes end as n from beats)
select seq, case when bps >= 1000000 then round({DEC("bps / 1e6")}, 1) || ' Mb/s' when bps is not null then
  cast(round({DEC("bps / 1e3")}, 0) as bigint) || ' kb/s' when n is null then '—' when n >= 1024 then
  cast(round({DEC("n / 1024.0")}, 0) as bigint) || ' kB' else n || ' B' end as shown from s""",
)
def _(t):
    bps = F.when(F.col("k") % 4 != 0, F.col("value") * F.col("k") * 100.0)
    total = F.when(F.col("k") % 3 != 0, F.col("bytes"))
    return shapes.beats(t).select("seq", media.throughput_text(bps, total).alias("shown"))


# --- geometry -----------------------------------------------------------------------------------

WRAP = lambda e: f"((({e}) % 360.0) + 360.0) % 360.0"
R6 = lambda e: f"round({e}, 6)"


def pointing():
    """Heading, azimuth and roll of a made-up sensor."""
    return F.col("value") * 3, F.col("k") * 7.5, F.when(F.col("k") % 2 == 0, F.col("k") * 1.25)


def sight():
    """Sensor latitude and longitude, frame-centre latitude and longitude."""
    lat, lon = F.col("value") / 10 - 20, F.col("k") * 3.0 - 140
    return lat, lon, lat + F.col("k") / 100.0, lon + F.col("value") / 1000


SENSOR = f"""{BEATS}, p as (select *, value * 3 as heading, k * 7.5::double as azimuth, case when k % 2 = 0 then k * 1.25::double end as roll,
    value / 10 - 20 as lat, k * 3.0::double - 140 as lon, value / 10 - 20 + k / 100.0 as flat, k * 3.0::double - 140 + value / 1000 as flon
    from beats)"""
BEARING = WRAP(
    "atan2(sin((flon - lon) * pi() / 180) * cos(flat * pi() / 180), cos(lat * pi() / 180) * sin(flat * pi() / 180)"
    " - sin(lat * pi() / 180) * cos(flat * pi() / 180) * cos((flon - lon) * pi() / 180)) * 180 / pi()"
)


@query("f06_sensor_bearing", f"{SENSOR} select seq, {R6(WRAP('heading + azimuth'))} as bearing from p")
def _(t):
    return shapes.beats(t).select("seq", F.round(geo.sensor_bearing(*pointing()[:2]), 6).alias("bearing"))


@query(
    "f07_north_in_image",
    f"""{SENSOR}, b as (select seq, roll, {WRAP('heading + azimuth')} as bearing from p)
select seq, {R6(WRAP('-(bearing + coalesce(roll, 0))'))} as north from b""",
)
def _(t):
    return shapes.beats(t).select("seq", F.round(geo.north_in_image(geo.sensor_bearing(*pointing()[:2]), pointing()[2]), 6).alias("north"))


@query("f08_bearing_between", f"{SENSOR} select seq, {R6(BEARING)} as bearing from p")
def _(t):
    return shapes.beats(t).select("seq", F.round(geo.bearing_between(*sight()), 6).alias("bearing"))


@query(
    "f09_bearing_difference",
    f"{SENSOR} select seq, {R6(WRAP('heading - azimuth + 180.0') + ' - 180.0')} as turn from p",
)
def _(t):
    return shapes.beats(t).select("seq", F.round(geo.bearing_difference(*pointing()[:2]), 6).alias("turn"))


@query(
    "f10_slant_range_residual",
    f"""{SENSOR} select seq, round(sqrt(pow((flat - lat) * 111320.0, 2) + pow((flon - lon) * 111320.0 * cos(lat * pi() / 180), 2)
  + pow(100.0 - value * 2, 2)) - value * 50, 4) as residual from p""",
)
def _(t):
    lat, lon, to_lat, to_lon = sight()
    residual = geo.slant_range_residual(lat, lon, F.col("value") * 2, to_lat, to_lon, F.lit(100.0), F.col("value") * 50)
    return shapes.beats(t).select("seq", F.round(residual, 4).alias("residual"))


@query(
    "f26_look_bearing",
    f"""{SENSOR} select seq, case when k % 5 = 0 then {R6(WRAP('heading + azimuth'))} else {R6(BEARING)} end as bearing from p""",
)
def _(t):
    lat, lon, to_lat, to_lon = sight()
    known = F.when(F.col("k") % 5 != 0, to_lat)
    bearing = geo.look_bearing(lat, lon, known, to_lon, *pointing()[:2])
    return shapes.beats(t).select("seq", F.round(bearing, 6).alias("bearing"))


@query(
    "f18_micros_and_second_text",
    f"{BEATS} select seq, at_us as micros, strftime(ts, '%Y-%m-%d %H:%M:%SZ') as second from beats",
)
def _(t):
    return t.events.select(
        F.col("event_id").alias("seq"), names.micros(F.col("ts")).alias("micros"), names.second_text(F.col("ts")).alias("second")
    )




def frame_size():
    return F.col("qty").cast("int") * 37 + 100, F.col("class_id") * 11 + 100


FRAMES = f"""{BOXES}, g as (select *, cast(qty * 37 + 100 as int) as w, class_id * 11 + 100 as h,
    least(640.0::double / (class_id * 11 + 100), 640.0::double / (qty * 37 + 100)) as gain from boxes),
  l as (select *, round_even(w * gain, 0) as pw, round_even(h * gain, 0) as ph from g),
  placed as (select *, round_even((640 - pw) / 2.0::double - 0.1::double, 0) as px, round_even((640 - ph) / 2.0::double - 0.1::double, 0) as py from l)"""


@query(
    "f11_place",
    f"""{FRAMES} select det, frame, cast(px as int) as pad_left, cast(py as int) as pad_top, cast(pw as int) as width,
  cast(ph as int) as height, 640 as stretch_width from placed""",
)
def _(t):
    box = geo.place(*frame_size(), "letterbox", 640)
    return shapes.boxes(t).select(
        "det", "frame", box["left"].alias("pad_left"), box["top"].alias("pad_top"), box["width"].alias("width"),
        box["height"].alias("height"), geo.place(*frame_size(), "stretch", 640)["width"].alias("stretch_width"),
    )


@query(
    "f12_to_model",
    f"""{FRAMES} select det, frame, {R6('("left" - 1) * gain + px')} as lx1, {R6('bottom * gain + py')} as ly2,
  {R6('("left" - 1)::double * 640 / 1920')} as sx1, {R6('bottom::double * 640 / 1080')} as sy2 from placed""",
)
def _(t):
    edges = [F.col(c) for c in ("left", "top", "right", "bottom")]
    boxed, stretched = geo.to_model(*edges, *frame_size(), "letterbox", 640), geo.to_model(*edges, F.lit(1920), F.lit(1080), "stretch", 640)
    return shapes.boxes(t).select(
        "det", "frame", F.round(boxed["x1"], 6).alias("lx1"), F.round(boxed["y2"], 6).alias("ly2"),
        F.round(stretched["x1"], 6).alias("sx1"), F.round(stretched["y2"], 6).alias("sy2"),
    )


@query(
    "f13_to_frame",
    f"""{FRAMES}, i as (select *, (("left" / 3.0::double) - px) / gain as x1, ((top / 3.0::double) - py) / gain as y1,
    (("right" / 3.0::double) - px) / gain as x2, ((bottom / 3.0::double) - py) / gain as y2 from placed),
  c as (select det, frame, w, h, least(greatest(cast(round_even(x1, 0) as int) + 1, 1), w) as "left",
    least(greatest(cast(round_even(y1, 0) as int) + 1, 1), h) as top, least(greatest(cast(round_even(x2, 0) as int), 1), w) as r,
    least(greatest(cast(round_even(y2, 0) as int), 1), h) as b from i)
select det, frame, "left", top, greatest("left", r) as "right", greatest(top, b) as bottom from c""",
)
def _(t):
    edges = [F.col(c) / 3.0 for c in ("left", "top", "right", "bottom")]
    return shapes.boxes(t).select("det", "frame", geo.to_frame(*edges, *frame_size(), "letterbox", 640).alias("b")).select("det", "frame", "b.*")


@query(
    "f14_to_frame_normalised",
    """with e as (select vec_id, 0.5 + embedding[1]::double as cx, 0.5 + embedding[2]::double as cy, abs(embedding[3]::double) as w,
    abs(embedding[4]::double) as h from embeddings), i as (select vec_id, (cx - w / 2) * 560 / 560 * 1920 as x1,
    (cy - h / 2) * 560 / 560 * 1080 as y1, (cx + w / 2) * 560 / 560 * 1920 as x2, (cy + h / 2) * 560 / 560 * 1080 as y2 from e),
  c as (select vec_id, least(greatest(cast(round_even(x1, 0) as int) + 1, 1), 1920) as "left",
    least(greatest(cast(round_even(y1, 0) as int) + 1, 1), 1080) as top, least(greatest(cast(round_even(x2, 0) as int), 1), 1920) as r,
    least(greatest(cast(round_even(y2, 0) as int), 1), 1080) as b from i)
select vec_id, "left", top, greatest("left", r) as "right", greatest(top, b) as bottom from c""",
)
def _(t):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    box = geo.to_frame_normalised(0.5 + e(0), 0.5 + e(1), F.abs(e(2)), F.abs(e(3)), F.lit(1920), F.lit(1080), "stretch", 560)
    return t.embeddings.select("vec_id", box.alias("b")).select("vec_id", "b.*")


@query(
    "f15_iou",
    f"""{BOXES}, e as (select det, frame, "left" as l, top as t, "right" + 1 as r, bottom + 1 as b, "left" + 10 as l2, top + 5 as t2,
    "right" + 31 as r2, bottom + 11 as b2 from boxes), i as (select *, greatest(0, least(r, r2) - greatest(l, l2))::double
    * greatest(0, least(b, b2) - greatest(t, t2)) as inter from e)
select det, frame, {R6('inter / ((r - l)::double * (b - t) + (r2 - l2)::double * (b2 - t2) - inter)')} as iou from i""",
)
def _(t):
    a = [F.col(c) for c in ("left", "top", "right", "bottom")]
    b = [a[0] + 10, a[1] + 5, a[2] + 30, a[3] + 10]
    return shapes.boxes(t).select("det", "frame", F.round(geo.iou(a, b), 6).alias("iou"))


@query(
    "f16_scores",
    """select vec_id, round(1 / (1 + exp(-(embedding[1]::double))), 6) as score,
  cast(round_even(100 / (1 + exp(-(embedding[1]::double))), 0) as int) as confidence,
  embedding[1]::double > ln(0.55 / 0.45) as kept from embeddings""",
)
def _(t):
    x = F.get("embedding", F.lit(0)).cast("double")
    return t.embeddings.select(
        "vec_id", F.round(geo.sigmoid(x), 6).alias("score"), geo.confidence_pct(geo.sigmoid(x)).alias("confidence"),
        (x > geo.logit_cutoff(0.55)).alias("kept"),
    )


@query(
    "f17_pixel_number",
    f"""{BOXES} select det, frame, "left" + (top - 1)::bigint * 1920 as pixel, "left" as pixel_column, top as pixel_row from boxes""",
)
def _(t):
    numbered = shapes.boxes(t).select(
        "det", "frame", geo.pixel_number(F.col("left"), F.col("top"), F.lit(1920), F.lit(1080)).alias("pixel")
    )
    at = geo.pixel_position(F.col("pixel"), F.lit(1920))
    return numbered.select("det", "frame", "pixel", at["column"].alias("pixel_column"), at["row"].alias("pixel_row"))


@query(
    "f19_queue_depth",
    f"{BEATS} select seq, least(2048, greatest(4, cast(ceil(greatest(k / 10.0::double, 0.5::double) * value) as int))) as depth from beats",
)
def _(t):
    return shapes.beats(t).select("seq", geo.queue_depth(F.col("value"), F.col("k") / 10.0, 2048).alias("depth"))


@query(
    "f20_effective_rate",
    f"""{BEATS}, r as (select seq, k::double as declared, value, greatest(k::double, case when kind <> 'error' and value > 0 then value + 1 else 0 end)
    as rate from beats) select seq, rate, rate > declared * 1.25 as misdeclared from r""",
)
def _(t):
    declared, observed = F.col("k").cast("double"), F.when(F.col("kind") != "error", F.col("value"))
    return shapes.beats(t).select(
        "seq", geo.effective_rate(declared, observed, F.lit(1.0)).alias("rate"),
        geo.misdeclared(declared, observed, F.lit(1.0)).alias("misdeclared"),
    )


@query(
    "f21_fitting_preroll",
    f"""{BEATS}, r as (select seq, k - 10.0::double as asked, 2048.0::double / (value + 1) - 5 as room from beats),
  q as (select *, least(asked, room) as ask, least(asked, room) + 2 as reaches from r)
select seq, round(case when asked <= 0 then asked when room <= 0 then 0 when reaches <= room then ask
  else greatest(0, ask - (reaches - room)) end, 6) as seconds from q""",
)
def _(t):
    asked, room = F.col("k") - 10.0, geo.queue_room(F.col("value") + 1, 2048, 5)
    fitted = geo.fitting_preroll(asked, room, F.least(asked, room) + 2)
    return shapes.beats(t).select("seq", F.round(fitted, 6).alias("seconds"))


@query(
    "u02_label_sets",
    f"""{BEATS} select seq, case when k % 4 = 0 then kind = 'view' else kind <> 'view' and k % 4 = 1 end as same from beats""",
)
def _(t):
    wanted = F.when(F.col("kind") != "view", F.array(F.lit("car"), F.lit("dog")))
    other = F.when(F.col("k") % 4 == 1, F.array(F.lit("dog"), F.lit("car"), F.lit("dog"))).when(
        F.col("k") % 4 != 0, F.array(F.lit("cat"))
    )
    return shapes.beats(t).select("seq", rules.same_labels(wanted, other).alias("same"))


@query(
    "u04_transports",
    f"""{BEATS} select seq, case when k % 2 = 0 then 'rtsp,srt' else 'srt' end as both_ways from beats""",
)
def _(t):
    inputs = F.when(F.col("k") % 2 == 0, F.array(F.lit("srt"), F.lit("rtsp"), F.lit("hls"))).otherwise(F.array(F.lit("srt")))
    outputs = F.array(F.lit("udp"), F.lit("rtsp"), F.lit("srt"))
    return shapes.beats(t).select("seq", F.array_join(rules.transports_both_ways(inputs, outputs), ",").alias("both_ways"))
