"""Detection, layout, VMTI and tracking queries."""

from pyspark.sql import functions as F

from ..functions.constants import COCO, COCO_NAMES
from ..operators import detections as ops
from ..operators import layout, tracking, vmti
from ..operators.listing import positioned
from ..operators.ordered import block, lane
from . import shapes
from .registry import query
from .shapes import with_shapes

BOXES = with_shapes("boxes")
SQL_YOLO = "[" + ", ".join(f"'{n}'" for n in COCO_NAMES) + "]"
SQL_SPARSE = "[" + ", ".join(f"'{COCO[i]}'" if i in COCO else "null" for i in range(91)) + "]"

# --- tensors ------------------------------------------------------------------------------------


@query(
    "s14_tensor_table",
    """select vec_id, label, cast(i as int) as row_index, embedding[i * 4 + 1]::double as v0, embedding[i * 4 + 2]::double as v1, embedding[i * 4 + 3]::double as v2,
  embedding[i * 4 + 4]::double as v3 from embeddings, range(16) r(i)""",
)
def _(t):
    rows = ops.tensor_rows(t.embeddings, "embedding", 4)
    return rows.select("vec_id", "label", "row_index", *[F.get("values", F.lit(j)).cast("double").alias(f"v{j}") for j in range(4)])


@query(
    "j14_class_names",
    f"""select vec_id, family, class_name from (
  select vec_id, 'rf-detr' as family, {SQL_SPARSE}[vec_id % 100 + 1] as class_name from embeddings
  union all select vec_id, 'yolo26', {SQL_YOLO}[vec_id % 100 + 1] from embeddings) where class_name is not null""",
)
def _(t):
    ids = t.embeddings.select("vec_id", (F.col("vec_id") % 100).cast("int").alias("class_id"))
    named = lambda family: ops.class_names(ids, "class_id", family).select("vec_id", F.lit(family).alias("family"), "class_name")
    return named("rf-detr").unionByName(named("yolo26"))


@query(
    "t05_top_queries",
    """with cells as (select vec_id, i - 1 as index, embedding[i]::double as score from embeddings, range(1, 65) r(i))
select vec_id, row_number() over (partition by vec_id order by score desc, index) as rank, index, score from cells
qualify row_number() over (partition by vec_id order by score desc, index) <= 10""",
)
def _(t):
    return ops.top_queries(t.embeddings.select("vec_id", "embedding"), "embedding", 10)


def heads(t):
    e = F.col("embedding")
    logits = F.transform(e, lambda x: x.cast("double") * 8)
    boxes = F.transform(e, lambda x, i: F.when(i % 4 < 2, x.cast("double") + 0.5).otherwise(F.abs(x.cast("double"))))
    rows = F.transform(
        e,
        lambda x, i: F.when(i % 6 == 4, x.cast("double") + 0.6).when(i % 6 == 5, F.floor(F.abs(x.cast("double")) * 300))
        .otherwise(x.cast("double") * 600 + 320),
    )
    return t.embeddings.select("vec_id", logits.alias("scores"), boxes.alias("boxes"), rows.alias("rows"))


CLAMP = "least(greatest(cast(round_even({e}, 0) as int){plus}, 1), {top})"
EDGES = lambda size, w, h: (
    f'{CLAMP.format(e=f"x1 / {size} * {w}", plus=" + 1", top=w)} as "left", {CLAMP.format(e=f"y1 / {size} * {h}", plus=" + 1", top=h)} as top,'
    f' {CLAMP.format(e=f"x2 / {size} * {w}", plus="", top=w)} as r, {CLAMP.format(e=f"y2 / {size} * {h}", plus="", top=h)} as b'
)


@query(
    "k06_decode_query_scores",
    f"""with cells as (select vec_id, i - 1 as i, embedding[i]::double * 8 as raw, embedding from embeddings, range(1, 65) r(i)),
  kept as (select *, {SQL_SPARSE}[i % 8 + 1] as class_name, i // 8 as query from cells where embedding[i + 1]::double * 8 > ln(0.6 / 0.4)),
  named as (select *, row_number() over (partition by vec_id order by i) as id, embedding[query * 4 + 1]::double + 0.5 as cx, embedding[query * 4 + 2]::double + 0.5 as cy,
    abs(embedding[query * 4 + 3]::double) as w, abs(embedding[query * 4 + 4]::double) as h from kept where class_name is not null),
  e as (select *, (cx - w / 2) * 560 as x1, (cy - h / 2) * 560 as y1, (cx + w / 2) * 560 as x2, (cy + h / 2) * 560 as y2 from named),
  c as (select *, {EDGES(560, 1920, 1080)} from e)
select vec_id, cast(id as int) as id, cast(query as int) as query, class_name, cast(round_even(100 / (1 + exp(-raw)), 0) as int) as confidence,
  "left", top, greatest("left", r) as "right", greatest(top, b) as bottom from c""",
)
def _(t):
    tensors = heads(t).select("vec_id", "scores", "boxes")
    return ops.decode_query_scores(tensors, "scores", "boxes", 8, 0.6, F.lit(1920), F.lit(1080), 560)


@query(
    "k07_decode_sorted_rows",
    f"""with cells as (select vec_id, cast(r as int) as row_index, embedding[r * 6 + 1]::double * 600 + 320 as x1, embedding[r * 6 + 2]::double * 600 + 320 - 140 as y1,
    embedding[r * 6 + 3]::double * 600 + 320 as x2, embedding[r * 6 + 4]::double * 600 + 320 - 140 as y2, embedding[r * 6 + 5]::double + 0.6 as score,
    cast(floor(abs(embedding[r * 6 + 6]::double) * 300) as int) as class_id from embeddings, range(10) t(r)),
  ended as (select *, min(case when score <= 0.5 then row_index end) over (partition by vec_id) as stop_at from cells),
  named as (select *, {SQL_YOLO}[class_id + 1] as class_name from ended where row_index < coalesce(stop_at, 10)),
  kept as (select *, row_number() over (partition by vec_id order by row_index) as id from named where class_name is not null),
  c as (select *, {EDGES(640, 1920, 1080).replace('/ 640 * 1920', '/ (640.0::double / 1920)').replace('/ 640 * 1080', '/ (640.0::double / 1920)')} from kept)
select vec_id, cast(id as int) as id, row_index, class_name, cast(round_even(score * 100, 0) as int) as confidence, "left", top,
  greatest("left", r) as "right", greatest(top, b) as bottom from c""",
)
def _(t):
    return ops.decode_sorted_rows(heads(t).select("vec_id", "rows"), "rows", 0.5, F.lit(1920), F.lit(1080), 640)


@query(
    "k12_run_detector",
    "select vec_id, round(embedding[1]::double * 2, 4) as first, round(embedding[64]::double * 2, 4) as last from embeddings",
)
def _(t):
    found = ops.run_detector(t.embeddings.select("vec_id", "embedding"), "embedding", lambda: lambda x: x * 2, "doubling")
    value = lambda i: F.round(F.get("scores", F.lit(i)).cast("double"), 4)
    return found.select("vec_id", value(0).alias("first"), value(63).alias("last"))


# --- boxes --------------------------------------------------------------------------------------


@query(
    "j09_iou_pairs",
    f"""{BOXES}, a as (select * from boxes where qty % 2 = 0), d as (select * from boxes where qty % 2 = 1),
  p as (select a.stream, a.frame, a.det as t_id, d.det as d_id, (least(a."right", d."right") - greatest(a."left", d."left") + 1)::double
    * (least(a.bottom, d.bottom) - greatest(a.top, d.top) + 1) as inter, (a."right" - a."left" + 1)::double * (a.bottom - a.top + 1) as aa,
    (d."right" - d."left" + 1)::double * (d.bottom - d.top + 1) as dd, coalesce(d.confidence, 100) / 100.0::double as score
    from a join d on a.stream = d.stream and a.frame = d.frame and least(a."right", d."right") >= greatest(a."left", d."left")
      and least(a.bottom, d.bottom) >= greatest(a.top, d.top))
select stream, frame, t_id, d_id, round(inter / (aa + dd - inter), 6) as iou, round(1 - inter / (aa + dd - inter), 6) as cost,
  round(1 - inter / (aa + dd - inter) * score, 6) as fused_cost from p""",
)
def _(t):
    b = shapes.boxes(t).withColumnRenamed("det", "id")
    pairs = ops.iou_pairs(b.where("qty % 2 = 0"), b.where("qty % 2 = 1"), ["stream", "frame"])
    return pairs.select("stream", "frame", "t_id", "d_id", *[F.round(c, 6).alias(c) for c in ("iou", "cost", "fused_cost")])


@query(
    "t06_strongest_first",
    f"""{BOXES} select det, frame, coalesce(confidence, 100) as confidence, row_number() over (order by coalesce(confidence, 100) desc, det, frame) as position from boxes""",
)
def _(t):
    rows = shapes.boxes(t).select("det", "frame", F.coalesce("confidence", F.lit(100)).alias("confidence"), (-F.coalesce("confidence", F.lit(100))).alias("weakness"))
    return positioned(rows, ["weakness", "det", "frame"]).select("det", "frame", "confidence", "position")


@query(
    "w18_track_history",
    f"""{BOXES} select stream, det, frame, array_to_string(list("left") over (partition by stream order by frame, det rows between 29 preceding and current row), ',')
  as history from boxes""",
)
def _(t):
    on = lane("stream", ("frame", "det"), block("frame", 1 << 14))
    kept = ops.track_history(shapes.boxes(t).select("stream", "frame", "det", "left"), on, F.col("left"))
    return kept.select("stream", "det", "frame", F.array_join(F.transform("history", lambda v: v.cast("string")), ",").alias("history"))


@query(
    "a19_inference_batches",
    f"""{BOXES}, n as (select case when class_id % 3 = 0 then 'yolo26' else 'rf-detr' end as model, det, frame,
    (row_number() over (partition by case when class_id % 3 = 0 then 'yolo26' else 'rf-detr' end order by frame, det) - 1) // 8 as batch from boxes)
select model, batch, count(*) as frames, min(frame) as first_frame from n group by model, batch""",
)
def _(t):
    model = F.when(F.col("class_id") % 3 == 0, "yolo26").otherwise("rf-detr")
    due = shapes.boxes(t).select(model.alias("model"), "det", "frame")
    on = lane("model", ("frame", "det"), block("frame", 1 << 10))
    return ops.inference_batches(due, on).groupBy("model", "batch").agg(F.count(F.lit(1)).alias("frames"), F.min("frame").alias("first_frame"))


# --- layouts ------------------------------------------------------------------------------------

TRACKS = f"""{with_shapes("parts")}, tracks as (select doc_no as stream, part_no - 1 as index, case o1 % 4 when 0 then 'video' when 1 then 'audio' when 2 then 'data' else 'subtitle' end as kind,
    case o1 % 8 when 0 then 'h264' when 1 then 'aac' when 2 then 'klv' when 3 then 'srt' when 4 then 'hevc' when 5 then 'opus' when 6 then 'bin' else 'ass' end as codec,
    cast(size * 32 as int) as width, cast(size * 18 as int) as height, case when o1 % 5 <> 0 then 48000 else 0 end as sample_rate,
    case when o1 % 7 <> 0 then 1024 else 0 end as frame_size, cast(size * 1000 as int) as avg_num, cast(o1 % 3 * 1001 as int) as avg_den,
    cast(o1 % 2 * 30 as int) as base_num, 1 as base_den, 1 as tb_num, cast(90000 - o1 % 2 * 42000 as int) as tb_den, o1, size from parts)"""


def tracks(t):
    o1, size = F.col("o1"), F.col("size")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (o1 % n + 1).cast("int"))
    return shapes.parts(t).select(
        F.col("doc_no").alias("stream"), (F.col("part_no") - 1).alias("index"), pick(["video", "audio", "data", "subtitle"], 4).alias("kind"),
        pick(["h264", "aac", "klv", "srt", "hevc", "opus", "bin", "ass"], 8).alias("codec"), (size * 32).cast("int").alias("width"),
        (size * 18).cast("int").alias("height"), F.when(o1 % 5 != 0, 48_000).otherwise(0).alias("sample_rate"),
        F.when(o1 % 7 != 0, 1_024).otherwise(0).alias("frame_size"), (size * 1000).cast("int").alias("avg_num"), (o1 % 3 * 1001).cast("int").alias("avg_den"),
        (o1 % 2 * 30).cast("int").alias("base_num"), F.lit(1).alias("base_den"), F.lit(1).alias("tb_num"), (90_000 - o1 % 2 * 42_000).cast("int").alias("tb_den"),
        "o1", "size",
    )


@query(
    "a14_layout_description",
    f"""{TRACKS} select stream, string_agg(case when kind = 'video' then codec || ' ' || width || 'x' || height else codec end, ', ' order by index) as layout
  from tracks group by stream""",
)
def _(t):
    return layout.layout_description(tracks(t), slice_tracks=4)


@query(
    "a15_declared_packet_rate",
    f"""{TRACKS}, r as (select stream, case when kind = 'audio' and sample_rate > 0 and frame_size > 0 then sample_rate / frame_size::double
    when avg_den <> 0 and avg_num / avg_den::double > 0 then avg_num / avg_den::double when base_num > 0 then base_num::double end as rate from tracks)
select stream, round(sum(case when rate > 0 and rate <= 1000 then rate else 60 end) + 1, 6) as packets_per_second from r group by stream""",
)
def _(t):
    rates = layout.declared_packet_rate(tracks(t), F.lit(1.0))
    return rates.withColumn("packets_per_second", F.round("packets_per_second", 6))


@query(
    "a23_track_roles",
    f"""{TRACKS}, f as (select stream, count(*) as arrived, min(case when kind = 'video' then index end) as v, min(case when codec = 'klv' then index end) as k,
    arg_min(tb_den, index) filter (kind = 'video') as vtb, arg_min(tb_den, index) as ftb from tracks group by stream),
  s as (select o_orderkey as stream, o_orderkey % 2 as extra from orders),
  j as (select coalesce(f.stream, s.stream) as stream, coalesce(arrived, 0) as arrived, v, k, vtb, ftb, coalesce(extra, 0) as extra from f full join s on f.stream = s.stream)
select stream, coalesce(v, -1) as video_index, coalesce(k, case when extra > 0 then arrived end, -1) as klv_index, k is null and extra > 0 as klv_is_synthetic,
  arrived + case when k is null then extra else 0 end as tracks, 1 as tb_num, coalesce(vtb, ftb, 90000) as tb_den from j""",
)
def _(t):
    synthetic = t.orders.select(
        F.col("o_orderkey").alias("stream"), (F.col("o_orderkey") % 2).cast("int").alias("count"), F.lit(True).alias("has_platform")
    )
    return layout.track_roles(tracks(t), synthetic)


@query(
    "f22_layout_matches",
    f"""{TRACKS} select stream, bool_and(o1 % 10 <> 0 or size % 2 <> 0) and bool_and(not (stream % 9 = 0 and index = 0)) as matches from tracks group by stream""",
)
def _(t):
    mine = tracks(t)
    edited = F.when((F.col("o1") % 10 == 0) & (F.col("size") % 2 == 0), F.col("width") + 2).otherwise(F.col("width"))
    theirs = mine.withColumn("width", edited).where("not (stream % 9 = 0 and index = 0)")
    return layout.layout_matches(mine, theirs)


DEC = lambda e: f"cast({e} as decimal(30, 9))"
TRIM = lambda e, d: f"regexp_replace(regexp_replace(cast(cast(round({DEC(e)}, {d}) as decimal(30, {d})) as varchar), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"  # noqa: E731,E501


@query(
    "k11_describe_media",
    f"""{TRACKS}, n as (select *, row_number() over (partition by stream, kind order by index) as n from tracks),
  l as (select *, upper(kind[1]) || kind[2:] || case when n > 1 then ' ' || n else '' end as label, (index + 1) * 100 as base from n),
  c as (select o_orderkey as doc_no, o_orderkey % 100 as seconds, cast(floor(o_totalprice) as bigint) as bps from orders)
select doc_no, 0::bigint as position, 'Container' as label, 'MPEG-TS' as text from c where doc_no % 3 <> 0
union all select doc_no, 1, 'Duration', case when seconds < 60 then seconds || ' s' else '1:' || lpad(cast(seconds - 60 as varchar), 2, '0') end from c where seconds > 0
union all select doc_no, 2, 'Overall bitrate', {TRIM('bps / 1e3', 1)} || ' kbit/s' from c where bps > 0
union all select stream, base, label || ' codec', codec from l
union all select stream, base + 1, label || ' dimensions', width || ' x ' || height || ' px' from l where kind = 'video'
union all select stream, base + 2, label || ' aspect ratio', '16:9' from l where kind = 'video' and o1 % 3 <> 0
union all select stream, base + 3, label || ' pixel format', 'yuv420p' from l where kind = 'video'
union all select stream, base + 4, label || ' frame rate', {TRIM('avg_num / (avg_den::double)', 2)} || ' fps' from l where kind = 'video' and avg_den <> 0
union all select stream, base + 5, label || ' frames', cast(size as varchar) from l where kind = 'video'
union all select stream, base + 6, label || ' channels', '2' from l where kind = 'audio'
union all select stream, base + 7, label || ' sample rate', '48 kHz' from l where kind = 'audio' and sample_rate > 0
union all select stream, base + 8, label || ' language', 'eng' from l where kind = 'subtitle' and o1 % 8 = 3
union all select stream, base + 9, label || ' bitrate', {TRIM('size * 1000 / 1e3', 1)} || ' kbit/s' from l where o1 % 5 <> 0""",
)
def _(t):
    containers = t.orders.select(
        F.col("o_orderkey").alias("doc_no"), F.when(F.col("o_orderkey") % 3 != 0, "MPEG-TS").otherwise("unknown").alias("container"),
        (F.col("o_orderkey") % 100).cast("double").alias("seconds"), F.floor("o_totalprice").alias("bit_rate"),
    )
    o1 = F.col("o1")
    probed = tracks(t).select(
        F.col("stream").alias("doc_no"), "index", "kind", "codec", "width", "height", F.when(o1 % 3 != 0, 1).otherwise(0).alias("sar_num"), F.lit(1).alias("sar_den"),
        F.lit("yuv420p").alias("pixel_format"), "avg_num", "avg_den", F.col("size").alias("frames"), F.lit(2).alias("channels"), "sample_rate",
        F.when(o1 % 8 == 3, "eng").otherwise("N/A").alias("language"), F.when(o1 % 5 != 0, F.col("size") * 1000).otherwise(0).alias("bit_rate"),
    )
    return layout.describe_media(containers, probed)


@query(
    "k11_media_tags",
    f"""{TRACKS}, n as (select *, row_number() over (partition by stream, kind order by index) as n from tracks),
  l as (select *, upper(kind[1]) || kind[2:] || case when n > 1 then ' ' || n else '' end as label, (index + 1) * 100 as base from n),
  c as (select o_orderkey as doc_no, o_orderkey % 100 as seconds, o_orderpriority from orders)
select doc_no, 10::bigint as position, 1::int as place, 'Creation time' as label, o_orderpriority as text from c
union all select doc_no, case when seconds > 0 then 1 else 10 end, case when seconds > 0 then 0 else 2 end, 'Duration', 'told otherwise' from c where doc_no % 7 = 0
union all select doc_no, 1, 0, 'Duration', case when seconds < 60 then seconds || ' s' else '1:' || lpad(cast(seconds - 60 as varchar), 2, '0') end from c where seconds > 0 and doc_no % 7 <> 0
union all select stream, base + 10, 1, label || ' Handler name', 'handler ' || index from l where index % 2 = 1""",
)
def _(t):
    """What the tags of containers and streams add, and where a tag replaces what the probe said."""
    number = F.col("o_orderkey")
    tag = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    containers = t.orders.select(
        number.alias("doc_no"), F.lit("MPEG-TS").alias("container"), (number % 100).cast("double").alias("seconds"), F.lit(0).alias("bit_rate"),
        F.array(tag("creation_time", F.col("o_orderpriority")), tag("duration", F.when(number % 7 == 0, " told otherwise ")), tag("", F.lit("no key")), tag("encoder", F.lit("N/A"))).alias("tags"),
    )
    probed = tracks(t).select(
        F.col("stream").alias("doc_no"), "index", "kind", "codec", "width", "height", F.lit(1).alias("sar_num"), F.lit(1).alias("sar_den"), F.lit("yuv420p").alias("pixel_format"),
        "avg_num", "avg_den", F.col("size").alias("frames"), F.lit(2).alias("channels"), "sample_rate", F.lit("eng").alias("language"), F.lit(0).alias("bit_rate"),
        F.array(tag("LANGUAGE", F.lit("eng")), tag("handler_name", F.when(F.col("index") % 2 == 1, F.concat(F.lit("handler "), F.col("index").cast("string"))))).alias("tags"),
    )
    return layout.describe_media(containers, probed).where("place > 0 or label = 'Duration'")


# --- packets of detections ----------------------------------------------------------------------


def targets(t):
    b = shapes.boxes(t)
    digest = F.md5(F.concat_ws("|", "stream", F.col("det").cast("string")))
    dashed = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]])
    tracked = F.col("qty") % 2 == 0
    when = lambda c: F.when(tracked, c)
    return b.select(
        "stream", "frame", (F.col("det") % 2_097_151 + 1).cast("int").alias("target_id"), "left", "top", "right", "bottom", "confidence",
        F.when(F.col("class_id") != 0, F.concat(F.lit("class-"), F.col("class_id").cast("string"))).alias("ontology_class"),
        when(dashed).alias("track_uuid"), when(F.lit(1)).alias("track_status"), when(F.col("frame") * 1000).alias("track_started_us"),
        when(F.col("frame") * 1000 + F.col("qty")).alias("track_last_seen_us"), when(F.lit("ByteTrack")).alias("track_algorithm"),
        F.lit(None).cast("int").alias("track_confidence"),
    )


def vmti_packets(t):
    found = targets(t)
    frames = t.orders.select(
        F.concat(F.lit("cam-"), (F.col("o_orderkey") % 50).cast("string")).alias("stream"), F.col("o_orderkey").alias("frame"),
        (F.col("o_orderkey") * 1_000_000 + 7).alias("timestamp_us"), F.lit(1920).alias("frame_width"), F.lit(1080).alias("frame_height"),
        F.lit("EO").alias("sensor"), F.lit("urn:coco").alias("ontology"),
    )
    return vmti.encode_vmti(frames, found, ["stream", "frame"])


@query(
    "k03_encode_vmti",
    """select 'cam-' || (o_orderkey % 50) as stream, o_orderkey as frame, coalesce(n, 0) as targets, 'ok' as status from orders
  left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey""",
)
def _(t):
    decoded = vmti.decode_vmti(vmti_packets(t))
    return decoded.groupBy("stream", "frame").agg(F.count("target_id").alias("targets"), F.min("status").alias("status"))


@query(
    "k04_decode_vmti",
    f"""{BOXES} select stream, frame, frame * 1000000 + 7 as timestamp_us, cast(det % 2097151 + 1 as int) as target_id, "left", top, "right", bottom,
  coalesce(confidence, -1) as confidence, case when class_id <> 0 then 'class-' || class_id end as ontology_class,
  case when qty % 2 = 0 then substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) end as track_uuid,
  case when qty % 2 = 0 then frame * 1000 + qty else -1 end as track_last_seen_us from (select *, md5(stream || '|' || det) as h from boxes)""",
)
def _(t):
    decoded = vmti.decode_vmti(vmti_packets(t)).where("target_id is not null")
    return decoded.select(
        "stream", "frame", "timestamp_us", "target_id", "left", "top", "right", "bottom", F.coalesce("confidence", F.lit(-1)).alias("confidence"),
        "ontology_class", "track_uuid", F.coalesce("track_last_seen_us", F.lit(-1)).alias("track_last_seen_us"),
    )


@query(
    "k03_refused_targets",
    f"""{BOXES} select det, frame, case when qty % 7 = 0 then 'the box is inside out' when qty % 5 = 0 then 'the box is outside the frame'
  when confidence + qty > 100 then 'a confidence is a percentage' end as refusal from boxes where qty % 7 = 0 or qty % 5 = 0 or confidence + qty > 100""",
)
def _(t):
    b = shapes.boxes(t).select(
        "det", "frame", F.lit(1).alias("target_id"), F.when(F.col("qty") % 7 == 0, F.col("right") + 1).otherwise(F.col("left")).alias("left"),
        "top", "right", F.when(F.col("qty") % 5 == 0, 2000).otherwise(F.col("bottom")).alias("bottom"),
        (F.col("confidence") + F.col("qty")).alias("confidence"), F.lit(None).cast("int").alias("track_confidence"), F.lit(1920).alias("frame_width"),
        F.lit(1080).alias("frame_height"), F.lit(0).alias("track_started_us"), F.lit(0).alias("track_last_seen_us"),
    )
    return b.select("det", "frame", vmti.refuse_target().alias("refusal")).where("refusal is not null")


# --- tracking -----------------------------------------------------------------------------------


def scene(t):
    """Two objects drifting across every stream, seen with gaps, one of them weakly at times."""
    base = shapes.beats(t).select(F.col("name").alias("stream"), "seq", "at_us", "k", "kind")
    from ..operators.ordered import numbered

    numbered_rows = numbered(base, shapes.beat_lane("stream"), "n")
    frames = numbered_rows.select(
        "stream", F.col("n").alias("seq"), (F.col("n") * 40).alias("pts"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), "k", "kind"
    )
    x = (F.lit(100) + F.col("seq") * 4 % 1600).cast("int")
    first = frames.where("kind <> 'error'").select("stream", "seq", F.lit(1).alias("det"), x.alias("left"), F.lit(300).alias("top"), F.col("k").alias("confidence"), F.lit("car").alias("class_name"))
    second = frames.where("kind <> 'view'").select("stream", "seq", F.lit(2).alias("det"), (x + 60).alias("left"), F.lit(600).alias("top"), F.lit(90).alias("confidence"), F.lit("dog").alias("class_name"))
    boxes = first.unionByName(second).withColumns({"right": F.col("left") + 79, "bottom": F.col("top") + 79})
    return frames.select("stream", "seq", "pts", "width", "height").withColumn("steps_before", F.lit(0).cast("long")), boxes


@query("k08_track_objects")
def _(t):
    return tracking.track_objects(*scene(t))


@query("a16_track_summary")
def _(t):
    return tracking.track_summary(tracking.track_objects(*scene(t)))


@query(
    "k08_pending_steps",
    f"""{with_shapes("beats")}, f as (select name, seq, seq * 10 + k as pts, lag(seq * 10 + k) over (partition by name order by seq) as before from beats where is_key),
  c as (select *, sum(case when pts < before then 1 else 0 end) over (partition by name order by seq) as clock from f),
  p as (select b.name, b.seq, b.seq * 10 + b.k as pts, c.clock from beats b asof join c on b.name = c.name and b.seq >= c.seq where not b.is_key)
select c.name as stream, c.seq, count(p.pts) as steps_before from c left join p on p.name = c.name and p.clock = c.clock and c.pts >= c.before
  and p.seq < c.seq and p.pts > c.before and p.pts < c.pts group by c.name, c.seq""",
)
def _(t):
    b = shapes.beats(t).select(F.col("name").alias("stream"), "seq", (F.col("seq") * 10 + F.col("k")).alias("pts"), "is_key")
    frames = b.where("is_key").drop("is_key")
    return tracking.pending_steps(frames, b.where("not is_key").drop("is_key"), 2_000).select("stream", "seq", "steps_before")
