"""How the benchmark tables stand in for the domain tables.

Each builder has a twin in :data:`CTE`, the same shape in SQL, so that a query and the statement that
checks it start from one definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators.ordered import Lane, block, lane, numbered
from .registry import Tables

EXTENSIONS = [".pdf", ".mp4", ".jpg", ".txt", ".ts", ".svg", ""]
DAY_US = 86_400_000_000
AS_OF_US = 1_706_572_800_000_000  # 2024-01-30T00:00:00Z


def beats(t: Tables) -> DataFrame:
    """Heartbeats, packets and counters of streams, out of ``events``."""
    return t.events.select(
        F.concat(F.lit("cam-"), F.col("user_id").cast("string")).alias("name"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("ts"),
        names.micros(F.col("ts")).alias("at_us"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.round(F.col("value") * 100).cast("long").alias("bytes"),
        (F.col("event_type") == "view").alias("is_key"),
    )


def beat_lane(keys: str | tuple[str, ...] = "name", seconds: int = 3_600) -> Lane:
    return lane(keys, ("at_us", "seq"), F.floor(F.col("at_us") / F.lit(seconds * 1_000_000)))


def packets(t: Tables) -> DataFrame:
    """Packets of streams on a millisecond clock; decode times step back now and then."""
    return beats(t).select(
        F.col("name").alias("stream"),
        "seq",
        "at_us",
        F.floor(F.col("at_us") / 1000).alias("pts"),
        (F.floor(F.col("at_us") / 1000) - F.col("k").cast("long") * 600_000).alias("dts"),
        F.col("bytes").alias("size"),
        "is_key",
        "kind",
        "k",
    )


def packet_lane(keys: str | tuple[str, ...] = "stream", seconds: int = 3_600) -> Lane:
    return beat_lane(keys, seconds)


def catalog(t: Tables) -> DataFrame:
    """Documents, out of ``orders``."""
    number = F.col("o_orderkey").cast("string")
    extension = F.element_at(
        F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("o_orderkey") % len(EXTENSIONS) + 1).cast("int")
    )
    name = F.concat(F.lit("doc-"), number, extension)
    recorded = F.col("o_orderstatus") == "F"
    stream = F.concat(F.lit("cam-"), (F.col("o_custkey") % 150).cast("string"))
    return t.orders.select(
        number.alias("id"),
        name.alias("file_name"),
        names.document_key(number, name).alias("storage_key"),
        F.lit(None).cast("string").alias("content_type"),
        F.floor("o_totalprice").alias("size"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 3 == 0, names.thumbnail_key(number)).alias("thumbnail_key"),
        F.when(recorded, stream).alias("stream"),
        F.col("o_orderkey").alias("doc_no"),
        F.col("o_custkey").alias("cust_no"),
    )


def parts(t: Tables) -> DataFrame:
    """Document parts, out of ``lineitem``: numbered from 1 in part-key order."""
    ordered = t.lineitem.select(
        F.col("l_orderkey").alias("doc_no"),
        F.col("l_partkey").alias("o1"),
        F.col("l_suppkey").alias("o2"),
        F.col("l_linenumber").alias("o3"),
        F.col("l_extendedprice").alias("o4"),
        F.col("l_quantity").cast("long").alias("size"),
    )
    on = lane("doc_no", ("o1", "o2", "o3", "o4"), block("o1", 1 << 14))
    return numbered(ordered, on, "part_no").select("doc_no", "part_no", "size", "o1")


def part_lane() -> Lane:
    return lane("doc_no", "part_no", block("part_no", 4_096))


def registry(t: Tables) -> DataFrame:
    """The shared registry: the newest heartbeat of every stream."""
    newest = (
        beats(t)
        .groupBy("name")
        .agg(F.max_by(F.struct("ts", "at_us", "seq", "kind", "k", "bytes"), F.struct("at_us", "seq")).alias("b"))
    )
    return newest.select(
        "name",
        F.col("b.at_us").alias("heartbeat_us"),
        F.col("b.ts").alias("heartbeat"),
        F.when(F.col("b.kind") == "error", "Interrupted").otherwise("Live").alias("state"),
        F.concat(F.lit("pod-"), (F.col("b.k") % 5).cast("string")).alias("owner"),
        F.col("b.k").alias("viewers"),
        F.col("b.bytes").alias("bytes"),
        (F.col("b.k") % 7 != 0).alias("startable"),
        F.when(F.col("b.k") % 3 == 0, F.col("b.at_us") - 3_600_000_000).alias("recording_us"),
        (F.col("b.k") % 2 == 0).alias("detection_enabled"),
        F.when(F.col("b.k") % 4 == 0, F.concat(F.lit("worker-"), (F.col("b.k") % 3).cast("string"))).alias("worker"),
    )


def sources(t: Tables) -> DataFrame:
    """Configured sources, out of ``customer``; a source without a URL is pushed to us."""
    number = F.col("c_custkey").cast("string")
    host = F.col("c_nationkey").cast("string")
    return t.customer.select(
        F.concat(F.lit("cam-"), number).alias("name"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit(None).cast("string"))
        .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("srt://host-"), host, F.lit(":9000")))
        .when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("RTSP://Host-"), host, F.lit("/live")))
        .otherwise(F.concat(F.lit("/mnt/feeds/"), number))
        .alias("url"),
        (F.col("c_acctbal") > 0).alias("enabled"),
        F.col("c_custkey").alias("cust_no"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )


def forwards(t: Tables) -> DataFrame:
    """Configured forwards of sources with the status their owner reports, out of ``orders``."""
    number = F.col("o_orderkey").cast("string")
    return t.orders.select(
        F.concat(F.lit("cam-"), F.col("o_custkey").cast("string")).alias("name"),
        F.concat(F.lit("fw-"), number).alias("id"),
        F.concat(F.lit("udp://out-"), (F.col("o_orderkey") % 97).cast("string")).alias("url"),
        F.col("o_orderkey").alias("pos"),
        (F.col("o_orderstatus") != "F").alias("known"),
        (F.col("o_orderstatus") == "O").alias("connected"),
    )


def boxes(t: Tables) -> DataFrame:
    """Detections in 1920 x 1080 frames, out of ``lineitem``."""
    left = (F.col("l_partkey") % 1800 + 1).cast("int")
    top = ((F.col("l_partkey") * 7) % 1000 + 1).cast("int")
    return t.lineitem.select(
        F.concat(F.lit("cam-"), (F.col("l_orderkey") % 50).cast("string")).alias("stream"),
        F.col("l_orderkey").alias("frame"),
        (F.col("l_partkey") * 1_000_003 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("det"),
        left.alias("left"),
        top.alias("top"),
        F.least(left + 20 + (F.col("l_suppkey") % 400).cast("int"), F.lit(1920)).alias("right"),
        F.least(top + 20 + F.col("l_linenumber") * 40, F.lit(1080)).alias("bottom"),
        F.when(F.col("l_linenumber") != 7, F.round(F.col("l_discount") * 1000).cast("int")).alias("confidence"),
        (F.col("l_partkey") % 91).cast("int").alias("class_id"),
        F.col("l_quantity").cast("long").alias("qty"),
    )


CTE = {
    "beats": """beats as (
  select 'cam-' || user_id as name, event_id as seq, ts, epoch_us(ts) as at_us, event_type as kind, value,
    cast(json_extract(props, '$.k') as int) as k, cast(round(value * 100) as bigint) as bytes,
    event_type = 'view' as is_key
  from events)""",
    "packets": """packets as (
  select name as stream, seq, at_us, at_us // 1000 as pts, at_us // 1000 - k * 600000 as dts, bytes as size,
    is_key, kind, k from beats)""",
    "catalog": """catalog as (
  select id, file_name, 'documents/' || id || '/' || file_name as storage_key, cast(null as varchar) as content_type,
    size, created_at, thumbnail_key, stream, doc_no, cust_no
  from (select cast(o_orderkey as varchar) as id,
      'doc-' || o_orderkey || ['.pdf', '.mp4', '.jpg', '.txt', '.ts', '.svg', ''][o_orderkey % 7 + 1] as file_name,
      cast(floor(o_totalprice) as bigint) as size, o_orderdate as created_at,
      case when o_orderkey % 3 = 0 then 'thumbnails/' || o_orderkey || '.jpg' end as thumbnail_key,
      case when o_orderstatus = 'F' then 'cam-' || (o_custkey % 150) end as stream,
      o_orderkey as doc_no, o_custkey as cust_no
    from orders))""",
    "parts": """parts as (
  select l_orderkey as doc_no, row_number() over (partition by l_orderkey
      order by l_partkey, l_suppkey, l_linenumber, l_extendedprice) as part_no,
    cast(l_quantity as bigint) as size, l_partkey as o1
  from lineitem)""",
    "registry": """registry as (
  select name, at_us as heartbeat_us, ts as heartbeat,
    case when kind = 'error' then 'Interrupted' else 'Live' end as state, 'pod-' || (k % 5) as owner,
    k as viewers, bytes, k % 7 <> 0 as startable, case when k % 3 = 0 then at_us - 3600000000 end as recording_us,
    k % 2 = 0 as detection_enabled, case when k % 4 = 0 then 'worker-' || (k % 3) end as worker
  from beats qualify row_number() over (partition by name order by at_us desc, seq desc) = 1)""",
    "sources": """sources as (
  select 'cam-' || c_custkey as name,
    case c_custkey % 4 when 0 then null when 1 then 'srt://host-' || c_nationkey || ':9000'
      when 2 then 'RTSP://Host-' || c_nationkey || '/live' else '/mnt/feeds/' || c_custkey end as url,
    c_acctbal > 0 as enabled, c_custkey as cust_no, c_acctbal as balance, c_mktsegment as segment
  from customer)""",
    "forwards": """forwards as (
  select 'cam-' || o_custkey as name, 'fw-' || o_orderkey as id, 'udp://out-' || (o_orderkey % 97) as url,
    o_orderkey as pos, o_orderstatus <> 'F' as known, o_orderstatus = 'O' as connected
  from orders)""",
    "boxes": """boxes as (
  select 'cam-' || (l_orderkey % 50) as stream, l_orderkey as frame,
    l_partkey * 1000003 + l_suppkey * 10 + l_linenumber as det, cast(l_partkey % 1800 + 1 as int) as "left",
    cast((l_partkey * 7) % 1000 + 1 as int) as top,
    cast(least(l_partkey % 1800 + 21 + l_suppkey % 400, 1920) as int) as "right",
    cast(least((l_partkey * 7) % 1000 + 21 + l_linenumber * 40, 1080) as int) as bottom,
    case when l_linenumber <> 7 then cast(round(l_discount * 1000) as int) end as confidence,
    cast(l_partkey % 91 as int) as class_id, cast(l_quantity as bigint) as qty
  from lineitem)""",
}


def with_shapes(*shapes: str) -> str:
    """``with a as (...), b as (...)`` for the named shapes, to which a statement adds its own."""
    return "with " + ",\n".join(CTE[s] for s in shapes)

