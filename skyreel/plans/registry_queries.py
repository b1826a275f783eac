"""Registry, source, forward and worker queries."""

from pyspark.sql import functions as F

from ..functions import names
from ..operators import listing, metrics
from ..operators import registry as ops
from ..schemas import REGISTRY
from . import shapes
from .registry import query
from .shapes import AS_OF_US, DAY_US, with_shapes

REG = with_shapes("beats", "registry")
GRACE = 2 * DAY_US  # events are hours apart: thresholds scale with them
BEAT = DAY_US // 6
AS_OF = AS_OF_US


def now():
    return F.lit(AS_OF)


ALIVE = f"{AS_OF} - heartbeat_us <= {3 * BEAT}"
GONE = f"{AS_OF} - heartbeat_us > {GRACE}"


@query(
    "s09_read_registry",
    """select event_id, 'cam-' || user_id as name, event_type as state, cast(value as double) as buffered_seconds
  from events where event_id % 9 <> 0 order by name""",
)
def _(t):
    from ..sources.stores import read_registry

    text = F.to_json(
        F.struct(
            F.concat(F.lit("cam-"), "user_id").alias("name"), F.col("event_type").alias("state"),
            F.col("value").alias("buffered_seconds"),
        )
    )
    stored = t.events.select(
        F.col("event_id"), F.when(F.col("event_id") % 9 == 0, F.substring(text, 1, 15)).otherwise(text).alias("entry")
    )
    readable, _unreadable = read_registry(stored, "entry", REGISTRY)
    return readable.select("event_id", "name", "state", "buffered_seconds")


@query("s09_unreadable_entries", "select event_id from events where event_id % 9 = 0")
def _(t):
    from ..sources.stores import read_registry

    text = F.to_json(F.struct(F.concat(F.lit("cam-"), "user_id").alias("name")))
    stored = t.events.select(
        F.col("event_id"), F.when(F.col("event_id") % 9 == 0, F.substring(text, 1, 9)).otherwise(text).alias("entry")
    )
    return read_registry(stored, "entry", REGISTRY)[1].select("event_id")


@query("p20_visible_streams", f"{REG} select name, heartbeat_us from registry where not ({GONE})")
def _(t):
    return ops.visible_streams(shapes.registry(t), now(), GRACE).select("name", "heartbeat_us")


@query("p21_owner_alive", f"{REG} select name, owner, {ALIVE} as alive from registry")
def _(t):
    return shapes.registry(t).select("name", "owner", ops.owner_alive(F.col("heartbeat_us"), now(), BEAT).alias("alive"))


ATTEMPTS = f"""{with_shapes("beats", "registry", "sources")},
  attempts as (select 'pod-' || (cust_no % 7) as pod, name from sources),
  placed as (select owner as pod, name from registry)"""


@query(
    "p22_admission_verdict",
    f"""{ATTEMPTS}, load as (select pod, count(*) as n from placed group by pod)
select a.pod, a.name, case when coalesce(r.state = 'Live' and {ALIVE}, false) then 'conflict'
  when coalesce(load.n, 0) >= 25 and p.name is null then 'overload' else 'admit' end as verdict
from attempts a left join registry r on a.name = r.name left join load on a.pod = load.pod
  left join placed p on a.pod = p.pod and a.name = p.name""",
)
def _(t):
    attempts = shapes.sources(t).select(F.concat(F.lit("pod-"), (F.col("cust_no") % 7).cast("string")).alias("pod"), "name")
    streams = shapes.registry(t)
    placed = streams.select(F.col("owner").alias("pod"), "name")
    return ops.admission_verdict(attempts, streams, placed, now(), 25, BEAT)


@query(
    "j15_claim_outcome",
    f"""{with_shapes("beats", "registry", "sources")}, a as (select name, 'pod-' || (cust_no % 5) as owner from sources),
  o as (select a.name, a.owner, r.recording_us, case when coalesce(r.owner <> a.owner and r.state = 'Live' and {ALIVE}, false)
    then 'refused' when r.name is not null and not ({GONE}) then 'resumed' else 'taken' end as outcome, r.bytes
    from a left join registry r on a.name = r.name)
select name, owner, outcome, case when outcome = 'resumed' then bytes else {AS_OF} end as started_us from o""",
)
def _(t):
    attempts = shapes.sources(t).select(
        "name", F.concat(F.lit("pod-"), (F.col("cust_no") % 5).cast("string")).alias("owner"), now().alias("started_us")
    )
    held = shapes.registry(t).withColumn("started_us", F.col("bytes"))
    return ops.claim_outcome(attempts, held, now(), BEAT, GRACE)


ROWS = f"""{with_shapes("beats", "registry", "sources", "forwards")}, fc as (select name, count(*) as configured,
    count(*) filter (known and connected) as connected from forwards group by name),
  rows_ as (select s.name, s.url, s.enabled, s.cust_no, case when r.name is null then 'NotOnAir' when r.state = 'Interrupted'
    then 'Interrupted' else 'Live' end as state, coalesce(configured, 0) as configured, coalesce(connected, 0) as connected,
    r.bytes as stream_bytes from sources s left join registry r on s.name = r.name left join fc on s.name = fc.name),
  overall as (select *, case when state = 'Interrupted' or (state = 'Live' and configured > connected) then 'alert'
    when state = 'Live' then 'streaming' else 'inactive' end as overall from rows_)"""


def dashboard(t):
    wanted = shapes.forwards(t)
    counts = ops.forward_counts(wanted, wanted.where("known"))
    rows = ops.source_rows(shapes.sources(t), shapes.registry(t)).join(counts, "name", "left")
    rows = rows.fillna(0, ["configured", "connected"])
    state = [F.col("state"), F.col("configured"), F.col("connected")]
    return rows.withColumns({"overall": ops.overall_state(*state), "state_text": ops.state_text(*state)})


@query("j03_source_rows", f"{ROWS} select name, state, coalesce(stream_bytes, -1) as stream_bytes from rows_")
def _(t):
    rows = ops.source_rows(shapes.sources(t), shapes.registry(t))
    return rows.select("name", "state", F.coalesce("stream_bytes", F.lit(-1)).alias("stream_bytes"))


@query(
    "p32_overall_state",
    f"""{ROWS} select name, overall, case when state = 'Live' and configured > connected then 'Degraded' when state = 'Live'
  then 'Streaming' when state = 'Interrupted' then 'Interrupted' else 'Not on air' end as state_text from overall""",
)
def _(t):
    return dashboard(t).select("name", "overall", "state_text")


@query(
    "p31_filter_sources",
    f"""{ROWS} select name, overall from overall where overall <> 'streaming' and overall = 'inactive' and url is not null
  and (contains(lower(name), 'st-1') or contains(lower(url), 'st-1') or contains('udp://backup-' || (cust_no % 20), 'st-1')
    or contains('srt://localhost:9001?streamid=' || name, 'st-1'))""",
)
def _(t):
    backup = F.concat(F.lit("udp://backup-"), (F.col("cust_no") % 20).cast("string"))
    rows = dashboard(t).withColumns(
        {"output": names.local_output(F.col("name"), "srt://localhost:9001"), "forward_urls": F.array(backup)}
    )
    return ops.filter_sources(rows, "inactive", "pull", "ST-1").select("name", "overall")


@query(
    "a22_dashboard_counts",
    f"""{ROWS} select count(*) as total, count(*) filter (overall = 'streaming') as streaming,
  count(*) filter (overall = 'alert') as alert, count(*) filter (overall = 'inactive') as inactive,
  count(*) filter (enabled) as shown from overall""",
)
def _(t):
    return ops.dashboard_counts(dashboard(t), F.col("enabled"))


@query(
    "j04_forward_detail",
    f"""{with_shapes("forwards")} select name, id, url, case when known then cast(connected as varchar) end as connected from forwards""",
)
def _(t):
    configured = shapes.forwards(t)
    first = configured.where("known").select("name", "id", "pos", "connected")
    second = first.withColumn("pos", F.col("pos") + 1_000_000_000).withColumn("connected", ~F.col("connected"))
    detail = ops.forward_detail(configured.select("name", "id", "url"), first.unionByName(second))
    return detail.withColumn("connected", F.col("connected").cast("string"))


@query(
    "j05_forward_plan",
    f"""{with_shapes("forwards")}, desired as (select name, id, url from forwards where pos % 5 <> 0),
  running as (select name, id, case when pos % 4 = 0 then url || '/old' else url end as url, pos % 3 = 0 as finished,
    {AS_OF} - (pos % 20) * 1000000 as last_attempt_us from forwards where pos % 7 <> 0),
  j as (select coalesce(d.name, r.name) as name, coalesce(d.id, r.id) as id, coalesce(d.url, r.url) as url, d.id is null as unwanted,
    r.id is null as fresh, d.url <> r.url as edited, r.finished and {AS_OF} - r.last_attempt_us >= 10000000 as retry
    from desired d full join running r on d.name = r.name and d.id = r.id)
select name, id, 'stop' as action, url from j where unwanted or (not fresh and (edited or retry))
union all select name, id, 'start', url from j where not unwanted and (fresh or edited or retry)""",
)
def _(t):
    f = shapes.forwards(t)
    running = f.where("pos % 7 <> 0").select(
        "name", "id", F.when(F.col("pos") % 4 == 0, F.concat("url", F.lit("/old"))).otherwise(F.col("url")).alias("url"),
        (F.col("pos") % 3 == 0).alias("finished"), (now() - (F.col("pos") % 20) * 1_000_000).alias("last_attempt_us"),
    )
    return ops.forward_plan(f.where("pos % 5 <> 0").select("name", "id", "url"), running, now(), 10_000_000)


@query(
    "j06_adopt_candidates",
    f"""{with_shapes("beats", "registry", "sources")}, local as (select name from registry where owner = 'pod-1'),
  free as (select name, url from sources where enabled and url is not null and name not in (select name from local)
    and name not in (select name from registry where owner <> 'pod-1' and state = 'Live' and {ALIVE})
    and not (cust_no % 10 = 1 and cust_no % 30 < 10)),
  ranked as (select *, row_number() over (order by md5('pod-1|' || name), name) as spot from free)
select name, url from ranked where spot <= 200 - (select count(*) from local)""",
)
def _(t):
    streams, wanted = shapes.registry(t), shapes.sources(t)
    local = streams.where("owner = 'pod-1'").select("name")
    tried = wanted.where("cust_no % 10 = 1").select("name", (now() - (F.col("cust_no") % 30) * 1_000_000).alias("at_us"))
    return ops.adopt_candidates(wanted, local, streams, tried, "pod-1", now(), 200, 10_000_000, BEAT)


CACHE = f"""{with_shapes("sources")} select name, cust_no from sources where cust_no % 3 <> 0 and cust_no % 4 = 0"""


@query("j13_prune_stale_keys", CACHE)
def _(t):
    sources = shapes.sources(t)
    return ops.prune_stale_keys(sources.where("cust_no % 3 <> 0").select("name", "cust_no"), sources.where("cust_no % 4 <> 0"))


@query("u01_key_difference", f"{with_shapes('sources')} select distinct segment || (cust_no % 10) as key from sources except select segment || (cust_no % 7) from sources")
def _(t):
    s = shapes.sources(t)
    key = lambda n: s.select(F.concat("segment", (F.col("cust_no") % n).cast("string")).alias("key"))
    return key(10).subtract(key(7))


@query(
    "j16_worker_plan",
    f"""{REG}, listing as (select name, detection_enabled, worker, case when viewers % 5 = 0 then '' else 'http://' || owner || '/' end
    as owner_address, viewers % 4 as rate, case viewers % 3 when 0 then null when 1 then 'YOLO' else 'default' end as model from registry),
  held as (select name from registry where viewers % 6 < 2 union all select 'cam-gone-' || viewers from registry where viewers = 1),
  j as (select coalesce(l.name, h.name) as name, h.name is not null as here, l.* exclude (name) from listing l full join held h on l.name = h.name),
  k as (select *, case when here and coalesce(detection_enabled and (worker is null or worker = 'worker-1'), false) then 'keep'
    when here then 'stop' when detection_enabled and worker is null then 'claim' end as action from j)
select name, action, case when action <> 'stop' then case when owner_address <> '' then rtrim(owner_address, '/') else 'http://api' end end
  as owner_url, case when action <> 'stop' then case when rate > 0 then rate else 2 end else -1 end as rate,
  case when action <> 'stop' then case when model = 'YOLO' then 'yolo26' else 'rf-detr' end end as model
from k where action is not null""",
)
def _(t):
    r = shapes.registry(t)
    listing_ = r.select(
        "name", "detection_enabled", "worker",
        F.when(F.col("viewers") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("http://"), "owner", F.lit("/"))).alias("owner_address"),
        (F.col("viewers") % 4).alias("rate"),
        F.when(F.col("viewers") % 3 == 1, F.lit("YOLO")).when(F.col("viewers") % 3 == 2, F.lit("default")).alias("model"),
    )
    lost = r.where("viewers = 1").select(F.concat(F.lit("cam-gone-"), F.col("viewers").cast("string")).alias("name"))
    held = r.where("viewers % 6 < 2").select("name").unionByName(lost)
    return ops.worker_plan(listing_, held, "worker-1", "http://api/", 2, "rf-detr").fillna(-1, ["rate"])


@query(
    "a20_effective_decode_rate",
    f"{with_shapes('beats')} select name, coalesce(max(case when kind = 'view' then value end), 0.0) as rate from beats group by name",
)
def _(t):
    asked = shapes.beats(t).select("name", F.when(F.col("kind") == "view", F.col("value")).alias("rate"))
    return ops.effective_decode_rate(asked)


@query(
    "a04_census",
    f"""{REG} select owner, count(*) as streams, count(*) filter (state = 'Interrupted') as interrupted,
  count(*) filter (not startable) as unstartable, cast(sum(viewers) as bigint) as viewers, count(recording_us) as recordings,
  cast(sum(bytes % 4) as bigint) as forwards from registry group by owner""",
)
def _(t):
    return ops.census(shapes.registry(t).withColumn("forwards", F.col("bytes") % 4))


@query(
    "j19_snapshot_delta",
    f"""{with_shapes("beats")}, s0 as (select name, sum(bytes) as bytes, count(*) as packets from beats where at_us < {AS_OF - 8 * DAY_US} group by name),
  s1 as (select name, sum(bytes) as bytes, count(*) as packets from beats group by name)
select name, cast(s1.bytes - s0.bytes as bigint) as bytes, s1.packets - s0.packets as packets,
  round((s1.bytes - s0.bytes) * 8 / 60.0, 6) as bits_per_second from s1 join s0 using (name)""",
)
def _(t):
    b = shapes.beats(t)
    totals = lambda d: d.groupBy("name").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("packets"))
    delta = metrics.snapshot_delta(totals(b.where(F.col("at_us") < AS_OF - 8 * DAY_US)), totals(b), 60)
    return delta.withColumn("bits_per_second", F.round("bits_per_second", 6))


# --- orders and picks ---------------------------------------------------------------------------


@query("t02_ordinal_order", f"{with_shapes('sources')} select name, segment from sources order by name")
def _(t):
    return listing.by_name(shapes.sources(t).select("name", "segment"))


@query(
    "t02_case_insensitive_order",
    """select s_suppkey, case when s_suppkey % 2 = 0 then lower(s_name) else s_name end as name,
  row_number() over (order by upper(s_name), case when s_suppkey % 2 = 0 then lower(s_name) else s_name end, s_suppkey) as position
  from supplier""",
)
def _(t):
    name = F.when(F.col("s_suppkey") % 2 == 0, F.lower("s_name")).otherwise(F.col("s_name"))
    rows = t.supplier.select("s_suppkey", name.alias("name"), F.upper("s_name").alias("folded"))
    return listing.positioned(rows, ["folded", "name", "s_suppkey"]).select("s_suppkey", "name", "position")


@query(
    "t03_fair_pick",
    f"{with_shapes('sources')} select name, url from sources where url is not null order by md5('pod-3|' || name), name limit 40",
)
def _(t):
    return listing.fair_pick(shapes.sources(t).where("url is not null").select("name", "url"), 40, "pod-3")


@query(
    "t04_drop_oldest",
    f"""{with_shapes("beats")} select name, seq from beats qualify row_number() over (partition by name order by at_us desc, seq desc) <= 16""",
)
def _(t):
    newest = listing.newest_rows(shapes.beats(t), ["name"], [F.desc("at_us"), F.desc("seq")], 16)
    return newest.select("name", "seq")


@query(
    "a11_latest_n_per_stream",
    f"""{with_shapes("beats")} select name, seq, at_us, value from beats where kind = 'click'
  qualify row_number() over (partition by name order by at_us desc, seq desc) <= 64""",
)
def _(t):
    klv = shapes.beats(t).where("kind = 'click'")
    return listing.newest_rows(klv, ["name"], [F.desc("at_us"), F.desc("seq")], 64).select("name", "seq", "at_us", "value")


@query("a10_latest_per_stream", f"{REG} select name, heartbeat_us, state, owner from registry")
def _(t):
    b = ops.latest_per_name(shapes.beats(t), ["at_us", "seq"])
    return b.select(
        "name", F.col("at_us").alias("heartbeat_us"), F.when(F.col("kind") == "error", "Interrupted").otherwise("Live").alias("state"),
        F.concat(F.lit("pod-"), (F.col("k") % 5).cast("string")).alias("owner"),
    )


@query(
    "a13_stream_marking",
    f"""{with_shapes("beats")} select name, case when k % 3 = 0 then null when k % 3 = 1 then 'SECRET' else 'RESTRICTED' end as marking
  from beats qualify row_number() over (partition by name order by at_us desc, seq desc) = 1""",
)
def _(t):
    marking = F.when(F.col("k") % 3 == 1, "SECRET").when(F.col("k") % 3 == 2, "RESTRICTED")
    samples = shapes.beats(t).select("name", "at_us", "seq", marking.alias("marking"))
    return ops.latest_per_name(samples, ["at_us", "seq"]).select("name", "marking")
