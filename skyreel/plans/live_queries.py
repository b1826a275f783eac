"""Batch twins of the streaming operators, and the sources that are files."""

from pyspark.sql import functions as F

from ..operators import arrival, claims
from ..sources.objects import list_objects
from . import shapes
from .registry import query
from .shapes import beat_lane, with_shapes

HOUR = 3_600_000_000
BEATS = with_shapes("beats")
LEASE = 12 * HOUR


@query("s01_list_objects", "select c_custkey // 100 as piece, cast(sum(octet_length(encode(c_name)) + 1) as bigint) as size from customer group by 1")
def _(t):
    """Customers' names stored as objects of a hundred keys each, then listed: the contents are not read again."""
    from .streaming_queries import work_folder

    root = work_folder(t)
    piece = F.floor(F.col("c_custkey") / 100).alias("piece")
    t.customer.select(piece, F.col("c_name").alias("value")).repartition("piece").write.partitionBy("piece").text(root)
    found = list_objects(t.spark, root)
    return found.select(F.regexp_extract("key", "piece=(\\d+)/", 1).cast("long").alias("piece"), "size")


def lease_events(t):
    action = F.when(F.col("kind") == "signup", "release").when(F.col("k") % 25 == 0, "disable").otherwise("claim")
    worker = F.concat(F.lit("worker-"), (F.col("k") % 3).cast("string"))
    return shapes.beats(t).select(F.col("name").alias("stream"), "seq", "at_us", action.alias("action"), worker.alias("worker"))


LEASES = f"""with recursive {BEATS[5:]}, n as (select name as stream, seq, at_us, case when kind = 'signup' then 'release' when k % 25 = 0 then 'disable' else 'claim' end as action,
    'worker-' || (k % 3) as worker, row_number() over (partition by name order by at_us, seq) as rn from beats),
  w as (select stream, seq, at_us, action, worker, rn, case action when 'claim' then worker end as held, case action when 'claim' then at_us end as since,
      action <> 'release' as granted from n where rn = 1
    union all select n.stream, n.seq, n.at_us, n.action, n.worker, n.rn,
      case when n.action = 'claim' then case when w.held is not null and n.at_us - w.since <= {LEASE} and w.held <> n.worker then w.held else n.worker end
        when n.action = 'release' and (w.held is null or w.held <> n.worker) then w.held end,
      case when n.action = 'claim' then case when w.held is not null and n.at_us - w.since <= {LEASE} and w.held <> n.worker then w.since else n.at_us end
        when n.action = 'release' and (w.held is null or w.held <> n.worker) then w.since end,
      case when n.action = 'claim' then not (w.held is not null and n.at_us - w.since <= {LEASE} and w.held <> n.worker)
        when n.action = 'release' then coalesce(w.held = n.worker, false) else true end
    from w join n on n.stream = w.stream and n.rn = w.rn + 1)
select stream, seq, at_us, action, worker, granted, case when held is not null and at_us - since <= {LEASE} then held end as holder from w"""


@query("x04_detector_leases", LEASES)
def _(t):
    return claims.detector_leases(lease_events(t), beat_lane("stream"), LEASE)


CLAIMS = f"""with recursive {BEATS[5:]}, n as (select name, seq, at_us, 'pod-' || (k % 3) as owner, row_number() over (partition by name order by at_us, seq) as rn from beats),
  w as (select name, seq, at_us, owner, rn, owner as held, at_us as beat, at_us as started_us, 'taken' as outcome from n where rn = 1
    union all select name, seq, at_us, owner, rn, case when refused then held else owner end, case when refused then beat else at_us end,
      case when refused or resumed then started_us else at_us end, case when refused then 'refused' when resumed then 'resumed' else 'taken' end
    from (select n.name, n.seq, n.at_us, n.owner, n.rn, w.held, w.beat, w.started_us, w.held <> n.owner and n.at_us - w.beat <= {9 * HOUR} as refused,
      n.at_us - w.beat <= {12 * HOUR} as resumed from w join n on n.name = w.name and n.rn = w.rn + 1))
select name, seq, at_us, owner, outcome, started_us from w"""


@query("x05_name_claims", CLAIMS)
def _(t):
    attempts = shapes.beats(t).select("name", "seq", "at_us", F.concat(F.lit("pod-"), (F.col("k") % 3).cast("string")).alias("owner"))
    return claims.name_claims(attempts, beat_lane(), 3 * HOUR, 12 * HOUR)


HELD = f"""{BEATS[5:]}, r as (select name, 'pod-' || ((min(k) + 1) % 3) as holder, case when min(seq) % 2 = 0 then 'Interrupted' else 'Live' end as state,
    min(at_us) - (min(seq) % 15) * {HOUR} as heartbeat_us, min(at_us) - {50 * HOUR} as began_us from beats group by name)"""
CLAIMS_OVER_REGISTRY = f"""with recursive {HELD}, n as (select name, seq, at_us, 'pod-' || (k % 3) as owner, row_number() over (partition by name order by at_us, seq) as rn from beats),
  w as (select name, cast(null as bigint) as seq, heartbeat_us as at_us, holder as owner, cast(0 as bigint) as rn, holder as held, heartbeat_us as beat, began_us as started_us, '' as outcome, state = 'Live' as live from r
    union all select name, seq, at_us, owner, rn, case when refused then held else owner end, case when refused then beat else at_us end,
      case when refused or resumed then started_us else at_us end, case when refused then 'refused' when resumed then 'resumed' else 'taken' end, live or not refused
    from (select n.name, n.seq, n.at_us, n.owner, n.rn, w.held, w.beat, w.started_us, w.live, w.live and w.held <> n.owner and n.at_us - w.beat <= {9 * HOUR} as refused,
      n.at_us - w.beat <= {12 * HOUR} as resumed from w join n on n.name = w.name and n.rn = w.rn + 1))
select name, seq, at_us, owner, outcome, started_us from w where rn > 0"""


def claim_attempts(beats):
    return beats.select("name", "seq", "at_us", "ts", F.concat(F.lit("pod-"), (F.col("k") % 3).cast("string")).alias("owner"))


def held_names(t):
    """A registry as it stood before the first beat: some holders live, some interrupted, some long gone."""
    first = shapes.beats(t).groupBy("name").agg(F.min("k").alias("k"), F.min("seq").alias("seq"), F.min("at_us").alias("at_us"))
    state = F.when(F.col("seq") % 2 == 0, "Interrupted").otherwise("Live")
    return first.select(
        "name", F.concat(F.lit("pod-"), ((F.col("k") + 1) % 3).cast("string")).alias("owner"), state.alias("state"),
        (F.col("at_us") - F.col("seq") % 15 * HOUR).alias("heartbeat_us"), (F.col("at_us") - 50 * HOUR).alias("started_us"),
    )


@query("x05_claims_over_registry", CLAIMS_OVER_REGISTRY)
def _(t):
    return claims.name_claims(claim_attempts(shapes.beats(t)).drop("ts"), beat_lane(), 3 * HOUR, 12 * HOUR, held_names(t))


@query(
    "x12_arrival_flags",
    f"""{BEATS}, p as (select name, seq, at_us, case when k % 13 <> 0 then at_us - (k % 5) * {6 * HOUR} end as pts from beats),
  f as (select *, max(pts) over (partition by name order by at_us, seq rows between unbounded preceding and 1 preceding) as top from p)
select name, count(*) filter (pts is null) as missing, count(*) filter (pts < top) as regressed, count(*) as packets from f group by name""",
)
def _(t):
    pts = F.when(F.col("k") % 13 != 0, F.col("at_us") - (F.col("k") % 5) * (6 * HOUR))
    flagged = arrival.arrival_flags(shapes.beats(t).select("name", "seq", "at_us", pts.alias("pts")), beat_lane())
    return arrival.lateness(flagged, "name")


@query(
    "x12_late_rows",
    f"""{BEATS}, p as (select name, seq, at_us, at_us - (k % 5) * {6 * HOUR} as seen_us from beats),
  f as (select *, max(seen_us) over (partition by name order by at_us, seq rows between unbounded preceding and 1 preceding) as top from p)
select name, seq, seen_us from f where top - seen_us > {8 * HOUR}""",
)
def _(t):
    seen = F.col("at_us") - (F.col("k") % 5) * (6 * HOUR)
    rows = shapes.beats(t).select("name", "seq", "at_us", seen.alias("seen_us"))
    return arrival.late_rows(rows, beat_lane(), "seen_us", 8 * HOUR).select("name", "seq", "seen_us")


@query(
    "x03_registry_table",
    f"""{BEATS} select name, seq, at_us, kind from beats qualify row_number() over (partition by name order by at_us desc, seq desc) = 1 and kind <> 'error'""",
)
def _(t):
    from ..operators.registry import latest_per_name

    newest = latest_per_name(shapes.beats(t).select("name", "seq", "at_us", "kind"), ["at_us", "seq"])
    return newest.where("kind <> 'error'")
