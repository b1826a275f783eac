"""Telemetry queries."""

from pyspark.sql import functions as F

from ..operators import telemetry as ops
from . import shapes
from .registry import query
from .shapes import beat_lane, with_shapes

BEATS = with_shapes("beats")
PACKETS = with_shapes("beats", "packets")


def sensor_rows(t):
    """A fixed sensor's readings per event."""
    k, value = F.col("k"), F.col("value")
    return shapes.beats(t).select(
        F.col("name").alias("stream"), "seq", F.col("at_us").alias("timestamp_us"),
        (value / 10 - 20).alias("latitude"), (k * 3.0 - 140).alias("longitude"), (value * 10).alias("altitude_m"),
        (k * 3.6).alias("true_bearing"), (k * -1.5).alias("relative_elevation"), (k + 1.0).alias("horizontal_fov"),
        (value / 5).alias("vertical_fov"), F.when(k % 3 == 0, "secret").when(k % 3 == 1, "UNCLASSIFIED").alias("classification"),
    )


U16 = lambda v, lo, hi: f"{lo} + round_even(({v} - ({lo})) / ({hi} - ({lo})) * 65535, 0) * ({hi} - ({lo})) / 65535"
S32 = lambda v, r: f"round_even({v} / {r}.0 * 2147483647, 0) * {r}.0 / 2147483647"
SENSORS = f"""{BEATS}, s as (select name as stream, seq, at_us as timestamp_us, value / 10 - 20 as latitude, k * 3.0::double - 140 as longitude,
    value * 10 as altitude_m, k * 3.6::double as true_bearing, k * -1.5::double as relative_elevation, k + 1.0::double as horizontal_fov,
    value / 5 as vertical_fov, case k % 3 when 0 then 'SECRET' when 1 then 'UNCLASSIFIED' end as classification from beats)"""


@query(
    "k01_decode_telemetry",
    f"""{SENSORS} select stream, seq, 'ok' as status, timestamp_us, 'SYNTHESISED STATIC SENSOR' as platform_designation, classification,
  16 as version, round({U16('true_bearing', 0, 360)}, 6) as platform_heading, round({S32('latitude', 90)}, 6) as sensor_latitude,
  round({S32('longitude', 180)}, 6) as sensor_longitude, round({U16('altitude_m', -900, 19000)}, 6) as sensor_true_altitude,
  round({U16('horizontal_fov', 0, 180)}, 6) as sensor_horizontal_fov, round({U16('vertical_fov', 0, 180)}, 6) as sensor_vertical_fov,
  0.0::double as sensor_relative_azimuth, round({S32('relative_elevation', 180)}, 6) as sensor_relative_elevation, true as synthesised from s""",
)
def _(t):
    decoded = ops.decode_telemetry(ops.encode_telemetry(sensor_rows(t), "timestamp_us").drop("timestamp_us"))
    six = lambda c: F.round(c, 6).alias(c)
    return decoded.select(
        "stream", "seq", "status", "timestamp_us", "platform_designation", "classification", "version", six("platform_heading"),
        six("sensor_latitude"), six("sensor_longitude"), six("sensor_true_altitude"), six("sensor_horizontal_fov"),
        six("sensor_vertical_fov"), six("sensor_relative_azimuth"), six("sensor_relative_elevation"),
        ops.provenance(F.col("platform_designation")).alias("synthesised"),
    )


@query("f23_klv_provenance", f"{SENSORS} select stream, seq, seq % 2 = 0 as synthesised from s")
def _(t):
    from ..functions.constants import SYNTHETIC_DESIGNATION

    designation = F.when(F.col("seq") % 2 == 0, F.lit(SYNTHETIC_DESIGNATION)).when(F.col("seq") % 3 == 0, F.lit("MQ-9"))
    return shapes.beats(t).select(F.col("name").alias("stream"), "seq", ops.provenance(designation).alias("synthesised"))


SYNTH_FROM, SYNTH_TO = 1_704_067_200_000_000, 1_704_067_205_000_000


def sensors(t):
    c = F.col("cust_no")
    return shapes.sources(t).select(
        "name", "enabled", (c % 4 == 0).alias("own_klv"), (c % 100 - 5).cast("double").alias("latitude"),
        (c % 360 - 170).cast("double").alias("longitude"), (c % 1900 * 10).cast("double").alias("altitude_m"),
        (c % 361).cast("double").alias("true_bearing"), F.lit(-10.0).alias("relative_elevation"), (c % 50 + 1).cast("double").alias("horizontal_fov"),
        F.lit(20.0).alias("vertical_fov"), F.when(c % 5 == 0, "SECRET").alias("classification"),
    )


@query(
    "k02_synthesise_telemetry",
    f"""{with_shapes("sources")}, s as (select * from sources where enabled and cust_no % 4 <> 0 and cust_no % 100 - 5 <= 90 and cust_no % 360 - 170 <= 180),
  ticks as (select s.*, unnest(generate_series({SYNTH_FROM}, {SYNTH_TO}, 1000000)) as timestamp_us from s)
select name, timestamp_us, 'ok' as status, case when cust_no % 5 = 0 then 'SECRET' end as classification,
  round({S32('(cust_no % 100 - 5)::double', 90)}, 6) as sensor_latitude, round({U16('(cust_no % 361)::double', 0, 360)}, 6) as platform_heading from ticks""",
)
def _(t):
    decoded = ops.decode_telemetry(ops.synthesise_telemetry(sensors(t), SYNTH_FROM, SYNTH_TO).drop("timestamp_us"))
    return decoded.select(
        "name", "timestamp_us", "status", "classification", F.round("sensor_latitude", 6).alias("sensor_latitude"),
        F.round("platform_heading", 6).alias("platform_heading"),
    )


def damaged(t):
    """Packets of which every seventh has a flipped byte, every eleventh is another standard's, every 13th is cut."""
    good = ops.encode_telemetry(sensor_rows(t), "timestamp_us")
    flipped = F.concat(F.substring("data", 1, 20), F.unhex(F.lit("FF")), F.expr("substring(data, 22)"))
    other = F.concat(F.unhex(F.lit("00")), "data")
    data = (
        F.when(F.col("seq") % 7 == 0, flipped).when(F.col("seq") % 11 == 0, other)
        .when(F.col("seq") % 13 == 0, F.substring("data", 1, 40)).otherwise(F.col("data"))
    )
    return ops.decode_telemetry(good.withColumn("data", data).withColumn("received_us", F.col("timestamp_us")).drop("timestamp_us"))


DAMAGED = f"""{SENSORS}, d as (select *, case when seq % 7 = 0 then 'bad_checksum' when seq % 11 = 0 then 'not_0601' when seq % 13 = 0 then 'malformed'
    else 'ok' end as status from s)"""


@query(
    "a12_klv_accounting",
    f"""{DAMAGED} select stream, count(*) filter (status in ('ok', 'not_0601')) as packets, count(*) filter (status not in ('ok', 'not_0601')) as rejected,
  coalesce(max(case when status in ('ok', 'not_0601') then timestamp_us end), -1) as last_seen from d group by stream""",
)
def _(t):
    return ops.klv_accounting(damaged(t), "received_us").fillna(-1, ["last_seen"])


@query(
    "k05_checksum_audit",
    f"""{DAMAGED} select stream, count(*) as packets, count(*) filter (status = 'bad_checksum') as failed,
  round(count(*) filter (status = 'bad_checksum') / count(*), 6) as failed_share from d where status <> 'not_0601' group by stream""",
)
def _(t):
    return ops.checksum_audit(damaged(t)).withColumn("failed_share", F.round("failed_share", 6))


@query(
    "j07_nearest_klv",
    f"""{PACKETS}, frames as (select stream, seq, pts from packets where is_key), klv as (select stream, seq as klv_seq, pts as klv_pts from packets
    where kind in ('click', 'error') and k % 9 <> 0),
  ranked as (select f.stream, f.seq, k.klv_seq, row_number() over (partition by f.stream, f.seq order by abs(k.klv_pts - f.pts), klv_seq) as r
    from frames f left join klv k on f.stream = k.stream)
select stream, seq, coalesce(klv_seq, -1) as klv_seq from ranked where r = 1""",
)
def _(t):
    p = shapes.packets(t)
    frames = p.where("is_key").select("stream", "seq", "pts")
    samples = p.where("kind in ('click', 'error')").select("stream", "seq", F.when(F.col("k") % 9 != 0, F.col("pts")).alias("pts"))
    aligned = ops.nearest_klv(frames, samples, "stream", "pts", "seq", 86_400_000)
    return aligned.select("stream", "seq", F.coalesce("klv.seq", F.lit(-1)).alias("klv_seq"))


@query(
    "j08_platform_state_at_detection",
    f"""{BEATS}, d as (select name, seq, at_us from beats where kind = 'click'), s as (select name, seq as s_seq, at_us as s_us, value from beats where kind <> 'click'
    union all select name, seq, at_us, value from beats where kind = 'click' and k % 5 = 0),
  ranked as (select d.*, s.s_seq, s.s_us, s.value, row_number() over (partition by d.name, d.seq order by s.s_us desc, s.s_seq desc) as r
    from d left join s on d.name = s.name and s.s_us <= d.at_us)
select name, seq, coalesce(case when at_us - s_us <= 14400000000 then s_seq end, -1) as telemetry_seq,
  case when at_us - s_us <= 14400000000 then value end as value from ranked where r = 1""",
)
def _(t):
    b = shapes.beats(t)
    sets = b.where("kind <> 'click' or k % 5 = 0").select("name", "seq", "at_us", "value")
    found = ops.platform_state_at_detection(
        b.where("kind = 'click'").select("name", "seq", "at_us"), sets, "name", "at_us", "seq", 14_400_000_000, shapes.DAY_US
    )
    return found.select("name", "seq", F.coalesce("platform.seq", F.lit(-1)).alias("telemetry_seq"), F.col("platform.value").alias("value"))


@query(
    "w16_path_continuity",
    f"""{BEATS}, p as (select name, seq, value / 10 as lat, k / 10.0::double as lon, value as heading, k - 50.0::double as pitch, k / 2.0::double as roll, k * 1.0::double - 95 as elev,
    k * 1.6::double as hfov, value / 10 as vfov, lag(value / 10) over w as lat0, lag(k / 10.0::double) over w as lon0 from beats
    window w as (partition by name order by at_us, seq))
select name, seq, coalesce(abs(lat - lat0) <= 5, true) and coalesce(abs(lon - lon0) <= 5, true) as step_ok,
  heading between 0 and 360 and pitch between -20 and 20 and roll between -50 and 50 as attitude_ok, elev between -90 and 0 as elevation_ok,
  coalesce(abs(hfov / vfov - 16 / 9.0::double) <= 0.5, false) as fov_ok from p""",
)
def _(t):
    k, value = F.col("k"), F.col("value")
    sets = shapes.beats(t).select(
        "name", "seq", "at_us", (value / 10).alias("sensor_latitude"), (k / 10.0).alias("sensor_longitude"), value.alias("platform_heading"),
        (k - 50.0).alias("platform_pitch"), (k / 2.0).alias("platform_roll"), (k * 1.0 - 95).alias("sensor_relative_elevation"),
        (k * 1.6).alias("sensor_horizontal_fov"), (value / 10).alias("sensor_vertical_fov"),
    )
    checked = ops.path_continuity(sets, beat_lane(), max_step=5, fov_slack=0.5)
    return checked.select("name", "seq", "step_ok", "attitude_ok", "elevation_ok", "fov_ok")


@query(
    "w17_clock_agreement",
    f"""{PACKETS} select stream, round((max(pts) - min(pts)) * 0.001::double, 6) as pts_seconds, round((max(at_us + k * 1000) - min(at_us + k * 1000)) / 1e6, 6) as tag_seconds,
  abs((max(pts) - min(pts)) * 0.001::double - (max(at_us + k * 1000) - min(at_us + k * 1000)) / 1e6) <= 0.05 as agree from packets group by stream""",
)
def _(t):
    sets = shapes.packets(t).withColumn("tag_us", F.col("at_us") + F.col("k") * 1000)
    spans = ops.clock_agreement(sets, "stream", "pts", "tag_us", 0.001)
    return spans.select("stream", F.round("pts_seconds", 6).alias("pts_seconds"), F.round("tag_seconds", 6).alias("tag_seconds"), "agree")

