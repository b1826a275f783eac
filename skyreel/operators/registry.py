"""The stream registry: who is on air, who owns what, and what each replica or worker should do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import media
from .listing import fair_pick, turn

GRACE_US = 30_000_000
BEAT_US = 2_000_000

# --- staleness ----------------------------------------------------------------------------------


def is_gone(heartbeat_us: Column, as_of_us: Column, grace_us: int = GRACE_US) -> Column:
    return as_of_us - heartbeat_us > grace_us


def owner_alive(heartbeat_us: Column, as_of_us: Column, beat_us: int = BEAT_US) -> Column:
    """An owner may miss two beats; after three it no longer counts."""
    return as_of_us - heartbeat_us <= 3 * beat_us


def visible_streams(registry: DataFrame, as_of_us: Column, grace_us: int = GRACE_US) -> DataFrame:
    return registry.where(~is_gone(F.col("heartbeat_us"), as_of_us, grace_us))


def telemetry_age_flag(received_us: Column, as_of_us: Column, stale_us: int = 3_000_000) -> Column:
    """``unknown`` without a receipt time, ``stale`` beyond the limit, else null."""
    return F.when(received_us.isNull(), "unknown").when(as_of_us - received_us > stale_us, "stale")


def latest_per_name(beats: DataFrame, order: list[str], key: str = "name") -> DataFrame:
    """The newest row per stream, nulls included; map tasks reduce to one row per stream first."""
    row = F.struct(*beats.columns)
    return beats.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("__row")).select("__row.*")


# --- claims and admission -----------------------------------------------------------------------


def _held_live(prefix: str, as_of_us: Column, beat_us: int) -> Column:
    return (F.col(f"{prefix}state") == "Live") & owner_alive(F.col(f"{prefix}heartbeat_us"), as_of_us, beat_us)


def _prefixed(registry: DataFrame, prefix: str = "held_") -> DataFrame:
    return registry.select(*[F.col(c).alias(prefix + c) for c in registry.columns])


def admission_verdict(
    attempts: DataFrame, registry: DataFrame, local: DataFrame, as_of_us: Column, max_streams: int, beat_us: int = BEAT_US
) -> DataFrame:
    """``conflict``, ``overload`` or ``admit`` per ``attempts(pod, name)``. ``local(pod, name)`` is on air there."""
    held = _prefixed(registry.select("name", "state", "heartbeat_us"))
    load = local.groupBy("pod").agg(F.count(F.lit(1)).alias("load"))
    own = local.select("pod", "name", F.lit(True).alias("already_here"))
    busy = F.lit(max_streams > 0) & (F.coalesce("load", F.lit(0)) >= max_streams) & F.col("already_here").isNull()
    return (
        attempts.join(held, F.col("name") == F.col("held_name"), "left")
        .join(load, "pod", "left")
        .join(own, ["pod", "name"], "left")
        .select(
            *attempts.columns,
            F.when(F.coalesce(_held_live("held_", as_of_us, beat_us), F.lit(False)), "conflict")
            .when(busy, "overload")
            .otherwise("admit")
            .alias("verdict"),
        )
    )


def claim_outcome(
    attempts: DataFrame, registry: DataFrame, as_of_us: Column, beat_us: int = BEAT_US, grace_us: int = GRACE_US
) -> DataFrame:
    """``refused``, ``resumed`` (start time carried over) or ``taken`` per ``attempts(name, owner, started_us)``."""
    held = _prefixed(registry.select("name", "owner", "state", "heartbeat_us", "started_us"))
    refused = (F.col("held_owner") != F.col("owner")) & _held_live("held_", as_of_us, beat_us)
    resumed = F.col("held_name").isNotNull() & ~is_gone(F.col("held_heartbeat_us"), as_of_us, grace_us)
    outcome = F.when(F.coalesce(refused, F.lit(False)), "refused").when(resumed, "resumed").otherwise("taken")
    return attempts.join(held, F.col("name") == F.col("held_name"), "left").select(
        "name",
        "owner",
        outcome.alias("outcome"),
        F.when(outcome == "resumed", F.col("held_started_us")).otherwise(F.col("started_us")).alias("started_us"),
    )


# --- sources and forwards -----------------------------------------------------------------------


def source_rows(sources: DataFrame, streams: DataFrame) -> DataFrame:
    """Configured sources with the stream of the same name: NotOnAir, Live or Interrupted."""
    live = streams.select(F.col("name"), F.col("state").alias("stream_state"), F.col("bytes").alias("stream_bytes"))
    state = (
        F.when(F.col("stream_state").isNull(), "NotOnAir")
        .when(F.col("stream_state") == "Interrupted", "Interrupted")
        .otherwise("Live")
    )
    return sources.join(live, "name", "left").withColumn("state", state)


def forward_detail(configured: DataFrame, reported: DataFrame) -> DataFrame:
    """Every configured forward with the first status its owner reports for it.

    ``configured(name, id, url)``, ``reported(name, id, pos, connected)``.
    """
    first = reported.groupBy("name", "id").agg(F.min_by("connected", "pos").alias("connected"))
    return configured.join(first, ["name", "id"], "left")


def forward_counts(configured: DataFrame, reported: DataFrame) -> DataFrame:
    """Configured against connected forwards per source."""
    wanted = configured.groupBy("name").agg(F.count(F.lit(1)).alias("configured"))
    up = reported.groupBy("name").agg(F.count_if("connected").alias("connected"))
    return wanted.join(up, "name", "left").fillna(0, ["connected"])


def forward_plan(desired: DataFrame, running: DataFrame, as_of_us: Column, retry_us: int) -> DataFrame:
    """Forwards to stop and start: gone, edited, failed long enough ago, new.

    ``desired(name, id, url)``, ``running(name, id, url, finished, last_attempt_us)``.
    """
    now = running.select(
        F.col("name").alias("r_name"), F.col("id").alias("r_id"), F.col("url").alias("r_url"), "finished", "last_attempt_us"
    )
    both = desired.join(now, (F.col("name") == F.col("r_name")) & (F.col("id") == F.col("r_id")), "full_outer")
    stop, start = F.array(F.lit("stop")), F.array(F.lit("start"))
    retry = F.col("finished") & (as_of_us - F.col("last_attempt_us") >= retry_us)
    actions = (
        F.when(F.col("id").isNull(), stop)
        .when(F.col("r_id").isNull(), start)
        .when((F.col("url") != F.col("r_url")) | retry, F.concat(stop, start))
    )
    return both.select(
        F.coalesce("name", "r_name").alias("name"),
        F.coalesce("id", "r_id").alias("id"),
        F.explode(actions).alias("action"),
        F.coalesce("url", "r_url").alias("url"),
    )


def adopt_candidates(
    sources: DataFrame,
    local: DataFrame,
    registry: DataFrame,
    attempted: DataFrame,
    me: str,
    as_of_us: Column,
    max_streams: int,
    backoff_us: int,
    beat_us: int = BEAT_US,
) -> DataFrame:
    """Pull sources this replica should pick up, in an order of its own, up to its free slots.

    ``local(name)`` is on air here, ``attempted(name, at_us)`` was tried from here. ``max_streams`` 0 is no limit.
    """
    elsewhere = registry.where(_held_live("", as_of_us, beat_us) & (F.col("owner") != me)).select("name")
    recent = attempted.where(as_of_us - F.col("at_us") < backoff_us).select("name")
    free = sources.where("enabled and length(url) > 0").select("name", "url")
    for taken in (local.select("name"), elsewhere, recent):
        free = free.join(taken, "name", "left_anti")
    # An order of its own per replica keeps a fleet from reaching for one source on the same beat.
    if max_streams == 0:
        return free
    first = fair_pick(free, max_streams, me)
    spot = F.row_number().over(Window.orderBy(turn(F.col("name"), me), "name"))  # at most max_streams rows
    free_slots = F.lit(max_streams) - local.agg(F.count(F.lit(1))).scalar()
    return first.withColumn("__spot", spot).where(F.col("__spot") <= free_slots).select("name", "url")


def prune_stale_keys(cache: DataFrame, current: DataFrame, key: str = "name") -> DataFrame:
    """Cached keys the current listing no longer carries."""
    return cache.join(current.select(key), key, "left_anti")


def overall_state(state: Column, configured: Column, connected: Column) -> Column:
    degraded = (state == "Live") & (configured > connected)
    return F.when((state == "Interrupted") | degraded, "alert").when(state == "Live", "streaming").otherwise("inactive")


def state_text(state: Column, configured: Column, connected: Column) -> Column:
    return (
        F.when((state == "Live") & (configured > connected), "Degraded")
        .when(state == "Live", "Streaming")
        .when(state == "Interrupted", "Interrupted")
        .otherwise("Not on air")
    )


def filter_sources(rows: DataFrame, state: str = "all", kind: str = "all", text: str = "") -> DataFrame:
    """Dashboard filter over ``rows(name, output, url, overall, forward_urls)``."""
    out = rows
    if state != "all":
        out = out.where(F.col("overall") == state)
    if kind != "all":
        out = out.where(F.when(F.length("url") > 0, "pull").otherwise("push") == kind)
    if text.strip():
        needle = F.lit(text.lower())
        hit = lambda c: F.coalesce(F.contains(F.lower(c), needle), F.lit(False))
        out = out.where(hit(F.col("name")) | hit(F.col("output")) | hit(F.col("url")) | F.exists("forward_urls", hit))
    return out


def dashboard_counts(rows: DataFrame, shown: Column) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("overall") == s)
    return rows.agg(
        F.count(F.lit(1)).alias("total"), is_("streaming").alias("streaming"), is_("alert").alias("alert"),
        is_("inactive").alias("inactive"), F.count_if(shown).alias("shown"),
    )


# --- detection workers --------------------------------------------------------------------------


def worker_plan(listing: DataFrame, held: DataFrame, me: str, api_url: str, default_rate: int, default_model: str) -> DataFrame:
    """What one worker does with each stream: keep, stop or claim, with the settings it runs under.

    ``listing(name, detection_enabled, worker, owner_address, rate, model)``, ``held(name)``.
    """
    mine = held.select(F.col("name").alias("held_name"))
    both = listing.join(mine, F.col("name") == F.col("held_name"), "full_outer")
    held_here = F.col("held_name").isNotNull()
    ours = F.coalesce(F.col("detection_enabled") & (F.col("worker").isNull() | (F.col("worker") == me)), F.lit(False))
    action = (
        F.when(held_here & ours, "keep")
        .when(held_here, "stop")
        .when(F.col("detection_enabled") & F.col("worker").isNull(), "claim")
    )
    address = F.when(F.length("owner_address") > 0, F.col("owner_address")).otherwise(F.lit(api_url))
    return both.withColumn("action", action).where("action is not null").select(
        F.coalesce("name", "held_name").alias("name"),
        "action",
        F.when(F.col("action") != "stop", F.rtrim(address, F.lit("/"))).alias("owner_url"),
        F.when(F.col("action") != "stop", F.when(F.col("rate") > 0, F.col("rate")).otherwise(default_rate)).alias("rate"),
        F.when(F.col("action") != "stop", F.coalesce(media.normalize_model(F.col("model")), F.lit(default_model))).alias("model"),
    )


def effective_decode_rate(subscribers: DataFrame) -> DataFrame:
    """Pictures a second the fastest subscriber of each stream asks for; 0 is keyframes only."""
    return subscribers.groupBy("name").agg(F.coalesce(F.max("rate"), F.lit(0.0)).alias("rate"))


def census(entries: DataFrame) -> DataFrame:
    """Fleet counts per owner. ``entries(owner, state, startable, viewers, recording_us, forwards)``."""
    return entries.groupBy("owner").agg(
        F.count(F.lit(1)).alias("streams"),
        F.count_if(F.col("state") == "Interrupted").alias("interrupted"),
        F.count_if(~F.col("startable")).alias("unstartable"),
        F.sum("viewers").cast("long").alias("viewers"),
        F.count("recording_us").alias("recordings"),
        F.sum("forwards").cast("long").alias("forwards"),
    )
