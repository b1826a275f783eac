"""Gap sessions: stream life cycles, recordings that triggers keep open, bursts of notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import Lane, around, running, sessions
from .sequential import replay, width_for

FEED_TIMEOUT_US = 5_000_000
GRACE_US = 30_000_000


def gap_sessions(rows: DataFrame, on: Lane, at_us: str, gap_us: int, name: str = "session") -> DataFrame:
    """Rows with ``previous_us`` and a session number that rises after every silence above ``gap_us``."""
    seen = running(rows, on, inclusive=False, previous_us=("max", F.col(at_us)))
    fresh = F.col("previous_us").isNull() | (F.col(at_us) - F.col("previous_us") > gap_us)
    return sessions(seen, on, fresh, name)


def live_sessions(
    packets: DataFrame, on: Lane, at_us: str = "at_us", size: str = "bytes", timeout_us: int = FEED_TIMEOUT_US, grace_us: int = GRACE_US
) -> DataFrame:
    """One row per life of a stream: a reconnect within the grace period is the same life."""
    marked = gap_sessions(packets, on, at_us, grace_us)
    gap = F.col(at_us) - F.col("previous_us")
    return marked.groupBy(*on.keys, "session").agg(
        F.min(at_us).alias("started_us"),
        F.max(at_us).alias("last_us"),
        F.count_if((gap > timeout_us) & (gap <= grace_us)).alias("interruptions"),
        F.count(F.lit(1)).alias("packets"),
        F.sum(size).alias("bytes"),
    )


def lifecycle_events(
    packets: DataFrame, on: Lane, as_of_us: int, at_us: str = "at_us", timeout_us: int = FEED_TIMEOUT_US, grace_us: int = GRACE_US, ended: Column | None = None
) -> DataFrame:
    """State changes of every stream up to ``as_of_us``: Live, Interrupted after a silence, Gone after the grace.

    Rows where ``ended`` holds are no packets but say that the feed has ended: its stream is interrupted at once, and gone a grace
    period after its last packet. Only rows next to a silence matter, so gaps are found first and the changes made out of those.
    """
    keys = [F.col(k) for k in on.keys]
    change = lambda state, when: F.struct(F.lit(state).alias("state"), when.alias("at_us"))
    if ended is None:
        seen = running(packets, on, inclusive=False, previous_us=("max", F.col(at_us)))
        ending = packets.groupBy(*on.keys).agg(F.max(at_us).alias("previous_us")).withColumn(at_us, F.lit(None).cast("long"))
        gaps = seen.select(*keys, at_us, "previous_us").unionByName(ending.select(*keys, at_us, "previous_us"))
        until = F.coalesce(F.col(at_us), F.lit(as_of_us))
        silence = until - F.col("previous_us")
        interrupted = F.when(silence > timeout_us, change("Interrupted", F.col("previous_us") + timeout_us))
        gone = F.when(silence > grace_us, change("Gone", F.col("previous_us") + grace_us))
        back = F.col("previous_us").isNull() | (silence > timeout_us)
        live = F.when(F.col(at_us).isNotNull() & back, change("Live", F.col(at_us)))
        changes = gaps.select(*keys, F.explode(F.array_compact(F.array(interrupted, gone, live))).alias("c"))
        return changes.select(*keys, "c.state", "c.at_us")
    # a packet and the ends of the feed behind it share a number; one row of each is left
    marked = packets.select(*on.keys, *[c for c in on.order if c not in on.keys], *([at_us] if at_us not in on.order else []), on.chunk.alias("__at_chunk"), F.coalesce(ended, F.lit(False)).alias("__ended"))
    laned = Lane(on.keys, on.order, F.col("__at_chunk"))
    counted = running(marked, laned, __no=("count", F.when(~F.col("__ended"), 1)))
    spans = cut_lineage(
        counted.where("__no > 0").groupBy(*on.keys, "__no").agg(
            F.max(F.when(~F.col("__ended"), F.col(at_us))).alias("__from"), F.min(F.when(F.col("__ended"), F.col(at_us))).alias("__end"), F.min("__at_chunk").alias("__at_chunk")
        )
    )
    both = around(spans, Lane(on.keys, ("__no",), F.col("__at_chunk")), F.lit(True), start=F.col("__from"), end=F.col("__end"))
    until = F.coalesce(F.col("after_start"), F.lit(as_of_us))
    silent_at = lambda start, end, to: F.least(F.when(to - start > timeout_us, start + timeout_us), end)
    silent = silent_at(F.col("__from"), F.col("__end"), until)
    before = silent_at(F.col("before_start"), F.col("before_end"), F.col("__from"))
    live = F.when(F.col("before_start").isNull() | before.isNotNull(), change("Live", F.col("__from")))
    interrupted = F.when(silent <= as_of_us, change("Interrupted", silent))
    gone = F.when(until - F.col("__from") > grace_us, change("Gone", F.col("__from") + grace_us))
    changes = both.select(*keys, F.explode(F.array_compact(F.array(live, interrupted, gone))).alias("c"))
    return changes.select(*keys, "c.state", "c.at_us")


def never_fed(created: DataFrame, packets: DataFrame, as_of_us: int, grace_us: int = GRACE_US) -> DataFrame:
    """Streams created over a grace period ago that have not seen one packet. ``created(name, created_us)``."""
    waiting = created.where(F.lit(as_of_us) - F.col("created_us") > grace_us)
    return waiting.join(packets.select("name"), "name", "left_anti")


def bursts(notifications: DataFrame, on: Lane, at_us: str = "at_us", quiet_us: int = 1_000_000) -> DataFrame:
    """Notification bursts: one row per run without a pause of ``quiet_us``, fired when the pause has passed."""
    marked = gap_sessions(notifications, on, at_us, quiet_us - 1, "burst")
    return marked.groupBy(*on.keys, "burst").agg(
        F.min(at_us).alias("first_us"),
        (F.max(at_us) + quiet_us).alias("fires_us"),
        F.count(F.lit(1)).alias("notifications"),
    )


# --- recordings ---------------------------------------------------------------------------------

RECORDING_SECONDS = 30
RECORDING_CAP_SECONDS = 12 * 3600


def recording_sessions(triggers: DataFrame, on: Lane, at_us: str = "at_us", seconds: Column | None = None, cap_seconds: int | None = RECORDING_CAP_SECONDS) -> DataFrame:
    """Recordings that triggers open and extend, one row each.

    The first trigger opens one for its duration, later ones only move its end, never past the cap.
    Without the cap the end is a running maximum, so recordings fall out of window functions.  Runs that
    outlast the cap - and only those - are replayed in order to find where the next recording starts.
    """
    lasting = F.lit(RECORDING_SECONDS) if seconds is None else seconds
    lasting = lasting.cast("double") if cap_seconds is None else F.least(lasting.cast("double"), F.lit(float(cap_seconds)))
    until = F.col(at_us) + (lasting * 1e6).cast("long")
    timed = triggers.select(*dict.fromkeys([*on.keys, *on.order, at_us]), until.alias("__until"))
    ends = running(timed, on, inclusive=False, __open=("max", F.col("__until")))
    fresh = F.col("__open").isNull() | (F.col(at_us) >= F.col("__open"))
    runs = sessions(ends, on, fresh, "run")
    if cap_seconds is not None:
        runs = cut_lineage(runs)  # read three times below
    whole = runs.groupBy(*on.keys, "run").agg(
        F.min(at_us).alias("started_us"), F.max("__until").alias("ends_us"), F.count(F.lit(1)).alias("triggers")
    )
    if cap_seconds is None:
        return whole.drop("run")
    cap = cap_seconds * 1_000_000
    long_run = F.col("ends_us") - F.col("started_us") > cap
    short = whole.where(~long_run).drop("run")
    replayed = runs.join(whole.where(long_run).select(*on.keys, "run"), [*on.keys, "run"], "left_semi")
    keys = list(on.keys)
    others = [c for c in on.order if c != at_us]
    rows = replayed.select(*keys, "run", *others, at_us, "__until")
    fields = ", ".join(f"{k} {dict(triggers.dtypes)[k]}" for k in keys)
    schema = f"{fields}, started_us long, ends_us long, triggers long"
    capped = replay(rows, [*keys, "run"], list(on.order), lambda: _CappedRecordings(len(keys), cap), schema, width_for(runs))
    return short.unionByName(capped)


class _CappedRecordings:
    def __init__(self, keys: int, cap: int):
        self.keys, self.cap = keys, cap
        self.open: tuple | None = None  # started, ends, triggers

    def feed(self, rows: list[tuple]) -> list[tuple]:
        self.who, done = rows[0][: self.keys], []
        for *_, at, until in rows:
            if self.open is not None and at < self.open[1]:
                started, ends, triggers = self.open
                self.open = (started, max(ends, min(until, started + self.cap)), triggers + 1)
                continue
            done.extend(self.finish())
            self.open = (at, min(until, at + self.cap), 1)
        return done

    def finish(self) -> list[tuple]:
        return [(*self.who, *self.open)] if self.open else []


def roll_parts(packets: DataFrame, started_us: str, at_us: str = "at_us", part_seconds: int = 300) -> DataFrame:
    """Which part of its recording a packet lands in; parts are tumbling from the recording's start."""
    return packets.withColumn("part", F.floor((F.col(at_us) - F.col(started_us)) / F.lit(part_seconds * 1_000_000)))

