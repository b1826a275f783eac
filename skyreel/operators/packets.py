"""Packet tables: keyframe segments, the rolling buffer they form, clocks, decoding plans.

Packets carry ``stream`` and an arrival order; ``pts`` and ``dts`` are ticks of the reference clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import Lane, block, previous, running, sessions
from .sequential import replay, width_for

WINDOW_SECONDS = 30.0
CEILING_BYTES = 96 << 20
CLOCK_RESET_SECONDS = 1.0

# --- segments -----------------------------------------------------------------------------------


def assign_segments(packets: DataFrame, on: Lane, starts: Column) -> DataFrame:
    """Number the keyframe segments; packets before the first start are segment 0, where nothing may join."""
    return sessions(packets, on, starts, "segment")


def segment_stats(segmented: DataFrame, on: Lane, size: str = "size") -> DataFrame:
    return segmented.groupBy(*on.keys, "segment").agg(
        F.min_by("pts", F.struct(*on.order)).alias("start_pts"),
        F.max("pts").alias("end_pts"),
        F.sum(size).alias("bytes"),
        (F.first("segment") > 0).alias("startable"),
        F.count(F.lit(1)).alias("packets"),
    )


def buffer_retained(
    segmented: DataFrame,
    on: Lane,
    seconds_per_tick: float,
    window_seconds: float = WINDOW_SECONDS,
    ceiling: int = CEILING_BYTES,
    size: str = "size",
    whole: bool = False,
) -> DataFrame:
    """The segments a rolling buffer holds after the last packet, and what its last eviction was caused by.

    A stream whose segments fit the ceiling and end in order keeps exactly the longest suffix within both
    limits, which is a reverse running sum.  A segment above the ceiling is thrown away while it is still
    growing, so what remains of it depends on the path: those streams, and only those, are replayed. With
    ``whole``, segments are held whole or not at all: the longest suffix is the answer for every stream.
    """
    keys = list(on.keys)
    # Narrow rows written once, then read by every pass below.
    segmented = cut_lineage(segmented.select(*keys, *on.order, "pts", F.col(size).alias("__size"), "segment"))
    size = "__size"
    segments = cut_lineage(segment_stats(segmented, on, size))
    seg_lane = Lane(on.keys, ("segment",), block("segment", 1 << 12))
    ordered = previous(segments, seg_lane, __end=F.col("end_pts"), __start=F.col("start_pts"))
    odd = (F.col("bytes") > ceiling) | (F.col("end_pts") < F.col("__end")) | (F.col("start_pts") < F.col("__start"))
    shape = ordered.groupBy(*keys).agg(
        F.max(odd).alias("__odd"), F.max("segment").alias("__last"), F.max_by("end_pts", "segment").alias("__live_edge")
    )
    window_ticks = window_seconds / seconds_per_tick

    plain = shape if whole else shape.where(~F.coalesce(F.col("__odd"), F.lit(False)))
    held = running(segments.join(plain, keys), seg_lane.reversed(), __suffix=("sum", F.col("bytes")))
    fits = (F.col("__suffix") <= ceiling) & (
        ((F.col("__live_edge") - F.col("start_pts")) <= window_ticks) | (F.col("segment") == F.col("__last"))
    )
    kept = held.withColumn("__fits", fits)
    binding = _binding(segmented, kept, on, window_ticks, ceiling, size)
    closed = (
        kept.where("__fits")
        .join(binding, keys, "left")
        .select(*keys, "segment", "start_pts", "end_pts", "bytes", "startable",
                F.coalesce("ceiling_binding", F.lit(False)).alias("ceiling_binding"))
    )
    if whole:
        return closed

    strange = shape.where("__odd").select(*keys)
    rows = segmented.join(strange, keys, "left_semi")  # often none
    types = dict(segmented.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + (
        ", segment long, start_pts long, end_pts long, bytes long, startable boolean, ceiling_binding boolean"
    )
    walked = replay(rows, keys, list(on.order), lambda: _Buffer(len(keys), window_ticks, ceiling), schema, width_for(segmented))
    return closed.unionByName(walked)


def _binding(segmented, kept, on, window_ticks, ceiling, size) -> DataFrame:
    """Whether bytes, not time, evicted the newest segment that is gone."""
    keys = list(on.keys)
    newest_gone = kept.where(~F.col("__fits")).groupBy(*keys).agg(
        F.max_by(F.struct("segment", "start_pts"), "segment").alias("__g")
    )
    since = segmented.join(newest_gone, keys).where(F.col("segment") >= F.col("__g.segment"))
    grown = running(since, on, __grown=("sum", F.col(size)))
    spot = F.struct(*on.order)
    over_bytes = F.min(F.when(F.col("__grown") > ceiling, spot)).alias("b")
    late = (F.col("segment") > F.col("__g.segment")) & (F.col("pts") - F.col("__g.start_pts") > window_ticks)
    crossings = grown.groupBy(*keys).agg(over_bytes, F.min(F.when(late, spot)).alias("w"))
    by_bytes = F.col("b").isNotNull() & (F.col("w").isNull() | (F.col("b") <= F.col("w")))
    return crossings.select(*keys, by_bytes.alias("ceiling_binding"))


class _Buffer:
    """The buffer itself, a packet at a time; it never holds more than the window's segments."""

    def __init__(self, keys: int, window_ticks: float, ceiling: int):
        self.keys, self.window, self.ceiling = keys, window_ticks, ceiling
        self.segments: list[list] = []  # segment, start, end, bytes, startable
        self.bytes, self.binding, self.seen = 0, False, None

    def feed(self, rows: list[tuple]) -> list[tuple]:
        self.who = rows[0][: self.keys]
        for *_, pts, size, segment in rows:
            starts = segment > 0 and segment != self.seen
            self.seen = segment
            if starts or not self.segments:
                self.segments.append([segment, pts, pts, 0, starts])
            newest = self.segments[-1]
            newest[2] = max(newest[2], pts)
            newest[3] += size
            self.bytes += size
            self._keep_suffix()
        return []

    def _keep_suffix(self) -> None:
        """The longest suffix that is light enough and, unless it is the newest segment alone, begins in the window."""
        count, edge, rest, light = len(self.segments), self.segments[-1][2], self.bytes, 0
        while rest > self.ceiling:
            rest -= self.segments[light][3]
            light += 1
        starts = (i for i in range(light, count) if i == count - 1 or edge - self.segments[i][1] <= self.window)
        cut = next(starts, count)
        if cut:
            self.binding = cut == light
            self.bytes -= sum(s[3] for s in self.segments[:cut])
            del self.segments[:cut]

    def finish(self) -> list[tuple]:
        return [(*self.who, *segment, self.binding) for segment in self.segments]


def preroll_start(segments: DataFrame, keys: list[str], seconds_back: Column, seconds_per_tick: float) -> DataFrame:
    """Where a viewer or recording going ``seconds_back`` begins, and how far back that really is.

    The newest startable segment at or before the asked position, else the oldest startable one.
    """
    edge = segments.groupBy(*keys).agg(F.max_by("end_pts", "segment").alias("edge_pts"))
    asked = edge.withColumn(
        "target_pts",
        F.col("edge_pts") - (F.greatest(seconds_back, F.lit(0.0)) / F.lit(seconds_per_tick)).cast("long"),
    )
    open_ = segments.where("startable").join(asked, keys)
    early = F.col("start_pts") <= F.col("target_pts")
    at = F.struct("segment", "start_pts")
    chosen = open_.groupBy(*keys, "edge_pts").agg(
        F.coalesce(F.max_by(at, F.when(early, F.col("segment"))), F.min_by(at, F.col("segment"))).alias("at")
    )
    return chosen.select(
        *keys,
        F.col("at.segment").alias("segment"),
        F.col("at.start_pts").alias("start_pts"),
        ((F.col("edge_pts") - F.col("at.start_pts")) * F.lit(seconds_per_tick)).alias("seconds_back"),
    )


def packets_from(segmented: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Packets of the chosen segment and everything after it."""
    return segmented.join(chosen.select(*keys, F.col("segment").alias("__from")), keys).where(
        F.col("segment") >= F.col("__from")
    ).drop("__from")


def newest_startable_packets(segmented: DataFrame, keys: list[str]) -> DataFrame:
    """What a snapshot is decoded from: the newest segment a decoder can start at, to the end."""
    newest = segmented.where("segment > 0").groupBy(*keys).agg(F.max("segment").alias("segment"))
    return packets_from(segmented, newest, keys)


# --- clocks -------------------------------------------------------------------------------------


def resume_shift(packets: DataFrame, on: Lane, resumed: Column) -> DataFrame:
    """Packets on one clock: every reconnect continues one tick after where the feed before it ended."""
    numbered = sessions(packets, on, resumed, "feed")
    feeds = cut_lineage(
        numbered.groupBy(*on.keys, "feed").agg(
            F.min_by("pts", F.struct(*on.order)).alias("first_pts"), F.max("pts").alias("last_pts")
        )
    )
    feed_lane = Lane(on.keys, ("feed",), block("feed", 1 << 12))
    known = previous(feeds, feed_lane, __before=F.col("last_pts"))
    # An empty clock (nothing before, or a feed that ended at zero) is not continued.
    second = previous(known, feed_lane, __first=F.col("__before"))
    fresh = F.col("__before").isNull() | ((F.col("__before") == 0) & F.col("__first").isNull())
    length = F.when(fresh, F.col("last_pts")).otherwise(F.col("last_pts") - F.col("first_pts") + 1)
    ends = running(second, feed_lane, __end=("sum", length))
    shifts = ends.select(*on.keys, "feed", (F.col("__end") - F.col("last_pts")).alias("shift"))
    return numbered.join(shifts, [*on.keys, "feed"]).withColumn("shifted_pts", F.col("pts") + F.col("shift"))


def rebase_timeline(
    packets: DataFrame, on: Lane, stamp: Column, origin: int, seconds_per_tick: float, reset_seconds: float = CLOCK_RESET_SECONDS
) -> DataFrame:
    """Timestamps moved to start at ``origin``; a clock that steps back too far continues after the last output.

    A step back from one packet to the next always re-anchors, so runs between such steps have one shift
    each and their lengths add up.  Only a run that also sinks below its own maximum in small steps is
    replayed to find where it breaks.
    """
    limit = reset_seconds / seconds_per_tick
    keys = list(on.keys)
    # Only key, order and stamp take part: written once, read by the passes below.
    narrow = cut_lineage(packets.select(*keys, *on.order, stamp.alias("__s")))
    seen = previous(narrow, on, where=F.col("__s").isNotNull(), __p=F.col("__s"))
    stepped = F.coalesce(F.col("__s") < F.col("__p") - limit, F.lit(False))
    runs = cut_lineage(sessions(seen, on, stepped, "__run").drop("__p"))
    in_run = on.by(*keys, "__run")
    sunk = running(runs, in_run, inclusive=False, __top=("max", F.col("__s")))
    drifting = F.coalesce(F.col("__s") < F.col("__top") - limit, F.lit(False))
    suspect = sunk.groupBy(*keys, "__run").agg(F.max(drifting).alias("__bad")).where("__bad").select(*keys, "__run")
    types = dict(packets.dtypes)
    where = [*keys, "__run", *on.order]
    fields = ", ".join(f"{c} {types.get(c, 'long')}" for c in where)
    found = replay(
        runs.join(suspect, [*keys, "__run"], "left_semi").select(*where, "__s"),
        [*keys, "__run"],
        list(on.order),
        lambda: _Breaks(limit),
        f"{fields}, __sub long",
    )
    placed = cut_lineage(runs.join(found, where, "left").withColumn("__sub", F.coalesce("__sub", F.lit(0))))
    stretch = placed.groupBy(*keys, "__run", "__sub").agg(
        F.min_by("__s", F.when(F.col("__s").isNotNull(), F.struct(*on.order))).alias("__first"), F.max("__s").alias("__max")
    )
    # Stretches in order: run numbers first, breaks within a run second.
    stretch_lane = Lane(on.keys, ("__run", "__sub"), block("__run", 1 << 12))
    upto = running(stretch, stretch_lane, inclusive=False, __before=("sum", F.col("__max") - F.col("__first")))
    shifts = upto.select(*keys, "__run", "__sub", (F.lit(origin) + F.col("__before") - F.col("__first")).alias("shift"))
    moved = placed.join(shifts, [*keys, "__run", "__sub"]).select(
        *keys, *on.order, "shift", (F.col("__s") + F.col("shift")).alias("rebased")
    )
    return packets.join(moved, [*keys, *on.order]).select(*packets.columns, "shift", "rebased")


class _Breaks:
    """Numbers the stretches of a run; a row far below the stretch's maximum begins the next."""

    def __init__(self, limit: float):
        self.limit, self.top, self.sub = limit, None, 0

    def feed(self, rows: list[tuple]) -> list[tuple]:
        out = []
        for *where, stamp in rows:
            if stamp is None:  # goes with the stretch it arrives in
                pass
            elif self.top is not None and stamp < self.top - self.limit:
                self.sub += 1
                self.top = stamp
            else:
                self.top = stamp if self.top is None else max(self.top, stamp)
            out.append((*where, self.sub))
        return out

    def finish(self) -> list[tuple]:
        return []


def monotonic_dts(packets: DataFrame, on: Lane) -> DataFrame:
    """Decode times that never repeat or fall: a late one becomes the previous plus one, its pts moved along.

    ``max(dts - n) + n`` over the packets so far is what nudging one packet after another arrives at.
    Packets without a dts pass through.
    """
    stamped = F.col("dts").isNotNull()
    counted = running(packets, on, __n=("count", F.when(stamped, 1)))
    lifted = running(counted, on, __top=("max", F.col("dts") - F.col("__n")))
    out = F.when(stamped, F.col("__top") + F.col("__n"))
    return lifted.withColumn("out_dts", out).select(
        *packets.columns, "out_dts", (F.col("pts") + F.coalesce(F.col("out_dts") - F.col("dts"), F.lit(0))).alias("out_pts")
    )


# --- decoding -----------------------------------------------------------------------------------


def keyframe_intervals(packets: DataFrame, on: Lane, seconds_per_tick: float) -> DataFrame:
    """The sender's keyframe interval as known at every packet: the last positive gap, 0 before there is one."""
    is_key = F.col("is_key")
    keyed = previous(packets, on, where=is_key, __key_pts=F.col("pts"))
    gap = F.when(is_key & (F.col("pts") > F.col("__key_pts")), F.col("pts") - F.col("__key_pts"))
    gapped = keyed.withColumn("__gap", gap)
    latest = previous(gapped, on, where=F.col("__gap").isNotNull(), inclusive=True, __known=F.col("__gap"))
    seconds = F.coalesce(F.col("__known") * F.lit(seconds_per_tick), F.lit(0.0))
    return latest.select(*packets.columns, seconds.alias("keyframe_interval"))


def decode_plan(packets: DataFrame, on: Lane, rate: Column, seconds_per_tick: float) -> DataFrame:
    """Which packets must be decoded for ``rate`` pictures a second (0: keyframes only, infinite: all).

    A predicted packet is skipped when keyframes alone satisfy the rate, and once one is skipped all are
    until the next keyframe: the newest skip is compared with the newest keyframe.
    """
    spot = [*on.keys, *on.order]
    narrow = cut_lineage(packets.select(*spot, "pts", "is_key", rate.alias("__rate")))
    known = keyframe_intervals(narrow, on, seconds_per_tick)
    rate = F.col("__rate")
    suffice = (F.col("keyframe_interval") <= 0) | (rate * F.col("keyframe_interval") <= 1.0001)
    skip = ~F.col("is_key") & ((rate <= 0) | ((rate != float("inf")) & suffice))
    here = F.struct(*on.order)
    newest = running(known, on, __key=("max", F.when(F.col("is_key"), here)), __skipped=("max", F.when(skip, here)))
    waiting = F.col("__skipped").isNotNull() & (F.col("__key").isNull() | (F.col("__skipped") > F.col("__key")))
    plan = newest.select(*spot, "keyframe_interval", (F.col("is_key") | ~waiting).alias("decode"))
    return packets.join(plan, spot)
