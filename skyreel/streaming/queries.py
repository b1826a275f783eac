"""The live twins of the batch operators, on Structured Streaming.

Time windows and de-duplication use built-in operators with watermarks; rules with memory run as
stateful processors over the same small classes the batch jobs use, with their state in the state store (``turns``).
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, StructField, StructType

from ..operators import catalog, registry
from ..operators.claims import Lease, NameClaim
from ..operators.tracking import TRACK_STATE, Tracker
from ..sources.buckets import Table, update
from ..sources.objects import stream_objects
from ..sources.snapshots import read_latest
from .turns import InTurn, in_turn

# --- built-in operators -------------------------------------------------------------------------


def beat_metrics(beats: DataFrame, at: str = "ts", late: str = "10 seconds", width: str = "2 seconds") -> DataFrame:
    """Totals per heartbeat window and kind."""
    return (
        beats.withWatermark(at, late)
        .groupBy(F.window(at, width), "kind")
        .agg(F.count(F.lit(1)).alias("beats"), F.sum("bytes").alias("bytes"))
    )


def error_alerts(samples: DataFrame, at: str = "ts", late: str = "10 seconds", width: str = "30 seconds", slide: str = "2 seconds", min_beats: int = 15) -> DataFrame:
    """Sliding windows in which a pod's error counter rose."""
    wide = samples.withWatermark(at, late).groupBy(F.window(at, width, slide), "pod").agg(
        (F.max("errors") - F.min("errors")).alias("increase"), F.count(F.lit(1)).alias("beats")
    )
    return wide.where((F.col("increase") > 0) & (F.col("beats") >= min_beats))


def debounced(notifications: DataFrame, at: str = "ts", quiet: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """One row per burst of notifications."""
    return (
        notifications.withWatermark(at, late)
        .groupBy(F.session_window(at, quiet), "name")
        .agg(F.count(F.lit(1)).alias("notifications"))
    )


def live_sessions(packets: DataFrame, at: str = "ts", grace: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    """Lives of streams: a silence longer than ``grace`` ends one. A session window ends at a gap equal to its length,
    so it is a microsecond longer than the grace period."""
    return (
        packets.withWatermark(at, late)
        .groupBy(F.session_window(at, f"{grace} 1 microsecond"), "name")
        .agg(F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes"))
    )


# --- sinks --------------------------------------------------------------------------------------


def analysis_queue(spark: SparkSession, folder: str, schema: StructType, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand out every work item once, oldest file first; lines that do not parse are dropped.

    ``handle`` gets each micro-batch and its number; the checkpoint remembers which files were handed out. A batch that
    is run again has the same number and items, so a handler that keeps its effect by number has it once.
    """
    items = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("latestFirst", False).json(folder)
    return items.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def publish_changes(changes: DataFrame, folder: str) -> None:
    """Append feed rows; :func:`change_feed` picks them up."""
    changes.write.mode("append").parquet(folder)


def change_feed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema("kind string, id string, key string, name string").parquet(folder)


def registry_table(beats: DataFrame, root: str, checkpoint: str, buckets: int = 64):
    """Keep the newest heartbeat per stream in a table of buckets; a row with ``ended`` removes its stream.

    A batch is reduced per stream before it meets the buckets its streams lie in; no other bucket is read or written. A batch
    that is run again finds its version.
    """
    table = Table(root, ("name",), buckets)

    def newest(held: DataFrame, batch: DataFrame) -> DataFrame:
        return registry.latest_per_name(held.unionByName(registry.latest_per_name(batch, ["at_us", "seq"])), ["at_us", "seq"])

    return beats.writeStream.foreachBatch(lambda batch, number: update(batch, table, newest, number + 1)).option("checkpointLocation", checkpoint)


def current_registry(spark: SparkSession, root: str) -> DataFrame | None:
    table = read_latest(spark, root)
    return None if table is None else table.where("not ended")


def ingest_documents(spark: SparkSession, root: str, catalog_root: str, checkpoint: str, requests_root: str | None = None, buckets: int = 64):
    """New objects become catalog rows as they arrive, and, with ``requests_root``, requests to analyse them: one folder a
    micro-batch, written over when the batch runs again. Of the catalog only the buckets of the new ids are rewritten."""
    table = Table(catalog_root, ("id",), buckets)

    def merge(batch: DataFrame, number: int) -> None:
        rows = catalog.import_objects(batch)
        update(rows, table, lambda held, new: catalog.upsert_documents(new, held, "created_at"), number + 1)
        if requests_root is not None:
            asked = rows.select("id", "storage_key", "file_name", "content_type")
            asked.write.mode("overwrite").json(f"{requests_root}/batch={number}")

    return stream_objects(spark, root).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


# --- rules with memory --------------------------------------------------------------------------

SLOT_US = 60_000_000
"""Rows wait in slots of a minute, if the caller names no other width."""


def _timed(rows: DataFrame, at: str | None, late: str) -> DataFrame:
    return rows if at is None else rows.withWatermark(at, late)


class LeaseRule(InTurn):
    memory = "worker string, seen_us long"
    columns = ["stream", "seq", "at_us", "action", "worker", "granted", "holder"]

    def __init__(self, lease_us: int, slot: int, by_time: bool):
        super().__init__(slot, by_time)
        self.lease_us = lease_us

    def step(self, key, rows):
        lease = Lease(self.lease_us)
        lease.worker, lease.seen_us = self.recall() or (None, None)
        out = []
        for seq, at, action, worker in zip(rows["seq"], rows["at_us"], rows["action"], rows["worker"]):
            granted = lease.apply(action, worker, int(at))
            out.append((key[0], seq, at, action, worker, granted, lease.holder(int(at))))
        self.remember(lease.worker, lease.seen_us)
        return out


def detector_leases(events: DataFrame, lease_us: int = 10_000_000, at: str | None = None, late: str = "10 seconds", slot_us: int = SLOT_US) -> DataFrame:
    """Events in the order of each micro-batch; with a timestamp ``at``, in order of time, as the watermark passes them."""
    schema = "stream string, seq long, at_us long, action string, worker string, granted boolean, holder string"
    return in_turn(_timed(events, at, late), ["stream"], LeaseRule(lease_us, slot_us, at is not None), schema)


class ClaimRule(InTurn):
    memory = "owner string, beat_us long, started_us long, live boolean"
    columns = ["name", "seq", "at_us", "owner", "outcome", "started_us"]

    def __init__(self, beat_us: int, grace_us: int, slot: int, by_time: bool):
        super().__init__(slot, by_time)
        self.beat_us, self.grace_us = beat_us, grace_us

    def handleInitialState(self, key, initialState, timerValues):
        row = initialState.iloc[0]
        self.remember(row["owner"], int(row["heartbeat_us"]), int(row["started_us"]), row["state"] == "Live")

    def step(self, key, rows):
        claim = NameClaim(self.beat_us, self.grace_us)
        if (held := self.recall()) is not None:
            claim.hold(*held)
        out = []
        for seq, at, owner in zip(rows["seq"], rows["at_us"], rows["owner"]):
            outcome = claim.apply(owner, int(at))
            out.append((key[0], seq, at, owner, outcome, claim.started))
        self.remember(claim.owner, claim.beat_at, claim.started, claim.live)
        return out


def name_claims(
    attempts: DataFrame, beat_us: int = 2_000_000, grace_us: int = 30_000_000, held: DataFrame | None = None,
    at: str | None = None, late: str = "10 seconds", slot_us: int = SLOT_US,
) -> DataFrame:
    """Claims on names as they come. ``held`` (name, owner, state, heartbeat_us, started_us; a row a name) is the registry a new stream
    starts from: a name that is held but interrupted is free to take."""
    schema = "name string, seq long, at_us long, owner string, outcome string, started_us long"
    rule = ClaimRule(beat_us, grace_us, slot_us, at is not None)
    initial = None if held is None else held.select("name", "owner", "state", "heartbeat_us", "started_us")
    return in_turn(_timed(attempts, at, late), ["name"], rule, schema, initial)


class ChangeRule(InTurn):
    memory = "watched string"
    columns = ["name", "seq", "at_us", "watched"]

    def step(self, key, rows):
        before = rows["watched"].shift(1)
        fresh = (rows["watched"] != before) & ~(rows["watched"].isna() & before.isna())
        held = self.recall()
        first = rows["watched"].iloc[0]
        fresh.iloc[0] = held is None or not (first == held[0] or (pd.isna(first) and held[0] is None))
        last = rows["watched"].iloc[-1]
        self.remember(None if pd.isna(last) else last)
        kept = rows[fresh]
        return [(key[0], *row) for row in zip(kept["seq"], kept["at_us"], kept["watched"])]


def changed_only(rows: DataFrame, at: str | None = None, late: str = "10 seconds", slot_us: int = SLOT_US) -> DataFrame:
    """``rows(name, seq, at_us, watched)`` whose watched text differs from the one emitted before."""
    return in_turn(_timed(rows, at, late), ["name"], ChangeRule(slot_us, at is not None), "name string, seq long, at_us long, watched string")


class LifecycleRule(InTurn):
    """Live, then Interrupted after a silence or the end of the feed, then Gone."""

    memory = "state string, last_ms long"
    columns = ["name", "state", "at_ms"]

    def __init__(self, timeout_ms: int, grace_ms: int, slot: int):
        super().__init__(slot, True)
        self.timeout_ms, self.grace_ms = timeout_ms, grace_ms

    def _silent(self, key, state, last, now, out):
        """What the silence from ``last`` up to ``now`` changes."""
        if state == "Live" and now - last > self.timeout_ms:
            state = "Interrupted"
            out.append((key[0], state, last + self.timeout_ms))
        if state == "Interrupted" and now - last > self.grace_ms:
            out.append((key[0], "Gone", last + self.grace_ms))
            state = None
        return state

    def step(self, key, rows):
        state, last = self.recall() or (None, None)
        out = []
        ends = rows["ended"].fillna(False) if "ended" in rows else [False] * len(rows)
        for at, ended in zip(rows["at_us"] // 1000, ends):
            at = int(at)
            if state is not None:
                state = self._silent(key, state, last, at, out)
            if ended:
                if state == "Live":
                    state = "Interrupted"
                    out.append((key[0], state, at))
                continue
            if state != "Live":
                state = "Live"
                out.append((key[0], state, at))
            last = at
        self.remember(state, last)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        state, last = self.recall() or (None, None)
        if state is None:
            return
        # rows that wait may break the silence: their own timer looks again
        waiting = min(self.slots.waiting(), default=None)
        now = timerValues.getCurrentWatermarkInMs()
        if waiting is not None:
            now = min(now, waiting * self.slot // 1000)
        out: list[tuple] = []
        state = self._silent(key, state, last, now, out)
        if state is None:
            self.held.clear()
        else:
            self.remember(state, last)
            self.handle.registerTimer(max(last + (self.timeout_ms if state == "Live" else self.grace_ms), timerValues.getCurrentWatermarkInMs()) + 1)
        if out:
            yield pd.DataFrame(out, columns=self.columns)


def stream_lifecycle(packets: DataFrame, at: str = "ts", late: str = "10 seconds", timeout_ms: int = 5_000, grace_ms: int = 30_000, slot_us: int = 1_000_000) -> DataFrame:
    """State changes of every stream, as the watermark passes them. ``packets(name, ts, at_us)``, in any order within ``late``;
    rows of which a column ``ended`` is true are no packets but say that the feed has ended."""
    wanted = packets.withColumn("seq", F.lit(0)) if "seq" not in packets.columns else packets
    return in_turn(wanted.withWatermark(at, late), ["name"], LifecycleRule(timeout_ms, grace_ms, slot_us), "name string, state string, at_ms long")


class LifeRule(InTurn):
    """Lives of a stream with their interruptions. Where the next session of packets begins is known only in order of time,
    not when a session window closes: one that is still open may have begun within the grace period."""

    memory = "started_us long, last_us long, interruptions long, packets long, bytes long"
    columns = ["name", "started_us", "last_us", "interruptions", "packets", "bytes"]

    def __init__(self, timeout_us: int, grace_us: int, slot: int):
        super().__init__(slot, True)
        self.timeout_us, self.grace_us = timeout_us, grace_us

    def step(self, key, rows):
        held = self.recall()
        at, size = rows["at_us"].to_numpy("int64"), rows["bytes"].fillna(0).to_numpy("int64")
        before = np.r_[at[:1] if held is None else held[1], at[:-1]]
        gap = at - before
        first = np.flatnonzero(gap > self.grace_us)  # where a life begins
        edges = np.unique(np.r_[0, first, len(at)])
        broken = (gap > self.timeout_us) & (gap <= self.grace_us)
        out = []
        for a, b in zip(edges[:-1], edges[1:]):
            if held is not None and gap[a] > self.grace_us:
                out.append((key[0], *held))
                held = None
            told = (int(broken[a:b].sum()), int(b - a), int(size[a:b].sum()))
            held = (int(at[a]), int(at[b - 1]), *told) if held is None else (held[0], int(at[b - 1]), *(x + y for x, y in zip(held[2:], told)))
        self.remember(*held)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        held = self.recall()
        if held is None:
            return
        end = (held[1] + self.grace_us) // 1000 + 1
        waiting = min(self.slots.waiting(), default=None)
        now = timerValues.getCurrentWatermarkInMs()
        if now > end and (waiting is None or waiting * self.slot > held[1] + self.grace_us):
            self.held.clear()
            yield pd.DataFrame([(key[0], *held)], columns=self.columns)
        else:
            self.handle.registerTimer(max(end, now) + 1)


def lives(packets: DataFrame, at: str = "ts", late: str = "10 seconds", timeout_us: int = 5_000_000, grace_us: int = 30_000_000, slot_us: int = 1_000_000) -> DataFrame:
    """One row per life of a stream when it is over, with the silences above ``timeout_us`` that it outlived. ``packets(name, ts, at_us, seq, bytes)``."""
    schema = "name string, started_us long, last_us long, interruptions long, packets long, bytes long"
    return in_turn(packets.withWatermark(at, late), ["name"], LifeRule(timeout_us, grace_us, slot_us), schema)


class TrackRule(InTurn):
    """A tracker per stream that survives between micro-batches; time running backwards starts a new one.

    The tracks of a stream are entries of a map, which go when the tracker drops them; what belongs to no track is a value.
    """

    order, at = ["seq", "det"], "seq"
    memory = "epoch long, pts long, width int, height int, frame long, born long"
    columns = ["stream", "epoch", "seq", "pts", "track_id", "left", "top", "right", "bottom", "confidence", "class_name", "started_pts", "last_seen_pts", "hits"]

    def __init__(self, settings: dict, slot: int):
        super().__init__(slot)
        self.settings = settings

    def init(self, handle):
        super().init(handle)
        self.tracks = handle.getMapState("tracks", "id int", TRACK_STATE)

    def step(self, key, rows):
        tracker, epoch, last = None, 0, None
        if (held := self.recall()) is not None:
            epoch, last, width, height, frame, born = held
            tracker = Tracker.restored(width, height, frame, born, sorted((k[0], *v) for k, v in self.tracks.iterator()), **self.settings)
        known = {t["id"] for t in tracker.info} if tracker else set()
        out = []
        fields = ["seq", "pts", "width", "height", "steps_before", "left", "top", "right", "bottom", "confidence", "class_name"]
        for seq, frame in groupby(zip(*(rows[f].tolist() for f in fields)), key=itemgetter(0)):
            frame = list(frame)
            _, pts, width, height, steps = map(int, frame[0][:5])
            if tracker is None or pts < last or (width, height) != (tracker.width, tracker.height):
                tracker = Tracker(width, height, **self.settings)
                epoch += 1
            else:
                for _ in range(steps):
                    tracker.predict()
            last = pts
            seen = [row for row in frame if not pd.isna(row[5])]
            sure = [np.nan if pd.isna(row[9]) else row[9] for row in seen]
            tracker.update(pts, [row[5:9] for row in seen], sure, [row[10] for row in seen])
            out.extend((key[0], epoch, seq, pts, *track) for track in tracker.reported())
        self.remember(epoch, last, tracker.width, tracker.height, tracker.frame, tracker.born)
        left = tracker.state()
        for gone in known - {t[0] for t in left}:
            self.tracks.removeKey((gone,))
        for number, *values in left:
            self.tracks.updateValue((number,), tuple(values))
        return out

    def table(self, told):
        return pd.DataFrame({name: pd.Series(values, dtype=object if name == "confidence" else None) for name, values in zip(self.columns, zip(*told))})


def track_objects(rows: DataFrame, threshold: float = 0.6, match: float = 0.8, buffer: int = 30, slot_frames: int = 4_096) -> DataFrame:
    """``rows(stream, seq, pts, width, height, steps_before, det, left, top, right, bottom, confidence, class_name)``,
    one per box (or one without a box), to the tracks reported at each frame. A micro-batch holds whole frames, later ones than those before."""
    schema = (
        "stream string, epoch long, seq long, pts long, track_id int, left int, top int, right int, bottom int, confidence int, "
        "class_name string, started_pts long, last_seen_pts long, hits int"
    )
    settings = {"threshold": threshold, "match": match, "buffer": buffer}
    return in_turn(rows, ["stream"], TrackRule(settings, slot_frames), schema)


# --- rows that come late ------------------------------------------------------------------------


class LateRule(StatefulProcessor):
    """Tells rows behind the watermark from the others; keeps nothing."""

    by_time = True

    def init(self, handle):
        pass

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs()
        for some in rows:  # without the key
            yield some.assign(late=some["at_us"].to_numpy("int64") // 1000 < mark)

    def close(self) -> None:
        pass


LANES = 64


def with_lateness(rows: DataFrame, at: str = "ts", late: str = "10 seconds", lanes: int = LANES) -> DataFrame:
    """``rows`` (with ``at`` and its ``at_us``) and whether each came ``late``: behind the watermark that the micro-batches before left.

    Operators with a watermark drop such rows. Here the watermark is kept on a column that goes no further, so nothing is dropped, and
    rows are dealt to ``lanes`` by their own hash, as the watermark is one for all.
    """
    marked = rows.withColumn("__mark", F.col(at)).withWatermark("__mark", late).drop("__mark")
    lane = F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]), F.lit(lanes)).cast("int")
    schema = StructType([*rows.schema.fields, StructField("late", BooleanType())])
    return in_turn(marked.withColumn("__lane", lane), ["__lane"], LateRule(), schema)


def split_late(tagged: DataFrame, folder: str, checkpoint: str):
    """Timely rows to ``folder``/timely and late ones to ``folder``/late, a folder a micro-batch, written over when it runs again.

    The query's progress holds how many there were of either (``observedMetrics["arrivals"]``).
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("late").parquet(f"{folder}/batch={number}")

    counted = tagged.observe("arrivals", F.count_if(~F.col("late")).alias("timely"), F.count_if("late").alias("late"))
    return counted.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", checkpoint)
