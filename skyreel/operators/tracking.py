"""Multi-object tracking (ByteTrack) over detections of many streams.

Boxes of a stream are followed frame by frame, so the work inside a tracker is sequential.  What makes it
spread: a tracker starts anew where the frame size changes or time runs backwards, and between those it is
*empty* once no usable box has been seen for longer than lost tracks are kept.  From an empty tracker on
nothing earlier matters except how many ids are used up, which is added afterwards.

A busy stretch, in which a tracker is never empty, is split in space. Boxes without overlap cannot match, so boxes whose grid cells are
not connected over the whole stretch are followed apart; every part tells which cells its tracks were ever predicted in. A
stretch in which one entered another part's cells is followed as a whole after all, so the result is the one-pass result. Ids are dealt
anew in the order in which tracks began.
"""

from __future__ import annotations

import math
from array import array
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import TRACKER_NAME
from ..session import cut_lineage
from .ordered import Lane, around, block, following, numbered, previous, running, sessions
from .sequential import replay, width_for

FLOOR = 0.1
SECOND_MATCH = 0.5
CONFIRM_MATCH = 0.7

ACTIVE, LOST, GONE = 1, 2, 0  # the numbers ST 0903 gives active, dropped and inactive


# --- motion -------------------------------------------------------------------------------------
# The filter's eight states (centre x, centre y, aspect, height and their speeds) fall apart into four
# independent position/speed pairs: every noise and the first covariance are diagonal, and motion and
# measurement only couple a quantity with its own speed.  A 2x2 covariance per pair replaces the 8x8 one.
# A frame has a handful of tracks, for which plain numbers cost a tenth of array calls; the operations and
# their order are the same.


def _ratio(a: float, b: float) -> float:
    """Division as IEEE has it: a box without height makes infinities, not errors."""
    try:
        return a / b
    except ZeroDivisionError:
        with np.errstate(all="ignore"):
            return float(np.float64(a) / np.float64(b))


def _squared(height: float, weight: float, aspect: float) -> tuple[float, float]:
    """The variances of a position or height, and of the aspect."""
    scale = height * weight
    return scale * scale, aspect * aspect


class Motion:
    """Positions, speeds and their (co)variances, one row per track."""

    def __init__(self):
        self.at: list[array] = []
        self.speed: list[array] = []
        self.var_at: list[array] = []
        self.cov: list[array] = []
        self.var_speed: list[array] = []

    def add(self, boxes) -> None:
        for box in boxes:
            own, aspect = _squared(box[3], 2 / 20, 1e-2)
            fast, turning = _squared(box[3], 10 / 160, 1e-5)
            self.at.append(array("d", box))
            self.speed.append(array("d", (0, 0, 0, 0)))
            self.var_at.append(array("d", (own, own, aspect, own)))
            self.cov.append(array("d", (0, 0, 0, 0)))
            self.var_speed.append(array("d", (fast, fast, turning, fast)))

    def keep(self, mask) -> None:
        for name in ("at", "speed", "var_at", "cov", "var_speed"):
            setattr(self, name, list(compress(getattr(self, name), mask)))

    def advance(self, unseen) -> None:
        for gone, at, speed, var_at, cov, var_speed in zip(unseen, self.at, self.speed, self.var_at, self.cov, self.var_speed):
            if gone:
                speed[3] = 0
            own, aspect = _squared(at[3], 1 / 20, 1e-2)
            fast, turning = _squared(at[3], 1 / 160, 1e-5)
            for k in range(4):
                c, v = cov[k], var_speed[k]
                at[k] += speed[k]
                var_at[k] += 2 * c + v + (aspect if k == 2 else own)
                cov[k] = c + v
                var_speed[k] = v + (turning if k == 2 else fast)

    def correct(self, rows, seen) -> None:
        for row, box in zip(rows, seen):
            at, speed, var_at, cov, var_speed = self.at[row], self.speed[row], self.var_at[row], self.cov[row], self.var_speed[row]
            own, aspect = _squared(at[3], 1 / 20, 1e-1)
            for k in range(4):
                c, v = cov[k], var_at[k]
                total = v + (aspect if k == 2 else own)
                gain, gain_speed = _ratio(v, total), _ratio(c, total)
                miss = box[k] - at[k]
                at[k] += gain * miss
                speed[k] += gain_speed * miss
                var_speed[k] -= gain_speed * c
                cov[k] = c - gain * c
                var_at[k] = v - gain * v

    def edges_of(self, row: int) -> tuple[float, float, float, float]:
        """Left, top, right, bottom."""
        x, y, aspect, height = self.at[row]
        height = 1 if height < 1 else height
        width = aspect * height
        width = 1 if width < 1 else width
        return x - width / 2, y - height / 2, x + width / 2, y + height / 2

    def edges(self) -> np.ndarray:
        return np.array([self.edges_of(row) for row in range(len(self.at))]).reshape(-1, 4)


def centred(edges) -> tuple[float, float, float, float]:
    """Continuous edges as centre, aspect and height."""
    left, top, right, bottom = edges
    return (left + right) / 2, (top + bottom) / 2, _ratio(right - left, bottom - top), bottom - top


def likeness(a, b) -> float:
    """IoU of two boxes."""
    wide, high = (a[2] if a[2] < b[2] else b[2]) - (a[0] if a[0] > b[0] else b[0]), (a[3] if a[3] < b[3] else b[3]) - (a[1] if a[1] > b[1] else b[1])
    shared = wide * high if wide > 0 and high > 0 else 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return shared / union if union > 0 else 0.0


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box of ``a`` with every box of ``b``."""
    low = np.maximum(a[:, None, :2], b[None, :, :2])
    high = np.minimum(a[:, None, 2:], b[None, :, 2:])
    shared = np.prod(np.maximum(high - low, 0), axis=2)
    area = lambda e: (e[:, 2] - e[:, 0]) * (e[:, 3] - e[:, 1])
    union = area(a)[:, None] + area(b)[None, :] - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)


# --- assignment ---------------------------------------------------------------------------------


def assign(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """The cheapest set of (row, column) pairs where leaving a row out costs ``limit``.

    Each row gets a private column of that price; rows are then placed one by one along the cheapest chain
    of swaps.  Pairs at or above the limit can never help, and rows that have none are skipped.
    """
    rows, columns = cost.shape
    if not rows or not columns:
        return []
    usable = cost < limit
    busy = np.flatnonzero(usable.any(axis=1))
    # The common case: every row and column has at most one partner, nothing to decide.
    if (usable.sum(axis=0) <= 1).all() and (usable[busy].sum(axis=1) == 1).all():
        return [(int(r), int(usable[r].argmax())) for r in busy]
    wide = np.full((len(busy), columns + len(busy)), np.inf)
    wide[:, :columns] = np.where(usable[busy], cost[busy], np.inf)
    wide[np.arange(len(busy)), columns + np.arange(len(busy))] = limit
    row_of = np.full(wide.shape[1], -1)
    row_price, column_price = np.zeros(len(busy)), np.zeros(wide.shape[1])
    for new in range(len(busy)):
        best = np.full(wide.shape[1], np.inf)
        came_from = np.full(wide.shape[1], -1)
        done = np.zeros(wide.shape[1], dtype=bool)
        row, reached, last = new, 0.0, -1
        while True:
            through = reached + wide[row] - row_price[row] - column_price
            better = ~done & (through < best)
            best[better], came_from[better] = through[better], last
            last = int(np.where(done, np.inf, best).argmin())
            reached = best[last]
            done[last] = True
            if row_of[last] < 0:
                break
            row = row_of[last]
        settled = np.flatnonzero(done)
        owners = row_of[settled]
        row_price[new] += reached
        placed = owners >= 0
        row_price[owners[placed]] += reached - best[settled[placed]]
        column_price[settled] -= reached - best[settled]
        while last >= 0:
            before = came_from[last]
            row_of[last] = row_of[before] if before >= 0 else new
            last = before
    return sorted((int(busy[r]), c) for c, r in enumerate(row_of[:columns]) if r >= 0)


FEW = 64
"""Pairs of tracks and boxes up to which they are compared one by one. The result does not depend on it."""


def paired(tracks: list, boxes: list, scores: list[float] | None, limit: float) -> list[tuple[int, int]]:
    """:func:`assign` of tracks to boxes by overlap, ``scores`` weighing the boxes."""
    if len(tracks) * len(boxes) > FEW:
        like = overlap(np.array(tracks), np.array(boxes))
        return assign(1 - like if scores is None else 1 - like * np.array(scores)[None, :], limit)
    cost = [[1 - likeness(t, b) * s for b, s in zip(boxes, scores)] for t in tracks] if scores is not None else [[1 - likeness(t, b) for b in boxes] for t in tracks]
    usable = [(r, c) for r, row in enumerate(cost) for c, price in enumerate(row) if price < limit]
    if len({r for r, _ in usable}) == len({c for _, c in usable}) == len(usable):
        return usable
    return assign(np.array(cost), limit)


# --- the tracker --------------------------------------------------------------------------------


def _whole(value: float) -> float:
    """The nearest whole number, the even one of two."""
    return float(round(value)) if -1e15 < value < 1e15 else value


class Tracker:
    """ByteTrack: strong boxes claim tracks first, weak ones keep unclaimed tracks alive, and only strong ones start any."""

    def __init__(self, width: int, height: int, threshold: float = 0.6, match: float = 0.8, buffer: int = 30, frame: int = 0):
        self.width, self.height = width, height
        self.threshold, self.match, self.buffer, self.frame = threshold, match, buffer, frame
        self.born = 0
        self.births: list[tuple[int, int]] = []  # ids and boxes of tracks that the last frame began
        self.motion = Motion()
        self.info: list[dict] = []

    def _unseen(self) -> list[bool]:
        return [t["status"] != ACTIVE for t in self.info]

    def predicted(self) -> None:
        """Called whenever tracks have moved on and nothing has been matched yet."""

    def predict(self) -> None:
        self.frame += 1
        self.motion.advance(self._unseen())
        self.predicted()
        self._expire()

    def update(self, at: int, boxes, confidence, classes: list) -> None:
        """``boxes`` are one-based inclusive pixels, ``confidence`` percent with NaN for a certain box; arrays or lists."""
        self.frame += 1
        self.births = []
        self.motion.advance(self._unseen())
        self.predicted()
        boxes, confidence = (v.tolist() if isinstance(v, np.ndarray) else v for v in (boxes, confidence))
        seen = [(float(left), float(top), right + 1.0, bottom + 1.0) for left, top, right, bottom in boxes]
        score = [(100 if sure != sure else sure) / 100.0 for sure in confidence]
        high = [d for d, s in enumerate(score) if s > self.threshold]
        low = [d for d, s in enumerate(score) if FLOOR < s <= self.threshold]
        confirmed = [k for k, t in enumerate(self.info) if t["confirmed"]]
        unconfirmed = [k for k, t in enumerate(self.info) if not t["confirmed"]]
        active = {k for k, t in enumerate(self.info) if t["status"] == ACTIVE}

        def settle(tracks: list[int], found: list[int], limit: float, fused: bool):
            if not tracks or not found:
                return tracks, found
            pairs = paired([self.motion.edges_of(t) for t in tracks], [seen[d] for d in found], [score[d] for d in found] if fused else None, limit)
            for t, d in pairs:
                self._observe(tracks[t], found[d], at, seen, confidence, classes)
            rows, columns = {t for t, _ in pairs}, {d for _, d in pairs}
            return [t for k, t in enumerate(tracks) if k not in rows], [d for k, d in enumerate(found) if k not in columns]

        missed, rest = settle(confirmed, high, self.match, True)
        missed, _ = settle([t for t in missed if t in active], low, SECOND_MATCH, False)
        for t in missed:
            self.info[t]["status"] = LOST
        unproven, rest = settle(unconfirmed, rest, CONFIRM_MATCH, True)
        for t in unproven:
            self.info[t]["status"] = GONE
        for d in rest:
            if score[d] >= self.threshold + 0.1:
                self._start(d, at, seen, confidence, classes)
        self._expire()

    def _start(self, d, at, seen, confidence, classes) -> None:
        self.born += 1
        self.births.append((self.born, d))
        self.motion.add([centred(seen[d])])
        self.info.append({"id": self.born, "status": ACTIVE, "started": at, "hits": 0})
        self._observe(len(self.info) - 1, d, at, seen, confidence, classes)
        self.info[-1]["confirmed"] = self.frame == 1

    def _observe(self, t, d, at, seen, confidence, classes) -> None:
        self.motion.correct([t], [centred(seen[d])])
        track = self.info[t]
        track.update(status=ACTIVE, confirmed=True, last_seen=at, last_frame=self.frame, confidence=confidence[d], name=classes[d])
        track["hits"] += 1

    def _expire(self) -> None:
        for track in self.info:
            if track["status"] == LOST and self.frame - track["last_frame"] > self.buffer:
                track["status"] = GONE
        keep = [t["status"] != GONE for t in self.info]
        if not all(keep):
            self.info = list(compress(self.info, keep))
            self.motion.keep(keep)

    def reported(self) -> list[tuple]:
        """Active confirmed tracks: id, box, confidence, class, started, last seen, hits."""
        out = []
        for row, track in enumerate(self.info):
            if track["status"] != ACTIVE or not track["confirmed"]:
                continue
            left, top, right, bottom = map(_whole, self.motion.edges_of(row))
            left = int(min(max(left, 1), self.width))
            top = int(min(max(top, 1), self.height))
            right = int(min(max(right - 1, left), self.width))
            bottom = int(min(max(bottom - 1, top), self.height))
            sure = track["confidence"]
            out.append((track["id"], left, top, right, bottom, None if sure != sure else int(sure), track["name"], track["started"], track["last_seen"], track["hits"]))
        return out


    def state(self) -> list[tuple]:
        """A row of TRACK_STATE a track, its id first."""
        m = self.motion
        fields = ("status", "confirmed", "started", "last_seen", "last_frame", "hits", "name", "confidence")
        plain = lambda v: v.item() if isinstance(v, np.generic) else v
        return [
            (t["id"], *(plain(t[f]) for f in fields), [*at, *speed, *var_at, *cov, *var_speed])
            for t, at, speed, var_at, cov, var_speed in zip(self.info, m.at, m.speed, m.var_at, m.cov, m.var_speed)
        ]

    @classmethod
    def restored(cls, width: int, height: int, frame: int, born: int, tracks: list[tuple], **settings) -> "Tracker":
        """The tracker that had this state."""
        tracker = cls(width, height, frame=frame, **settings)
        tracker.born = born
        for number, status, confirmed, started, last_seen, last_frame, hits, name, confidence, _ in tracks:
            tracker.info.append({"id": number, "status": status, "confirmed": confirmed, "started": started, "last_seen": last_seen, "last_frame": last_frame, "hits": hits, "name": name, "confidence": confidence})
        m = tracker.motion
        m.at, m.speed, m.var_at, m.cov, m.var_speed = ([array("d", t[-1][k : k + 4]) for t in tracks] for k in range(0, 20, 4))
        return tracker


TRACK_STATE = "status int, confirmed boolean, started long, last_seen long, last_frame long, hits int, name string, confidence double, motion array<double>"

OUT_FIELDS = (
    "seq long, pts long, local_id int, left int, top int, right int, bottom int, confidence int, class_name string, "
    "started_pts long, last_seen_pts long, hits int, born int"
)


class _Run:
    """One stretch of one stream: gathers the boxes of a frame, steps the tracker, reports its tracks."""

    def __init__(self, settings: dict):
        self.settings = settings
        self.tracker: Tracker | None = None
        self.frame: list[tuple] = []

    def feed(self, rows: list[tuple]) -> list[tuple]:
        self.who, out = rows[0][:3], []
        for row in rows:
            if self.frame and row[3] != self.frame[0][3]:
                out.extend(self._frame_done())
            self.frame.append(row)
        return out

    def finish(self) -> list[tuple]:
        out = self._frame_done()
        out.append((*self.who, *self.last, *[None] * 10, self.tracker.born))
        return out

    def _frame_done(self) -> list[tuple]:
        seq, pts, width, height, step, before = self.frame[0][3:9]
        self.last = (seq, pts)
        if self.tracker is None:
            self.tracker = Tracker(width, height, frame=step - 1, **self.settings)
        else:
            for _ in range(before):
                self.tracker.predict()
        boxes = [row[9:] for row in self.frame if row[10] is not None]
        sure = [math.nan if b[5] is None else b[5] for b in boxes]
        self.tracker.update(pts, [b[1:5] for b in boxes], sure, [b[6] for b in boxes])
        self.frame = []
        return [(*self.who, seq, pts, *track, None) for track in self.tracker.reported()]


CELL = 64
"""Pixels of a grid cell's side. The result does not depend on it."""
BUSY = 20_000
"""Boxes from which on a stretch is looked at for parts. The result does not depend on it."""


def cells_of(edges: np.ndarray, width: int, height: int, cell: int) -> set[int]:
    """The grid cells that boxes touch inside the frame."""
    out: set[int] = set()
    across = -(-width // cell) + 1
    low = np.floor(edges[:, :2] / cell).astype(np.int64)
    high = np.floor(edges[:, 2:] / cell).astype(np.int64)
    limit = np.array([width // cell, height // cell])
    low, high = np.maximum(low, 0), np.minimum(high, limit)
    for (left, top), (right, bottom) in zip(low.tolist(), high.tolist()):
        for y in range(top, bottom + 1):
            out.update(range(y * across + left, y * across + right + 1))
    return out


class _Watched(Tracker):
    """A tracker that notes the cells its tracks are predicted in."""

    def __init__(self, *args, cell: int = CELL, **settings):
        super().__init__(*args, **settings)
        self.cell, self.entered = cell, set()

    def predicted(self) -> None:
        if self.info:
            self.entered |= cells_of(self.motion.edges(), self.width, self.height, self.cell)


class _Part:
    """One part of one stretch. Frames in which it has no box are not among its rows: the first of them ends all matches, the
    others only move tracks on."""

    def __init__(self, settings: dict, cell: int):
        self.settings, self.cell = settings, cell
        self.tracker: _Watched | None = None
        self.frame: list[tuple] = []

    def feed(self, rows: list[tuple]) -> list[tuple]:
        self.who, out = rows[0][:4], []
        for row in rows:
            if self.frame and row[4] != self.frame[0][4]:
                out.extend(self._frame_done())
            self.frame.append(row)
        return out

    def finish(self) -> list[tuple]:
        out = self._frame_done()
        return out + [(*self.who, *[None] * 14, entered) for entered in sorted(self.tracker.entered)]

    def _frame_done(self) -> list[tuple]:
        seq, pts, width, height, step, before, number, following = self.frame[0][4:12]
        if self.tracker is None:
            self.tracker = _Watched(width, height, frame=step - 1, cell=self.cell, **self.settings)
        else:
            tracker = self.tracker
            if number > self.last[1] + 1:
                for _ in range(self.last[2]):
                    tracker.predict()
                tracker.update(pts, [], [], [])
            while tracker.frame < step - 1:
                if not tracker.info:
                    tracker.frame = step - 1
                    break
                tracker.predict()
        self.last = (seq, number, following)
        sure = [math.nan if row[17] is None else row[17] for row in self.frame]
        self.tracker.update(pts, [row[13:17] for row in self.frame], sure, [row[18] for row in self.frame])
        out = [(*self.who, seq, pts, *track, None, None, None) for track in self.tracker.reported()]
        out += [(*self.who, seq, pts, local, *[None] * 9, self.frame[d][12], local, None) for local, d in self.tracker.births]
        self.frame = []
        return out


PART_FIELDS = (
    "seq long, pts long, local_id int, left int, top int, right int, bottom int, confidence int, class_name string, "
    "started_pts long, last_seen_pts long, hits int, birth_det long, birth_id int, entered int"
)


def _labelled(cells: pd.DataFrame) -> pd.DataFrame:
    """Connected cells of one stretch, corners included, as parts from 0. A frame has a bounded number of cells."""
    part: dict[int, int] = {}
    across = int(cells["across"].iloc[0])
    wanted = set(cells["cell"].tolist())
    count = 0
    for cell in sorted(wanted):
        if cell in part:
            continue
        open_ = [cell]
        part[cell] = count
        while open_:
            at = open_.pop()
            for dy in (-across, 0, across):
                for dx in (-1, 0, 1):
                    near = at + dy + dx
                    if near in wanted and near not in part:
                        part[near] = count
                        open_.append(near)
        count += 1
    first = cells.iloc[0]
    return pd.DataFrame({"stream": first["stream"], "epoch": first["epoch"], "run": first["run"], "cell": list(part), "part": list(part.values())})


def _in_parts(rows: DataFrame, runs: DataFrame, settings: dict, cell: int, busy: int, block_rows: int) -> tuple[DataFrame, DataFrame] | None:
    """What the parts of busy stretches report, shaped like the one-pass rows, and the stretches (keys) it covers; None if nothing can be split."""
    keys = ["stream", "epoch", "run"]
    crowded = rows.where("det is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= busy).select(*keys)
    crowded = cut_lineage(crowded)
    if crowded.isEmpty():
        return None
    boxes = rows.where("det is not null").join(crowded, keys, "left_semi")
    across = F.ceil(F.col("width") / cell).cast("int") + 1
    spot = lambda x, y: (F.floor(F.col(y) / cell) * across + F.floor(F.col(x) / cell)).cast("int")
    # boxes as the tracker sees them, inside the frame
    span = lambda low, high, most: F.sequence(F.floor(F.greatest(F.col(low), F.lit(0)) / cell), F.floor(F.least(F.col(high) + 1, F.col(most)) / cell))
    fits = F.coalesce(F.expr("left <= width and top <= height and left >= 0 and top >= 0 and left <= right and top <= bottom"), F.lit(False))
    inside = boxes.where(fits)
    wide = inside.select(*keys, across.alias("across"), F.explode(span("top", "bottom", "height")).alias("y"), span("left", "right", "width").alias("xs"))
    cells = wide.select(*keys, "across", F.explode(F.transform("xs", lambda x: (F.col("y") * F.col("across") + x).cast("int"))).alias("cell")).distinct()
    labels = cut_lineage(cells.groupBy(*keys).applyInPandas(_labelled, "stream string, epoch long, run long, cell int, part int"))
    # a box that lies outside the frame has no cell: its stretch stays whole
    odd = boxes.where(~fits).select(*keys).distinct()
    several = cut_lineage(labels.groupBy(*keys).agg(F.max("part").alias("parts")).where("parts > 0").select(*keys).join(odd, keys, "left_anti"))
    if several.isEmpty():
        return None
    frames = runs.join(several, keys, "left_semi").select(*keys, "seq", "steps_before")
    along = Lane(tuple(keys), ("seq",), block("seq", block_rows))
    placed = following(numbered(frames, along, "number"), along, __next=F.col("steps_before")).drop("steps_before")
    corner = boxes.join(several, keys, "left_semi").withColumn("cell", spot("left", "top"))
    dealt = corner.join(labels, [*keys, "cell"]).join(placed, [*keys, "seq"]).select(
        *keys, "part", "seq", "pts", "width", "height", "step", "steps_before", "number", F.coalesce("__next", F.lit(0)).alias("following"),
        "det", "left", "top", "right", "bottom", "confidence", "class_name",
    )
    told = cut_lineage(replay(dealt, [*keys, "part"], ["seq", "det"], lambda: _Part(settings, cell), f"stream string, epoch long, run long, part int, {PART_FIELDS}", width_for(rows)))
    entered = told.where("entered is not null").select(*keys, F.col("part").alias("mine"), F.col("entered").alias("cell"))
    strayed = entered.join(labels, [*keys, "cell"]).where("part <> mine").select(*keys).distinct()
    sound = cut_lineage(several.join(strayed, keys, "left_anti"))
    good = told.join(sound, keys, "left_semi")
    births = numbered(good.where("birth_id is not null").select(*keys, "part", "seq", F.col("birth_det").alias("det"), F.col("birth_id").alias("local_id")), Lane(tuple(keys), ("seq", "det"), block("seq", block_rows)), "dealt_id")
    tracks = good.where("entered is null and birth_id is null").join(births.select(*keys, "part", "local_id", "dealt_id"), [*keys, "part", "local_id"])
    names = [f.split()[0] for f in OUT_FIELDS.split(", ")]
    reported = tracks.select(*keys, *[F.col("dealt_id").cast("int").alias(n) if n == "local_id" else F.lit(None).cast("int").alias(n) if n == "born" else F.col(n) for n in names])
    types = dict(reported.dtypes)
    totals = births.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("born"))
    ends = totals.select(*keys, *[F.col("born") if n == "born" else F.lit(None).cast(types[n]).alias(n) for n in names])
    return reported.unionByName(ends), sound


# --- the job ------------------------------------------------------------------------------------


def pending_steps(frames: DataFrame, packets: DataFrame, block_rows: int = 65_536, block_ticks: int = 1 << 20) -> DataFrame:
    """``frames(stream, seq, pts, ...)`` with the steps the motion model takes before each: the packets of
    ``packets(stream, seq, pts)`` that have arrived by then and lie between it and the frame before in time, whenever
    they arrived since the clock last stepped back.  ``seq`` is the shared arrival order."""
    rows = frames.select("stream", "seq", "pts", F.lit(1).alias("__frame")).unionByName(
        packets.where("pts is not null").select("stream", "seq", "pts", F.lit(0).alias("__frame"))
    )
    arrival = Lane(("stream",), ("seq", "__frame"), block("seq", block_rows))
    is_frame = F.col("__frame") == 1
    earlier = previous(rows, arrival, where=is_frame, __last=F.col("pts"))
    back = is_frame & (F.col("__last").isNull() | (F.col("pts") < F.col("__last")))
    # Narrow rows, read by the passes along the clock.
    clocked = cut_lineage(sessions(earlier, arrival, back, "__clock").select("stream", "__clock", "seq", "pts", "__frame"))
    along = Lane(("stream", "__clock"), ("pts", "__frame", "seq"), block("pts", block_ticks))
    placed = around(clocked, along, is_frame, pts=F.col("pts"), seq=F.col("seq"))
    between = ~is_frame & F.col("before_pts").isNotNull() & (F.col("after_pts") > F.col("pts")) & (F.col("seq") < F.col("after_seq"))
    counted = placed.where(between).groupBy("stream", F.col("after_seq").alias("seq")).agg(F.count(F.lit(1)).alias("__steps"))
    return frames.join(counted, ["stream", "seq"], "left").select(*frames.columns, F.coalesce("__steps", F.lit(0)).cast("long").alias("steps_before"))


def track_objects(
    frames: DataFrame,
    boxes: DataFrame,
    threshold: float = 0.6,
    match: float = 0.8,
    buffer: int = 30,
    block_rows: int = 65_536,
    cell: int = CELL,
    busy: int = BUSY,
) -> DataFrame:
    """Tracks reported at every frame.

    ``frames(stream, seq, pts, width, height, steps_before)`` are the pictures a detector ran on, in arrival
    order; ``boxes(stream, seq, det, left, top, right, bottom, confidence, class_name)`` what it found.
    Ids count up from 1 per tracker (``epoch``) and are never reused.
    """
    on = Lane(("stream",), ("seq",), block("seq", block_rows))
    usable = boxes.groupBy("stream", "seq").agg(
        F.max(F.coalesce("confidence", F.lit(100)) / 100.0 > FLOOR).alias("usable")
    )
    # One narrow row per frame; each cut is written once and read by the passes after it.
    seen = cut_lineage(frames.join(usable, ["stream", "seq"], "left").fillna(False, ["usable"]))

    before = previous(seen, on, __p=F.col("pts"), __w=F.col("width"), __h=F.col("height"))
    anew = F.col("__p").isNull() | (F.col("pts") < F.col("__p")) | (F.col("width") != F.col("__w")) | (F.col("height") != F.col("__h"))
    started = before.withColumn("steps_before", F.when(anew, 0).otherwise(F.col("steps_before")))
    epochs = cut_lineage(sessions(started, on, anew, "epoch").drop("__p", "__w", "__h"))

    in_epoch = on.by("stream", "epoch")
    stepped = running(epochs, in_epoch, step=("sum", F.col("steps_before") + 1))
    latest = running(cut_lineage(stepped), in_epoch, inclusive=False, __used=("max", F.when(F.col("usable"), F.col("step"))))
    # Empty for certain: the frame before came later after the last usable one than lost tracks are kept.
    frame_before = F.col("step") - F.col("steps_before") - 1
    empty = (frame_before > 0) & (F.col("__used").isNull() | (frame_before - F.col("__used") > buffer))
    runs = sessions(latest, in_epoch, F.col("usable") & empty, "run").drop("__used", "usable")

    rows = runs.join(boxes, ["stream", "seq"], "left").select(
        "stream", "epoch", "run", "seq", "pts", "width", "height", "step", "steps_before",
        "det", "left", "top", "right", "bottom", "confidence", "class_name",
    )
    settings = {"threshold": threshold, "match": match, "buffer": buffer}
    keys = ["stream", "epoch", "run"]
    rows = cut_lineage(rows)
    apart = _in_parts(rows, runs, settings, cell, busy, block_rows)
    whole = rows if apart is None else rows.join(apart[1], keys, "left_anti")
    tracked = replay(whole, keys, ["seq", "det"], lambda: _Run(settings), f"stream string, epoch long, run long, {OUT_FIELDS}", width_for(rows))
    tracked = cut_lineage(tracked if apart is None else tracked.unionByName(apart[0]))
    births = tracked.where("born is not null").select("stream", "epoch", "run", "born")
    used = running(births, Lane(("stream", "epoch"), ("run",), block("run", 4_096)), inclusive=False, __used=("sum", F.col("born")))
    out = tracked.where("born is null").drop("born").join(used.drop("born"), keys)
    track_id = F.col("local_id") + F.col("__used")
    digest = F.md5(F.concat_ws("|", "stream", F.col("epoch").cast("string"), track_id.cast("string")))
    dashed = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]])
    return out.select(
        "stream", "epoch", "seq", "pts", track_id.alias("track_id"), dashed.alias("track_uuid"), "left", "top", "right", "bottom",
        "confidence", "class_name", F.lit(ACTIVE).alias("status"), "started_pts", "last_seen_pts", "hits", F.lit(TRACKER_NAME).alias("algorithm"),
    )


def track_summary(tracks: DataFrame) -> DataFrame:
    """One row per track: when it began, was last seen, how often, and what it was last taken for."""
    last = lambda c: F.max_by(c, "seq").alias(c)
    return tracks.groupBy("stream", "epoch", "track_id").agg(
        F.min("started_pts").alias("started_pts"), F.max("last_seen_pts").alias("last_seen_pts"), F.max("hits").alias("hits"),
        last("confidence"), last("class_name"),
    )
