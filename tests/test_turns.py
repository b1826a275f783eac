"""Rows in turn: how much is held at once, and what restarts, late files and registries change."""

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import difference, duck
from pyspark.sql import functions as F
from test_streaming import drain, in_files

from skyreel.operators import lifecycle
from skyreel.operators.ordered import block, lane
from skyreel.streaming import queries as live
from skyreel.streaming.turns import InTurn, Slots

EVENTS = "/root/testdata/sf0.001/events.parquet"


class Held(dict):
    """A state store's map."""

    def getValue(self, key):
        return self.get(key)

    def containsKey(self, key):
        return key in self

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Handle:
    def __init__(self):
        self.maps = {}

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, Held())


def test_slots_hand_out_a_slot_at_a_time_and_keep_nothing():
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"at_us": rng.integers(0, 1_000, 5_000), "seq": range(5_000), "text": "x"})
    handle = Handle()
    slots = Slots(handle, 50)
    for piece in np.array_split(np.arange(5_000), 23):
        slots.put(rows.iloc[piece], "at_us")
    assert slots.waiting() == list(range(20))
    taken = [slots.take(s) for s in slots.waiting()]
    assert max(map(len, taken)) < 400  # of 5 000
    assert all((t["at_us"] // 50 == k).all() for k, t in enumerate(taken))
    assert sorted(pd.concat(taken)["seq"]) == list(range(5_000))
    assert not any(handle.maps.values())


def most(*args):
    class Most(InTurn):  # in a function, so that workers get it by value
        """Tells how many rows it is handed at once."""

        memory, columns = "rows long", ["seq", "most"]

        def step(self, key, rows):
            self.remember(max(len(rows), (self.recall() or (0,))[0]))
            assert rows["at_us"].is_monotonic_increasing
            return [(int(s), len(rows)) for s in rows["seq"]]

    return Most(*args)


@pytest.mark.parametrize("by_time", [False, True])
def test_one_key_with_nearly_all_rows_is_never_held_whole(spark, tmp_path, by_time):
    from skyreel.streaming.turns import in_turn

    spark.conf.set("spark.sql.execution.arrow.transformWithStateInPandas.maxRecordsPerBatch", 500)
    rows = spark.range(20_000).select(F.lit("hot").alias("name"), F.col("id").alias("seq"), (F.pmod(F.xxhash64("id"), F.lit(1_000)) * 1_000_000 + 1_700_000_000_000_000).alias("at_us"))
    rows = rows.unionByName(spark.sql("select 'clock' as name, -1L as seq, 1800000000000000 as at_us"))
    rows = rows.withColumn("ts", F.timestamp_micros("at_us"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    got = drain(in_turn(feed.withWatermark("ts", "1 hour") if by_time else feed, ["name"], most(10_000_000, by_time), "seq long, most long"), tmp_path)
    told = got.where("seq >= 0").agg(F.count_distinct("seq").alias("n"), F.max("most").alias("most")).first()
    spark.conf.unset("spark.sql.execution.arrow.transformWithStateInPandas.maxRecordsPerBatch")
    assert told.n == 20_000 and told.most < 400


def feed_of(spark, tmp_path, rows, files=6):
    return in_files(spark, rows, f"{tmp_path}/in", "name string, at_us long, seq long, ended boolean, bytes long", "seq", files).withColumn("ts", F.timestamp_micros("at_us"))


def lives_and_ends(rng, count=400):
    base = 1_700_000_000_000_000
    steps = rng.choice([1, 2, 4, 6, 20, 29, 31, 70], count, p=[0.3, 0.2, 0.2, 0.1, 0.05, 0.05, 0.05, 0.05])
    at = base + np.cumsum(steps) * 1_000_000
    # files by arrival: rows up to four seconds behind those before them
    frame = pd.DataFrame({"name": rng.choice(["a", "b"], count), "at_us": at, "ended": rng.random(count) < 0.1, "bytes": rng.integers(1, 9, count)})
    frame = frame.iloc[np.argsort(np.arange(count) + rng.integers(0, 3, count), kind="stable")].reset_index(drop=True)
    late = pd.DataFrame({"name": "clock", "at_us": [at[-1] + 10**9, at[-1] + 2 * 10**9], "ended": False, "bytes": 1})
    return pd.concat([frame, late], ignore_index=True).assign(seq=range(count + 2))


@pytest.mark.parametrize("seed, slot", [(1, 1_000_000), (2, 7_000_000), (3, 100_000_000)])
def test_feed_ends_over_files_out_of_order(spark, tmp_path, seed, slot):
    rows = lives_and_ends(np.random.default_rng(seed))
    got = drain(live.stream_lifecycle(feed_of(spark, tmp_path, rows), late="5 minutes", slot_us=slot), tmp_path).where("name <> 'clock'")
    table = spark.createDataFrame(rows[["name", "at_us", "seq", "ended"]]).where("name <> 'clock'")
    want = lifecycle.lifecycle_events(table, lane("name", ("at_us", "seq"), block("at_us", 60_000_000)), int(rows["at_us"].max()), ended=F.col("ended"))
    key = lambda df, at: sorted((r.name, r[at], r.state) for r in df.collect())
    assert key(got, "at_ms") == [(n, at // 1000, s) for n, at, s in key(want, "at_us")]
    assert {"Live", "Interrupted", "Gone"} == {s for *_, s in key(got, "at_ms")}


@pytest.mark.parametrize("seed, slot", [(4, 1_000_000), (5, 50_000_000)])
def test_lives_count_interruptions(spark, tmp_path, seed, slot):
    rows = lives_and_ends(np.random.default_rng(seed))
    got = drain(live.lives(feed_of(spark, tmp_path, rows), late="5 minutes", slot_us=slot), tmp_path).where("name <> 'clock'")
    table = spark.createDataFrame(rows[["name", "at_us", "seq", "bytes"]]).where("name <> 'clock'")
    want = lifecycle.live_sessions(table, lane("name", ("at_us", "seq"), block("at_us", 60_000_000)))
    columns = ["name", "started_us", "last_us", "interruptions", "packets", "bytes"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_a_life_waits_for_a_session_that_is_still_open(spark, tmp_path):
    """A second session that begins within the grace period and goes on: one life, however late its end."""
    base = 1_700_000_000
    at = [base, base + 20, *range(base + 21, base + 200), base + 5_000, base + 6_000]
    rows = pd.DataFrame({"name": "a", "at_us": [s * 1_000_000 for s in at], "ended": False, "bytes": 1, "seq": range(len(at))})
    got = drain(live.lives(feed_of(spark, tmp_path, rows, files=len(at) // 10), late="1 second"), tmp_path).collect()
    assert [(r.started_us // 1_000_000 - base, r.last_us // 1_000_000 - base, r.interruptions) for r in sorted(got)][:1] == [(0, 199, 1)]


def test_names_of_interrupted_holders_are_free(spark, tmp_path):
    base = 1_700_000_000_000_000
    held = spark.createDataFrame(
        [("live", "other", "Live", base, base - 9), ("waiting", "other", "Interrupted", base, base - 9), ("gone", "other", "Live", base - 60_000_000, 1), ("mine", "me", "Live", base, base - 9)],
        "name string, owner string, state string, heartbeat_us long, started_us long",
    )
    data = pd.DataFrame({"name": ["live", "waiting", "gone", "mine", "new", "live", "waiting"], "seq": range(7), "at_us": [base + 1] * 5 + [base + 7_000_000] * 2, "owner": ["me"] * 6 + ["third"]})
    source = in_files(spark, data, f"{tmp_path}/in", "name string, seq long, at_us long, owner string", "seq", files=2)
    got = drain(live.name_claims(source, held=held), tmp_path).collect()
    assert {r.seq: (r.outcome, r.started_us) for r in got} == {
        0: ("refused", base - 9), 1: ("resumed", base - 9), 2: ("taken", base + 1), 3: ("resumed", base - 9), 4: ("taken", base + 1),
        5: ("resumed", base - 9), 6: ("resumed", base - 9),
    }


def test_late_rows_leave_as_late_and_are_counted(spark, tmp_path):
    base = 1_700_000_000
    data = pd.DataFrame({"name": "abcdefgh", "seq": range(8), "at": [0, 10, 5, 100, 20, 95, 80, 300]}).assign(name=list("abcdefgh"))
    data["at_us"] = (data.pop("at") + base) * 1_000_000
    source = in_files(spark, data, f"{tmp_path}/in", "name string, seq long, at_us long", "seq", files=4).withColumn("ts", F.timestamp_micros("at_us"))
    run = live.split_late(live.with_lateness(source, late="10 seconds"), f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    told = {r.seq: r.late == "true" for r in spark.read.parquet(f"{tmp_path}/out").collect()}  # a folder each
    assert told == {0: False, 1: False, 2: False, 3: False, 4: True, 5: False, 6: True, 7: False}
    metrics = [p.observedMetrics["arrivals"] for p in run.recentProgress if "arrivals" in p.observedMetrics]
    assert (sum(m.timely for m in metrics), sum(m.late for m in metrics)) == (6, 2)


def test_tracks_survive_restarts(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    columns = ["stream", "epoch", "seq", "pts", "track_id", "left", "top", "right", "bottom", "confidence", "class_name", "started_pts", "last_seen_pts", "hits"]
    got, want = (sorted(map(str, entry.queries()[q](spark, folder).select(columns).collect())) for q in ("x11_track_objects_stream", "k08_track_objects"))
    assert got == want and len(got) > 1_000


@pytest.mark.parametrize("name", ["x02_live_sessions_stream", "x08_beat_metrics_stream", "x10_debounce_stream", "x02_lives_stream", "x05_claims_over_registry_stream", "x01_feed_ended_stream"])
def test_the_later_year_first(spark, tmp_path, monkeypatch, name):
    """A table of two years whose later file is read first loses nothing."""
    import __spark_entry__ as entry
    from skyreel.plans import streaming_queries

    monkeypatch.setattr(streaming_queries, "FILES_PER_TRIGGER", 1)
    whole = pq.read_table(EVENTS).to_pandas()
    later = whole.assign(ts=whole["ts"] + pd.Timedelta(days=700), event_id=whole["event_id"] + 100_000)
    os.makedirs(f"{tmp_path}/events.parquet")
    schema = pq.read_schema(EVENTS)
    for part, rows in enumerate((later, whole)):
        path = f"{tmp_path}/events.parquet/part-{part}.parquet"
        pq.write_table(pa.Table.from_pandas(rows, schema=schema, preserve_index=False), path)
        os.utime(path, (1_700_000_000 + part, 1_700_000_000 + part))
    got = entry.queries()[name](spark, str(tmp_path)).toPandas()
    connection = duck("/root/testdata/sf0.001")
    connection.execute(f"create or replace view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert difference(got, connection.sql(entry.oracle_sql()[name]).df()) is None


def test_a_key_has_one_timer_however_many_slots_wait():
    class Now:
        def getCurrentWatermarkInMs(self):
            return 0

    class Timed(Handle):
        def registerTimer(self, at):
            timers.append(at)

    timers: list[int] = []
    rule = most(1_000_000, True)
    rule.memory = ""
    rule.init(Timed())
    rows = pd.DataFrame({"at_us": np.arange(3, 33) * 1_000_000, "seq": range(30)})
    list(rule.handleInputRows(("a",), iter([rows]), Now()) or [])
    assert timers == [4_000]
    list(rule.handleInputRows(("a",), iter([rows.iloc[5:9], rows.iloc[:1].assign(at_us=0)]), Now()) or [])
    assert timers == [4_000, 1_000]


class Counting(Handle):
    """Counts what is written."""

    def __init__(self):
        super().__init__()
        self.written = 0

    def getMapState(self, name, *_):
        def write(key, value):
            self.written += 1
            dict.__setitem__(held, key, value)

        held = super().getMapState(name)
        held.updateValue = write
        return held


def test_few_rows_of_many_slots_are_one_pack():
    handle = Counting()
    slots = Slots(handle, 10)
    rows = pd.DataFrame({"at_us": np.arange(300, 0, -5), "seq": range(60)})
    assert slots.put(rows, "at_us") == set(range(31))
    assert handle.written == 2  # the pack and the index
    pieces = list(slots.taken(slots.waiting()))
    assert [sorted(p["seq"]) for p in pieces] == [list(range(60))]
    assert not any(handle.maps.values())


def test_slots_taken_a_few_at_a_time_lose_and_repeat_nothing():
    rng = np.random.default_rng(8)
    slots, held, seen = Slots(handle := Handle(), 100), [], 0
    for round_ in range(40):
        count = int(rng.choice([0, 1, 30, 700]))
        rows = pd.DataFrame({"at_us": rng.integers(round_ * 40, round_ * 40 + int(rng.choice([150, 3_000])), count), "seq": range(seen, seen + count), "kind": rng.choice(["x", None], count)})
        seen += count
        before = set(slots.waiting())
        assert slots.put(rows, "at_us") == set((rows["at_us"] // 100).tolist()) - before
        due = [s for s in slots.waiting() if s < round_ * 40 // 100]
        for piece in slots.taken(due):
            assert len(piece) <= 256 or piece["at_us"].floordiv(100).nunique() == 1
            assert piece["at_us"].floordiv(100).isin(due).all()
            held.append(piece)
    held += slots.taken(slots.waiting())
    whole = pd.concat(held)
    assert sorted(whole["seq"]) == list(range(seen))
    assert not any(handle.maps.values())


def test_rows_without_a_place_are_handed_out_alone_and_first():
    slots = Slots(Handle(), 10)
    slots.put(pd.DataFrame({"at_us": [25.0, np.nan, 12.0, np.nan], "seq": range(4)}), "at_us")
    assert [p["seq"].tolist() for p in slots.taken(slots.waiting())] == [[1, 3], [2, 0]]
