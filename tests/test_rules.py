"""Small cases of rules that the benchmark tables don't reach."""

import pytest
from pyspark.sql import functions as F

from skyreel.functions import geometry, names
from skyreel.operators import detections, lifecycle, metrics, packets, registry, tracking
from skyreel.operators.ordered import block, lane


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_no_stream_limit(spark):
    sources = spark.createDataFrame([("a", "u", True), ("b", "u", True)], "name string, url string, enabled boolean")
    local = spark.createDataFrame([("c",)], "name string")
    held = spark.createDataFrame([], "name string, owner string, state string, heartbeat_us long")
    tried = spark.createDataFrame([], "name string, at_us long")
    for most, count in ((0, 2), (2, 1), (1, 0)):
        assert registry.adopt_candidates(sources, local, held, tried, "me", F.lit(0), most, 1).count() == count


def test_first_trigger_is_capped(spark):
    triggers = spark.createDataFrame([("r", 0, 0, 100), ("r", 50_000_000, 1, 5)], "name string, at_us long, seq long, secs long")
    got = lifecycle.recording_sessions(triggers, lane("name", ("at_us", "seq"), block("at_us", 1 << 40)), seconds=F.col("secs"), cap_seconds=20)
    assert rows_of(got, "started_us", "ends_us", "triggers") == [(0, 20_000_000, 1), (50_000_000, 55_000_000, 1)]


def test_buffer_with_a_start_that_steps_back(spark):
    found = spark.createDataFrame([("s", k, pts, 1, k + 1) for k, pts in enumerate([100, 50, 145])], "stream string, seq long, pts long, size long, segment long")
    kept = packets.buffer_retained(found, lane("stream", "seq", block("seq", 100)), 1.0, 60.0, 1_000)
    assert rows_of(kept, "segment", "start_pts") == [(1, 100), (2, 50), (3, 145)]


def test_buffer_against_a_loop(spark):
    import random

    rng = random.Random(7)
    data, want = [], {}
    for stream in range(12):
        held, bytes_, pts = [], 0, 0
        for seq in range(60):
            pts += rng.choice([-15, 5, 10, 20])
            size, segment = rng.choice([5, 10, 90]), seq // 3 + 1
            data.append((f"s{stream}", seq, pts, size, segment))
            if not held or held[-1][0] != segment:
                held.append([segment, pts, pts, 0])
            held[-1][2], held[-1][3] = max(held[-1][2], pts), held[-1][3] + size
            while held and (sum(h[3] for h in held) > 150 or (len(held) > 1 and held[-1][2] - held[0][1] > 80)):
                held.pop(0)
        want[f"s{stream}"] = [h[0] for h in held]
    rows = spark.createDataFrame(data, "stream string, seq long, pts long, size long, segment long")
    got = rows_of(packets.buffer_retained(rows, lane("stream", "seq", block("seq", 16)), 1.0, 80.0, 150), "stream", "segment")
    assert got == sorted((s, n) for s, segments in want.items() for n in segments)


def test_packets_without_a_stamp_follow_the_break(spark):
    # the clock sinks in small steps, so the run breaks inside; the packet without a stamp comes after the break
    data = [("s", 0, 10_000), ("s", 1, 9_000), ("s", 2, 8_000), ("s", 3, None), ("s", 4, 8_100)]
    out = packets.rebase_timeline(spark.createDataFrame(data, "stream string, seq long, pts long"), lane("stream", "seq", block("seq", 100)), F.col("pts"), 0, 1.0, 1_500.0)
    shifts = {r.seq: r["shift"] for r in out.collect()}
    assert shifts[3] == shifts[2] == shifts[4] != shifts[0]


def test_rates_close_after_a_second(spark):
    polls = [(0, 0), (0, 0), (400_000, 40), (1_000_000, 100), (1_300_000, 400), (2_500_000, 700)]
    rows = spark.createDataFrame([("s", seq, at, n) for seq, (at, n) in enumerate(polls)], "name string, seq long, at_us long, packets long")
    got = metrics.observed_rate(rows, lane("name", ("at_us", "seq"), block("at_us", 1 << 40)))
    assert rows_of(got, "seq", "window_rate", "observed_rate") == [(0, None, 0.0), (1, None, 0.0), (2, None, 0.0), (3, 100.0, 0.0), (4, None, 0.0), (5, 400.0, 100.0)]


def test_numbers_that_are_none(spark):
    nan = float("nan")
    row = spark.createDataFrame([(nan, 5.0, float("inf"), nan)], "a double, b double, c double, d double")
    box = row.select(geometry.to_frame(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.lit(640), F.lit(480), "stretch", 640).alias("b")).first().b
    assert tuple(box) == (1, 5, 640, 5)
    model = spark.createDataFrame([([1.0, 1.0, 9.0, 9.0, 0.9, nan, 1.0, 1.0, nan, 9.0, 0.8, 0.0],)], "rows array<double>")
    assert detections.decode_sorted_rows(model, "rows", 0.5, F.lit(640), F.lit(640), 640).count() == 1


@pytest.mark.parametrize("said, name", [("\tcam-1\n", "cam-1"), ("  cam-1 ", "cam-1"), (" cam 1", None), ("#!::r=" + "a/" * 3 + "b", "a/a/a/b")])
def test_names_lose_white_space(spark, said, name):
    got = spark.createDataFrame([(said,)], "id string").select(names.parse_stream_id(F.col("id")).alias("p")).first().p
    assert got.name == name and (got.rejection is None) == (name is not None)


def test_long_identifiers_are_read_whole(spark):
    text = "#!::x=" + "y" * (1 << 20) + ",user_from=7,s=1"
    got = spark.createDataFrame([(text,)], "id string").select(names.preroll_position(F.col("id")).alias("p"), names.carries_session_key(F.col("id")).alias("s")).first()
    assert (got.p, got.s) == (7.0, True)


def test_steps_count_by_time(spark):
    frames = spark.createDataFrame([("s", 1, 100), ("s", 5, 200), ("s", 8, 150), ("s", 9, 160)], "stream string, seq long, pts long")
    # 0 arrives before the first picture; 2 lies past the next one; 6 and 7 are forgotten as the clock steps back
    behind = spark.createDataFrame([("s", s, p) for s, p in ((0, 150), (2, 250), (3, 150), (4, 160), (6, 155), (7, 220))], "stream string, seq long, pts long")
    got = tracking.pending_steps(frames, behind)
    assert rows_of(got, "seq", "steps_before") == [(1, 0), (5, 2), (8, 0), (9, 0)]
    early = spark.createDataFrame([("s", 0, 100), ("s", 3, 200), ("s", 4, 300)], "stream string, seq long, pts long")
    ahead = spark.createDataFrame([("s", 1, 250), ("s", 2, 150)], "stream string, seq long, pts long")
    assert rows_of(tracking.pending_steps(early, ahead), "seq", "steps_before") == [(0, 0), (3, 1), (4, 1)]
