"""The chunked kernels against straight loops, with chunk boundaries everywhere and one key owning most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyreel.operators import asof, claims, lifecycle, metrics, packets
from skyreel.operators.listing import positioned
from skyreel.operators.ordered import around, block, following, lane, numbered, preceding, previous, running, trailing
from skyreel.operators.sampling import due_rows


def skewed(rows=600, seed=3):
    """A third of the rows and more belong to one key; some stretches of positions are empty."""
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(rows) < 0.5, "hot", rng.choice(list("abcdef"), rows))
    position = np.sort(rng.choice(np.arange(rows * 8), rows, replace=False))
    position[rows // 2 :] += 5_000
    return pd.DataFrame({"key": keys, "pos": position.astype("int64"), "v": rng.integers(-50, 50, rows), "flag": rng.random(rows) < 0.2})


@pytest.fixture(scope="module")
def table(spark):
    return skewed(), lane("key", "pos", block("pos", 97))


def frame(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def test_running(spark, table):
    data, on = table
    out = frame(
        running(spark.createDataFrame(data), on, s=("sum", F.col("v")), m=("max", F.col("v")), n=("count", F.when(F.col("flag"), 1))), "key", "pos"
    )
    want = data.sort_values(["key", "pos"]).reset_index(drop=True)
    groups = want.groupby("key")
    assert (out["s"] == groups["v"].cumsum()).all()
    assert (out["m"] == groups["v"].cummax()).all()
    assert (out["n"] == groups["flag"].cumsum()).all()


def test_running_exclusive_and_backwards(spark, table):
    data, on = table
    df = spark.createDataFrame(data)
    before = frame(running(df, on, inclusive=False, s=("sum", F.col("v"))), "key", "pos")
    after = frame(running(df, on.reversed(), s=("sum", F.col("v"))), "key", "pos")
    want = data.sort_values(["key", "pos"]).reset_index(drop=True)
    total = want.groupby("key")["v"].transform("sum")
    sums = want.groupby("key")["v"].cumsum()
    assert (before["s"] == sums - want["v"]).all()
    assert (after["s"] == total - sums + want["v"]).all()


def test_previous_and_following(spark, table):
    data, on = table
    df = spark.createDataFrame(data)
    got = frame(previous(df, on, where=F.col("flag"), p=F.col("v"), at=F.col("pos")), "key", "pos")
    want = data.sort_values(["key", "pos"]).reset_index(drop=True)
    held = want["pos"].where(want["flag"]).groupby(want["key"]).ffill().groupby(want["key"]).shift()
    assert got["at"].astype(float).fillna(-1).tolist() == held.fillna(-1).tolist()
    ahead = frame(following(df, on, p=F.col("v")), "key", "pos")
    assert ahead["p"].astype(float).fillna(-99).tolist() == want.groupby("key")["v"].shift(-1).fillna(-99).tolist()
    both = frame(around(df, on, F.col("flag"), pos=F.col("pos")), "key", "pos")
    assert both["before_pos"].astype(float).fillna(-1).tolist() == held.fillna(-1).tolist()


def test_numbered_trailing_and_positions(spark, table):
    data, on = table
    df = spark.createDataFrame(data)
    want = data.sort_values(["key", "pos"]).reset_index(drop=True)
    assert (frame(numbered(df, on), "key", "pos")["row_no"] == want.groupby("key").cumcount() + 1).all()
    kept = frame(trailing(df, on, 5, F.col("pos"), "last", block_rows=7), "key", "pos")
    for row in kept.itertuples():
        mine = want[(want["key"] == row.key) & (want["pos"] <= row.pos)]["pos"].tolist()[-5:]
        assert list(row.last) == mine
    placed = frame(positioned(df.select("key", "pos"), ["pos"]), "pos")
    assert placed["position"].tolist() == list(range(1, len(data) + 1))


@pytest.mark.parametrize("chunk", [50, 10_000_000])
def test_asof(spark, chunk):
    data = skewed(300, seed=5)
    left, right = data[~data["flag"]][["key", "pos"]], data[data["flag"]].rename(columns={"pos": "rpos"})[["key", "rpos", "v"]]
    right = right.assign(no=range(len(right)))
    found = asof.nearest(spark.createDataFrame(left), spark.createDataFrame(right), "key", "pos", "rpos", "no", chunk)
    for row in found.collect():
        mine = right[right["key"] == row.key]
        if len(mine) == 0:
            assert row.match is None
            continue
        gap = (mine["rpos"] - row.pos).abs()
        best = mine.assign(gap=gap).sort_values(["gap", "no"]).iloc[0]
        assert row.match.no == best["no"]


@pytest.mark.parametrize("rate", [1.0, 0.35, 4.0])
def test_sampling_in_tiny_blocks_is_the_loop(spark, rate):
    rng = np.random.default_rng(11)
    rows = []
    for stream, count in (("hot", 700), ("b", 60), ("c", 1)):
        at = 0.0
        for seq in range(count):
            at += rng.choice([0.04, 0.04, 0.3, 2.5]) if rng.random() > 0.02 else -rng.choice([0.1, 30.0])
            rows.append((stream, seq, round(at, 3)))
    data = pd.DataFrame(rows, columns=["stream", "seq", "seconds"])
    got = due_rows(spark.createDataFrame(data), lane("stream", "seq", block("seq", 50)), "seconds", rate, block_rows=13)
    interval, want = 1 / rate, []
    for stream, part in data.groupby("stream"):
        due = -np.inf
        for seq, at in zip(part["seq"], part["seconds"]):
            if at < due - interval:
                due = at
            if at >= due:
                want.append((stream, seq))
                due = at + interval
    # Times that fall within rounding of the due time are decided by the same sum on both sides.
    assert sorted((r.stream, r.seq) for r in got.collect()) == sorted(want)


def buffer_loop(rows, window, ceiling):
    segments, total, binding = [], 0, False
    for pts, size, key in rows:
        if key or not segments:
            segments.append([pts, pts, 0, key])
        segments[-1][1] = max(segments[-1][1], pts)
        segments[-1][2] += size
        total += size
        emptied = True
        while segments:
            heavy, wide = total > ceiling, segments[-1][1] - segments[0][0] > window
            if not heavy and (not wide or len(segments) == 1):
                emptied = False
                break
            binding = heavy
            total -= segments.pop(0)[2]
        if emptied:
            binding = True
    return [tuple(s) for s in segments], binding


@pytest.mark.parametrize("ceiling", [10_000, 1_500, 400, 90])
def test_rolling_buffer_is_the_loop(spark, ceiling):
    rng = np.random.default_rng(2)
    rows = []
    for stream in ("a", "b", "c", "d", "e", "f"):
        pts = 0
        for seq in range(120):
            pts += int(rng.integers(1, 40))
            rows.append((stream, seq, pts, int(rng.integers(10, 100)), bool(rng.random() < (0.0 if stream == "f" else 0.15))))
    data = pd.DataFrame(rows, columns=["stream", "seq", "pts", "size", "is_key"])
    on = lane("stream", "seq", block("seq", 11))
    segmented = packets.assign_segments(spark.createDataFrame(data), on, F.col("is_key"))
    got = packets.buffer_retained(segmented, on, 1.0, 600, ceiling).toPandas()
    for stream, part in data.groupby("stream"):
        segments, binding = buffer_loop(part[["pts", "size", "is_key"]].itertuples(index=False, name=None), 600, ceiling)
        mine = got[got["stream"] == stream].sort_values("start_pts")
        assert [tuple(r) for r in mine[["start_pts", "end_pts", "bytes", "startable"]].itertuples(index=False, name=None)] == segments
        assert all(mine["ceiling_binding"] == binding)


def test_rebase_is_the_loop(spark):
    rng = np.random.default_rng(4)
    rows = []
    for stream in ("hot", "x"):
        stamp = 0
        for seq in range(400 if stream == "hot" else 40):
            stamp += int(rng.choice([40, 40, 40, -300, -700, -5_000], p=[0.5, 0.2, 0.15, 0.08, 0.05, 0.02]))
            rows.append((stream, seq, stamp))
    data = pd.DataFrame(rows, columns=["stream", "seq", "stamp"])
    out = packets.rebase_timeline(spark.createDataFrame(data), lane("stream", "seq", block("seq", 31)), F.col("stamp"), 100, 0.001)
    got = frame(out, "stream", "seq")
    for stream, part in data.groupby("stream"):
        shift, last, want = None, None, []
        for here in part["stamp"]:
            if shift is None:
                shift, last = 100 - here, 100
            elif here + shift < last - 1_000:
                shift = last - here
            last = max(last, here + shift)
            want.append(here + shift)
        assert got[got["stream"] == stream]["rebased"].tolist() == want


def test_monotonic_dts_is_the_loop(spark):
    rng = np.random.default_rng(9)
    data = pd.DataFrame({"stream": "hot", "seq": range(300), "pts": range(300), "dts": np.cumsum(rng.integers(-5, 8, 300))})
    got = frame(packets.monotonic_dts(spark.createDataFrame(data), lane("stream", "seq", block("seq", 7))), "seq")
    last, want = None, []
    for dts in data["dts"]:
        last = dts if last is None or dts > last else last + 1
        want.append(last)
    assert got["out_dts"].tolist() == want


def test_decode_plan_waits_for_a_keyframe_after_a_skip(spark):
    keys = [0, 50, 100, 150]
    data = pd.DataFrame({"stream": "s", "seq": range(200), "pts": [i * 10 for i in range(200)]})
    data["is_key"] = data["seq"].isin(keys)
    data["rate"] = np.where(data["seq"] < 120, 1.0, 25.0)  # the faster subscriber arrives mid-way
    plan = frame(packets.decode_plan(spark.createDataFrame(data), lane("stream", "seq", block("seq", 9)), F.col("rate"), 0.001), "seq")
    assert plan[plan["decode"]]["seq"].tolist() == [0, 50, 100] + list(range(150, 200))


def test_capped_recordings_is_the_loop(spark):
    rng = np.random.default_rng(6)
    at = np.cumsum(rng.integers(1, 40, 500)) * 1_000_000
    data = pd.DataFrame({"name": "hot", "seq": range(500), "at_us": at, "seconds": rng.integers(5, 60, 500)})
    got = lifecycle.recording_sessions(
        spark.createDataFrame(data), lane("name", ("at_us", "seq"), block("at_us", 300_000_000)), seconds=F.col("seconds"), cap_seconds=120
    ).toPandas()
    want, opened = [], None
    for t, s in zip(at, data["seconds"]):
        until = t + s * 1_000_000
        if opened and t < opened[1]:
            opened = (opened[0], max(opened[1], min(until, opened[0] + 120_000_000)), opened[2] + 1)
            continue
        if opened:
            want.append(opened)
        opened = (t, until, 1)
    want.append(opened)
    assert sorted(map(tuple, got[["started_us", "ends_us", "triggers"]].to_numpy().tolist())) == [tuple(map(int, w)) for w in want]


def test_leases_split_into_pieces_are_the_loop(spark):
    rng = np.random.default_rng(8)
    data = pd.DataFrame(
        {
            "stream": "hot", "seq": range(300), "at_us": np.cumsum(rng.choice([1, 4, 14], 300)) * 1_000_000,
            "action": rng.choice(["claim", "claim", "claim", "release", "disable"], 300), "worker": rng.choice(["w1", "w2"], 300),
        }
    )
    got = frame(claims.detector_leases(spark.createDataFrame(data), lane("stream", "seq", block("seq", 17))), "seq")
    lease = claims.Lease()
    want = [lease.apply(a, w, t) for a, w, t in zip(data["action"], data["worker"], data["at_us"].tolist())]
    assert got["granted"].tolist() == want


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"k": "hot", "v": rng.integers(0, 5_000, 2_001)})
    got = metrics.nearest_rank(spark.createDataFrame(data), ["k"], "v", {"p50": F.floor(F.col("n") / 2), "p95": F.floor(F.col("n") * 0.95)}, 64).first()
    ordered = sorted(data["v"])
    assert (got.p50, got.p95) == (ordered[1_000], ordered[int(2_001 * 0.95)])


@pytest.mark.parametrize("spread, bits", [(3, 2), (5_000, 64), (1 << 50, 4_096), (1, 16)])
def test_exact_quantiles_by_digits(spark, spread, bits):
    """Many keys, null ones among them, negative and far values, ties, nulls."""
    rng = np.random.default_rng(spread % 97)
    keys = ["hot"] * 400 + [None] * 30 + list("abc")
    data = [(k, None if rng.random() < 0.05 else int(rng.integers(-spread // 2, spread // 2 + 1))) for k in keys]
    ranks = {"least": F.lit(0), "p50": F.floor(F.col("n") / 2), "most": F.col("n") - 1}
    got = {r.k: r for r in metrics.nearest_rank(spark.createDataFrame(data, "k string, v long"), ["k"], "v", ranks, bits).collect()}
    for k in set(keys):
        held = sorted(v for key, v in data if key == k and v is not None)
        if held:
            assert (got[k].n, got[k].total, got[k].least, got[k].p50, got[k].most) == (len(held), sum(held), held[0], held[len(held) // 2], held[-1])
        else:
            assert k not in got
    whole = metrics.nearest_rank(spark.createDataFrame(data, "k string, v long"), [], "v", ranks, bits).collect()
    held = sorted(v for _, v in data if v is not None)
    assert [tuple(r) for r in whole] == [(len(held), sum(held), held[0], held[len(held) // 2], held[-1])]
    assert [tuple(r) for r in metrics.nearest_rank(spark.createDataFrame([], "k string, v long"), [], "v", ranks, bits).collect()] == [(None,) * 5]


@pytest.mark.parametrize("rows", [1, 2, 5, 30])
def test_preceding_rows_over_chunks(spark, table, rows):
    data, on = table
    value = F.when(F.col("v") % 7 != 0, F.col("v"))
    out = frame(preceding(spark.createDataFrame(data), on, rows, "before", value), "key", "pos")
    want = []
    for _, group in data.sort_values(["key", "pos"]).groupby("key"):
        held = group["v"].tolist()
        want += [[v for v in held[max(0, i - rows) : i] if v % 7] for i in range(len(held))]
    assert [list(b) for b in out["before"]] == want


def test_replay_deals_runs_anew_behind_a_join(spark):
    """Behind a join on the run's key the deal must stay: AQE may turn the join into a broadcast and read its input by mapper,
    and then the rows of a run are on several tasks."""
    from skyreel.operators.sequential import replay
    from skyreel.session import cut_lineage

    class Nothing:
        def feed(self, rows):
            return []

        def finish(self):
            return []

    rows = cut_lineage(spark.range(0, 400, numPartitions=4).select((F.col("id") % 20).alias("k"), F.col("id").alias("n")))
    wanted = rows.groupBy("k").agg(F.max("n").alias("m")).where("m > 0").select("k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        replayed = replay(rows.join(wanted, ["k"], "left_semi"), ["k"], ["n"], Nothing, "k long, rows long")
        plan = replayed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "REPARTITION_BY_NUM" in plan


def test_whole_segments_are_kept_or_dropped_as_one(spark):
    """A segment is over the ceiling: the walk keeps its tail, ``whole`` keeps nothing of it."""
    rows = [("a", n, n * 10, n * 10, 40, segment) for n, segment in enumerate([1, 1, 2, 2, 2, 2, 3])]
    segmented = spark.createDataFrame(rows, "stream string, seq long, at_us long, pts long, size long, segment long")
    on = lane("stream", ("at_us", "seq"), block("at_us", 30))
    held = lambda ceiling, **how: sorted((r.segment, r.bytes) for r in packets.buffer_retained(segmented, on, 1.0, 1_000, ceiling, **how).collect())
    assert held(100, whole=True) == [(3, 40)]
    assert held(100) == [(2, 40), (3, 40)]
    assert held(1_000, whole=True) == held(1_000) == [(1, 80), (2, 160), (3, 40)]


def test_every_poll_may_close_a_window(spark):
    rows = [("a", 1, 0, 0), ("a", 2, 500_000, 10), ("a", 3, 500_000, 30), ("a", 4, 500_000, 30), ("a", 5, 1_000_000, 35)]
    polls = spark.createDataFrame(rows, "name string, seq long, at_us long, packets long")
    rated = metrics.observed_rate(polls, lane("name", ("at_us", "seq"), block("at_us", 400_000)), least_seconds=0).orderBy("seq").collect()
    assert [r.window_rate for r in rated[:3]] == [None, 20.0, float("inf")] and np.isnan(rated[3].window_rate) and rated[4].window_rate == 10.0
    assert [r.observed_rate for r in rated[:3]] == [0.0, 0.0, 20.0] and rated[4].observed_rate == 10.0
