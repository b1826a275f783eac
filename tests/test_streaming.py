"""Streams brought to their end against batch twins, over several micro-batches and restarts."""

import json
import os
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyreel.functions.names import document_id_for_key
from skyreel.operators import claims
from skyreel.operators.ordered import block, lane
from skyreel.sources import snapshots, stores
from skyreel.sources.objects import list_objects
from skyreel.streaming import queries as live
from tests_support import one_pass_tracks, random_scene


def drain(stream, folder, mode="append"):
    schema = stream.schema

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/out/*")


def in_files(spark, rows, folder, schema, order, files=3):
    """Rows as several files in order, read one file per trigger."""
    os.makedirs(folder)
    for number, piece in enumerate(np.array_split(np.arange(len(rows)), files)):
        path = f"{folder}/part-{number}.json"
        with open(path, "w") as out:
            for row in rows.sort_values(order, kind="stable").iloc[piece].to_dict("records"):
                out.write(json.dumps({k: (None if v is pd.NA or v != v else v) for k, v in row.items()}, default=int) + "\n")
        os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


def test_leases_over_micro_batches(spark, tmp_path):
    rng = np.random.default_rng(5)
    data = pd.DataFrame(
        {"stream": rng.choice(["a", "b"], 200), "seq": range(200), "at_us": np.cumsum(rng.choice([1, 4, 14], 200)) * 1_000_000,
         "action": rng.choice(["claim", "claim", "release", "disable"], 200), "worker": rng.choice(["w1", "w2"], 200)}
    )
    schema = "stream string, seq long, at_us long, action string, worker string"
    streamed = drain(live.detector_leases(in_files(spark, data, f"{tmp_path}/in", schema, "seq")), tmp_path)
    batch = claims.detector_leases(spark.createDataFrame(data), lane("stream", "seq", block("seq", 20)))
    key = lambda df: sorted((r.stream, r.seq, r.granted, r.holder or "") for r in df.collect())
    assert key(streamed) == key(batch)


def test_tracks_over_micro_batches(spark, tmp_path):
    frames, boxes = random_scene(seed=3, frames=120)
    rows = frames.merge(boxes, on=["stream", "seq"], how="left")
    whole = ["det", "left", "top", "right", "bottom", "confidence"]
    rows[whole] = rows[whole].astype("Int64")  # written without decimals
    schema = (
        "stream string, seq long, pts long, width int, height int, steps_before int, det int, left int, top int, right int, bottom int, "
        "confidence int, class_name string"
    )
    # A file boundary may not cut through a frame: files are split by frame number.
    os.makedirs(f"{tmp_path}/in")
    for number, piece in enumerate(np.array_split(sorted(rows["seq"].unique()), 3)):
        part = rows[rows["seq"].isin(piece)]
        path = f"{tmp_path}/in/{number}.json"
        part.to_json(path, orient="records", lines=True)
        os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    got = drain(live.track_objects(source), tmp_path)
    columns = ["stream", "epoch", "seq", "track_id", "left", "top", "right", "bottom"]
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == one_pass_tracks(frames, boxes)


def test_changed_only_remembers_between_batches(spark, tmp_path):
    data = pd.DataFrame({"name": "a", "seq": range(9), "at_us": range(9), "watched": list("xxxyyxxzz")})
    source = in_files(spark, data, f"{tmp_path}/in", "name string, seq long, at_us long, watched string", "seq")
    got = drain(live.changed_only(source), tmp_path)
    assert sorted(r.seq for r in got.collect()) == [0, 3, 5, 7]


def test_registry_table_and_rerun_of_a_batch(spark, tmp_path):
    data = pd.DataFrame(
        {"name": ["a", "b", "a", "b", "c"], "seq": range(5), "at_us": [1, 2, 3, 4, 5], "ended": [False, False, False, True, False]}
    )
    source = in_files(spark, data, f"{tmp_path}/in", "name string, seq long, at_us long, ended boolean", "seq")
    live.registry_table(source, f"{tmp_path}/table", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.name, r.at_us) for r in live.current_registry(spark, f"{tmp_path}/table").collect()) == [("a", 3), ("c", 5)]


def test_ingest_and_listing(spark, tmp_path):
    store = tmp_path / "store"
    for key in ("incoming/a.mp4", "incoming/deep/b.pdf"):
        path = store / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * 7)
    listing = {r.key: r["size"] for r in list_objects(spark, str(store)).collect()}
    assert listing == {"incoming/a.mp4": 7, "incoming/deep/b.pdf": 7}
    assert [r.key for r in list_objects(spark, str(store), "incoming/deep").collect()] == ["incoming/deep/b.pdf"]
    run = lambda: live.ingest_documents(spark, str(store), f"{tmp_path}/catalog", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    run()
    shutil.copy(store / "incoming/a.mp4", store / "c.ts")
    run()
    rows = {r.storage_key: r for r in snapshots.read_latest(spark, f"{tmp_path}/catalog").collect()}
    assert set(rows) == {"incoming/a.mp4", "incoming/deep/b.pdf", "c.ts"}
    assert rows["c.ts"].content_type == "video/mp2t"
    want = spark.range(1).select(document_id_for_key(F.lit("c.ts")).alias("id")).first().id
    assert rows["c.ts"].id == want


def test_change_feed(spark, tmp_path):
    feed = spark.createDataFrame([("Added", "1", "k", "n")], "kind string, id string, key string, name string")
    live.publish_changes(feed, f"{tmp_path}/feed")
    live.publish_changes(feed.withColumn("kind", F.lit("Removed")), f"{tmp_path}/feed")
    assert sorted(r.kind for r in drain(live.change_feed(spark, f"{tmp_path}/feed"), tmp_path).collect()) == ["Added", "Removed"]


def test_source_store_keeps_the_last_whole_version(spark, tmp_path):
    root = f"{tmp_path}/sources"
    assert stores.current_sources(spark, root)[0].count() == 0
    for name in ("cam-1", "cam-2"):
        stores.write_sources(spark.createDataFrame([(name, True)], "name string, enabled boolean"), root)
    os.makedirs(f"{root}/v-000000000003")  # a writer that died
    assert [r.name for r in stores.current_sources(spark, root)[0].collect()] == ["cam-2"]


def test_lifecycle_timers_fire_as_time_moves_on(spark, tmp_path):
    base = 1_700_000_000  # a first watermark of zero would call the first row late
    at = [base + s for s in (0, 1, 2, 10, 100)]
    data = pd.DataFrame({"name": "a", "at_us": [s * 1_000_000 for s in at], "other": range(5)})
    mover = pd.DataFrame({"name": "clock", "at_us": [(base + s) * 1_000_000 for s in (200, 300, 400)], "other": range(5, 8)})
    rows = pd.concat([data, mover])
    source = in_files(spark, rows, f"{tmp_path}/in", "name string, at_us long, other long", "other", files=8)
    packets = source.withColumn("ts", F.timestamp_micros("at_us"))
    got = drain(live.stream_lifecycle(packets, late="1 second"), tmp_path).where("name = 'a'")
    assert sorted((r.at_ms - base * 1000, r.state) for r in got.collect()) == [
        (0, "Live"), (7_000, "Interrupted"), (10_000, "Live"), (15_000, "Interrupted"), (40_000, "Gone"), (100_000, "Live"),
        (105_000, "Interrupted"), (130_000, "Gone"),
    ]


def test_error_alerts(spark, tmp_path):
    data = pd.DataFrame({"pod": "p", "at_us": [1_700_000_000_000_000 + i * 2_000_000 for i in range(40)], "errors": [0] * 20 + [3] * 20})
    source = in_files(spark, data, f"{tmp_path}/in", "pod string, at_us long, errors long", "at_us")
    alerts = live.error_alerts(source.withColumn("ts", F.timestamp_micros("at_us")), late="0 seconds")
    got = drain(alerts, tmp_path, "complete").distinct()  # every batch repeats the table
    assert got.count() == 14 and {r.increase for r in got.collect()} == {3}


@pytest.fixture(autouse=True)
def _quiet(spark):
    spark.sparkContext.setLogLevel("OFF")
    yield


@pytest.mark.parametrize("name", ["x09_changed_only_stream", "x03_registry_table_stream", "x08_beat_metrics_stream"])
def test_tables_in_folders_over_several_batches(spark, tmp_path, monkeypatch, name):
    """Events as four files of a folder, one a trigger, give what the table in one file gives."""
    import pyarrow.parquet as pq
    from oracle import difference, duck

    import __spark_entry__ as entry
    from skyreel.plans import streaming_queries

    monkeypatch.setattr(streaming_queries, "FILES_PER_TRIGGER", 1)
    whole = pq.read_table("/root/testdata/sf0.001/events.parquet")
    whole = whole.sort_by([("ts", "ascending"), ("event_id", "ascending")])
    os.makedirs(f"{tmp_path}/events.parquet")
    for part in range(4):
        path = f"{tmp_path}/events.parquet/part-{part}.parquet"
        pq.write_table(whole.slice(part * 250, 250), path)
        os.utime(path, (1_700_000_000 + part, 1_700_000_000 + part))
    got = entry.queries()[name](spark, str(tmp_path)).toPandas()
    assert difference(got, duck("/root/testdata/sf0.001").sql(entry.oracle_sql()[name]).df()) is None
