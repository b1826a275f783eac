"""Plans the operators must keep: one wide shuffle per lane, pushed filters, pruned columns, no shuffle for tensors."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from skyreel.operators import detections, metrics
from skyreel.operators.ordered import lane, time_chunk
from skyreel.plans import shapes
from skyreel.plans.registry import Tables
from skyreel.session import configure

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_lane_moves_wide_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        packets = configure(spark).range(1000).select(
            F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("name"), F.timestamp_seconds("id").alias("ts"), "id",
            F.repeat(F.lit("x"), 100).alias("payload"),
        )
        deltas = metrics.interval_deltas(packets, lane("name", ("ts", "id"), time_chunk("ts", 60)), ["id"])
        lines = plan_of(deltas).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Between the join and the window of the wide side there is neither an exchange nor a sort.
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    window = next(i for i, line in enumerate(lines) if i > join and "Window" in line)
    assert not any("Exchange" in line or "Sort [" in line for line in lines[join + 1 : window])
    wide = [line for line in lines if "Exchange" in line and "payload" in line]
    assert not wide or len(wide) == 1


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["s03_get_document"](spark, FOLDER))
    assert "EqualTo(o_orderkey,1234)" in plan
    counted = plan_of(QUERIES["a17_outcome_tally"](spark, FOLDER))
    assert re.search(r"ReadSchema: struct<event_type:string>", counted)


def test_tensors_decode_without_a_shuffle(spark):
    for name in ("k06_decode_query_scores", "k07_decode_sorted_rows", "t05_top_queries"):
        assert "Exchange" not in plan_of(QUERIES[name](spark, FOLDER))


def test_newest_rows_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(QUERIES["t04_drop_oldest"](spark, FOLDER))


def test_pairs_meet_in_cells(spark):
    boxes = shapes.boxes(Tables(configure(spark), FOLDER)).withColumnRenamed("det", "id")
    assert "__cx" in plan_of(detections.iou_pairs(boxes, boxes, ["stream", "frame"]))


def test_several_rows_back_in_three_shuffles(spark):
    plan = plan_of(QUERIES["w19_stream_health"](spark, FOLDER))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 3


def test_quantiles_of_one_group_gather_no_rows(spark):
    """Only counts of digits meet in one place: the executed plans of the last step hold a rank's counts, not the rates."""
    rates = spark.range(50_000).select((F.xxhash64("id") % 1_000_000_007).alias("bps"))
    ranks = {"p50": F.floor(F.col("n") / 2)}
    found = metrics.nearest_rank(rates, [], "bps", ranks, 64)
    values = sorted(r.bps for r in rates.collect())
    assert found.first().p50 == values[25_000]
    assert "50000" not in plan_of(found) and "SinglePartition" in plan_of(found)


def test_a_byte_range_plan_numbers_the_parts_once(spark, monkeypatch):
    calls, parts = [], shapes.parts
    monkeypatch.setattr(shapes, "parts", lambda t: calls.append(t) or parts(t))
    assert QUERIES["j18_byte_range_plan"](spark, FOLDER).count() > 1_000
    assert len(calls) == 1
