"""Model outputs and boxes: tensor decoding, class names, overlap pairs, batches, running a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..functions import geometry as geo
from ..functions.constants import COCO, COCO_NAMES
from .ordered import Lane, numbered, trailing

# --- classes ------------------------------------------------------------------------------------


def class_table(family: str) -> Column:
    """Class names by number: the sparse category ids (``rf-detr``) or the dense index (``yolo26``)."""
    if family == "rf-detr":
        return F.array(*[F.lit(COCO.get(i)).cast("string") for i in range(max(COCO) + 1)])
    return F.array(*[F.lit(n) for n in COCO_NAMES])


def class_names(ids: DataFrame, column: str, family: str) -> DataFrame:
    """Rows whose class number the family knows, with its name."""
    named = ids.withColumn("class_name", F.when(F.col(column) >= 0, F.get(class_table(family), F.col(column))))
    return named.where("class_name is not null")


# --- tensors ------------------------------------------------------------------------------------
# A frame's tensor is one row, so decoding never leaves the row: array functions, no shuffle.


def tensor_rows(tensors: DataFrame, column: str, stride: int) -> DataFrame:
    """One row per ``stride`` consecutive values of a tensor column."""
    count = F.floor(F.size(column) / F.lit(stride)).cast("int")
    rows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(column, i * stride + 1, stride))
    kept = [c for c in tensors.columns if c != column]
    return tensors.select(*kept, F.posexplode(F.when(count > 0, rows)).alias("row_index", "values"))


def top_queries(tensors: DataFrame, scores: str, k: int = 300) -> DataFrame:
    """The ``k`` best scores of each frame with where they stand in the tensor; equal scores in tensor order."""
    ranked = F.slice(
        F.array_sort(F.transform(scores, lambda x, i: F.struct((-x.cast("double")).alias("s"), i.alias("i")))), 1, k
    )
    kept = [c for c in tensors.columns if c != scores]
    out = tensors.select(*kept, F.posexplode(ranked).alias("rank", "r"))
    return out.select(*kept, (F.col("rank") + 1).alias("rank"), F.col("r.i").alias("index"), (-F.col("r.s")).alias("score"))


def decode_query_scores(
    tensors: DataFrame,
    scores: str,
    boxes: str,
    classes: int,
    threshold: float,
    width: Column,
    height: Column,
    size: int,
    family: str = "rf-detr",
    logits: bool = True,
) -> DataFrame:
    """Detections of a query-by-class head: every (query, class) above the threshold, in tensor order."""
    cutoff = geo.logit_cutoff(threshold) if logits else threshold
    table = class_table(family)
    cells = F.filter(
        F.transform(
            scores,
            lambda x, i: F.struct(
                x.cast("double").alias("raw"),
                F.floor(i / F.lit(classes)).cast("int").alias("query"),
                F.get(table, i % classes).alias("name"),
            ),
        ),
        lambda c: (c["raw"] > cutoff) & c["name"].isNotNull(),
    )
    kept = [c for c in tensors.columns if c not in (scores, boxes)]
    hits = tensors.select(*kept, boxes, F.posexplode(cells).alias("__n", "__c"))
    edge = lambda j: F.get(boxes, F.col("__c.query") * 4 + j).cast("double")
    box = geo.to_frame_normalised(edge(0), edge(1), edge(2), edge(3), width, height, "stretch", size)
    raw = F.col("__c.raw")
    return hits.select(
        *kept,
        (F.col("__n") + 1).alias("id"),
        F.col("__c.query").alias("query"),
        F.col("__c.name").alias("class_name"),
        geo.confidence_pct(geo.sigmoid(raw) if logits else raw).alias("confidence"),
        box.alias("__b"),
    ).select(*kept, "id", "query", "class_name", "confidence", "__b.*")


def decode_sorted_rows(
    tensors: DataFrame, rows: str, cutoff: float, width: Column, height: Column, size: int, family: str = "yolo26"
) -> DataFrame:
    """Detections of a score-sorted head of ``x1, y1, x2, y2, score, class`` rows; the first low score ends the frame."""
    count = F.floor(F.size(rows) / F.lit(6)).cast("int")
    at = lambda r, j: F.get(rows, r * 6 + j).cast("double")
    every = F.when(count > 0, F.sequence(F.lit(0), count - 1))
    end = F.coalesce(F.array_min(F.filter(every, lambda r: at(r, 4) <= cutoff)), count)
    table = class_table(family)
    named = lambda r: F.when((at(r, 5) > -1) & (at(r, 5) < F.size(table)), F.get(table, at(r, 5).cast("int")))
    kept_rows = F.filter(every, lambda r: (r < end) & named(r).isNotNull())
    kept = [c for c in tensors.columns if c != rows]
    hits = tensors.select(*kept, rows, F.posexplode(kept_rows).alias("__n", "__r"))
    r = F.col("__r")
    box = geo.to_frame(at(r, 0), at(r, 1), at(r, 2), at(r, 3), width, height, "letterbox", size)
    return hits.select(
        *kept, (F.col("__n") + 1).alias("id"), r.alias("row_index"), named(r).alias("class_name"),
        geo.confidence_pct(at(r, 4)).alias("confidence"), box.alias("__b"),
    ).select(*kept, "id", "row_index", "class_name", "confidence", "__b.*")


# --- boxes --------------------------------------------------------------------------------------

BOX = ["left", "top", "right", "bottom"]


def iou_pairs(tracks: DataFrame, detections: DataFrame, keys: list[str], cell: int = 128) -> DataFrame:
    """Overlapping (track, detection) pairs of a frame with cost ``1 - IoU`` and ``1 - IoU x score``.

    Pairs that do not touch cost exactly 1 and are left out.  Boxes meet through the grid cells they cover,
    so a frame with very many boxes joins neighbourhoods, not everything with everything; a pair is emitted
    by the one cell that holds the top-left corner of its overlap.
    """
    a = _on_grid(tracks, keys, "t_", cell)
    b = _on_grid(detections, keys, "d_", cell)
    x, y = F.greatest("t_left", "d_left"), F.greatest("t_top", "d_top")
    overlap = (F.least("t_right", "d_right") >= x) & (F.least("t_bottom", "d_bottom") >= y)
    owner = (F.floor(x / F.lit(cell)) == F.col("__cx")) & (F.floor(y / F.lit(cell)) == F.col("__cy"))
    pairs = a.join(b, [*keys, "__cx", "__cy"]).where(overlap & owner)
    shared = geo.iou([F.col(f"t_{c}") for c in BOX], [F.col(f"d_{c}") for c in BOX])
    score = F.coalesce(F.col("d_confidence"), F.lit(100)) / 100.0
    return pairs.withColumn("iou", shared).select(
        *keys, "t_id", "d_id", "iou", (1 - F.col("iou")).alias("cost"), (1 - F.col("iou") * score).alias("fused_cost")
    )


def _on_grid(boxes: DataFrame, keys: list[str], prefix: str, cell: int) -> DataFrame:
    renamed = boxes.select(*keys, *[F.col(c).alias(prefix + c) for c in ["id", *BOX, "confidence"] if c in boxes.columns])
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / F.lit(cell)), F.floor(F.col(hi) / F.lit(cell)))
    return renamed.withColumn("__cx", F.explode(span(f"{prefix}left", f"{prefix}right"))).withColumn(
        "__cy", F.explode(span(f"{prefix}top", f"{prefix}bottom"))
    )


def strongest_first(detections: DataFrame, tie: list[str]) -> DataFrame:
    """Detections by confidence, a missing one counting as certain."""
    return detections.orderBy(F.desc(F.coalesce("confidence", F.lit(100))), *tie)


def track_history(observations: DataFrame, on: Lane, value: Column, length: int = 30) -> DataFrame:
    """Every observation with its track's last ``length`` ones, oldest first."""
    return trailing(observations, on, length, value, "history")


def inference_batches(frames: DataFrame, on: Lane, size: int = 8) -> DataFrame:
    """Due frames in batches of at most ``size`` per model, in arrival order; ``on`` is keyed by model."""
    placed = numbered(frames, on, "__n")
    return placed.withColumn("batch", F.floor((F.col("__n") - 1) / F.lit(size))).drop("__n")


# --- running a model ----------------------------------------------------------------------------

_loaded: dict = {}


def run_detector(
    frames: DataFrame,
    tensor: str,
    model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    name: str,
    output: str = "scores",
    batch: int = 8,
) -> DataFrame:
    """Frames with a model's output per row.

    ``model`` builds the callable that maps a batch of stacked tensors to a batch of outputs; a Python worker
    builds it once (per ``name``) and keeps it.  Filter frames with the decode plan before coming here:
    the optimiser cannot move a filter through Python.
    """
    kept = [f for f in frames.schema.fields if f.name != tensor]
    schema = StructType([*kept, StructField(output, ArrayType(FloatType()))])
    names = [f.name for f in kept]

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _loaded:
            _loaded[name] = model()
        infer = _loaded[name]
        for rows in batches:
            outputs = []
            for start in range(0, len(rows), batch):
                stacked = np.stack(rows[tensor].iloc[start : start + batch].to_numpy())
                outputs.extend(np.asarray(infer(stacked), dtype=np.float32))
            yield rows[names].assign(**{output: [o.ravel().tolist() for o in outputs]})

    return frames.mapInPandas(detect, schema)


def onnx_model(path: str) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A model builder for an ONNX file every executor can read."""

    def build():
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        feed = session.get_inputs()[0].name
        return lambda stacked: session.run(None, {feed: stacked.astype(np.float32)})[0]

    return build
