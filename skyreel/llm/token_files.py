"""Token counts from flat token files: a separator scan.

A token file is nothing but token ids of a fixed width, one document after another, each followed by an end-of-document
id; there is no index. Files are cut into blocks of whole tokens, every block is searched for the separator as an array,
and a prefix scan over the blocks of a file (separators so far, place of the last one) stitches the documents that cross
block boundaries.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, prepared, shared_folder

BLOCK_BYTES = 8 << 20


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write(rows: DataFrame, separator: int, ids: str = "token_ids", width: int = 2) -> DataFrame:
    """Write packed 32-bit ``ids`` of every row into flat files in the cluster's shared folder: each task one file.

    Returns (file, ordinal, doc_id, bytes): which document of a file belongs to which row, and the file's final size.
    A task that runs again writes another file; only files named in the result count. Null ids are an empty document; an id or
    separator that ``width`` bytes don't hold is an error.
    """
    spark = prepared(rows.sparkSession)
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    kind = np.dtype(f"<u{width}")

    def put(batches):
        name, out, ordinal, size = f"{folder}/{uuid.uuid4().hex}.bin", None, 0, 0
        for batch in batches:
            if out is None:
                system, path = _opened(name)
                system.create_dir(path.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(path)
            for packed in batch.column("ids").to_pylist():
                ids_ = np.append(np.frombuffer(packed or b"", "<u4"), np.uint32(separator))
                if int(ids_.max()) >> (8 * width):
                    raise ValueError(f"a token id doesn't fit {width} bytes")
                data = ids_.astype(kind).tobytes()
                out.write(data)
                size += len(data)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(batch), pa.string()), pa.array(np.arange(ordinal, ordinal + len(batch))), batch.column("doc_id"), pa.array(np.full(len(batch), size))], ["file", "ordinal", "doc_id", "bytes"])
            ordinal += len(batch)
        if out is not None:
            out.close()

    told = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(put, "file string, ordinal long, doc_id long, bytes long")
    return checkpointed(told)


def blocks(files: DataFrame, width: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, at, size): byte ranges of whole tokens of the ``files`` (file, bytes). A torn last token is left out."""
    step = block_bytes - block_bytes % width
    whole = files.where("bytes is not null").withColumn("bytes", F.col("bytes") - F.col("bytes") % width).where("bytes > 0")
    cut = whole.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / step))).alias("block"))
    return cut.select("file", "block", (F.col("block") * step).alias("at"), F.least(F.lit(step), F.col("bytes") - F.col("block") * step).alias("size"))


def token_counts(files: DataFrame, separator: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens, closed) for every document of the flat ``files`` (file, bytes), in order from 0.

    ``n_tokens`` doesn't count the separator; two separators in a row enclose an empty document. Tokens behind the last
    separator are a document with ``closed`` false. Empty files have no documents.
    """
    prepared(files.sparkSession)
    kind = np.dtype(f"<u{width}")

    def scan(batches):
        for batch in batches:
            first, last, ends = [], [], []
            for file, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size"))):
                system, path = _opened(file)
                with system.open_input_file(path) as source:
                    found = np.flatnonzero(np.frombuffer(source.read_at(size, at), kind) == separator) + at // width
                first.append(int(found[0]) if len(found) else None)
                last.append(int(found[-1]) if len(found) else None)
                ends.append(np.diff(found).astype("<i8") - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array([(a + s) // width for a, s in zip(batch.column("at").to_pylist(), batch.column("size").to_pylist())], pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array([e.tolist() for e in ends], pa.list_(pa.int64()))],
                ["file", "block", "upto", "first", "last", "inside"],
            )

    found = blocks(files, width, block_bytes).repartition("file", "block").mapInArrow(scan, "file string, block long, upto long, first long, last long, inside array<long>")
    so_far = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    here = F.when(F.col("first").isNull(), F.lit(0)).otherwise(F.size("inside") + 1)
    scanned = found.select(
        "file", "block", "first", "last", "inside", "upto",
        F.coalesce(F.sum(here).over(so_far), F.lit(0)).alias("before"), F.coalesce(F.max("last").over(so_far), F.lit(-1)).alias("open"),
        F.max("block").over(whole).alias("final"),
    )
    closed = scanned.where("first is not null").select("file", "before", F.posexplode(F.concat(F.array(F.col("first") - F.col("open") - 1), "inside")).alias("k", "n_tokens"))
    closed = closed.select("file", (F.col("before") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    end = F.coalesce("last", "open")
    rest = scanned.where((F.col("block") == F.col("final")) & (F.col("upto") - 1 > end)).select("file", (F.col("before") + here).alias("ordinal"), (F.col("upto") - 1 - end).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def counts_of_documents(rows: DataFrame, separator: int, ids: str = "token_ids", width: int = 2) -> DataFrame:
    """doc_id and n_tokens of every row, by writing its ids to flat files and scanning these."""
    told = write(rows, separator, ids, width)
    files = told.groupBy("file").agg(F.max("bytes").alias("bytes"))
    # a row a document on both sides; their sizes are underrated where arrays are exploded, and such a side would be broadcast
    counts = token_counts(files, separator, width).hint("merge")
    return told.select("file", "ordinal", "doc_id").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
