"""What the operators of this package share: session settings, crc folds, bounded samples."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, cut_lineage

__all__ = ["checkpointed", "fold", "prepared", "shared_folder", "table", "tidied", "unused", "written"]

BATCH_ROWS = 256
"""Rows of an Arrow batch that carries whole texts."""


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings these operators rely on; texts go to Python in small batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def fold(key: Column | str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % parts


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each lengthened until no column of a caller is called so."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def tidied(work):
    """A function over Arrow batches that leaves its worker without unused memory: workers live on from task to task."""

    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # of the GNU library only
            ctypes.CDLL(None).malloc_trim(0)

    return run


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written once in the cluster's shared checkpoint folder."""
    return cut_lineage(df)


def written(df: DataFrame) -> DataFrame:
    """The rows as a columnar table in the cluster's shared folder: smaller than a checkpoint, and readers take the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all hosts of the cluster share, as a URI."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        checkpointed(spark.range(1))
    place = context.getCheckpointDir().get()
    return place if "://" in place else f"file://{place.removeprefix('file:')}"
