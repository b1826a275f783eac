"""Object-store listings, and the tables other systems bring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import decode_metadata, decode_parts
from ..schemas import PACKET


def list_objects(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """``(key, size, last_modified)`` of every object below ``prefix``; contents are never read.

    Works for any file system Spark knows, ``s3a://`` included.
    """
    base = root.rstrip("/")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(f"{base}/{prefix}".rstrip("/"))
        .select("path", "length", "modificationTime")
    )
    return _as_listing(files, base)


def stream_objects(spark: SparkSession, root: str, files_per_trigger: int = 10_000) -> DataFrame:
    """The same listing as a stream: objects appear once each, as they arrive."""
    base = root.rstrip("/")
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(base)
        .select("path", "length", "modificationTime")
    )
    return _as_listing(files, base)


def _as_listing(files: DataFrame, base: str) -> DataFrame:
    bare = base.split("://", 1)[-1].split(":", 1)[-1].lstrip("/")
    key = F.element_at(F.split("path", f"\\Q{bare}/\\E", 2), 2)
    return files.select(
        key.alias("key"), F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("last_modified")
    )


def packet_table(spark: SparkSession, path: str) -> DataFrame:
    """Demultiplexed packets; filters on ``stream`` and ``stream_index`` reach the scan."""
    return spark.read.schema(PACKET).parquet(path)


def catalog_from_database(spark: SparkSession, url: str, table: str = "documents", **options: str) -> DataFrame:
    """The catalog out of a relational store over JDBC: JSON columns arrive as text and are decoded here."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return rows.withColumn("metadata", decode_metadata(F.col("metadata"))).withColumn("parts", decode_parts(F.col("parts")))
