"""Registry and source-configuration stores kept as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import SOURCE
from .snapshots import latest_version, write_version

CORRUPT = "_corrupt"


def read_registry(stored: DataFrame, column: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Entries that parse, spread into columns in name order, and the rows that do not."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    wide = StructType([*schema.fields]).add(CORRUPT, "string")
    parsed = stored.withColumn("__e", F.from_json(column, wide, options))
    entry = F.col("__e")
    broken = entry.isNull() | entry.getField(CORRUPT).isNotNull() | entry.getField("name").isNull()
    others = [c for c in stored.columns if c != column]
    fields = [F.col(f"__e.{f.name}").alias(f.name) for f in schema.fields]
    return parsed.where(~broken).select(*others, *fields).orderBy("name"), parsed.where(broken).select(*stored.columns)


def read_sources(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Configured sources, one JSON object a line, and the unreadable lines for quarantine."""
    lines = spark.read.text(path)
    readable, broken = read_registry(lines, "value", SOURCE)
    return readable, broken


def write_sources(sources: DataFrame, root: str) -> str:
    """Replace the configured list; readers see the old version until the new one is whole."""
    return write_version(sources, root, "json")


def current_sources(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The newest whole list; a store nothing was written to yet is empty."""
    path = latest_version(spark, root)
    if path is None:
        empty = spark.createDataFrame([], SOURCE)
        return empty, spark.createDataFrame([], "value string")
    return read_sources(spark, path)
