"""Tables kept as numbered versions in a shared folder; a reader takes the newest finished one.

One writer per table.  A version counts once Spark's commit has left its ``_SUCCESS`` marker, so a job that
dies halfway leaves something nobody reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import buckets

KEPT_VERSIONS = 3


def _finished(spark: SparkSession, root: str) -> list[str]:
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [entry.getPath().getName() for entry in files.listStatus(folder) if entry.isDirectory()]
    done = lambda n: files.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))
    return sorted(n for n in names if n.startswith("v-") and done(n))


def latest_version(spark: SparkSession, root: str) -> str | None:
    versions = _finished(spark, root)
    return f"{root}/{versions[-1]}" if versions else None


def read_latest(spark: SparkSession, root: str, format: str = "parquet") -> DataFrame | None:
    """The newest version's rows, of a table kept whole or in buckets; None if there is none."""
    path = latest_version(spark, root)
    if path is None:
        return buckets.read(spark, root)
    return spark.read.format(format).load(path)


def write_version(df: DataFrame, root: str, format: str = "parquet", number: int | None = None, kept: int = KEPT_VERSIONS) -> str:
    """Write ``df`` as the next version; with ``number`` a repeated write of the same step replaces itself.

    For tables that are small or change as a whole (``buckets`` rewrites what changed). All but the newest ``kept`` versions go.
    """
    versions = _finished(df.sparkSession, root)
    step = number if number is not None else (int(versions[-1][2:]) + 1 if versions else 1)
    path = f"{root}/v-{step:012d}"
    df.write.format(format).mode("overwrite").save(path)
    for old in _finished(df.sparkSession, root)[: -max(kept, 1)]:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{root}/{old}")
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
    return path
