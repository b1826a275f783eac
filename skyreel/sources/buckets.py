"""A table whose rows lie in buckets by the hash of their key, so that a change rewrites only the buckets it touches.

A manifest names, for one version of the table, the folder each bucket lies in. An update reads the touched buckets, writes
them to folders of its own and then puts a new manifest in place, in which all other buckets keep their folders: readers see
the old version or the new one, whole. One writer a table. Versions beyond those kept are taken away, with the folders that only they named.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"
KEPT_VERSIONS = 3


@dataclass(frozen=True)
class Table:
    """Where a table lies and how its rows are dealt. ``buckets`` counts for a new table; an old one keeps its number."""

    root: str
    keys: tuple[str, ...]
    buckets: int = 64


class _Files:
    """The table's folder, by the file system it lies in."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.system = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        place = self.path(folder)
        return sorted(f.getPath().getName() for f in self.system.listStatus(place)) if self.system.exists(place) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """The file appears whole or not at all."""
        aside = f"aside-{uuid.uuid4().hex}"
        stream = self.system.create(self.path(aside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.system.mkdirs(self.path(name).getParent())
        if not self.system.rename(self.path(aside), self.path(name)):
            raise OSError(f"{self.root}/{name} could not be put in place")

    def remove(self, name: str) -> None:
        self.system.delete(self.path(name), True)


def _name(version: int) -> str:
    return f"{version:012d}"


def versions(spark: SparkSession, root: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in _Files(spark, root).names("manifests") if n.endswith(".json")]


def manifest(spark: SparkSession, root: str, before: int | None = None) -> dict | None:
    """The newest manifest, or the newest of a version below ``before``."""
    found = [v for v in versions(spark, root) if before is None or v < before]
    return json.loads(_Files(spark, root).read(f"manifests/{_name(found[-1])}.json")) if found else None


def _rows(spark: SparkSession, root: str, held: dict, only: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(held["schema"])
    places = [f"{root.rstrip('/')}/{place}" for bucket, place in held["places"].items() if only is None or int(bucket) in only]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The newest version's rows (of those below ``before``); None if there is none."""
    held = manifest(spark, root, before)
    return None if held is None else _rows(spark, root, held)


def bucket_of(keys: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_keys(wanted: DataFrame, table: Table) -> DataFrame | None:
    """The rows whose key is in ``wanted``, out of the buckets these keys lie in."""
    spark = wanted.sparkSession
    held = manifest(spark, table.root)
    if held is None:
        return None
    return _rows(spark, table.root, held, _touched(wanted, table.keys, held["buckets"])).join(wanted.select(*table.keys).distinct(), list(table.keys), "left_semi")


def _touched(rows: DataFrame, keys: tuple[str, ...], buckets: int) -> list[int]:
    """Numbers of buckets, so never more than there are."""
    return sorted(r[0] for r in rows.select(bucket_of(keys, buckets)).distinct().collect())


def update(
    changes: DataFrame, table: Table, merged: Callable[[DataFrame, DataFrame], DataFrame], number: int | None = None, kept: int = KEPT_VERSIONS
) -> int:
    """Put a new version in place, in which ``merged(held, changes)`` are the rows of the buckets that ``changes`` touch.

    ``held`` are those buckets' rows so far; ``merged`` has to return all of them that stay, and only rows of the same keys' buckets. With
    ``number`` the version is that of a step: a step that is run again finds its version and repeats nothing. Changes without rows
    leave the table as it is (and make an empty one). Returns the version.
    """
    spark, root = changes.sparkSession, table.root.rstrip("/")
    files, done = _Files(spark, root), versions(spark, root)
    version = number if number is not None else (done[-1] + 1 if done else 1)
    if version in done:
        return version
    before = manifest(spark, root, version) or {"buckets": table.buckets, "schema": None, "places": {}}
    changes = changes.persist()
    try:
        touched = _touched(changes, table.keys, before["buckets"])
        if not touched and before["schema"] is not None:
            return done[-1]
        schema = StructType.fromJson(before["schema"]) if before["schema"] else None
        held = _rows(spark, root, before, touched) if schema is not None else None
        rows = merged(held if held is not None else spark.createDataFrame([], merged(changes.limit(0), changes.limit(0)).schema), changes)
        schema = schema or rows.schema
        rows = rows.select(*schema.fieldNames(), bucket_of(table.keys, before["buckets"]).alias(BUCKET))
        folder = f"data/{_name(version)}"
        rows.repartition(max(len(touched), 1), BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{root}/{folder}")
    finally:
        changes.unpersist()
    written = {n.removeprefix(f"{BUCKET}=") for n in files.names(folder) if n.startswith(f"{BUCKET}=")}
    if not written <= {str(b) for b in touched}:
        raise ValueError("merged rows lie in buckets that no change touches")
    places = {b: p for b, p in before["places"].items() if int(b) not in touched} | {b: f"{folder}/{BUCKET}={b}" for b in written}
    files.put(f"manifests/{_name(version)}.json", json.dumps({"buckets": before["buckets"], "schema": schema.jsonValue(), "places": places}))
    expire(spark, root, kept)
    return version


def rebucketed(spark: SparkSession, table: Table, buckets: int, kept: int = KEPT_VERSIONS) -> int:
    """The table with another number of buckets, as a new version: for tables that have outgrown theirs."""
    root = table.root.rstrip("/")
    held = manifest(spark, root)
    if held is None:
        raise ValueError(f"{root} holds no table")
    files, version = _Files(spark, root), versions(spark, root)[-1] + 1
    folder = f"data/{_name(version)}"
    rows = _rows(spark, root, held).withColumn(BUCKET, bucket_of(table.keys, buckets))
    rows.repartition(buckets, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{root}/{folder}")
    places = {n.removeprefix(f"{BUCKET}="): f"{folder}/{n}" for n in files.names(folder) if n.startswith(f"{BUCKET}=")}
    files.put(f"manifests/{_name(version)}.json", json.dumps(held | {"buckets": buckets, "places": places}))
    expire(spark, root, kept)
    return version


def expire(spark: SparkSession, root: str, kept: int = KEPT_VERSIONS) -> None:
    """Take away all but the newest ``kept`` versions, and the buckets' folders that no version left names."""
    files, done = _Files(spark, root), versions(spark, root)
    stay = done[-max(kept, 1) :]
    for version in done[: len(done) - len(stay)]:
        files.remove(f"manifests/{_name(version)}.json")
    named = {p for v in stay for p in json.loads(files.read(f"manifests/{_name(v)}.json"))["places"].values()}
    for version in files.names("data"):
        if not stay or int(version) > stay[-1]:
            continue  # a step under way
        buckets = [b for b in files.names(f"data/{version}") if b.startswith(BUCKET)]
        gone = [b for b in buckets if f"data/{version}/{b}" not in named]
        if len(gone) == len(buckets):
            files.remove(f"data/{version}")
        else:
            for bucket in gone:
                files.remove(f"data/{version}/{bucket}")
