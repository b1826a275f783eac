"""Structured Streaming runs over the tables, each brought to its end and held against its batch statement.

Every run reads its table as a file stream, with as many files per trigger as a cluster would want, keeps its
checkpoint in the session's shared folder, and leaves its result as a table of files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..session import shared_root
from ..streaming import queries as live
from . import catalog_queries, detection_queries, live_queries, metric_queries, shapes
from .registry import ORACLES, Tables, query
from .shapes import with_shapes

BEATS = with_shapes("beats")


def work_folder(t: Tables) -> str:
    return f"{shared_root(t.spark)}/stream-{uuid.uuid4().hex}"


FILES_PER_TRIGGER = 256


def is_folder(spark, path: str) -> bool:
    """Asked of the file system the path lies in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


class StreamedTables(Tables):
    """The same tables, read as streams: the shapes build on either."""

    def __getattr__(self, table: str) -> DataFrame:
        if table.startswith("_"):
            raise AttributeError(table)
        path = f"{self.folder}/{table}.parquet"
        # a table is one file or a folder of files; the glob names the files either way
        stream = self.spark.readStream.schema(self.spark.read.parquet(path).schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER)
        return stream.parquet(f"{path}/*" if is_folder(self.spark, path) else f"{self.folder}/{table}.parquet*")


def streamed(t: Tables) -> StreamedTables:
    return StreamedTables(t.spark, t.folder)


def finished(t: Tables, stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Run a stream over all there is and return what it emitted, with ``folder`` also in earlier runs that it goes on from.

    Rows leave in append mode, as the watermark passes them, and each micro-batch overwrites its own folder, so a batch
    that runs again repeats nothing. A last, empty batch lets what the final watermark has closed leave too.
    """
    folder = folder or work_folder(t)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run = (
        stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out/*")


END = "the end"
DAY_US = 86_400_000_000


def in_time(beats: DataFrame) -> DataFrame:
    return beats.withColumn("ts", F.col("ts").cast("timestamp"))


def to_the_end(t: Tables) -> tuple[DataFrame, str]:
    """The beats as a stream, and how late its rows may be: then comes one row of the stream ``END`` ten years later, in a file of its own
    that comes last and moves the watermark past everything, so that all windows and lives close. A table's files come in any
    order, so a replay of one allows rows to be as late as its first and last time lie apart; a live feed has the operators' own seconds."""
    folder = f"{work_folder(t)}/beats"
    beats = in_time(shapes.beats(t))
    beats.write.parquet(folder)
    span = beats.agg(F.min("ts").alias("first"), F.max("ts").alias("ts")).where("ts is not null").withColumn("seconds", F.unix_seconds("ts") - F.unix_seconds("first"))
    held = span.first()
    last = span.select(F.lit(END).alias("name"), (F.col("ts") + F.expr("interval 3650 days") + F.expr("make_dt_interval(0, 0, 0, seconds)")).alias("ts"))
    ahead = beats.limit(0).unionByName(last.withColumn("at_us", F.unix_micros("ts")), allowMissingColumns=True)
    ahead.coalesce(1).write.mode("append").parquet(folder)
    feed = t.spark.readStream.schema(beats.schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER).parquet(folder)
    return feed, f"{(held.seconds if held else 0) + 1} seconds"


def micros(column: str):
    return F.unix_micros(column)


@query("x08_beat_metrics_stream", ORACLES["x08_beat_metrics"])
def _(t):
    feed, late = to_the_end(t)
    totals = live.beat_metrics(feed, late=late, width="2 hours")
    done = finished(t, totals)
    return done.select(micros("window.start").alias("window_us"), "kind", "beats", "bytes")


@query("x10_debounce_stream", f"{ORACLES['x10_debounce'].replace('cast(burst as bigint) as burst, ', '')}")
def _(t):
    feed, late = to_the_end(t)
    bursts = live.debounced(feed, quiet="1 hour", late=late)
    done = finished(t, bursts)
    return done.select(
        "name", micros("session_window.start").alias("first_us"), micros("session_window.end").alias("fires_us"), "notifications"
    )


@query(
    "x02_live_sessions_stream",
    f"""{metric_queries.SESSIONS}
select name, min(at_us) as started_us, max(at_us) + {metric_queries.GRACE} as gone_us, count(*) as packets, cast(sum(bytes) as bigint) as bytes from s group by name, session""",
)
def _(t):
    feed, late = to_the_end(t)
    lives = live.live_sessions(feed, grace="6 hours", late=late)
    done = finished(t, lives)
    return done.select(
        "name", micros("session_window.start").alias("started_us"), (micros("session_window.end") - 1).alias("gone_us"), "packets", "bytes"
    )


@query("x04_detector_leases_stream", live_queries.LEASES)
def _(t):
    return finished(t, live.detector_leases(live_queries.lease_events(streamed(t)), live_queries.LEASE))


@query("x05_name_claims_stream", live_queries.CLAIMS)
def _(t):
    owner = F.concat(F.lit("pod-"), (F.col("k") % 3).cast("string"))
    attempts = shapes.beats(streamed(t)).select("name", "seq", "at_us", owner.alias("owner"))
    return finished(t, live.name_claims(attempts, 3 * live_queries.HOUR, 12 * live_queries.HOUR))


@query("x05_claims_over_registry_stream", live_queries.CLAIMS_OVER_REGISTRY)
def _(t):
    """Claims that start from what the registry holds, in order of time as the watermark passes them."""
    feed, late = to_the_end(t)
    done = live.name_claims(live_queries.claim_attempts(feed), 3 * live_queries.HOUR, 12 * live_queries.HOUR, live_queries.held_names(t), "ts", late, DAY_US)
    return finished(t, done).where(F.col("name") != END)


@query("x09_changed_only_stream", ORACLES["w15_changed_only"])
def _(t):
    rows = shapes.beats(streamed(t)).select("name", "seq", "at_us", F.col("kind").alias("watched"))
    return finished(t, live.changed_only(rows)).select("name", "seq", F.col("watched").alias("kind"))


@query(
    "x03_registry_table_stream",
    f"""{BEATS} select name, seq, at_us, kind from beats qualify row_number() over (partition by name order by at_us desc, seq desc) = 1 and kind <> 'error'""",
)
def _(t):
    folder = work_folder(t)
    beats = shapes.beats(streamed(t)).select("name", "seq", "at_us", "kind", (F.col("kind") == "error").alias("ended"))
    live.registry_table(beats, f"{folder}/table", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return live.current_registry(t.spark, f"{folder}/table").drop("ended")


@query(
    "x01_stream_lifecycle_stream",
    f"""{metric_queries.SESSIONS} select name, 'Live' as state, at_us // 1000 as at_ms from g where gap is null or (at_us // 1000 - (at_us - gap) // 1000) > {metric_queries.TIMEOUT // 1000}
union all select name, 'Interrupted', (at_us - gap) // 1000 + {metric_queries.TIMEOUT // 1000} from g where (at_us // 1000 - (at_us - gap) // 1000) > {metric_queries.TIMEOUT // 1000}
union all select name, 'Gone', (at_us - gap) // 1000 + {metric_queries.GRACE // 1000} from g where (at_us // 1000 - (at_us - gap) // 1000) > {metric_queries.GRACE // 1000}
union all select name, 'Interrupted', max(at_us) // 1000 + {metric_queries.TIMEOUT // 1000} from g group by name
union all select name, 'Gone', max(at_us) // 1000 + {metric_queries.GRACE // 1000} from g group by name""",
)
def _(t):
    feed, late = to_the_end(t)
    changes = live.stream_lifecycle(feed.select("name", "ts", "at_us"), late=late, timeout_ms=metric_queries.TIMEOUT // 1000, grace_ms=metric_queries.GRACE // 1000, slot_us=DAY_US)
    return finished(t, changes).where(F.col("name") != END)


@query("x01_feed_ended_stream", metric_queries.feed_ends(metric_queries.AS_OF_US + 1000 * DAY_US, 1000, "at_ms"))
def _(t):
    feed, late = to_the_end(t)
    rows = feed.select("name", "ts", "at_us", "seq", F.coalesce(F.col("kind") == "error", F.lit(False)).alias("ended"))
    changes = live.stream_lifecycle(rows, late=late, timeout_ms=metric_queries.TIMEOUT // 1000, grace_ms=metric_queries.GRACE // 1000, slot_us=DAY_US)
    return finished(t, changes).where(F.col("name") != END)


@query("x02_lives_stream", ORACLES["x02_live_sessions"].replace("cast(session as bigint) as session, ", ""))
def _(t):
    """Lives with their interruptions, as they end."""
    feed, late = to_the_end(t)
    lives = live.lives(feed.select("name", "ts", "at_us", "seq", "bytes"), late=late, timeout_us=metric_queries.TIMEOUT, grace_us=metric_queries.GRACE, slot_us=DAY_US)
    return finished(t, lives).where(F.col("name") != END)


ARRIVALS = 4
LATE_HOURS = 8


@query(
    "x12_late_rows_stream",
    f"""{BEATS}, s as (select name, seq, at_us - (k % 5) * {6 * live_queries.HOUR} as seen_us, at_us, min(at_us) over () as lo, max(at_us) over () as hi from beats),
  a as (select *, (at_us - lo) * {ARRIVALS} // (hi - lo + 1) as arrival from s), top as (select arrival, max(seen_us) as top from a group by arrival),
  w as (select a.*, (select max(top) // 1000 - {LATE_HOURS * 3_600_000} from top where top.arrival < a.arrival) as mark from a)
select name, seq, seen_us, coalesce(seen_us // 1000 < mark, false) as late from w""",
)
def _(t):
    """Rows that arrive in several files, a restart before each: late ones leave as such, none is lost."""
    folder = work_folder(t)
    beats = shapes.beats(t)
    rows = beats.select("name", "seq", "at_us", (F.col("at_us") - F.col("k") % 5 * (6 * live_queries.HOUR)).alias("seen_us"))
    ends = beats.agg(F.min("at_us").alias("lo"), F.max("at_us").alias("hi")).first()
    span = (ends.hi or 0) - (ends.lo or 0) + 1
    arrival = F.floor((F.col("at_us") - F.lit(ends.lo or 0)) * ARRIVALS / span)
    shaped = rows.select("name", "seq", F.col("seen_us").alias("at_us"), arrival.alias("arrival")).withColumn("ts", F.timestamp_micros("at_us"))
    schema = shaped.drop("arrival").schema
    for number in range(ARRIVALS):
        shaped.where(F.col("arrival") == number).drop("arrival").write.mode("append").parquet(f"{folder}/in")
        feed = t.spark.readStream.schema(schema).parquet(f"{folder}/in")
        run = live.split_late(live.with_lateness(feed, late=f"{LATE_HOURS} hours"), f"{folder}/out", f"{folder}/checkpoint")
        run.trigger(availableNow=True).start().awaitTermination()
    whole = StructType([*schema.fields, StructField("late", BooleanType())])
    found = t.spark.read.schema(whole).parquet(f"{folder}/out") if ends.hi is not None else t.spark.createDataFrame([], whole)
    return found.select("name", "seq", F.col("at_us").alias("seen_us"), "late")


@query("x11_track_objects_stream")
def _(t):
    """Tracks of a stream of boxes, in several files of whole frames with a restart before each; equal to ``k08_track_objects``."""
    folder = work_folder(t)
    frames, boxes = detection_queries.scene(t)
    rows = frames.join(boxes, ["stream", "seq"], "left")
    last = (frames.agg(F.max("seq")).first()[0] or 0) + 1
    part = F.floor(F.col("seq") * 3 / last)
    out = None
    for number in range(3):
        rows.where(part == number).write.mode("append").parquet(f"{folder}/in")
        tracks = live.track_objects(t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        out = finished(t, tracks, folder)
    return out


@query("s07_upsert_table", ORACLES["s07_upsert_documents"])
def _(t):
    """The catalog as a table of buckets, and two rounds of changes put into it."""
    from ..operators.catalog import upsert_documents
    from ..sources import buckets

    table = buckets.Table(work_folder(t), ("id",))
    documents = catalog_queries.flat(shapes.catalog(t))
    number = F.col("id").cast("long")
    put = lambda held, new: upsert_documents(new, held, "created_at")
    for changes in (documents, documents.where(number % 4 == 0).withColumn("size", F.col("size") + 1), documents.where(number % 8 == 0).withColumn("file_name", F.lit("renamed"))):
        buckets.update(changes, table, put)
    return buckets.read(t.spark, table.root)


@query("s11_analysis_queue_stream", "select doc_id, lang, n_chars from documents where n_chars > 0")
def _(t):
    """Work items handed out once, by files of a folder; what was handed out is kept as it was given."""
    folder = work_folder(t)
    t.documents.select("doc_id", "lang", "n_chars").write.json(f"{folder}/queue")
    schema = "doc_id long, lang string, n_chars long"

    def handle(batch: DataFrame, number: int) -> None:
        batch.where("n_chars > 0").write.mode("overwrite").parquet(f"{folder}/handed/batch={number}")

    for _again in range(2):  # a restart finds nothing left to hand out
        run = live.analysis_queue(t.spark, f"{folder}/queue", schema, handle, f"{folder}/checkpoint")
        run.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(schema).parquet(f"{folder}/handed/*")


@query(
    "s10_source_store",
    f"""{with_shapes("sources")} select name, coalesce(url, '') as url, enabled, 'b' as forward_ids, case when cust_no % 2 = 1 then cust_no % 90 * 1.0::double end as latitude from sources
  where cust_no % 10 <> 0""",
)
def _(t):
    """Configured sources written as a new version of the store and read back; broken lines go to quarantine."""
    from ..sources import stores

    c = F.col("cust_no")
    sensor = F.when(c % 2 == 1, F.struct((c % 90 * 1.0).cast("double").alias("latitude"), F.lit(1.0).alias("longitude")))
    forwards = F.array(F.struct(F.lit("b").alias("id"), F.lit("srt://out").alias("url"), F.lit(True).alias("enabled")))
    rows = shapes.sources(t).select(
        F.when(c % 10 != 0, F.col("name")).alias("name"), "url", "enabled", forwards.alias("forwards"), sensor.alias("static_sensor")
    )
    root = work_folder(t)
    stores.write_sources(rows, root)
    readable, _broken = stores.current_sources(t.spark, root)
    return readable.select(
        "name", F.coalesce("url", F.lit("")).alias("url"), "enabled",
        F.array_join(F.transform("forwards", lambda f: f["id"]), ",").alias("forward_ids"), F.col("static_sensor.latitude").alias("latitude"),
    )


@query("x13_ingest_documents_stream", "select distinct c_custkey // 100 as folder, 'application/json' as content_type, true as asked from customer")
def _(t):
    """Objects of a hundred customers each, found by the monitor, catalogued and handed on for analysis; a restart adds nothing."""
    from ..sources.snapshots import read_latest

    folder = work_folder(t)
    piece = F.floor(F.col("c_custkey") / 100).alias("piece")
    t.customer.select(piece, "c_custkey", "c_name").repartition("piece").write.partitionBy("piece").json(f"{folder}/objects")
    for _again in range(2):
        run = live.ingest_documents(t.spark, f"{folder}/objects", f"{folder}/catalog", f"{folder}/checkpoint", f"{folder}/requests")
        run.trigger(availableNow=True).start().awaitTermination()
    asked = t.spark.read.schema("id string").json(f"{folder}/requests").withColumn("asked", F.lit(True))
    rows = read_latest(t.spark, f"{folder}/catalog").join(asked, "id", "left")
    number = F.regexp_extract("storage_key", "piece=(\\d+)/", 1).cast("long")
    return rows.select(number.alias("folder"), "content_type", F.coalesce("asked", F.lit(False)).alias("asked"))
