"""Track layouts of streams and the wording of probed media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media
from .ordered import block, lane, numbered

ASSUMED_RATE = 60.0
MAX_RATE = 1_000.0
COMPARED = ["kind", "codec", "width", "height", "format", "sample_rate", "channels", "extradata", "role"]


def layout_description(tracks: DataFrame, slice_tracks: int = 512) -> DataFrame:
    """``codec WxH, codec, ...`` per stream in track order, put together from bounded slices.

    ``tracks(stream, index, kind, codec, width, height)``.
    """
    size = F.concat(F.lit(" "), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    text = F.when(F.col("kind") == "video", F.concat("codec", size)).otherwise(F.col("codec"))
    joined = lambda c, order: F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), c.alias("t")))), lambda e: e["t"]), ", "
    )
    slices = (
        tracks.withColumn("__slice", F.floor(F.col("index") / F.lit(slice_tracks)))
        .groupBy("stream", "__slice")
        .agg(joined(text, "index").alias("__text"))
    )
    return slices.groupBy("stream").agg(joined(F.col("__text"), "__slice").alias("layout"))


def declared_packet_rate(tracks: DataFrame, synthetic: Column) -> DataFrame:
    """Packets a second each stream's tracks declare, plus what is added to it.

    An audio track sends one packet per coded frame; others their average, else their declared frame rate;
    a rate that is absent or not believable counts as 60.
    """
    audio = (F.col("kind") == "audio") & (F.col("sample_rate") > 0) & (F.col("frame_size") > 0)
    ratio = lambda n, d: F.col(n).cast("double") / F.when(F.col(d) != 0, F.col(d))
    average, nominal = ratio("avg_num", "avg_den"), ratio("base_num", "base_den")
    rate = (
        F.when(audio, F.col("sample_rate") / F.when(F.col("frame_size") > 0, F.col("frame_size")))
        .when(average > 0, average)
        .when(nominal > 0, nominal)
    )
    believable = F.when((rate > 0) & (rate <= MAX_RATE), rate).otherwise(F.lit(ASSUMED_RATE))
    return tracks.groupBy("stream").agg((F.sum(believable) + synthetic).alias("packets_per_second"))


def track_roles(tracks: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Which track is the picture, which the telemetry, and the reference clock of each stream.

    ``tracks(stream, index, kind, codec, tb_num, tb_den)``, ``synthetic(stream, count, has_platform)``: tracks we
    would append, which happens only where the sender brings no telemetry of its own.
    """
    is_klv = (F.col("kind") == "data") & (F.col("codec") == "klv")
    facts = tracks.groupBy("stream").agg(
        F.count(F.lit(1)).alias("arrived"),
        F.min(F.when(F.col("kind") == "video", F.col("index"))).alias("video_index"),
        F.min(F.when(is_klv, F.col("index"))).alias("sender_klv"),
        F.min_by(F.struct("tb_num", "tb_den"), F.when(F.col("kind") == "video", F.col("index"))).alias("video_tb"),
        F.min_by(F.struct("tb_num", "tb_den"), "index").alias("first_tb"),
    )
    both = facts.join(synthetic, "stream", "full_outer").fillna(0, ["arrived", "count"])
    appended = F.when(F.col("sender_klv").isNull(), F.col("count")).otherwise(0)
    clock = F.coalesce("video_tb", "first_tb", F.struct(F.lit(1).alias("tb_num"), F.lit(90_000).alias("tb_den")))
    own = F.when((appended > 0) & F.col("has_platform"), F.col("arrived"))
    return both.select(
        "stream",
        F.coalesce("video_index", F.lit(-1)).cast("long").alias("video_index"),
        F.coalesce("sender_klv", own, F.lit(-1)).cast("long").alias("klv_index"),
        (F.col("sender_klv").isNull() & F.coalesce(own.isNotNull(), F.lit(False))).alias("klv_is_synthetic"),
        (F.col("arrived") + appended).cast("long").alias("tracks"),
        clock["tb_num"].alias("tb_num"),
        clock["tb_den"].alias("tb_den"),
    )


def layout_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two layouts of each stream have the same tracks, field by field, nulls equal to nulls."""
    fields = [c for c in COMPARED if c in a.columns]
    theirs = b.select(*[F.col(c).alias(f"b_{c}") for c in ["stream", "index", *fields]])
    both = a.join(theirs, (F.col("stream") == F.col("b_stream")) & (F.col("index") == F.col("b_index")), "full_outer")
    same = F.col("stream").isNotNull() & F.col("b_stream").isNotNull()
    for field in fields:
        same = same & F.col(field).eqNullSafe(F.col(f"b_{field}"))
    return both.groupBy(F.coalesce("stream", "b_stream").alias("stream")).agg(F.bool_and(same).alias("matches"))


def describe_media(containers: DataFrame, tracks: DataFrame) -> DataFrame:
    """What a probe found, worded: ``(doc_no, position, label, text)`` in reading order.

    ``containers(doc_no, container, seconds, bit_rate)``, ``tracks(doc_no, index, kind, codec, width, height, sar_num,
    sar_den, pixel_format, avg_num, avg_den, frames, channels, sample_rate, language, bit_rate)``.  Values that say
    nothing are left out.  Streams are numbered per kind from the second on.

    Either may have ``tags``, an array of ``struct(key, value)`` in the file's order: they follow what the probe itself says of the container or
    stream, with a ``place`` (0 for the probe's own) that orders them. A label that comes again keeps its first place and
    its last text.
    """
    tagged = "tags" in containers.columns or "tags" in tracks.columns
    tags = lambda of: F.col("tags") if "tags" in of.columns else F.array().cast("array<struct<key: string, value: string>>")
    whole = containers.select(
        "doc_no",
        _entries(
            F.lit(0),
            [
                (F.lit("Container"), F.col("container")),
                (F.lit("Duration"), F.when(F.col("seconds") > 0, media.fmt_duration(F.col("seconds")))),
                (F.lit("Overall bitrate"), F.when(F.col("bit_rate") > 0, media.fmt_bitrate(F.col("bit_rate")))),
            ],
            F.lit(""), tags(containers),
        ).alias("e"),
    )
    ordinal = numbered(tracks, lane(("doc_no", "kind"), "index", block("index", 4_096)), "__n")
    ordinal = _with_aspect(ordinal.withColumn("__label", media.stream_label(F.col("kind"), F.col("__n"))))
    named = lambda what: F.concat("__label", F.lit(f" {what}"))
    only = lambda kind, value: F.when(F.col("kind") == kind, value)
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    per_track = ordinal.select(
        "doc_no",
        _entries(
            F.col("index") + 1,
            [
                (named("codec"), F.col("codec")),
                (named("dimensions"), only("video", F.when(sized, media.fmt_dimensions(F.col("width"), F.col("height"))))),
                (named("aspect ratio"), F.col("__aspect")),
                (named("pixel format"), only("video", F.col("pixel_format"))),
                (named("frame rate"), only("video", media.fmt_frame_rate(F.col("avg_num"), F.col("avg_den")))),
                (named("frames"), only("video", F.when(F.col("frames") > 0, F.col("frames").cast("string")))),
                (named("channels"), only("audio", F.when(F.col("channels") > 0, F.col("channels").cast("string")))),
                (named("sample rate"), only("audio", F.when(F.col("sample_rate") > 0, media.fmt_sample_rate(F.col("sample_rate"))))),
                (named("language"), only("subtitle", F.col("language"))),
                (named("bitrate"), F.when(F.col("bit_rate") > 0, media.fmt_bitrate(F.col("bit_rate")))),
            ],
            F.concat("__label", F.lit(" ")), F.filter(tags(tracks), lambda t: F.lower(t["key"]) != "language"),
        ).alias("e"),
    )
    entries = whole.unionByName(per_track).select("doc_no", F.explode("e").alias("e"))
    worded = entries.select("doc_no", "e.position", "e.place", "e.label", media.meaningful(F.col("e.text")).alias("text")).where("text is not null")
    if not tagged:
        return worded.drop("place")
    order = F.struct("position", "place")
    last = worded.groupBy("doc_no", "label").agg(F.min(order).alias("o"), F.max_by("text", order).alias("text"))
    return last.select("doc_no", "o.position", "o.place", "label", "text")


TAGS_AT = 10
"""Where tags stand among the hundred positions of a container or stream."""


def _entries(base: Column, pairs: list[tuple[Column, Column]], prefix: Column, tags: Column) -> Column:
    entry = lambda n, place, label, text: F.struct((base * 100 + n).cast("long").alias("position"), place.cast("int").alias("place"), label.alias("label"), text.cast("string").alias("text"))
    own = F.array(*[entry(n, F.lit(0), label, value) for n, (label, value) in enumerate(pairs)])
    keyed = F.filter(tags, lambda t: F.length(t["key"]) > 0)
    told = F.transform(keyed, lambda t, n: entry(TAGS_AT, n + 1, F.concat(prefix, media.capitalise(F.replace(t["key"], F.lit("_"), F.lit(" ")))), t["value"]))
    return F.concat(own, F.coalesce(told, F.array().cast("array<struct<position: bigint, place: int, label: string, text: string>>")))


def _with_aspect(tracks: DataFrame) -> DataFrame:
    """Adds the display aspect, worked out once for each different shape: of these there are few."""
    sides = ["width", "height", "sar_num", "sar_den"]
    shaped = (F.col("kind") == "video") & (F.col("width") > 0) & (F.col("height") > 0) & (F.col("sar_num") > 0) & (F.col("sar_den") > 0)
    wide, high = F.col("width").cast("long") * F.col("sar_num"), F.col("height").cast("long") * F.col("sar_den")
    reduced = F.transform(F.array(_gcd(wide, high)), lambda g: media.fmt_aspect(F.floor(wide / g), F.floor(high / g)))
    shapes = tracks.where(shaped).select(*sides).distinct().select(*sides, reduced[0].alias("__aspect"))
    keyed = tracks.withColumns({f"__{c}": F.when(shaped, F.col(c)) for c in sides})
    return keyed.join(shapes.withColumnsRenamed({c: f"__{c}" for c in sides}), [f"__{c}" for c in sides], "left")


def _gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's rule, in as many rounds as the smaller number can need: five per digit."""
    rounds = F.length(F.least(a, b).cast("string")) * 5
    step = lambda acc, _: F.when(acc["b"] == 0, acc).otherwise(
        F.struct(acc["b"].alias("a"), (acc["a"] % F.when(acc["b"] != 0, acc["b"])).alias("b"))
    )
    begin = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), rounds), begin, step)["a"]
